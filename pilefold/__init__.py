"""Spark-native analysis of paired tumor/normal sequence alignments."""

VERSION = "0.2"
