"""Reads decoded once and kept as Parquet, in a folder for each sample and contig, in order of position.

Files of a folder are written by the splits of the alignment file, which are in order already, so nothing
is shuffled; Parquet's statistics of ref_start and ref_end then let a region skip files and row groups, and
a sample or contig skips folders.
"""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession

from ..schema import READS
from . import bam

#: Windows around a candidate, and the probes before it, reach no further than this.
MARGIN = 128


def done(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written to its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _identity(path: str) -> list:
    if "://" in path:
        return [path]
    s = os.stat(path)
    return [os.path.abspath(path), s.st_size, s.st_mtime_ns]


def stored_reads(spark: SparkSession, normal: str, tumor: str, folder: str, regions: DataFrame | None = None) -> DataFrame:
    """Reads of both files; `regions` (chrom, start, end exclusive), a list of targets, limits them to reads within MARGIN of one.

    The first call for the same files and regions decodes them into folder/reads-<digest>; later ones, and later stages, read that.
    """
    spans = None
    if regions is not None:
        spans = sorted([r["chrom"], max(r["start"] - MARGIN, 0), r["end"] + MARGIN] for r in regions.select("chrom", "start", "end").toLocalIterator())
    asked = json.dumps([_identity(normal), _identity(tumor), spans])
    path = f"{folder}/reads-{hashlib.md5(asked.encode()).hexdigest()[:16]}"
    if not done(spark, path):
        bam.register(spark)

        def one(source: str, sample: str) -> DataFrame:
            reader = spark.read.format("bam").option("sample", sample)
            return (reader if spans is None else reader.option("regions", json.dumps(spans))).load(source)

        both = one(normal, "N").unionByName(one(tumor, "T"))
        both.sortWithinPartitions("sample", "chrom", "ref_start", "file_order").write.mode("overwrite").partitionBy("sample", "chrom").parquet(path)
    return read_store(spark, path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    names = [f.split()[0] for f in READS.split(", ")]
    return spark.read.schema(READS).parquet(path).select(*names)
