"""FASTA files with an index (.fai): contigs from the index, and only the blocks that are asked for from the file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import REFERENCE
from .bam import open_file

FAI = "chrom string, length long, first long, per_line long, line long"


class IndexedFasta:
    """A reference whose blocks of `block` bases are read when asked for.

    An entry of the index says where a contig's bases begin, how many a line has and how many bytes a line
    takes, so a block is one range of bytes: base p is at first + p // per_line * line + p % per_line.
    """

    def __init__(self, spark: SparkSession, path: str, block: int = 65536, index: str | None = None):
        self.path, self.block = path, block
        self.index = spark.read.schema(FAI).csv(index or f"{path}.fai", sep="\t")

    @property
    def contigs(self) -> DataFrame:
        return self.index.select("chrom", "length")

    def blocks(self, wanted: DataFrame) -> DataFrame:
        """(chrom, block_start, seq) of the distinct blocks wanted (chrom, b) that the contigs have; b counts from 0. Blocks are dealt over the cluster, and a task reads its own, in order."""
        path, block = self.path, self.block

        def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with open_file(path) as file:
                for pdf in parts:
                    seqs = []
                    for low, length, first, per_line, line in zip(pdf["b"] * block, pdf["length"], pdf["first"], pdf["per_line"], pdf["line"]):
                        high = min(low + block, length) - 1
                        at = lambda p: first + p // per_line * line + p % per_line  # noqa: B023, E731
                        file.seek(at(low))
                        seqs.append(file.read(at(high) + 1 - at(low)).translate(None, b"\r\n").decode())
                    yield pd.DataFrame({"chrom": pdf["chrom"], "block_start": pdf["b"] * block, "seq": seqs})

        known = wanted.select("chrom", F.col("b").cast("long").alias("b")).distinct().join(self.index, "chrom").filter((F.col("b") >= 0) & (F.col("b") * block < F.col("length")))
        return known.sortWithinPartitions("chrom", "b").mapInPandas(read, REFERENCE)
