"""Coverage of alignments that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pileup import aligned_bases, coverage, passes_check
from ..schema import READS


def streaming_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Per-site base counts over every Parquet file that lands in a folder (reads schema); update mode."""
    reads = spark.readStream.schema(READS).parquet(folder)
    return coverage(aligned_bases(reads.filter(passes_check(F.col("flag"), F.col("mapq")))))


def start(coverage_stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's updated sites as Parquet."""
    return coverage_stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(path)).start()
