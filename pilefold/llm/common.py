"""What the corpus operators share: the scratch folder, saved tables, text primitives."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters of the word and line rules.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (spark.checkpoint.dir); where that is unset, as in tests, a local one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="pilefold-")
        base = _own[app]
    return f"{base.rstrip('/')}/pilefold/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder, in a folder for each value of `by`, and read again: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that saved() made and that no later step reads."""
    files = df.inputFiles()
    if files:
        where = files[0].rpartition("/")[0]
        remove(df.sparkSession, where.rpartition("/")[0] if "=" in where.rpartition("/")[2] else where)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free(name: str, taken: list[str]) -> str:
    """`name`, with as many _ after it as it takes to be none of `taken` (Spark's names have no case)."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def sampled(df: DataFrame, rows: int, seed: int, *by: str) -> DataFrame:
    """About `rows` rows (all, if no more), those whose hash of `by` falls under a share of the table: no sort, and nothing is moved."""
    total = df.count()
    if total <= rows:
        return df
    share = F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.filter(share < rows / total)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words as runs of characters other than the six blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n).cast("long"))


def slices(parts: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces, so that a worker holds the Python strings of few texts at a time; memory goes back to the system in between."""
    for batch in parts:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        pa.default_memory_pool().release_unused()
