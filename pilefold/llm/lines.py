"""Line dedup: levelled sorted runs of line hashes [native].

A *run* is a table of (h1, h2, n): the two 64-bit hashes of a line key and the number of documents it
was counted in, bucketed by the hashes and sorted inside each bucket, so runs meet in merge joins that
need no exchange. Each new batch of documents

1. counts its own keys (a document counts once for each key),
2. merge-anti-joins the keys that the runs already hold as saturated (at least `min_docs` documents:
   nothing more need be known of those), and
3. adds what is left as a run of its own at level 0.

A level that has `fanout` runs is merged into one run of the next level; that is also where the counts
of a key from several batches meet. So a common line, even one that a third of all documents hold, is
one row in a run and stops being recorded once it is saturated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, forget, remove, saved, scratch


def split_lines(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7919), key).alias("h2")]


class LineRuns:
    """The levels of runs of one corpus. Tables are kept in the shared folder; a run that is merged, and all at close(), go from the catalogue and from there."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, fanout: int = 3, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, counts: DataFrame, level: int, dealt: bool = False) -> None:
        """dealt: counts come in their buckets already."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch(self.spark, name)
        (
            (counts if dealt else counts.repartition(self.buckets, "h1", "h2"))
            .write.option("path", self.paths[name])
            .bucketBy(self.buckets, "h1", "h2")
            .sortBy("h1", "h2")
            .saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.paths.pop(name))

    def _merged(self, names: list[str]) -> DataFrame:
        """The sum of some runs. Their files are read as plain Parquet: a union of bucketed tables would claim a partitioning that it hasn't."""
        files = self.spark.read.schema("h1 long, h2 long, n long").parquet(*[self.paths[name] for name in names])
        return files.repartition(self.buckets, "h1", "h2").groupBy("h1", "h2").agg(F.sum("n").alias("n"))  # one exchange, for the sum and the buckets

    @property
    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, counts: DataFrame) -> None:
        """Takes a batch's (h1, h2, n) in: merge-anti-join of the saturated keys of each run, one run more, compaction."""
        for name in self.runs:
            known = self.spark.table(name).filter(F.col("n") >= self.min_docs).select("h1", "h2")
            counts = counts.join(known, ["h1", "h2"], "left_anti")
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full = self.levels[level]
            self._write(self._merged(full), level + 1, dealt=True)
            self.levels[level] = []
            self._drop(full)
            level += 1

    def saturated(self) -> DataFrame:
        """(h1, h2) of the keys found in at least min_docs documents over all batches."""
        return self._merged(self.runs).filter(F.col("n") >= self.min_docs).select("h1", "h2")

    def close(self) -> None:
        self._drop(self.runs)


def key_counts(docs: DataFrame, *by: str) -> DataFrame:
    """Documents that hold each line key of at least one code point, as (*by, h1, h2, n)."""
    keys = F.array_distinct(F.filter(F.transform(split_lines(F.col("text")), line_key), lambda k: F.length(k) > 0))
    return docs.select(*by, F.explode(keys).alias("key")).select(*by, *_hashed(F.col("key"))).groupBy(*by, "h1", "h2").agg(F.count("*").alias("n"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, batches: int = 6, fanout: int = 3) -> DataFrame:
    """docs plus n_lines, n_dropped and kept_text: every line whose key at least min_docs documents hold is gone.

    Keys are lines without blanks at either end, A-Z lower-cased; empty keys stay. Null and empty texts
    are one empty line, kept as "". Rows are told apart by doc_id (null is one too) and text, so repeated
    ids are safe (each row counts as a document); an empty table gives an empty result. Other columns pass
    through, whatever their names, but for input columns of the three names, which the new ones replace.
    The table of saturated keys is joined, not broadcast by force: Spark broadcasts it only below its
    size threshold and otherwise splits hot keys of the sort-merge join.
    """
    spark = docs.sparkSession
    staged = saved(
        key_counts(docs.select("text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("_batch")), "_batch"),
        "line-counts",
        by="_batch",
    )
    runs = LineRuns(spark, min_docs, fanout)
    for b in range(batches):
        runs.add(staged.filter(F.col("_batch") == b).select("h1", "h2", "n"))
    hot = saved(runs.saturated(), "hot-lines")
    runs.close()
    forget(staged)

    row = [F.xxhash64("doc_id", "text").alias("_r1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("_r2")]
    texts = docs.select(*row, "text")  # hashed here: in one select with the explode, the whole text would be hashed for each of its lines
    lines = texts.select("_r1", "_r2", F.posexplode(F.transform(split_lines(F.col("text")), line_key)).alias("_pos", "_key")).filter(F.length("_key") > 0)
    gone = (
        lines.select("_r1", "_r2", "_pos", *_hashed(F.col("_key")))
        .join(hot, ["h1", "h2"], "left_semi")
        .groupBy("_r1", "_r2")
        .agg(F.sort_array(F.collect_set("_pos")).alias("_at"))
    )
    # a flag for each line up to the last dropped one, from the gaps between dropped lines: looked up by place, so a text takes time in proportion to its lines
    gap = lambda p, k: p - F.when(k > 0, F.get("_at", k - 1)).otherwise(-1) - 1
    flags = F.flatten(F.transform("_at", lambda p, k: F.concat(F.array_repeat(F.lit(False), gap(p, k)), F.array(F.lit(True)))))
    gone = gone.select("_r1", "_r2", F.size("_at").cast("long").alias("_n"), flags.alias("_gone"))
    out = docs.select(F.struct("*").alias("_row"), *row).join(gone, ["_r1", "_r2"], "left")
    text = split_lines(F.col("_row.text"))
    kept = F.when(F.col("_gone").isNull(), text).otherwise(F.filter(text, lambda x, i: ~F.coalesce(F.get("_gone", i), F.lit(False))))
    out = out.select(
        "_row",
        F.size(text).cast("long").alias("n_lines"),
        F.coalesce("_n", F.lit(0).cast("long")).alias("n_dropped"),
        F.array_join(kept, "\n").alias("kept_text"),
    )
    own = out.columns[1:]
    return out.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in own], *own)
