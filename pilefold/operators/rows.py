"""Order, dedupe, batches, sampling, resume."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .order import ranked
from .sweep import window_counts


def in_batches(candidates: DataFrame, n: int = 100, order: tuple[str, ...] = ("pos", "chrom")) -> DataFrame:
    """candidates with batch_id 0 .. n - 1 by position, the first `rows mod n` batches one row longer.

    The rank over everything comes from a range sort that is saved, so a lost executor changes no batch.
    """
    rows = ranked(candidates, list(order), "_rank")
    total = candidates.count()
    long, q = total % n, total // n
    cut = long * (q + 1)
    rank = F.col("_rank")
    batch = F.when(rank < cut, F.floor(rank / (q + 1))).otherwise(F.lit(long) + F.floor((rank - cut) / max(q, 1)))
    return rows.withColumn("batch_id", batch.cast("int")).drop("_rank")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_i = 1").drop("_i")


def dedupe_predictions(predictions: DataFrame) -> DataFrame:
    """(batch_id, chrom, pos, pred_true, idx): the first row of a site in each batch."""
    return first_by(predictions, ["batch_id", "chrom", "pos"], ["idx"])


def dedupe_reads(reads: DataFrame, site: tuple[str, ...] = ("chrom", "pos", "sample")) -> DataFrame:
    """The first usable record of a name at each site and sample, in file order."""
    return first_by(reads, [*site, "query_name"], ["file_order"])


def marked_reads(reads: DataFrame, site: list[str]) -> DataFrame:
    """dedupe_reads over rows with `_use` (usable) and `_count` (counts for the bases): `_use` is left to the first usable record of a name, and of the others those that count stay."""
    nth = F.row_number().over(W.partitionBy(*site, "_use", "query_name").orderBy("file_order"))
    return reads.withColumn("_use", F.col("_use") & (nth == 1)).filter(F.coalesce(F.col("_use") | F.col("_count"), F.lit(True)))


def _ranked(reads: DataFrame, site: list[str], least: int | None) -> DataFrame:
    """reads with `_i`, their rank at a site in file order, and `_n`, the site's number of reads. least: both of marked_reads() to be used, and in `_f`, on one row of a
    site, window_counts() of all. Spark takes rows that were in Python to be anywhere, so all that needs them together comes before, in one sort.
    """
    w = W.partitionBy(*site)
    order = w.orderBy("file_order")
    if least is None:
        return reads.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(w))
    use = F.coalesce("_use", F.lit(False))
    past = F.sum(use.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    out = reads.withColumns({"_i": past - 1, "_last": F.lead(F.lit(1)).over(order).isNull()}).withColumns({"_n": F.sum(use.cast("int")).over(w), "_use": use})
    return out.withColumn("_f", window_counts(least)("_last", "_count", "w_start", "w_end", "ref_start", "cigar", "seq", "quals")).drop("_last")


def not_done(candidates: DataFrame, done: DataFrame) -> DataFrame:
    """Resume: candidates that have no output yet."""
    return candidates.join(done.select("chrom", "pos"), ["chrom", "pos"], "left_anti")


def missing(candidates: DataFrame, predictions: DataFrame) -> int:
    """How many candidate rows the predictions fall short of."""
    return max(0, candidates.count() - predictions.count())


def stacked(reads: DataFrame, site: list[str], limit: int) -> DataFrame:
    """Image rows: the rank of a read in file order, up to the limit."""
    return reads.withColumn("row", F.row_number().over(W.partitionBy(*site).orderBy("file_order")) - 1).filter(F.col("row") < limit)


def tetris(cells: DataFrame, site: list[str]) -> DataFrame:
    """Each base falls to the next free row of its column."""
    return cells.withColumn("row", F.row_number().over(W.partitionBy(*site, "col").orderBy("file_order")) - 1)


def reaching(reads: DataFrame, site: list[str], limit: int, least: int | None = None) -> DataFrame:
    """Reads that have a base among the first `limit` of some column of the window (w_start, w_end), in file order: all that can show where
    bases fall. Sites with no more reads than that are left as they are; what is left of another is at most `limit` reads a column.
    least: of marked_reads(), with the counts of all in `_f`; the row that has them stays too.

    A site's reads come in file order from the window, and what is kept meanwhile is a count a column; no read is moved or repeated for it.
    """

    @F.pandas_udf("boolean")
    def shows(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        depth, last = np.zeros(0, "i8"), -1
        for some in parts:
            deep = np.nonzero((some[1] > limit).to_numpy() & some[5].to_numpy())[0]
            out = np.ones(len(some[0]), bool)
            for k, i, a, b, width in zip(deep.tolist(), *(some[c].to_numpy()[deep].tolist() for c in (0, 2, 3, 4))):
                if i == 0:
                    depth, last = np.zeros(width, "i8"), -1
                if i != last + 1:
                    raise RuntimeError("reads are not in file order")
                here, last = depth[a : max(a, b)], i
                out[k] = (here < limit).any()
                here += 1
            yield pd.Series(out)

    counted = _ranked(reads, site, least)
    use = F.lit(True) if least is None else F.col("_use")
    low, high = F.greatest("ref_start", "w_start") - F.col("w_start"), F.least("ref_end", "w_end") - F.col("w_start")
    known = [F.coalesce(c, F.lit(0)).cast("int") for c in (low, high)]
    left = shows("_i", "_n", *known, (F.col("w_end") - F.col("w_start")).cast("int"), use)
    return counted.filter(left if least is None else left & use | F.col("_f").isNotNull()).drop("_i", "_n")


def sample_indices(n: int, k: int, seed: int) -> list[int]:
    """Sorted indices of a seeded draw of k of n; all where n <= k."""
    return list(range(n)) if n <= k else sorted(random.Random(seed).sample(range(n), k))


@F.pandas_udf(ArrayType(IntegerType()))
def _drawn(n: pd.Series, k: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series([sample_indices(int(a), int(b), int(c)) for a, b, c in zip(n, k, seed)])


def sample_reads(reads: DataFrame, site: list[str], k: int, seed: int = 1) -> DataFrame:
    """At most k reads of a site in file order: which ones depends on (number of reads, k, seed) alone, so each number is drawn for once."""
    numbers = reads.groupBy(*site).agg(F.count("*").alias("_n")).select("_n").distinct()
    drawn = numbers.select("_n", F.explode(_drawn("_n", F.lit(k), F.lit(seed))).alias("_i"))
    w = W.partitionBy(*site)
    numbered = reads.withColumn("_i", F.row_number().over(w.orderBy("file_order")) - 1).withColumn("_n", F.count("*").over(w))
    return numbered.join(drawn, ["_n", "_i"], "left_semi").select(reads.columns)


@lru_cache(maxsize=10_000)
def _takers(n: int, k: int, replicates: int, seed: int) -> list[list[int]]:
    """For each of n reads, the draws of k that take it."""
    out: list[list[int]] = [[] for _ in range(n)]
    for r in range(replicates):
        for i in sample_indices(n, k, seed + r):
            out[i].append(r)
    return out


def sample_replicates(reads: DataFrame, site: list[str], k: int, replicates: int, seed: int = 1, least: int | None = None) -> DataFrame:
    """sample_reads for the seeds from `seed` on, one for each replicate, numbered in `replicate`: a read has a row for each draw that takes it. Which ones do follows from a read's rank and its site's size, so no read is moved for it.

    least: of marked_reads(), with the counts of all in `_f`; the row that has them has a row for each draw, and `_use` tells which take it.
    """

    @F.pandas_udf(ArrayType(IntegerType()))
    def taken(n: pd.Series, i: pd.Series) -> pd.Series:
        every = list(range(replicates))
        return pd.Series([every if a <= k else _takers(a, k, replicates, seed)[b] for a, b in zip(n.tolist(), i.tolist())])

    numbered = _ranked(reads, site, least)
    if least is None:
        return numbered.withColumn("replicate", F.explode(taken("_n", "_i"))).select(*reads.columns, "replicate")
    every, none = F.array(*map(F.lit, range(replicates))), F.array().cast("array<int>")
    out = numbered.withColumn("_by", F.when(F.col("_use"), taken("_n", "_i")).otherwise(none))
    out = out.withColumn("replicate", F.explode(F.when(F.col("_f").isNotNull(), every).otherwise(F.col("_by"))))
    return out.withColumn("_use", F.array_contains("_by", F.col("replicate"))).drop("_i", "_n", "_by")


def subsample(reads: DataFrame, site: list[str], k: int, replicates: int, seed: int = 0) -> DataFrame:
    """`replicates` independent draws of k reads a site, numbered."""
    rep = reads.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    key = F.xxhash64(F.lit(seed), "replicate", "file_order")
    return rep.withColumn("_i", F.row_number().over(W.partitionBy(*site, "replicate").orderBy(key, "file_order"))).filter(F.col("_i") <= k).drop("_i")


def sharded(df: DataFrame, key: str, shards: int) -> DataFrame:
    """df with `shard`: distinct keys in order, in n equal runs; the first `keys mod n` runs have one key more."""
    keys = in_batches(df.select(key).distinct(), shards, (key,)).withColumnRenamed("batch_id", "shard")
    return df.join(keys, key)


def shard_rows(df: DataFrame, key: str, shards: int, shard: int) -> DataFrame:
    """The rows of one shard."""
    return sharded(df, key, shards).filter(F.col("shard") == shard).drop("shard")
