"""Ranks, running sums and neighbours in one order over all rows, without one task for all of them.

Rows are sorted over the cluster by ranges of the order and saved; what goes over the borders of the
ranges is one row a range, so the windows without a key see only those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import saved


def by_ranges(df: DataFrame, order: list) -> DataFrame:
    """df sorted and saved, with its range (_part) and its place (_id, rising with the order)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return saved(run.withColumn("_part", F.shiftright("_id", 33)), "ordered")


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with each row's rank in the order, from 0."""
    run = by_ranges(df, order)
    sizes = run.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return run.join(before, "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_id", "_before")


def running_sums(df: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its column over the rows up to and with this one."""
    run = by_ranges(df.withColumns({f"_v{i}": c for i, c in enumerate(sums.values())}), order)
    parts = run.groupBy("_part").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))])
    whole, inside = W.orderBy("_part"), W.partitionBy("_part").orderBy("_id")
    before = parts.select("_part", *[(F.sum(f"_t{i}").over(whole) - F.col(f"_t{i}")).alias(f"_b{i}") for i in range(len(sums))])
    out = run.withColumns({f"_s{i}": F.sum(f"_v{i}").over(inside) for i in range(len(sums))}).join(before, "_part")
    return out.withColumns({n: F.col(f"_s{i}") + F.col(f"_b{i}") for i, n in enumerate(sums)}).select(*df.columns, *sums)


def with_neighbours(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """df with `before` and `after`: the value of the row before and after it in the order of (key, value), null where that has another key."""
    here = F.struct(*key, value)
    run = by_ranges(df, [*key, value])
    ends = run.groupBy("_part").agg(F.min(here).alias("_first"), F.max(here).alias("_last"))
    ends = ends.select("_part", F.lag("_last").over(W.orderBy("_part")).alias("_left"), F.lead("_first").over(W.orderBy("_part")).alias("_right"))
    w = W.partitionBy("_part").orderBy("_id")
    out = run.withColumns({"_l": F.lag(here).over(w), "_r": F.lead(here).over(w)}).join(ends, "_part")
    same = lambda s: F.when(F.struct(*[s.getField(k) for k in key]) == F.struct(*key), s.getField(value))
    return out.select(*df.columns, same(F.coalesce("_l", "_left")).alias("before"), same(F.coalesce("_r", "_right")).alias("after"))
