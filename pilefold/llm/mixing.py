"""Mixing sources to target weights [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved, word_count


def draw(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the parts alone: the first 52 bits of an md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, limit: int = 3) -> DataFrame:
    """(source, size) of documents -> (source, source_size, target), one row a source.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share all sizes; a target stops at
    `limit` times its source's size and the excess is shared again by weight. That settles at
    min(limit * size, level * weight) with one level for all: sources are taken in order of
    limit * size / weight, and the level is what is left over for the weight that is left over at the
    first source it doesn't fill. The windows see one row a source, after partial aggregation.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("w", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    per = per.withColumn("cap", F.col("source_size") * limit)
    order = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    per = per.withColumns({
        "words": F.sum("source_size").over(everything),
        "left_w": F.sum("w").over(everything) - F.sum("w").over(order) + F.col("w"),
        "filled": F.sum("cap").over(order) - F.col("cap"),
    })
    per = per.withColumn("level", (F.col("words") - F.col("filled")).cast("double") / F.col("left_w").cast("double"))
    fits = F.when(F.col("level") <= F.col("cap").cast("double") / F.col("w").cast("double"), F.struct(F.row_number().over(order).alias("i"), "level"))
    per = per.withColumn("fits", fits).withColumn("level", F.min("fits").over(everything)["level"])
    even = F.col("level") * F.col("w")
    target = F.coalesce(F.least(F.col("cap").cast("double"), even), F.col("cap").cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size), saved: the one pass that counts words."""
    return saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")


def _copies(seed: int) -> Column:
    """How often a document is taken at its source's target: floor(rate) times, and once more if a number seeded by its id falls under the fraction."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (F.floor(rate) + F.when(draw(seed, F.col("doc_id")) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _with_targets(rows: DataFrame, sized: DataFrame, limit: int) -> DataFrame:
    """rows (source, ...) with their source's size and target. One row a source is joined back: a source with a third of all rows is only a hot probe key there, which adaptive execution splits or a size-checked broadcast avoids."""
    per = source_targets(sized, limit).withColumnRenamed("source", "_of")
    return rows.join(per, rows["source"].eqNullSafe(per["_of"])).drop("_of")


def mix(docs: DataFrame, seed: int = 17, limit: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row: the plan of the mix.

    Only doc_id, text and source are read, so other columns may have any name. Null texts have size 0; a
    source without words has rate 0; null is a source of its own. Repeated ids draw alike, and so do all
    null ids, as the empty text. An empty table gives an empty result.
    """
    sized = _sized(docs)
    return _with_targets(sized, sized, limit).withColumn("copies", _copies(seed)).select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, seed: int = 17, limit: int = 3) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, in the columns of docs, whatever their names. Words are counted once; nulls, ties and empty tables are as there."""
    rows = docs.select("doc_id", "source", F.struct("*").alias("_row"))
    times = _with_targets(rows, _sized(docs), limit).withColumn("_n", _copies(seed)).filter("_n > 0")
    return times.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_i")).select("_row.*")
