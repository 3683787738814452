"""Sharding along a Hilbert curve over several metadata dimensions [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free, saved


def hilbert_index(df: DataFrame, dims: list[str], bits: int, name: str) -> DataFrame:
    """df with the Hilbert index (long) of the integer columns `dims`, each 0 .. 2**bits - 1.

    Axes are turned into the transposed index bit plane by bit plane (reflect or exchange the low bits
    of two axes, then Gray-encode), one projection a step, so that each value is computed once.
    """
    n, tmp = len(dims), [f"_x{i}" for i in range(len(dims))]
    df = df.withColumns({t: F.col(d).cast("long") for t, d in zip(tmp, dims)})
    for plane in range(bits - 1, 0, -1):
        low = F.lit((1 << plane) - 1).cast("long")
        for i in range(n):
            on = F.getbit(F.col(tmp[i]), F.lit(plane)) == 1
            flip = F.when(on, low).otherwise(F.col(tmp[0]).bitwiseXOR(F.col(tmp[i])).bitwiseAND(low))
            both = {tmp[0]: F.col(tmp[0]).bitwiseXOR(F.col("_f"))}
            if i:
                both[tmp[i]] = F.when(on, F.col(tmp[i])).otherwise(F.col(tmp[i]).bitwiseXOR(F.col("_f")))
                df = df.withColumn("_f", flip).withColumns(both)
            else:
                df = df.withColumn(tmp[0], F.when(on, F.col(tmp[0]).bitwiseXOR(low)).otherwise(F.col(tmp[0])))
    for i in range(1, n):
        df = df.withColumn(tmp[i], F.col(tmp[i]).bitwiseXOR(F.col(tmp[i - 1])))
    turn = F.lit(0).cast("long")
    for plane in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.getbit(F.col(tmp[-1]), F.lit(plane)) == 1, F.lit((1 << plane) - 1).cast("long")).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("_f", turn).withColumns({t: F.col(t).bitwiseXOR(F.col("_f")) for t in tmp})
    index = F.lit(0).cast("long")
    for plane in range(bits - 1, -1, -1):
        for t in tmp:
            index = index * 2 + F.getbit(F.col(t), F.lit(plane)).cast("long")
    return df.withColumn(name, index).drop("_f", *tmp)


def _scaled(value: Column, low, high, bits: int) -> Column:
    """value of low..high as a cell 0 .. 2**bits - 1; null in cell 0."""
    top = (1 << bits) - 1
    if low is None or high is None or high <= low:
        return F.lit(0).cast("long")
    cell = F.floor((value.cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low)) * F.lit(float(top + 1)))
    return F.coalesce(F.least(F.greatest(cell, F.lit(0)), F.lit(top)), F.lit(0)).cast("long")


def ranked(rows: DataFrame, keys: list[str], name: str, weight: Column | None = None) -> DataFrame:
    """rows with `name`: how much weight (a row: 1) goes before a row in the order of keys, nulls first. Saved.

    A range-partitioned sort, running sums inside each partition and, added to those, what the partitions
    before it hold; never one task over all rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = rows.withColumn("_w", F.lit(1).cast("long") if weight is None else weight)
    run = run.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    run = saved(run.withColumn("_part", F.shiftright("_id", 33)), name)
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) if weight is None else F.sum("_w").over(W.partitionBy("_part").orderBy("_id")) - F.col("_w")
    #: One row for each partition of the sort, so the window over them stays that small.
    before = run.groupBy("_part").agg(F.sum("_w").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).select("_part", "_before")
    return run.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + inside).drop("_part", "_before", "_w", "_id")


def _depth_cells(rows: DataFrame, column: str, name: str, total: int, bits: int) -> DataFrame:
    """rows with `name`: the column's cell 0 .. 2**bits - 1. Values keep their order and share the cells by the rows that they have; equal values share one, null is the first."""
    per = rows.groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_rows"))
    placed = ranked(per, ["_value"], "_rank", F.col("_rows"))
    cells = placed.select("_value", F.least(F.expr(f"(_rank * {1 << bits}) div {max(1, total)}"), F.lit((1 << bits) - 1)).cast("long").alias(name))
    return rows.join(cells, rows[column].eqNullSafe(cells["_value"])).drop("_value")


def shard_documents(docs: DataFrame, shards: int = 8, bits: int = 5) -> DataFrame:
    """(doc_id, size, text_crc32, hilbert, shard, slot) of every document: runs of the Hilbert order, equal in rows.

    Dimensions: source and lang (in code point order, cells of about equally many rows, so that neighbours
    on the curve are neighbours in both and files can be skipped by either), size (its logarithm between
    the smallest and the largest), doc_id (linear). Rows are sorted over the cluster by (hilbert,
    text_crc32, doc_id, size), so equal texts of a cell are neighbours, and cut into `shards` runs whose
    row counts differ by one at most. Texts are read once. Null text: size 1, crc32 0; null source, lang or
    id: the first cell. Ties in all four keys get either slot; repeated rows are rows of their own; an
    empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    rows = saved(docs.select("doc_id", "source", "lang", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "narrow")
    seen = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min(F.log2("size")).alias("c"), F.max(F.log2("size")).alias("d"), F.count("*").alias("n")).first()
    rows = _depth_cells(_depth_cells(rows, "source", "_d0", seen["n"], bits), "lang", "_d1", seen["n"], bits)
    rows = rows.withColumns({"_d2": _scaled(F.log2("size"), seen["c"], seen["d"], bits), "_d3": _scaled(F.col("doc_id"), seen["a"], seen["b"], bits)})
    rows = hilbert_index(rows, ["_d0", "_d1", "_d2", "_d3"], bits, "hilbert").select("doc_id", "size", "text_crc32", "hilbert")
    out = ranked(rows, ["hilbert", "text_crc32", "doc_id", "size"], "_rank")
    shard = F.expr(f"(_rank * {shards}) div {max(1, seen['n'])}").cast("int")
    first = F.expr(f"(cast(shard as bigint) * {seen['n']} + {shards} - 1) div {shards}")
    return out.withColumn("shard", shard).withColumn("slot", (F.col("_rank") - first).cast("long")).select("doc_id", "size", "text_crc32", "hilbert", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, bits: int = 5) -> None:
    """Writes the whole documents, one folder a shard, in curve order inside each file, so that min/max statistics prune on every dimension.

    All columns stay as they are, whatever their names; the folders' column is shard, or shard_ where docs
    has that. Rows that repeat an id and a text go where one of them goes.
    """
    place = shard_documents(docs, shards, bits).select(F.col("doc_id").alias("_d"), F.col("text_crc32").alias("_c"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).dropDuplicates(["_d", "_c"])
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("_crc"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.join(place, rows["_id"].eqNullSafe(place["_d"]) & (rows["_crc"] == place["_c"])).repartitionByRange(parts, "_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    name = free("shard", docs.columns)
    placed.select(F.col("_shard").alias(name), "_row").select("_row.*", name).write.partitionBy(name).parquet(path)
