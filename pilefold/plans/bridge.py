"""Alignment-like views over the driver's tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 20
#: Orders lineitem without ties.
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("int")
    return table(spark, sf_dir, "lineitem").withColumns({"disc": cents("l_discount"), "tax": cents("l_tax"), "sample": F.when(F.col("l_linestatus") == "F", "N").otherwise("T"), "chrom": F.concat(F.lit("chr"), (F.col("l_partkey") % 5).cast("string"))})


def aligned_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.col("l_partkey")
    base = F.when((F.col("sample") == "T") & (part % 3 == 0) & (F.col("disc") <= 2), (part + 1) % 4).when((F.col("disc") == 10) & (F.col("tax") >= 6), (part + 2) % 4).otherwise(part % 4)
    return _lineitem(spark, sf_dir).select(
        "sample", "chrom", part.alias("pos"), F.col("l_quantity").cast("int").alias("mapq"), (15 + F.col("l_orderkey") % 26).cast("int").alias("baseq"),
        (F.col("l_linenumber") % 2 == 0).alias("is_reverse"), base.cast("int").alias("base"), (F.col("l_suppkey") % 40).alias("distance"),
        F.col("l_orderkey").alias("file_order"), "l_linenumber",
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    size = (10 - line % 3).cast("string")
    indel = F.concat(size, F.lit("M"), (1 + part % 3).cast("string"), F.when(part % 2 == 0, "I").otherwise("D"), F.lit("15M"))
    cigar = F.when((F.col("disc") <= 3) & ((F.col("sample") == "T") | (part % 7 == 0)), indel).when(F.col("tax") == 0, F.lit("5S30M")).otherwise(F.lit("35M"))
    order = (F.col("l_orderkey") * 8 + line).alias("file_order")
    return _lineitem(spark, sf_dir).select("sample", order, F.concat(F.lit("r"), (F.col("l_orderkey") % 50).cast("string")).alias("query_name"), "chrom", (part * 20 + line % 3).cast("long").alias("ref_start"), (F.col("l_quantity").cast("int") + 10).alias("mapq"), cigar.alias("cigar"), (line % 2 == 0).alias("is_reverse"), F.col("l_suppkey").alias("tie"), F.col("l_extendedprice").alias("tie2"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").agg(F.count("*").alias("n_part"))
    o = table(spark, sf_dir, "orders").join(F.broadcast(parts))  # one row
    pos = F.col("o_orderkey") % F.col("n_part")
    score = F.bround((F.col("o_orderkey") * 7919 % 10007).cast("double") / 10007.0, 4)
    return o.select(F.concat(F.lit("chr"), (pos % 5).cast("string")).alias("chrom"), pos.alias("pos"), score.alias("pred_true"), F.col("o_orderkey").alias("idx"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").filter(p % 4 == 1).select(F.concat(F.lit("chr"), (p % 5).cast("string")).alias("chrom"), p.alias("pos"), F.lit(1.0).alias("label"))


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 20 bases, one a part: letters of the part's hash."""
    p = F.col("p_partkey")
    seq = F.substring(F.translate(F.md5(p.cast("string").cast("binary")), "0123456789abcdef", "acgtACGTacgtACGT"), 1, BLOCK)
    return table(spark, sf_dir, "part").select(F.concat(F.lit("chr"), (p % 5).cast("string")).alias("chrom"), (p * BLOCK).alias("block_start"), seq.alias("seq"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(s.alias("idx"), F.concat(F.lit("chr"), (s % 5).cast("string")).alias("chrom"), (s * 100).alias("start"), (s * 100 + 3 + s * 37 % 90).alias("end"))


#: The same views for the SQL side, to go after WITH.
CTE = """
li AS (SELECT *, round(l_discount * 100)::INT AS disc, round(l_tax * 100)::INT AS tax, CASE WHEN l_linestatus = 'F' THEN 'N' ELSE 'T' END AS sample, 'chr' || (l_partkey % 5)::VARCHAR AS chrom FROM lineitem),
ab AS (
  SELECT sample, chrom, l_partkey AS pos, floor(l_quantity)::INT AS mapq, (15 + l_orderkey % 26)::INT AS baseq, l_linenumber % 2 = 0 AS is_reverse, l_suppkey % 40 AS distance, l_orderkey AS file_order, l_linenumber,
         CASE WHEN sample = 'T' AND l_partkey % 3 = 0 AND disc <= 2 THEN (l_partkey + 1) % 4 WHEN disc = 10 AND tax >= 6 THEN (l_partkey + 2) % 4 ELSE l_partkey % 4 END AS base FROM li
), rd AS (
  SELECT sample, l_orderkey * 8 + l_linenumber AS file_order, 'r' || (l_orderkey % 50)::VARCHAR AS query_name, chrom, l_partkey * 20 + l_linenumber % 3 AS ref_start, floor(l_quantity)::INT + 10 AS mapq, l_linenumber % 2 = 0 AS is_reverse, l_suppkey AS tie, l_extendedprice AS tie2,
         CASE WHEN disc <= 3 AND (sample = 'T' OR l_partkey % 7 = 0) THEN (10 - l_linenumber % 3)::VARCHAR || 'M' || (1 + l_partkey % 3)::VARCHAR || CASE WHEN l_partkey % 2 = 0 THEN 'I' ELSE 'D' END || '15M' WHEN tax = 0 THEN '5S30M' ELSE '35M' END AS cigar FROM li
), pr AS (
  SELECT 'chr' || (o_orderkey % n % 5)::VARCHAR AS chrom, o_orderkey % n AS pos, round_even((o_orderkey * 7919 % 10007)::DOUBLE / 10007.0::DOUBLE, 4) AS pred_true, o_orderkey AS idx FROM orders, (SELECT count(*) AS n FROM part)
), tr AS (SELECT 'chr' || (p_partkey % 5)::VARCHAR AS chrom, p_partkey AS pos, 1.0::DOUBLE AS label FROM part WHERE p_partkey % 4 = 1),
rf AS (SELECT 'chr' || (p_partkey % 5)::VARCHAR AS chrom, p_partkey * 20 AS block_start, substr(translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'acgtACGTacgtACGT'), 1, 20) AS seq FROM part),
rg AS (SELECT s_suppkey AS idx, 'chr' || (s_suppkey % 5)::VARCHAR AS chrom, s_suppkey * 100 AS "start", s_suppkey * 100 + 3 + s_suppkey * 37 % 90 AS "end" FROM supplier),
pile AS (
  SELECT chrom, pos, [count(*) FILTER (WHERE sample = 'N' AND base = 0), count(*) FILTER (WHERE sample = 'N' AND base = 1), count(*) FILTER (WHERE sample = 'N' AND base = 2), count(*) FILTER (WHERE sample = 'N' AND base = 3)] AS n,
         [count(*) FILTER (WHERE sample = 'T' AND base = 0), count(*) FILTER (WHERE sample = 'T' AND base = 1), count(*) FILTER (WHERE sample = 'T' AND base = 2), count(*) FILTER (WHERE sample = 'T' AND base = 3)] AS t
  FROM ab WHERE baseq >= 22 AND mapq >= 10 GROUP BY chrom, pos
), cg AS (SELECT rd.*, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 1) AS ln, regexp_extract_all(cigar, '(\\d+)([MIDNSHP=X])', 2) AS op FROM rd),
ev AS (
  SELECT sample, chrom, op[i] AS op, ln[i]::BIGINT AS len, file_order, mapq, tie, tie2,
         ref_start + coalesce(list_sum(list_transform(range(1, i), lambda k: CASE WHEN op[k] = 'I' THEN 0 ELSE ln[k]::BIGINT END)), 0)::BIGINT AS pos,
         coalesce(list_sum(list_transform(range(1, i), lambda k: CASE WHEN op[k] = 'D' THEN 0 ELSE ln[k]::BIGINT END)), 0)::BIGINT AS read
  FROM cg, unnest(range(1, len(op) + 1)) AS u(i) WHERE op[i] IN ('I', 'D')
), ie AS (
  SELECT sample, chrom, pos, count(*) FILTER (WHERE op = 'I') AS ins, count(*) FILTER (WHERE op = 'D') AS del, count(*) AS cnt FROM ev WHERE mapq >= 35 GROUP BY ALL
  HAVING count(*) FILTER (WHERE op = 'I') >= 2 OR count(*) FILTER (WHERE op = 'D') >= 2
)
"""
