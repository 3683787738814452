"""CIGAR strings as column expressions.

Cursor rules: an operation advances the reference cursor if it is in `ref_ops` and the read cursor if it is
in `read_ops`. The evidence walk lets a soft clip advance the reference cursor too, as the positions to
match have it; pass strict=True for positions by the SAM specification. = and X count as M, N as a skip.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"(\d+)([MIDNSHP=X])"


def tokens(cigar: Column) -> Column:
    """array<struct<op, len, ref, read>>: operations with the reference and read offsets at which each begins."""
    return offsets(parts(cigar))


def parts(cigar: Column) -> Column:
    lengths = F.regexp_extract_all(cigar, F.lit(PATTERN), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit(PATTERN), F.lit(2))
    return F.zip_with(ops, lengths, lambda o, n: F.struct(o.alias("op"), n.cast("long").alias("len")))


def offsets(parsed: Column, strict: bool = False) -> Column:
    """Running offsets before each operation, in one fold."""
    ref_ops = ("M", "=", "X", "D", "N") + (() if strict else ("S",))
    read_ops = ("M", "=", "X", "I", "S")
    zero = F.lit(0).cast("long")
    item = "array<struct<op:string,len:bigint,ref:bigint,read:bigint>>"
    start = F.struct(zero.alias("ref"), zero.alias("read"), F.array().cast(item).alias("out"))

    def step(s: Column, x: Column) -> Column:
        here = F.struct(x["op"].alias("op"), x["len"].alias("len"), s["ref"].alias("ref"), s["read"].alias("read"))
        return F.struct(
            (s["ref"] + F.when(x["op"].isin(*ref_ops), x["len"]).otherwise(zero)).alias("ref"),
            (s["read"] + F.when(x["op"].isin(*read_ops), x["len"]).otherwise(zero)).alias("read"),
            F.concat(s["out"], F.array(here)).alias("out"),
        )

    return F.aggregate(parsed, start, step, lambda s: s["out"])


def has_indel(cigar: Column) -> Column:
    return F.coalesce(cigar.rlike("[ID]"), F.lit(False))


def fully_clipped(cigar: Column) -> Column:
    """Only S and H operations."""
    return F.coalesce(cigar.rlike(r"^(\d+[SH])+$"), F.lit(False))


def clipped_in_the_middle(cigar: Column) -> Column:
    """An S or H operation that is neither first nor last."""
    return F.coalesce(cigar.rlike(r"^\d+[A-Z=](\d+[A-Z=])*\d+[SH](\d+[A-Z=])*\d+[A-Z=]$"), F.lit(False))


def reference_end(ref_start: Column, cigar: Column) -> Column:
    """Exclusive end of the aligned stretch."""
    used = F.aggregate(parts(cigar), F.lit(0).cast("long"), lambda n, x: n + F.when(x["op"].isin("M", "=", "X", "D", "N"), x["len"]).otherwise(F.lit(0)))
    return ref_start + used


def aligned_pairs(ref_start: Column, cigar: Column) -> Column:
    """array<struct<op, rp, gp>>: read and reference position of each column; null on the side that an operation doesn't use. H and P give none."""

    def each(x: Column) -> Column:
        on_ref, on_read = x["op"].isin("M", "=", "X", "D", "N"), x["op"].isin("M", "=", "X", "I", "S")
        steps = F.sequence(F.lit(0).cast("long"), x["len"] - 1)
        cells = F.transform(steps, lambda k: F.struct(x["op"].alias("op"), F.when(on_read, x["read"] + k).alias("rp"), F.when(on_ref, ref_start + x["ref"] + k).alias("gp")))
        return F.when((x["len"] > 0) & (on_ref | on_read), cells).otherwise(F.array().cast("array<struct<op:string,rp:bigint,gp:bigint>>"))

    return F.flatten(F.transform(offsets(parts(cigar), strict=True), each))


def trimmed_pairs(ref_start: Column, cigar: Column) -> Column:
    """Aligned pairs without the soft clip of the first and last operation."""
    pairs, ops = aligned_pairs(ref_start, cigar), parts(cigar)
    head = F.when(F.element_at(ops, 1)["op"] == "S", F.element_at(ops, 1)["len"]).otherwise(F.lit(0))
    tail = F.when((F.size(ops) > 1) & (F.element_at(ops, -1)["op"] == "S"), F.element_at(ops, -1)["len"]).otherwise(F.lit(0))
    return F.slice(pairs, (head + 1).cast("int"), F.greatest(F.size(pairs) - head - tail, F.lit(0)).cast("int"))
