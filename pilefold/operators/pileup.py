"""Read predicates and per-position base counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BASES
from ..functions import cigar as C
from .intervals import BIN, overlap_join

UNMAPPED, REVERSED, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x4, 0x10, 0x100, 0x200, 0x400, 0x800


def flagged(flag: Column, bits: int) -> Column:
    return flag.bitwiseAND(F.lit(bits)) != 0


def passes_check(flag: Column, mapq: Column, min_mapq: int = 10) -> Column:
    """The candidate stage's reads: mapped, no duplicate, mapq. Secondary, supplementary and QC-fail reads pass."""
    return ~flagged(flag, UNMAPPED | DUPLICATE) & (mapq >= min_mapq)


def is_usable(flag: Column) -> Column:
    """The tensor stage's reads: mapped and primary, no duplicate; any mapq."""
    return ~flagged(flag, UNMAPPED | DUPLICATE | SECONDARY | SUPPLEMENTARY)


def passes_default(flag: Column) -> Column:
    """The call stage's pileup: the usual default of pileup tools."""
    return ~flagged(flag, UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE)


def aligned_bases(reads: DataFrame) -> DataFrame:
    """One row an aligned base of M, = and X operations: (sample, chrom, pos, mapq, baseq, is_reverse, base 0-3 or null). Filter reads first: nothing is pushed through the explode. Rows of near() give the bases of their bin."""
    here = lambda x: F.floor(x["gp"] / BIN) == F.col("_bin") if "_bin" in reads.columns else F.lit(True)
    pairs = F.filter(C.aligned_pairs(F.col("ref_start"), F.col("cigar")), lambda x: x["rp"].isNotNull() & x["gp"].isNotNull() & here(x))
    at = (F.col("p.rp") + 1).cast("int")
    letter = F.upper(F.substring("seq", at, F.lit(1)))
    return (
        reads.withColumn("p", F.explode(pairs))
        .select("sample", "chrom", F.col("p.gp").alias("pos"), "mapq", F.coalesce(F.get("quals", at - 1), F.lit(255)).alias("baseq"), flagged(F.col("flag"), REVERSED).alias("is_reverse"), letter.alias("letter"))
        .withColumn("base", F.nullif(F.array_position(F.array(*map(F.lit, BASES)), F.col("letter")), F.lit(0)) - 1)
        .drop("letter")
    )


def counts(keep: Column, *more: Column) -> Column:
    """array<long> of A, C, G, T counts where keep holds."""
    return F.array(*[F.count_if(keep & (F.col("base") == i)) for i in range(len(BASES))])


def coverage(bases: DataFrame, min_base_quality: int = 22, min_mapq: int = 10) -> DataFrame:
    """(sample, chrom, pos, a, c, g, t, depth): one shuffle with map-side partial counts."""
    kept = bases.filter((F.col("baseq") >= min_base_quality) & (F.col("mapq") >= min_mapq))
    out = kept.groupBy("sample", "chrom", "pos").agg(*[F.count_if(F.col("base") == i).alias(b.lower()) for i, b in enumerate(BASES)])
    return out.withColumn("depth", F.col("a") + F.col("c") + F.col("g") + F.col("t"))


def paired_coverage(bases: DataFrame, min_base_quality: int = 22, min_mapq: int = 10) -> DataFrame:
    """(chrom, pos, n, t): count arrays of normal and tumor in one pass; no join of the two samples is needed."""
    kept = bases.filter((F.col("baseq") >= min_base_quality) & (F.col("mapq") >= min_mapq))
    return kept.groupBy("chrom", "pos").agg(counts(F.col("sample") == "N").alias("n"), counts(F.col("sample") == "T").alias("t"))


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda a, b: a + b)


def argmax(array: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def read_totals(sites: DataFrame, reads: DataFrame) -> DataFrame:
    """(chrom, pos, reads): usable reads over each site, 0 where there is none."""
    usable = reads.filter(is_usable(F.col("flag"))).select("chrom", "ref_start", "ref_end")
    windows = sites.select("chrom", "pos", F.col("pos").alias("w_start"), (F.col("pos") + 1).alias("w_end"))
    per = overlap_join(windows, usable).groupBy("chrom", "pos").agg(F.count("*").alias("reads"))
    return sites.select("chrom", "pos").join(per, ["chrom", "pos"], "left").select("chrom", "pos", F.coalesce("reads", F.lit(0)).cast("long").alias("reads"))
