"""Candidate positions: SNVs from base counts, indels from CIGAR evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Goldset, IndelFilter, SnvFilter
from ..functions import cigar as C
from .pileup import argmax, is_usable, paired_coverage, total


def gated(pairs: DataFrame, cfg: SnvFilter = SnvFilter()) -> DataFrame:
    """Sites deep enough in both samples, with depths nd and td."""
    return pairs.withColumns({"nd": total(F.col("n")), "td": total(F.col("t"))}).filter((F.col("nd") >= cfg.min_coverage) & (F.col("td") >= cfg.min_coverage))


def snv_candidates(bases: DataFrame, cfg: SnvFilter = SnvFilter()) -> DataFrame:
    """(chrom, pos, n, t) from aligned bases, as snv_candidates_of."""
    return snv_candidates_of(paired_coverage(bases, cfg.min_base_quality, cfg.min_mapq), cfg)


def snv_candidates_of(pairs: DataFrame, cfg: SnvFilter = SnvFilter()) -> DataFrame:
    """(chrom, pos, n, t): some allele other than the normal's commonest is frequent in the tumor and rare in the normal."""
    sites = gated(pairs, cfg).withColumn("top", argmax(F.col("n")))

    def somatic(j):
        n, t = F.get("n", j), F.get("t", j)
        return (j != F.col("top")) & (t / F.col("td") >= cfg.min_tumor_af) & (t >= cfg.min_alt_reads) & (n / F.col("nd") <= cfg.max_normal_af)

    return sites.filter(F.exists(F.array(*map(F.lit, range(4))), somatic)).select("chrom", "pos", "n", "t")


def indel_events(reads: DataFrame, cfg: IndelFilter = IndelFilter(), strict: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(sample, chrom, pos, op, len, read, file_order, *keep) of each I and D. reads may lack flag and quals."""
    kept = reads.filter(C.has_indel(F.col("cigar")) & (F.col("mapq") >= cfg.min_mapq))
    if "flag" in reads.columns:
        kept = kept.filter(is_usable(F.col("flag")))
    kept = kept.withColumn("x", F.explode(F.filter(C.offsets(C.parts(F.col("cigar")), strict), lambda x: x["op"].isin("I", "D"))))
    if "quals" in reads.columns and cfg.min_mean_quality > 0:
        own = F.slice("quals", (F.col("x.read") + 1).cast("int"), F.col("x.len").cast("int"))
        mean = F.aggregate(own, F.lit(0.0), lambda a, q: a + q) / F.size(own)
        kept = kept.filter((F.col("x.op") == "D") | F.coalesce(mean >= cfg.min_mean_quality, F.lit(True)))
    return kept.select("sample", "chrom", (F.col("ref_start") + F.col("x.ref")).alias("pos"), F.col("x.op").alias("op"), F.col("x.len").alias("len"), F.col("x.read").alias("read"), "file_order", *(keep or []))


def indel_evidence(events: DataFrame, cfg: IndelFilter = IndelFilter(), by: tuple[str, ...] = ()) -> DataFrame:
    """(sample, chrom, pos, *by, ins, del, cnt) with enough insertions or enough deletions."""
    per = events.groupBy("sample", "chrom", "pos", *by).agg(F.count_if(F.col("op") == "I").alias("ins"), F.count_if(F.col("op") == "D").alias("del"))
    return per.filter((F.col("ins") >= cfg.min_reads) | (F.col("del") >= cfg.min_reads)).withColumn("cnt", F.col("ins") + F.col("del"))


def indel_candidates(evidence: DataFrame, cfg: IndelFilter = IndelFilter(), by: tuple[str, ...] = ()) -> DataFrame:
    """(chrom, pos): tumor positions absent in the normal, or whose counts differ by more than the margin either way; the base before the indel is written."""
    of = lambda s: evidence.filter(F.col("sample") == s).select("chrom", "pos", *by, F.col("cnt").alias(f"cnt_{s}"))
    met = of("T").join(of("N"), ["chrom", "pos", *by], "left")
    return met.filter(F.col("cnt_N").isNull() | (F.abs(F.col("cnt_T") - F.col("cnt_N")) > cfg.margin)).select("chrom", (F.col("pos") - 1).alias("pos"))


def mad(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, mad): exact median, and median distance from it; the second pass joins the medians back."""
    median = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("median"))
    return df.join(median, by).groupBy(*by).agg(F.first("median").alias("median"), F.percentile(F.abs(F.col(value) - F.col("median")), F.lit(0.5)).alias("mad"))


def goldset_rejects(bases: DataFrame, cfg: Goldset = Goldset()) -> DataFrame:
    """(chrom, pos, r_strand, r_alleles, r_distance, r_mad, r_lowmapq, r_mapqgap, r_mapq, r_quality, rejected) of sites.

    bases: aligned_bases plus `distance` (to the read's end, null if unknown). Strand, distances and
    qualities are the tumor's. A statistic of no rows rejects nothing.
    """
    tumor, normal = F.col("sample") == "T", F.col("sample") == "N"
    distance = mad(bases.filter(tumor & F.col("distance").isNotNull()), ["chrom", "pos"], "distance").withColumnRenamed("median", "dist")
    med = lambda when, c: F.percentile(F.when(when, F.col(c)), F.lit(0.5))
    per = bases.groupBy("chrom", "pos").agg(
        F.avg(F.when(tumor, F.col("is_reverse").cast("int"))).alias("reverse"),
        F.avg(F.when(tumor, (F.col("mapq") < 1).cast("int"))).alias("low"),
        med(tumor, "mapq").alias("mq_t"), med(normal, "mapq").alias("mq_n"), med(tumor, "baseq").alias("bq"),
        F.array(*[F.count_if(tumor & (F.col("base") == i)) for i in range(4)]).alias("t"),
        F.array(*[F.count_if(normal & (F.col("base") == i)) for i in range(4)]).alias("n"),
    )
    alleles = F.exists(F.arrays_zip("t", "n"), lambda x: (x["t"] >= cfg.min_tumor_reads) & (x["n"] <= cfg.max_normal_reads))
    rules = {
        "r_strand": (F.col("reverse") < cfg.min_strand) | (1 - F.col("reverse") < cfg.min_strand),
        "r_alleles": ~alleles,
        "r_distance": F.col("dist") < cfg.min_end_distance,
        "r_mad": F.col("mad") < cfg.min_end_mad,
        "r_lowmapq": F.col("low") > cfg.max_low_mapq,
        "r_mapqgap": F.abs(F.col("mq_t") - F.col("mq_n")) > cfg.max_mapq_gap,
        "r_mapq": F.col("mq_t") < cfg.min_tumor_mapq,
        "r_quality": F.col("bq") < cfg.min_base_quality,
    }
    out = per.join(distance, ["chrom", "pos"], "left").withColumns({k: F.coalesce(v, F.lit(False)) for k, v in rules.items()})
    return out.select("chrom", "pos", *rules, F.greatest(*rules).alias("rejected"))


def indel_read_coverage(reads: DataFrame, strict: bool = False) -> DataFrame:
    """(sample, chrom, pos, coverage): matched bases, insertions and deletions of the reads that have an indel, counted where they stand or begin."""
    kept = reads.filter(C.has_indel(F.col("cigar")))
    if "flag" in reads.columns:
        kept = kept.filter(is_usable(F.col("flag")))
    ops = F.filter(C.offsets(C.parts(F.col("cigar")), strict), lambda x: x["op"].isin("M", "I", "D") & (x["len"] > 0))
    first = F.col("ref_start") + F.col("x.ref")
    last = F.when(F.col("x.op") == "M", first + F.col("x.len") - 1).otherwise(first)
    cells = kept.select("sample", "chrom", "ref_start", F.explode(ops).alias("x")).select("sample", "chrom", F.explode(F.sequence(first, last)).alias("pos"))
    return cells.groupBy("sample", "chrom", "pos").agg(F.count("*").alias("coverage"))
