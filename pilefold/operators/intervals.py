"""Regions, batches and interval joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encode import without_chr

#: Positions in a bin of the interval joins.
BIN = 1024


def split_contigs(contigs: DataFrame, parts: int = 10) -> DataFrame:
    """(chrom, start, end inclusive): chunks of length // parts positions, the rest in a shorter last one; one-position chunks where a contig is shorter than `parts`."""
    size = F.greatest(F.lit(1).cast("long"), F.floor(F.col("length") / parts))
    starts = F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("long"), F.col("length") - 1, size)).otherwise(F.array().cast("array<long>"))
    chunks = contigs.filter(F.col("length") > 0).select("chrom", "length", size.alias("size"), F.explode(starts).alias("start"))
    whole = F.col("start") + F.col("size") - 1
    # A contig that `parts` doesn't divide ends in a chunk of what is left; below `parts` positions it is one chunk.
    tiny = F.col("length") < parts
    out = chunks.withColumn("end", F.when(tiny, F.col("length") - 1).otherwise(F.least(whole, F.col("length") - 1)))
    return out.filter(~tiny | (F.col("start") == 0)).select("chrom", "start", "end")


def batch_regions(regions: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """(batch_id, chrom, start, end inclusive) of BED rows (idx, chrom, start, end exclusive), in file order.

    A region joins the batch while the length that the batch has is below the limit; otherwise it starts
    the next one. The fold is sequential by nature: one task runs over (idx, length), sorted, a row at a
    time; a BED file is a list of targets, far below what that takes.
    """

    def folded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = batch = 0
        for pdf in parts:
            numbers = []
            for n in pdf["n"]:
                if run >= limit:
                    run, batch = 0, batch + 1
                run += n
                numbers.append(batch)
            yield pd.DataFrame({"idx": pdf["idx"], "batch_id": numbers})

    lengths = regions.select(F.col("idx").cast("long"), (F.col("end") - F.col("start")).alias("n"))
    numbered = lengths.coalesce(1).sortWithinPartitions("idx").mapInPandas(folded, "idx long, batch_id int")
    return regions.join(numbered, "idx").select("idx", "batch_id", "chrom", "start", (F.col("end") - 1).alias("end"))


def fetch(reads: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Reads that overlap [start, end): plain predicates, which reach the Parquet scan."""
    return reads.filter((F.col("chrom") == chrom) & (F.col("ref_start") < end) & (F.col("ref_end") > start))


def overlap_join(windows: DataFrame, reads: DataFrame, bin_size: int = BIN) -> DataFrame:
    """windows (chrom, w_start, w_end exclusive, ...) with the reads (chrom, ref_start, ref_end, ...) that overlap them.

    Both sides are dealt into the bins that they touch and meet by (chrom, bin), an equi-join that adaptive
    execution can split at deep places; a pair is kept in the first bin that both touch, so no distinct is
    needed. Spark broadcasts the windows if their size allows.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor((F.col(b) - 1) / bin_size)))
    w = windows.filter("w_end > w_start").withColumn("_bin", bins("w_start", "w_end"))
    r = reads.filter("ref_end > ref_start").withColumn("_bin", bins("ref_start", "ref_end"))
    first = F.floor(F.greatest("w_start", "ref_start") / bin_size)
    return w.join(r, ["chrom", "_bin"]).filter((F.col("ref_start") < F.col("w_end")) & (F.col("ref_end") > F.col("w_start")) & (F.col("_bin") == first)).drop("_bin")


def near(reads: DataFrame, spans: DataFrame, bin_size: int = BIN) -> DataFrame:
    """reads with `_bin`: a row for each bin that a read and a span (chrom, w_start, w_end exclusive) both touch.

    What is outside the spans' bins goes before anything is exploded. A position of a read belongs to the
    row of its own bin (aligned_bases keeps to that), so nothing is counted twice. Spark broadcasts the
    distinct bins if their size allows.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_size), F.floor((F.col(b) - 1) / bin_size)))
    wanted = spans.filter("w_end > w_start").select("chrom", bins("w_start", "w_end").alias("_bin")).distinct()
    return reads.filter("ref_end > ref_start").withColumn("_bin", bins("ref_start", "ref_end")).join(wanted, ["chrom", "_bin"], "left_semi")


def in_regions(df: DataFrame, regions: DataFrame, last: int = 0, bin_size: int = BIN) -> DataFrame:
    """Rows (chrom, pos, ...) inside regions (end exclusive, moved by `last`), once for each region that holds them, with its bounds _from and _to; an equi-join on the bins that a region touches."""
    spans = regions.select("chrom", F.col("start").alias("_from"), (F.col("end") + last).alias("_to")).filter("_to > _from")
    spans = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_from") / bin_size), F.floor((F.col("_to") - 1) / bin_size))))
    met = df.withColumn("_bin", F.floor(F.col("pos") / bin_size)).join(spans, ["chrom", "_bin"])
    return met.filter((F.col("pos") >= F.col("_from")) & (F.col("pos") < F.col("_to"))).select(*df.columns, "_from", "_to")


def aliased(df: DataFrame, contigs: DataFrame, other: Callable[[Column], Column], name: str = "chrom") -> DataFrame:
    """df with `name`: its chrom, or other(chrom) where contigs (chrom) hasn't that. A list of names is thousands long at most; Spark broadcasts it."""
    known = contigs.select(F.col("chrom").alias("_known")).distinct()
    return df.join(known, F.col("chrom") == F.col("_known"), "left").withColumn(name, F.coalesce("_known", other(F.col("chrom")))).drop("_known")


def with_reference(sites: DataFrame, reference: DataFrame, length, block: int, name: str = "ref") -> DataFrame:
    """sites (chrom, pos, ...) plus the upper-cased reference bases [pos, pos + length), which may run into the next block. reference: blocks of `block` bases.

    A contig that the reference hasn't is looked up without its chr, chrM and M as MT. An IndexedFasta is
    asked for the sites' blocks only, and its index has the names.
    """
    last = F.col("pos") + length - 1
    indexed = not isinstance(reference, DataFrame)
    block = reference.block if indexed else block
    need = aliased(sites, reference.contigs if indexed else reference, without_chr, "_c").withColumn("_b", F.explode(F.sequence(F.floor(F.col("pos") / block), F.floor(last / block))))
    if indexed:
        reference = reference.blocks(need.select(F.col("_c").alias("chrom"), F.col("_b").alias("b")))
    met = need.join(reference.select(F.col("chrom").alias("_c"), F.floor(F.col("block_start") / block).alias("_b"), F.col("block_start").alias("_s"), F.col("seq").alias("_q")), ["_c", "_b"], "left")
    low = F.greatest(F.col("pos"), F.col("_s"))
    piece = F.upper(F.substring(F.col("_q"), (low - F.col("_s") + 1).cast("int"), (F.least(last, F.col("_s") + block - 1) - low + 1).cast("int")))
    keys = [F.col(c) for c in sites.columns]
    got = met.select(*keys, F.struct(F.col("_b"), piece.alias("p")).alias("_p")).groupBy(*sites.columns).agg(F.sort_array(F.collect_list("_p")).alias("_ps"))
    return got.withColumn(name, F.array_join(F.transform("_ps", lambda x: x["p"]), "")).drop("_ps")

