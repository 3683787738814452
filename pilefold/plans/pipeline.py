"""The two stages from end to end: candidates; scores and calls."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Calling, IndelFilter, IndelTensor, SnvFilter, SnvTensor
from ..functions.cigar import has_indel, parts
from ..functions.encode import with_chr
from ..operators import calls as K
from ..operators import candidates as N
from ..operators import tensors as M
from ..operators.evaluate import balanced
from ..operators.intervals import BIN, aliased, in_regions, near, overlap_join, with_reference
from ..operators.pileup import passes_check, passes_default
from ..operators.scoring import Scorer, refreshed, scored
from ..operators.sweep import sweep


def modes(snv: bool = False, indel: bool = False) -> tuple[bool, bool]:
    """Neither flag means both kinds; both flags at once are an error."""
    if snv and indel:
        raise ValueError("-snv and -indel exclude each other")
    return not indel, not snv


def _named(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """Regions under the contigs' names: where there is none, with chr before it (MT: chrM)."""
    return aliased(regions, contigs, with_chr, "_name").withColumn("chrom", F.col("_name")).drop("_name")


def snv_candidates(reads: DataFrame, cfg: SnvFilter = SnvFilter(), regions: DataFrame | None = None, contigs: DataFrame | None = None, in_order: bool = False) -> DataFrame:
    """(chrom, pos); with regions (end exclusive), those inside, once for each region, and reads elsewhere are never piled up. contigs: the names in use (a file's header has them); without, all reads are asked. in_order: reads come in order of position."""
    kept = reads.filter(passes_check(F.col("flag"), F.col("mapq"), cfg.min_mapq))
    if regions is None:
        return N.snv_candidates_of(sweep(kept, cfg.min_base_quality, in_order=in_order), cfg).select("chrom", "pos")
    regions = _named(regions, reads if contigs is None else contigs)
    kept = near(kept, regions.select("chrom", F.col("start").alias("w_start"), F.col("end").alias("w_end")))
    return in_regions(N.snv_candidates_of(sweep(kept, cfg.min_base_quality), cfg).select("chrom", "pos"), regions).select("chrom", "pos")


def indel_candidates(reads: DataFrame, cfg: IndelFilter = IndelFilter(), regions: DataFrame | None = None, keep_last: bool = False, contigs: DataFrame | None = None) -> DataFrame:
    """(chrom, pos), pos being the base before the event. A region tests the event itself and its reads: it counts events at its positions, of reads that overlap it.

    As in the results to match, a region's last base is left out; keep_last=True has it in.
    """
    if regions is None:
        return N.indel_candidates(N.indel_evidence(N.indel_events(reads, cfg), cfg), cfg)
    by = ("_from", "_to")
    regions = _named(regions, reads if contigs is None else contigs)
    touched = reads.filter(has_indel(F.col("cigar")) & (F.col("mapq") >= cfg.min_mapq))
    # a leading soft clip moves events beyond the read's end: bins up to the last place where one can be
    reach = F.col("ref_start") + F.aggregate(parts(F.col("cigar")), F.lit(1).cast("long"), lambda a, x: a + F.when(x["op"].isin("I", "H", "P"), 0).otherwise(x["len"]))
    touched = near(touched.withColumns({"_end": F.col("ref_end"), "ref_end": F.greatest("ref_end", reach)}), regions.select("chrom", F.col("start").alias("w_start"), F.col("end").alias("w_end")))
    events = N.indel_events(touched, cfg, keep=["ref_start", "_end", "_bin"]).filter(F.floor(F.col("pos") / BIN) == F.col("_bin")).drop("_bin")
    inside = in_regions(events, regions, 0 if keep_last else -1).filter((F.col("ref_start") < F.col("_to")) & (F.col("_end") > F.col("_from")))
    return N.indel_candidates(N.indel_evidence(inside, cfg, by), cfg, by)


def snv_images(sites: DataFrame, reads: DataFrame, reference: DataFrame, block: int, cfg: SnvTensor = SnvTensor(), replicates: int = 1, spike: bool = False, seed: int = 0, then: M.Then | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(chrom, pos, *keep, data), with the channels that cfg asks for. spike: sites (chrom, pos, variant[, share]) get their variant in the tumor's reads; fractions are, as in the results to match, of the reads before."""
    more = tuple(c for c in ("variant", "share") if spike and c in sites.columns)
    rows = M.snv_rows(sites, reads, reference, block, cfg, replicates, keep + more)
    if spike:
        rows = M.spiked(rows, seed=seed).drop(*more)
    return M.tensors(rows, "snv", cfg, then, keep)


def training_data(labels: DataFrame, reads: DataFrame, reference: DataFrame, block: int, kind: str, cfg: SnvTensor | IndelTensor | None = None, spikes: DataFrame | None = None, seed: int = 0, balance: bool = True) -> DataFrame:
    """(chrom, pos, data, label) of labelled sites (chrom, pos, label), one row for each: all positives and, with balance, as many negatives by a seeded hash.

    spikes (SNVs): sites (chrom, pos, variant) that are positives after their variant is put into the tumor's reads; the same site may be a negative as it is.
    """
    sites = labels.groupBy("chrom", "pos").agg(F.max("label").alias("label"))
    if balance:
        sites = balanced(sites, [F.xxhash64(F.lit(seed), "chrom", "pos"), F.col("chrom"), F.col("pos")], minority_only=False)
    if kind == "indel":
        if spikes is not None:
            raise ValueError("only SNVs are spiked in")
        return M.indel_tensors(sites, reads, reference, block, cfg or IndelTensor(), keep=("label",))
    cfg = cfg or SnvTensor()
    out = snv_images(sites, reads, reference, block, cfg, keep=("label",))
    if spikes is not None:
        spikes = spikes.groupBy("chrom", "pos").agg(F.min("variant").alias("variant"))
        made = snv_images(spikes, reads, reference, block, cfg, spike=True, seed=seed)
        out = out.unionByName(made.withColumn("label", F.lit(1.0)))
    return out


def predict(candidates: DataFrame, reads: DataFrame, reference: DataFrame, block: int, kind: str, scorer: Scorer, replicates: int = 1, refresh: int = 0, cfg: SnvTensor | IndelTensor | None = None) -> DataFrame:
    """(chrom, pos, pred_true) of the candidates: the mean over `replicates` draws of the reads of deep sites. refresh: so many sites at most give the network's batch norms new statistics first."""
    cfg = cfg or (SnvTensor() if kind == "snv" else IndelTensor())
    make, shape = partial(snv_images if kind == "snv" else M.indel_tensors, cfg=cfg), cfg.shape
    if refresh:
        some = candidates.select("chrom", "pos").distinct().orderBy(F.xxhash64(F.lit(0), "chrom", "pos"), "chrom", "pos").limit(refresh)
        scorer = refreshed(scorer, make(some, reads, reference, block), shape, refresh)
    scores = make(candidates, reads, reference, block, replicates=replicates, then=scored(candidates.sparkSession, scorer, shape))
    return scores if replicates == 1 else scores.groupBy("chrom", "pos").agg(F.avg("pred_true").alias("pred_true"))


def paired_counts(sites: DataFrame, reads: DataFrame, cfg: Calling = Calling()) -> DataFrame:
    """(chrom, pos, n, t) of the covered ones of sites (chrom, pos), default pileup. Reads away from the sites go before the pileup, other positions before its aggregation."""
    sites = sites.select("chrom", "pos").distinct()
    kept = near(reads.filter(passes_default(F.col("flag"))), sites.select("chrom", F.col("pos").alias("w_start"), (F.col("pos") + 1).alias("w_end")))
    return sweep(kept, cfg.default_base_quality, sites)


def site_counts(sites: DataFrame, reads: DataFrame, sample: str, cfg: Calling = Calling()) -> DataFrame:
    """(chrom, pos, counts) of one sample, as paired_counts has them."""
    return paired_counts(sites, reads.filter(F.col("sample") == sample), cfg).select("chrom", "pos", F.col(sample.lower()).alias("counts"))


def indel_sites(sites: DataFrame, reads: DataFrame, sample: str, reference: DataFrame, block: int) -> DataFrame:
    """(chrom, pos, ref, alt, dp, ro, ao, af, len) at sites (chrom, pos), over every read that overlaps them."""
    windows = sites.select("chrom", F.col("pos").alias("site"), F.col("pos").alias("w_start"), (F.col("pos") + 1).alias("w_end")).distinct()
    met = overlap_join(windows, reads.filter(F.col("sample") == sample)).withColumnRenamed("site", "pos")
    stats = K.indel_stats(K.read_evidence(met))
    known = with_reference(stats.withColumn("len", F.coalesce("len", F.lit(0).cast("long"))), reference, F.when(F.col("kind") == "D", F.col("len") + 1).otherwise(F.lit(1).cast("long")), block)
    return known.withColumnRenamed("ref", "_r").withColumns(K.indel_alleles(F.col("kind"), F.col("len"), F.col("seq"), F.col("_r"))).drop("_r", "kind", "seq")


def germline_sites(candidates: DataFrame, reads: DataFrame, reference: DataFrame, block: int, cfg: Calling = Calling()) -> DataFrame:
    """(chrom, pos, snp_af, indel_af, indel_len) of the normal at each distinct probe site."""
    probes = candidates.select("chrom", F.explode(F.sequence(F.col("pos") + 1 - cfg.germline_window, F.col("pos") + 1)).alias("pos")).filter("pos >= 1").distinct()
    snp = K.with_snv_stats(with_reference(site_counts(probes, reads, "N", cfg), reference, F.lit(1), block)).select("chrom", "pos", F.col("af").alias("snp_af"))
    indel = indel_sites(probes, reads, "N", reference, block).select("chrom", "pos", F.col("af").alias("indel_af"), F.abs(F.length("ref") - F.length("alt")).alias("indel_len"))
    return snp.join(indel, ["chrom", "pos"], "full")


def call(snvs: DataFrame | None, indels: DataFrame | None, reads: DataFrame, reference: DataFrame, block: int, cfg: Calling = Calling()) -> DataFrame:
    """VCF rows of SNV and indel predictions."""
    out = []
    for kind, p in (("SNV", snvs), ("INDEL", indels)):
        if p is None:
            out.append(None)
            continue
        kept = K.scored(p, cfg).select("chrom", "pos").distinct()
        rejected = K.germline_rejected(kept, germline_sites(kept, reads, reference, block, cfg), cfg)
        if kind == "SNV":
            calls = K.snv_calls(p, site_counts(kept, reads, "T", cfg), with_reference(kept, reference, F.lit(1), block), rejected, cfg)
        else:
            calls = K.indel_calls(p, indel_sites(kept, reads, "T", reference, block), rejected, cfg)
        out.append(K.vcf_rows(calls, kind))
    return K.vcf_union(*out)
