"""Statistics of call sites, the germline test, and VCF rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BASES, Calling
from ..functions import cigar as C
from ..functions.encode import number_text, ratio4, round4
from .pileup import total


def snv_stats(ref: Column, counts: Column) -> dict[str, Column]:
    """alt, dp, ro, ao, af of a site from its reference base and its A, C, G, T counts.

    ALT is the first base, in A, C, G, T order and the reference included, whose count is the largest
    non-reference count; so it is the reference base if that ties and comes first. A reference that is
    none of the four gives N and zeros.
    """
    bases = F.array(*map(F.lit, BASES))
    at = F.array_position(bases, ref)
    known = at > 0
    others = F.filter(counts, lambda x, i: i + 1 != at)
    ao = F.array_max(others)
    dp = total(counts)
    return {
        "alt": F.when(known, F.get(bases, (F.array_position(counts, ao) - 1).cast("int"))).otherwise(F.lit("N")),
        "dp": dp,
        "ro": F.when(known, F.get(counts, (at - 1).cast("int"))).otherwise(F.lit(0).cast("long")),
        "ao": F.when(known, ao).otherwise(F.lit(0).cast("long")),
        "af": F.when(known, ratio4(ao, dp)).otherwise(F.lit(0.0)),
    }


def with_snv_stats(sites: DataFrame) -> DataFrame:
    """sites (chrom, pos, ref, counts, ...) with alt, dp, ro, ao, af."""
    return sites.withColumns(snv_stats(F.col("ref"), F.col("counts")))


def read_evidence(reads: DataFrame) -> DataFrame:
    """reads ⋈ anchors (chrom, pos, ref_start, cigar, seq, ...) -> per read: ro (0/1) and its evidence items.

    A read without I or D supports the reference. Otherwise the pairs after the anchor count: deleted
    positions and inserted bases until the first fully aligned pair, which supports the reference too if
    it is the next position. Soft clips are part of the pairs.
    """
    indel = C.has_indel(F.col("cigar"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    # phase 0: before the anchor; 1: between the anchor and the next aligned pair; 2: past it.
    start = F.struct(zero.alias("phase"), F.lit("").alias("ins"), zero.alias("del"), zero.alias("ro"))

    def step(s: Column, x: Column) -> Column:
        low, op = F.col("ref_start") + x["ref"], x["op"]
        both, ref_only, read_only = op.isin("M", "=", "X"), op.isin("D", "N"), op.isin("I", "S")
        rest = low + x["len"] - F.col("pos") - 1
        holds = (s["phase"] == 0) & (both | ref_only) & (low <= F.col("pos")) & (rest >= 0)
        open_ = s["phase"] == 1
        inside = holds & both & (rest > 0)
        return F.struct(
            F.when(inside | (open_ & both), F.lit(2).cast("long")).when(holds, one).otherwise(s["phase"]).alias("phase"),
            F.when(open_ & read_only, F.concat(s["ins"], F.substring("seq", (x["read"] + 1).cast("int"), x["len"].cast("int")))).otherwise(s["ins"]).alias("ins"),
            (s["del"] + F.when(holds & ref_only, rest).when(open_ & ref_only, x["len"]).otherwise(zero)).alias("del"),
            F.when(inside | (open_ & both & (low == F.col("pos") + 1)), one).otherwise(s["ro"]).alias("ro"),
        )

    none = F.array().cast("array<struct<kind:string,seq:string,len:bigint>>")
    item = lambda kind, seq, n: F.struct(F.lit(kind).alias("kind"), seq.cast("string").alias("seq"), n.cast("long").alias("len"))
    out = reads.withColumn("_w", F.when(indel, F.aggregate(C.offsets(C.parts(F.col("cigar")), strict=True), start, step)))
    found = F.filter(F.array(F.when(F.length("_w.ins") > 0, item("I", F.col("_w.ins"), F.length("_w.ins"))), F.when(F.col("_w.del") > 0, item("D", F.lit(None), F.col("_w.del")))), lambda x: x.isNotNull())
    return out.withColumn("ro", F.coalesce(F.col("_w.ro"), one).cast("int")).withColumn("items", F.when(F.col("_w").isNotNull(), found).otherwise(none)).drop("_w")


def indel_stats(evidence: DataFrame) -> DataFrame:
    """(chrom, pos, dp, ro, ao, af, kind, seq, len): every read counts in dp; the commonest evidence is the call (ties: kind, length, bases)."""
    itself = F.array(F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("kind", "string"), ("seq", "string"), ("len", "long"))]))  # each read, whatever its items
    votes = evidence.select("chrom", "pos", "ro", F.explode(F.concat("items", itself)).alias("e"))
    votes = votes.groupBy("chrom", "pos", "e.kind", "e.seq", "e.len").agg(F.count("*").alias("ao"), F.sum("ro").alias("ro"))
    read = F.col("kind").isNull()
    best = F.min(F.when(~read, F.struct((-F.col("ao")).alias("less"), "kind", "len", "seq"))).alias("_b")
    out = votes.groupBy("chrom", "pos").agg(F.sum(F.when(read, F.col("ao"))).alias("dp"), F.sum(F.when(read, F.col("ro"))).alias("ro"), best)
    out = out.withColumn("ao", F.coalesce(-F.col("_b.less"), F.lit(0).cast("long")))
    return out.select("chrom", "pos", "dp", "ro", F.col("_b.kind").alias("kind"), F.col("_b.seq").alias("seq"), F.col("_b.len").alias("len"), "ao", ratio4(F.col("ao"), F.col("dp")).alias("af"))


def indel_alleles(kind: Column, length: Column, seq: Column, ref: Column) -> dict[str, Column]:
    """REF and ALT from the reference from the anchor on (anchor base and `length` bases more)."""
    first = F.substring(ref, 1, 1)
    return {
        "ref": F.when(kind == "D", F.substring(ref, F.lit(1), (length + 1).cast("int"))).otherwise(first),
        "alt": F.when(kind == "D", first).otherwise(F.concat(first, F.coalesce(seq, F.lit("")))),
    }


def germline_rejected(candidates: DataFrame, normal: DataFrame, cfg: Calling = Calling()) -> DataFrame:
    """candidates (chrom, pos) next to a normal-sample variant, each once.

    normal: (chrom, pos, snp_af, indel_af, indel_len), computed once a site, nulls as none. Probed are the
    sites pos + 1 down to pos - window + 1, none below 1. A frequent SNP or indel within one position
    rejects; so does a frequent indel, more frequent than the SNP there, that reaches the candidate. The
    fixed offsets make the range join an equi-join.
    """
    offsets = F.sequence(F.lit(1 - cfg.germline_window), F.lit(1))
    probes = candidates.select("chrom", "pos").distinct().withColumn("d", F.explode(offsets)).withColumn("at", F.col("pos") + F.col("d")).filter("at >= 1")
    n = normal.select("chrom", F.col("pos").alias("at"), F.coalesce("snp_af", F.lit(0.0)).alias("s"), F.coalesce("indel_af", F.lit(0.0)).alias("i"), F.coalesce("indel_len", F.lit(0)).alias("len"))
    n = n.filter((F.col("s") > cfg.germline_af) | (F.col("i") > cfg.germline_af))
    near = F.abs("d") <= 1
    reaches = (F.col("i") > cfg.germline_af) & (F.col("i") > F.col("s")) & (F.col("at") + F.col("len") + 1 >= F.col("pos"))
    return probes.join(n, ["chrom", "at"]).filter(near | reaches).select("chrom", "pos").distinct()


def scored(predictions: DataFrame, cfg: Calling = Calling()) -> DataFrame:
    """Predictions over the cutoff, after rounding to four places, with their FILTER."""
    out = predictions.withColumn("score", round4(F.col("pred_true"))).filter(F.col("score") >= cfg.cutoff)
    return out.withColumn("filter", F.when(F.col("score") >= cfg.pass_score, F.lit("PASS")).otherwise(F.lit("REJECT")))


def snv_calls(predictions: DataFrame, tumor: DataFrame, ref: DataFrame, rejected: DataFrame, cfg: Calling = Calling()) -> DataFrame:
    """(chrom, pos 0-based, ref, alt, score, filter, dp, ro, ao, af). tumor: (chrom, pos, counts) of covered sites; ref: (chrom, pos, ref).

    A site that no read of the default pileup covers is called with depth 0; its ALT is then A, the first of equal counts.
    """
    kept = scored(predictions, cfg).join(rejected, ["chrom", "pos"], "left_anti")
    met = kept.join(ref.select("chrom", "pos", "ref"), ["chrom", "pos"], "left").join(tumor.select("chrom", "pos", "counts"), ["chrom", "pos"], "left")
    met = met.withColumn("counts", F.coalesce("counts", F.array_repeat(F.lit(0).cast("long"), len(BASES))))
    return with_snv_stats(met.withColumn("ref", F.coalesce("ref", F.lit("")))).select("chrom", "pos", "ref", "alt", "score", "filter", "dp", "ro", "ao", "af")


def indel_calls(predictions: DataFrame, tumor: DataFrame, rejected: DataFrame, cfg: Calling = Calling()) -> DataFrame:
    """The same for indels, with the tumor's allele-frequency gate. tumor: (chrom, pos, ref, alt, dp, ro, ao, af)."""
    kept = scored(predictions, cfg).join(tumor.filter(F.col("af") >= cfg.min_indel_af), ["chrom", "pos"])
    return kept.join(rejected, ["chrom", "pos"], "left_anti").select("chrom", "pos", "ref", "alt", "score", "filter", "dp", "ro", "ao", "af")


def vcf_rows(calls: DataFrame, kind: str) -> DataFrame:
    """The ten VCF columns, POS 1-based; kind is SNV or INDEL. AF is a bare 0 where none can be computed: no depth, or a reference that is none of the four bases."""
    computed = (F.col("dp") > 0) & (F.col("ref").isin(*BASES) if kind == "SNV" else F.lit(True))
    af, score = F.when(computed, number_text(F.col("af"))).otherwise(F.lit("0")), number_text(F.col("score"))
    info = F.concat(F.lit(f"TYPE={kind};SCORE="), score, F.lit(";DP="), F.col("dp"), F.lit(";RO="), F.col("ro"), F.lit(";AO="), F.col("ao"), F.lit(";AF="), af, F.lit(";"))
    sample = F.concat_ws(":", F.lit("0/1"), F.col("dp").cast("string"), F.col("ro").cast("string"), F.col("ao").cast("string"), af)
    dot = F.lit(".")
    return calls.select("chrom", (F.col("pos") + 1).alias("pos"), dot.alias("id"), "ref", "alt", dot.alias("qual"), "filter", info.alias("info"), F.lit("GT:DP:RO:AO:AF").alias("format"), sample.alias("sample"))


def vcf_union(snvs: DataFrame | None, indels: DataFrame | None) -> DataFrame:
    """SNV rows, then indel rows, with an ordinal that keeps that order. At least one is needed."""
    parts = [df.withColumn("ord", F.lit(i)) for i, df in enumerate((snvs, indels)) if df is not None]
    if not parts:
        raise ValueError("neither SNVs nor indels asked for")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
