"""The operators as queries over the bridge views, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Calling, SnvFilter, SnvTensor
from ..functions import cigar as C
from ..functions import encode as E
from ..operators import calls as K
from ..operators import candidates as N
from ..operators import evaluate as V
from ..operators import fourier as FP
from ..operators import images as T
from ..operators import intervals as I
from ..operators import pileup as P
from ..operators import rows as R
from ..operators import scoring as S
from ..operators import sweep as W
from ..operators import tensors as M
from . import bridge as B
from . import image_sql as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{B.CTE}{sql if sql.lstrip().startswith(',') else sql}"
        return f

    return add


def _letter(index) -> F.Column:
    return F.get(F.array(*map(F.lit, "ACGT")), index)


# -- pileup and SNV candidates


@query("SELECT chrom, pos, n[1] AS n_a, n[2] AS n_c, n[3] AS n_g, n[4] AS n_t, t[1] AS t_a, t[2] AS t_c, t[3] AS t_g, t[4] AS t_t FROM (SELECT *, list_sum(n) AS nd, list_sum(t) AS td, list_position(n, list_max(n)) AS top FROM pile) WHERE nd >= 7 AND td >= 7 AND len(list_filter([1, 2, 3, 4], lambda j: j <> top AND t[j]::DOUBLE / td::DOUBLE >= 0.035::DOUBLE AND t[j] >= 2 AND n[j]::DOUBLE / nd::DOUBLE <= 0.05::DOUBLE)) > 0")
def snv_candidates(spark, sf_dir):
    """F1, A1, A3, A4, J1, F4, F5."""
    out = N.snv_candidates(B.aligned_bases(spark, sf_dir))
    return out.select("chrom", "pos", *[F.get(s, F.lit(i)).alias(f"{s}_{b}") for s in "nt" for i, b in enumerate("acgt")])


@query("SELECT sample, chrom, pos, count(*) FILTER (WHERE base = 0) AS a, count(*) FILTER (WHERE base = 1) AS c, count(*) FILTER (WHERE base = 2) AS g, count(*) FILTER (WHERE base = 3) AS t, count(*) AS depth FROM ab WHERE baseq >= 22 AND mapq >= 10 GROUP BY ALL")
def pileup_coverage(spark, sf_dir):
    """F1, A1, A3."""
    return P.coverage(B.aligned_bases(spark, sf_dir))


@query("SELECT sample, chrom, pos, count(*) FILTER (WHERE base = 0) AS a, count(*) FILTER (WHERE base = 1) AS c, count(*) FILTER (WHERE base = 2) AS g, count(*) FILTER (WHERE base = 3) AS t, count(*) AS depth FROM ab WHERE baseq >= 15 GROUP BY ALL")
def pileup_default(spark, sf_dir):
    """A2."""
    return P.coverage(B.aligned_bases(spark, sf_dir), 15, 0)


@query("SELECT chrom, pos, list_sum(n)::BIGINT AS nd, list_sum(t)::BIGINT AS td, (list_position(n, list_max(n)) - 1)::INT AS top FROM pile WHERE list_sum(n) >= 7 AND list_sum(t) >= 7")
def snv_coverage_gate(spark, sf_dir):
    """F4, A3, A4."""
    return N.gated(P.paired_coverage(B.aligned_bases(spark, sf_dir))).select("chrom", "pos", "nd", "td", P.argmax(F.col("n")).alias("top"))


@query("SELECT coalesce(x.chrom, y.chrom) AS chrom, coalesce(x.pos, y.pos) AS pos, x.d AS n_depth, y.d AS t_depth FROM (SELECT chrom, pos, count(*) AS d FROM ab WHERE sample = 'N' AND baseq >= 22 AND mapq >= 10 GROUP BY ALL) x JOIN (SELECT chrom, pos, count(*) AS d FROM ab WHERE sample = 'T' AND baseq >= 22 AND mapq >= 10 GROUP BY ALL) y ON x.chrom = y.chrom AND x.pos = y.pos")
def coverage_join(spark, sf_dir):
    """J1 as a join of the two samples."""
    c = P.coverage(B.aligned_bases(spark, sf_dir))
    of = lambda s: c.filter(F.col("sample") == s).select("chrom", "pos", F.col("depth").alias(f"{s.lower()}_depth"))
    return of("N").join(of("T"), ["chrom", "pos"])


@query("SELECT chrom, pos, reverse < 0.02::DOUBLE OR 1 - reverse < 0.02::DOUBLE AS r_strand, NOT alleles AS r_alleles, coalesce(dist < 10, false) AS r_distance, coalesce(mad < 3, false) AS r_mad, low > 0.10::DOUBLE AS r_lowmapq, coalesce(abs(mt - mn) > 5, false) AS r_mapqgap, mt < 40 AS r_mapq, bq < 30 AS r_quality, (reverse < 0.02::DOUBLE OR 1 - reverse < 0.02::DOUBLE OR NOT alleles OR coalesce(dist < 10, false) OR coalesce(mad < 3, false) OR low > 0.10::DOUBLE OR coalesce(abs(mt - mn) > 5, false) OR mt < 40 OR bq < 30) AS rejected FROM (SELECT chrom, pos, avg(is_reverse::INT) FILTER (WHERE sample = 'T') AS reverse, avg((mapq < 1)::INT) FILTER (WHERE sample = 'T') AS low, median(mapq) FILTER (WHERE sample = 'T') AS mt, median(mapq) FILTER (WHERE sample = 'N') AS mn, median(baseq) FILTER (WHERE sample = 'T') AS bq, median(distance) FILTER (WHERE sample = 'T') AS dist, mad(distance::DOUBLE) FILTER (WHERE sample = 'T') AS mad, (" + " OR ".join(f"(count(*) FILTER (WHERE sample = 'T' AND base = {i}) >= 4 AND count(*) FILTER (WHERE sample = 'N' AND base = {i}) <= 1)" for i in range(4)) + ") AS alleles FROM ab GROUP BY chrom, pos) WHERE reverse IS NOT NULL")
def goldset_filters(spark, sf_dir):
    """F3, A11, A12."""
    bases = B.aligned_bases(spark, sf_dir)
    some = bases.filter("sample = 'T'").select("chrom", "pos").distinct()
    return N.goldset_rejects(bases).join(some, ["chrom", "pos"], "left_semi")


@query("SELECT chrom, pos, median(distance::DOUBLE) AS median, mad(distance::DOUBLE) AS mad FROM ab GROUP BY ALL")
def median_mad(spark, sf_dir):
    """A11."""
    return N.mad(B.aligned_bases(spark, sf_dir), ["chrom", "pos"], "distance")


@query("SELECT sample, pos, avg(is_reverse::INT) AS reverse, count(*) FILTER (WHERE least(nullif(distance, 0), nullif(39 - distance, 0)) < 10) AS near_end FROM ab GROUP BY ALL")
def strand_and_ends(spark, sf_dir):
    """A12, X21."""
    near = E.end_distance(F.col("distance"), 39 - F.col("distance")) < 10
    return B.aligned_bases(spark, sf_dir).groupBy("sample", "pos").agg(F.avg(F.col("is_reverse").cast("int")).alias("reverse"), F.count_if(near).alias("near_end"))


# -- CIGAR and indel candidates


@query("SELECT sample, chrom, pos, op, len, read, file_order FROM ev WHERE mapq >= 35")
def indel_events(spark, sf_dir):
    """X1, X2, X3, W2, F6, F11."""
    return N.indel_events(B.reads(spark, sf_dir))


@query("SELECT sample, chrom, pos, count(*) FILTER (WHERE op = 'I') AS ins, count(*) FILTER (WHERE op = 'D') AS del FROM ev WHERE mapq >= 35 GROUP BY ALL")
def indel_counting(spark, sf_dir):
    """A5."""
    e = N.indel_events(B.reads(spark, sf_dir))
    return e.groupBy("sample", "chrom", "pos").agg(F.count_if(F.col("op") == "I").alias("ins"), F.count_if(F.col("op") == "D").alias("del"))


@query("SELECT * FROM ie")
def indel_evidence(spark, sf_dir):
    """F7."""
    return N.indel_evidence(N.indel_events(B.reads(spark, sf_dir)))


@query("SELECT t.chrom, t.pos - 1 AS pos FROM (SELECT * FROM ie WHERE sample = 'T') t LEFT JOIN (SELECT * FROM ie WHERE sample = 'N') n ON t.chrom = n.chrom AND t.pos = n.pos WHERE n.cnt IS NULL OR abs(t.cnt - n.cnt) > 3")
def indel_candidates(spark, sf_dir):
    """J2."""
    return N.indel_candidates(N.indel_evidence(N.indel_events(B.reads(spark, sf_dir))))


@query("SELECT cigar, count(*) AS n, list_sum(list_transform(range(1, len(op) + 1), lambda k: CASE WHEN op[k] IN ('M', 'D', 'N', '=', 'X') THEN ln[k]::BIGINT ELSE 0 END))::BIGINT AS span, regexp_matches(cigar, '[ID]') AS has_indel, regexp_matches(cigar, '^(\\d+[SH])+$') AS all_clipped FROM cg GROUP BY cigar, op, ln")
def cigar_facts(spark, sf_dir):
    """X1, F11, F12."""
    c = F.col("cigar")
    return B.reads(spark, sf_dir).groupBy("cigar").agg(F.count("*").alias("n")).select("cigar", "n", C.reference_end(F.lit(0).cast("long"), c).alias("span"), C.has_indel(c).alias("has_indel"), C.fully_clipped(c).alias("all_clipped"))


@query(", d AS (SELECT DISTINCT sample, chrom, pos FROM ev WHERE mapq >= 35) SELECT sample, chrom, pos, least(pos - lag(pos) OVER w, lead(pos) OVER w - pos) AS nearest FROM d WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos)")
def nearest_indel(spark, sf_dir):
    """W4."""
    return V.nearest_indel(N.indel_events(B.reads(spark, sf_dir)))


@query(", v AS (SELECT chrom, pos, op, len, count(*) AS n FROM ev GROUP BY ALL) SELECT chrom, pos, 100.0::DOUBLE * (sum(n) - max(n)) / sum(n) AS disagree, max(len) AS max_len FROM v GROUP BY chrom, pos")
def seq_disagreement(spark, sf_dir):
    """A16."""
    e = N.indel_events(B.reads(spark, sf_dir).withColumn("mapq", F.lit(60)))
    return V.disagreement(e.select("chrom", "pos", F.col("op").alias("kind"), F.col("len").cast("string").alias("seq"), "len"))


@query(", v AS (SELECT sample, chrom, pos, op, len, count(*) AS n FROM ev GROUP BY ALL) SELECT sample, chrom, pos, op, len, n FROM (SELECT *, row_number() OVER (PARTITION BY sample, chrom, pos ORDER BY n DESC, op, len) AS i FROM v) WHERE i = 1")
def modal_indel(spark, sf_dir):
    """A10."""
    e = N.indel_events(B.reads(spark, sf_dir).withColumn("mapq", F.lit(60)))
    n = e.groupBy("sample", "chrom", "pos", "op", "len").agg(F.count("*").alias("n"))
    return R.first_by(n.withColumn("neg", -F.col("n")), ["sample", "chrom", "pos"], ["neg", "op", "len"]).drop("neg")


@query("SELECT chrom, pos, max(len) AS widest FROM ev WHERE op = 'I' GROUP BY ALL")
def max_insertion(spark, sf_dir):
    """Over both samples."""
    e = N.indel_events(B.reads(spark, sf_dir).withColumn("mapq", F.lit(60)))
    return e.filter("op = 'I'").groupBy("chrom", "pos").agg(F.max("len").alias("widest"))


@query(", w AS (SELECT chrom, pos, max(len) AS n FROM ev WHERE op = 'I' GROUP BY ALL) SELECT chrom, floor(pos / 1000)::BIGINT AS win, sum(CASE WHEN pos % 1000 < 500 THEN n ELSE 0 END)::BIGINT AS before, sum(CASE WHEN pos % 1000 >= 500 THEN n ELSE 0 END)::BIGINT AS after FROM w GROUP BY ALL")
def insertion_totals(spark, sf_dir):
    """A14."""
    w = max_insertion(spark, sf_dir)
    side = lambda c: F.sum(F.when(c, F.col("widest")).otherwise(F.lit(0)))
    return w.groupBy("chrom", F.floor(F.col("pos") / 1000).alias("win")).agg(side(F.col("pos") % 1000 < 500).alias("before"), side(F.col("pos") % 1000 >= 500).alias("after"))


@query(", w AS (SELECT chrom, pos, max(len) AS n FROM ev WHERE op = 'I' GROUP BY ALL) SELECT chrom, pos, coalesce(sum(n) OVER (PARTITION BY chrom, floor(pos / 1000) ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM w")
def insertion_shift(spark, sf_dir):
    """W8."""
    from pyspark.sql import Window as W

    w = W.partitionBy("chrom", F.floor(F.col("pos") / 1000)).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return max_insertion(spark, sf_dir).select("chrom", "pos", F.coalesce(F.sum("widest").over(w), F.lit(0)).alias("shift"))


# -- regions and joins


@query("SELECT chrom, s AS \"start\", CASE WHEN n < 10 THEN n - 1 ELSE least(s + greatest(1, n // 10) - 1, n - 1) END AS \"end\" FROM (SELECT chrom, n, unnest(CASE WHEN n < 10 THEN [0::BIGINT] ELSE range(0, n, greatest(1, n // 10)) END) AS s FROM (SELECT 'c' || p_partkey::VARCHAR AS chrom, (p_size * 7 + 1)::BIGINT AS n FROM part))")
def split_contigs(spark, sf_dir):
    """T4, S6."""
    p = B.table(spark, sf_dir, "part")
    return I.split_contigs(p.select(F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("chrom"), (F.col("p_size") * 7 + 1).cast("long").alias("length")))


@query(", o AS (SELECT row_number() OVER (ORDER BY idx) AS i, idx, chrom, \"start\", \"end\", \"end\" - \"start\" AS n FROM rg), f(i, run, b) AS (SELECT 1::BIGINT, (SELECT n FROM o WHERE i = 1), 0 UNION ALL SELECT f.i + 1, CASE WHEN f.run < 200 THEN f.run + o.n ELSE o.n END, CASE WHEN f.run >= 200 THEN f.b + 1 ELSE f.b END FROM f JOIN o ON o.i = f.i + 1) SELECT idx, b AS batch_id, chrom, \"start\", \"end\" - 1 AS \"end\" FROM o JOIN f USING (i)", recursive=True)
def bed_batches(spark, sf_dir):
    """S7, W1."""
    return I.batch_regions(B.regions(spark, sf_dir), 200)


@query("SELECT g.idx, count(*) AS n_reads, sum(r.mapq)::BIGINT AS sum_mapq FROM rg g JOIN (SELECT *, ref_start + 35 AS ref_end FROM rd) r ON r.chrom = g.chrom AND r.ref_start < g.\"end\" AND r.ref_end > g.\"start\" GROUP BY g.idx")
def region_overlap(spark, sf_dir):
    """S2, J3."""
    r = B.reads(spark, sf_dir).withColumn("ref_end", F.col("ref_start") + 35)
    g = B.regions(spark, sf_dir).select("idx", "chrom", F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    return I.overlap_join(g, r, 256).groupBy("idx").agg(F.count("*").alias("n_reads"), F.sum("mapq").alias("sum_mapq"))


@query("SELECT sample, count(*) AS n, min(ref_start) AS low, max(ref_start) AS high FROM rd WHERE chrom = 'chr1' AND ref_start < 3000 AND ref_start + 35 > 1000 GROUP BY sample")
def fetch_region(spark, sf_dir):
    """S2."""
    r = B.reads(spark, sf_dir).withColumn("ref_end", F.col("ref_start") + 35)
    return I.fetch(r, "chr1", 1000, 3000).groupBy("sample").agg(F.count("*").alias("n"), F.min("ref_start").alias("low"), F.max("ref_start").alias("high"))


@query("SELECT c.chrom, c.pos, upper(substr(rf.seq, (c.pos % 20 + 1)::INT, 1)) AS ref FROM (SELECT DISTINCT chrom, (pos * 20 + pos % 20)::BIGINT AS pos FROM pr) c LEFT JOIN rf ON rf.chrom = c.chrom AND rf.block_start = c.pos - c.pos % 20")
def reference_lookup(spark, sf_dir):
    """S4, S5, J10."""
    sites = B.predictions(spark, sf_dir).select("chrom", (F.col("pos") * 20 + F.col("pos") % 20).alias("pos")).distinct()
    return I.with_reference(sites, B.reference(spark, sf_dir), F.lit(1), B.BLOCK).select("chrom", "pos", F.nullif("ref", F.lit("")).alias("ref"))


@query("SELECT chrom, CASE WHEN chrom IN ('chrM', 'M') THEN 'MT' ELSE replace(chrom, 'chr', '') END AS bare, CASE chrom WHEN 'MT' THEN 'chrM' ELSE 'chr' || chrom END AS prefixed, count(*) AS n FROM (SELECT ['chr1', '2', 'MT', 'chrM', 'M', 'chrX', 'GL000207.1'][l_partkey % 7 + 1] AS chrom FROM lineitem) GROUP BY ALL")
def contig_alias(spark, sf_dir):
    """X23."""
    names = F.get(F.array(*map(F.lit, ("chr1", "2", "MT", "chrM", "M", "chrX", "GL000207.1"))), (F.col("l_partkey") % 7).cast("int"))
    per = B.table(spark, sf_dir, "lineitem").groupBy(names.alias("chrom")).agg(F.count("*").alias("n"))
    return per.select("chrom", E.without_chr(F.col("chrom")).alias("bare"), E.with_chr(F.col("chrom")).alias("prefixed"), "n")


@query("SELECT c.chrom, c.pos, upper(substr(rf.seq, (c.pos % 20 + 1)::INT, 1)) AS ref FROM (SELECT DISTINCT chrom, (pos * 20 + pos % 20)::BIGINT AS pos FROM pr) c LEFT JOIN rf ON rf.chrom = c.chrom AND rf.block_start = c.pos - c.pos % 20")
def reference_fallback(spark, sf_dir):
    """Sites named with chr, three of the reference's contigs named without it."""
    sites = B.predictions(spark, sf_dir).select("chrom", (F.col("pos") * 20 + F.col("pos") % 20).alias("pos")).distinct()
    bare = B.reference(spark, sf_dir).withColumn("chrom", F.when(F.col("chrom") > "chr1", E.without_chr(F.col("chrom"))).otherwise(F.col("chrom")))
    return I.with_reference(sites, bare, F.lit(1), B.BLOCK).select("chrom", "pos", F.nullif("ref", F.lit("")).alias("ref"))


_REGIONED = ", r2 AS (SELECT s_suppkey AS idx, 'chr' || (s_suppkey % 5)::VARCHAR AS chrom, s_suppkey * 200 AS s, s_suppkey * 200 + 40 + s_suppkey * 37 % 190 AS e FROM supplier)"


def _regions(spark, sf_dir):
    """Regions over the bridge's reads, some of them next to one another's ends, named without chr."""
    s = F.col("s_suppkey")
    return B.table(spark, sf_dir, "supplier").select(s.alias("idx"), (s % 5).cast("string").alias("chrom"), (s * 200).alias("start"), (s * 200 + 40 + s * 37 % 190).alias("end"))


@query(_REGIONED + """, e2 AS (
  SELECT idx, sample, ev.chrom, pos, count(*) AS cnt FROM ev JOIN r2 ON r2.chrom = ev.chrom AND pos >= s AND pos < e - 1 WHERE mapq >= 35 GROUP BY ALL
  HAVING count(*) FILTER (WHERE op = 'I') >= 2 OR count(*) FILTER (WHERE op = 'D') >= 2
) SELECT t.chrom, t.pos - 1 AS pos, t.idx FROM (SELECT * FROM e2 WHERE sample = 'T') t LEFT JOIN (SELECT * FROM e2 WHERE sample = 'N') n ON t.idx = n.idx AND t.chrom = n.chrom AND t.pos = n.pos WHERE n.cnt IS NULL OR abs(t.cnt - n.cnt) > 3""".replace(", t.idx", ""))
def indel_candidates_in_regions(spark, sf_dir):
    """Regions test the event, not the base before it, without a region's last base."""
    from .pipeline import indel_candidates

    return indel_candidates(_sequenced(spark, sf_dir).drop("quals", "flag"), regions=_regions(spark, sf_dir))


# -- call statistics and the germline test

_TUMOR = """, st AS (
  SELECT chrom, pos, ['A', 'C', 'G', 'T'][pos % 4 + 1] AS ref, t, list_sum(t)::BIGINT AS dp, (pos % 4 + 1)::INT AS ri
  FROM (SELECT chrom, pos, [count(*) FILTER (WHERE base = 0), count(*) FILTER (WHERE base = 1), count(*) FILTER (WHERE base = 2), count(*) FILTER (WHERE base = 3)] AS t FROM ab WHERE sample = 'T' AND baseq >= 15 GROUP BY ALL)
), ao AS (SELECT *, list_max(list_filter(t, lambda x, i: i <> ri)) AS ao FROM st),
ss AS (SELECT chrom, pos, ref, ['A', 'C', 'G', 'T'][list_position(t, ao)] AS alt, dp, t[ri] AS ro, ao, CASE WHEN dp = 0 THEN 0 ELSE printf('%.4f', ao::DOUBLE / dp::DOUBLE)::DOUBLE END AS af FROM ao),
ca AS (
  SELECT p.chrom, p.pos, p.idx, ['A', 'C', 'G', 'T'][p.pos % 4 + 1] AS ref, coalesce(alt, 'A') AS alt, pred_true AS score, CASE WHEN pred_true >= 0.5 THEN 'PASS' ELSE 'REJECT' END AS filter, coalesce(dp, 0) AS dp, coalesce(ro, 0) AS ro, coalesce(ao, 0) AS ao, coalesce(af, 0) AS af
  FROM pr p LEFT JOIN (SELECT * FROM ss WHERE pos % 11 <> 0) x ON x.chrom = p.chrom AND x.pos = p.pos WHERE pred_true >= 0.3
)"""


def _tumor(spark, sf_dir):
    bases = B.aligned_bases(spark, sf_dir).filter("sample = 'T' and baseq >= 15")
    return bases.groupBy("chrom", "pos").agg(P.counts(F.lit(True)).alias("counts")).withColumn("ref", _letter((F.col("pos") % 4).cast("int")))


def _calls(spark, sf_dir, rejected):
    """Calls of predictions that keep their idx; every eleventh position has no tumor read."""
    p = B.predictions(spark, sf_dir)
    ref = p.select("chrom", "pos", _letter((F.col("pos") % 4).cast("int")).alias("ref")).distinct()
    return K.snv_calls(p, _tumor(spark, sf_dir).filter("pos % 11 <> 0"), ref, rejected)


@query(_TUMOR + " SELECT * FROM ss")
def snv_site_stats(spark, sf_dir):
    """A7."""
    return K.with_snv_stats(_tumor(spark, sf_dir)).drop("counts")


_NORMAL = ", nn AS (SELECT chrom, pos, printf('%.4f', count(*) FILTER (WHERE base <> pos % 4)::DOUBLE / count(*)::DOUBLE)::DOUBLE AS snp_af, CASE WHEN pos % 6 = 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS indel_af, pos % 9 AS indel_len FROM ab WHERE sample = 'N' GROUP BY chrom, pos), gr AS (SELECT DISTINCT p.chrom, p.pos FROM pr p JOIN nn ON nn.chrom = p.chrom AND nn.pos BETWEEN greatest(p.pos - 9, 1) AND p.pos + 1 WHERE ((nn.snp_af > 0.1::DOUBLE OR nn.indel_af > 0.1::DOUBLE) AND abs(nn.pos - p.pos) <= 1) OR (nn.indel_af > 0.1::DOUBLE AND nn.indel_af > nn.snp_af AND nn.pos + nn.indel_len + 1 >= p.pos))"


def _normal(spark, sf_dir):
    per = B.aligned_bases(spark, sf_dir).filter("sample = 'N'").groupBy("chrom", "pos").agg(F.count("*").alias("d"), F.count_if(F.col("base") != F.col("pos") % 4).alias("o"))
    return per.select("chrom", "pos", E.ratio4(F.col("o"), F.col("d")).alias("snp_af"), F.when(F.col("pos") % 6 == 0, F.lit(0.2)).otherwise(F.lit(0.0)).alias("indel_af"), (F.col("pos") % 9).alias("indel_len"))


@query(_NORMAL + " SELECT * FROM gr")
def germline_filter(spark, sf_dir):
    """J4, A9, X20."""
    return K.germline_rejected(B.predictions(spark, sf_dir).select("chrom", "pos"), _normal(spark, sf_dir))


@query("SELECT chrom, pos, idx, pred_true AS score, CASE WHEN pred_true >= 0.5 THEN 'PASS' ELSE 'REJECT' END AS filter FROM pr WHERE pred_true >= 0.3")
def score_cutoff(spark, sf_dir):
    """S9, F8, F9."""
    return K.scored(B.predictions(spark, sf_dir), Calling()).select("chrom", "pos", "idx", "score", "filter")


@query(_TUMOR + _NORMAL + " SELECT * EXCLUDE (idx) FROM ca WHERE NOT EXISTS (SELECT 1 FROM gr WHERE gr.chrom = ca.chrom AND gr.pos = ca.pos)")
def snv_calls(spark, sf_dir):
    """J9, F8, F9, J4, A7, with sites of no depth."""
    return _calls(spark, sf_dir, K.germline_rejected(B.predictions(spark, sf_dir).select("chrom", "pos"), _normal(spark, sf_dir)))


@query(_TUMOR + " SELECT p.chrom, p.pos, alt, pred_true AS score, af FROM pr p JOIN ss ON ss.chrom = p.chrom AND ss.pos = p.pos WHERE pred_true >= 0.3 AND af >= 0.03::DOUBLE")
def indel_af_gate(spark, sf_dir):
    """F10."""
    none = spark.createDataFrame([], "chrom string, pos long")
    stats = K.with_snv_stats(_tumor(spark, sf_dir))
    return K.indel_calls(B.predictions(spark, sf_dir), stats, none).select("chrom", "pos", "alt", "score", "af")


@query(_TUMOR + ", tx AS (SELECT *, CASE WHEN dp > 0 THEN af::VARCHAR ELSE '0' END AS aft FROM ca) SELECT chrom, pos + 1 AS pos, '.' AS id, ref, alt, '.' AS qual, filter, 'TYPE=SNV;SCORE=' || score::VARCHAR || ';DP=' || dp::VARCHAR || ';RO=' || ro::VARCHAR || ';AO=' || ao::VARCHAR || ';AF=' || aft || ';' AS info, 'GT:DP:RO:AO:AF' AS format, '0/1:' || dp::VARCHAR || ':' || ro::VARCHAR || ':' || ao::VARCHAR || ':' || aft AS sample FROM tx")
def vcf_projection(spark, sf_dir):
    """Whole VCF rows."""
    return K.vcf_rows(_calls(spark, sf_dir, spark.createDataFrame([], "chrom string, pos long")), "SNV")


@query("SELECT a, d, CASE WHEN d = 0 THEN 0 ELSE printf('%.4f', a::DOUBLE / d::DOUBLE)::DOUBLE END AS ratio, printf('%.4f', a::DOUBLE / greatest(d, 1)::DOUBLE)::DOUBLE::VARCHAR AS shown, count(*) AS n FROM (SELECT l_partkey % 700 AS d, l_suppkey * 7 % (l_partkey % 700 + 1) AS a FROM lineitem) GROUP BY ALL")
def ratio_text(spark, sf_dir):
    """Ratios rounded to four places on the binary value, and their text."""
    d = F.col("l_partkey") % 700
    rows = B.table(spark, sf_dir, "lineitem").groupBy(d.alias("d"), (F.col("l_suppkey") * 7 % (d + 1)).alias("a")).agg(F.count("*").alias("n"))
    return rows.select("a", "d", E.ratio4(F.col("a"), F.col("d")).alias("ratio"), E.number_text(F.col("a") / F.greatest("d", F.lit(1))).alias("shown"), "n")


@query("SELECT op, len, CASE op WHEN 'D' THEN upper(substr(seq, 1, (len + 1)::INT)) ELSE upper(substr(seq, 1, 1)) END AS ref, CASE op WHEN 'D' THEN upper(substr(seq, 1, 1)) ELSE upper(substr(seq, 1, 1)) || repeat('T', len::INT) END AS alt, count(*) AS n FROM ev JOIN rf ON rf.block_start = ev.pos - ev.pos % 20 AND rf.chrom = ev.chrom GROUP BY ALL")
def indel_alleles(spark, sf_dir):
    """X18, X19."""
    e = N.indel_events(B.reads(spark, sf_dir).withColumn("mapq", F.lit(60)))
    r = B.reference(spark, sf_dir).withColumnRenamed("block_start", "b")
    met = e.withColumn("b", F.col("pos") - F.col("pos") % 20).join(r, ["chrom", "b"]).withColumn("seq", F.upper("seq"))
    out = K.indel_alleles(F.col("op"), F.col("len"), F.expr("repeat('T', cast(len as int))"), F.col("seq"))
    return met.select("op", "len", *[v.alias(k) for k, v in out.items()]).groupBy("op", "len", "ref", "alt").agg(F.count("*").alias("n"))


# -- order, dedupe, sampling


@query(", o AS (SELECT idx, chrom, pos, row_number() OVER (ORDER BY pos, chrom, idx) - 1 AS r, count(*) OVER () AS c FROM pr) SELECT idx, chrom, pos, (CASE WHEN r < (c % 100) * (c // 100 + 1) THEN r // (c // 100 + 1) ELSE c % 100 + (r - (c % 100) * (c // 100 + 1)) // greatest(c // 100, 1) END)::INT AS batch_id FROM o")
def candidate_batches(spark, sf_dir):
    """T1, T2."""
    return R.in_batches(B.predictions(spark, sf_dir).select("idx", "chrom", "pos"), 100, ("pos", "chrom", "idx"))


@query("SELECT batch_id, chrom, pos, pred_true, idx FROM (SELECT *, idx % 7 AS batch_id, row_number() OVER (PARTITION BY idx % 7, chrom, pos ORDER BY idx) AS i FROM pr) WHERE i = 1")
def dedupe_predictions(spark, sf_dir):
    """A17, K4."""
    return R.dedupe_predictions(B.predictions(spark, sf_dir).withColumn("batch_id", F.col("idx") % 7)).select("batch_id", "chrom", "pos", "pred_true", "idx")


@query("SELECT sample, chrom, query_name, file_order, ref_start FROM (SELECT *, row_number() OVER (PARTITION BY sample, chrom, query_name ORDER BY file_order, ref_start, tie, tie2) AS i FROM rd) WHERE i = 1")
def dedupe_reads(spark, sf_dir):
    """A18."""
    return R.first_by(B.reads(spark, sf_dir), ["sample", "chrom", "query_name"], ["file_order", "ref_start", "tie", "tie2"]).select("sample", "chrom", "query_name", "file_order", "ref_start")


@query("SELECT idx, chrom, pos FROM pr WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.chrom = pr.chrom AND tr.pos = pr.pos)")
def resume_anti_join(spark, sf_dir):
    """J5, K9, U5."""
    return R.not_done(B.predictions(spark, sf_dir).select("idx", "chrom", "pos"), B.truth(spark, sf_dir)).select("idx", "chrom", "pos")


@query("SELECT (SELECT count(*) FROM pr) AS predicted, (SELECT count(*) FROM tr) AS wanted, (SELECT count(*) FROM pr) >= (SELECT count(*) FROM tr) AS complete")
def completeness(spark, sf_dir):
    """F15."""
    n, m = (df.agg(F.count("*").alias(c)) for df, c in ((B.predictions(spark, sf_dir), "predicted"), (B.truth(spark, sf_dir), "wanted")))
    return n.crossJoin(m).withColumn("complete", F.col("predicted") >= F.col("wanted"))  # two single rows


@query("SELECT sample, chrom, pos, file_order, l_linenumber, (r - 1)::INT AS \"row\" FROM (SELECT *, row_number() OVER (PARTITION BY sample, chrom, pos ORDER BY file_order, l_linenumber, mapq, distance, base, baseq) AS r FROM ab) WHERE r <= 10")
def row_stacking(spark, sf_dir):
    """W6, T5, W9."""
    b = B.aligned_bases(spark, sf_dir).withColumn("file_order", F.struct("file_order", "l_linenumber", "mapq", "distance", "base", "baseq"))
    return R.stacked(b, ["sample", "chrom", "pos"], 10).select("sample", "chrom", "pos", F.col("file_order.file_order").alias("file_order"), F.col("file_order.l_linenumber").alias("l_linenumber"), "row")


@query("SELECT chrom, col, \"row\", count(*) AS n FROM (SELECT chrom, distance AS col, (row_number() OVER (PARTITION BY chrom, pos, distance ORDER BY file_order, l_linenumber) - 1)::INT AS \"row\" FROM ab) GROUP BY ALL")
def tetris_stacking(spark, sf_dir):
    """W7."""
    b = B.aligned_bases(spark, sf_dir).withColumn("col", F.col("distance"))
    return R.tetris(b, ["chrom", "pos"]).groupBy("chrom", "col", "row").agg(F.count("*").alias("n"))


@query("SELECT sample, chrom, pos, sum(file_order)::BIGINT AS total FROM ab GROUP BY ALL HAVING count(*) <= 12")
def small_sites_unsampled(spark, sf_dir):
    """T6 where nothing is to draw: sites with no more reads than the limit stay whole."""
    b = R.sample_reads(B.aligned_bases(spark, sf_dir), ["sample", "chrom", "pos"], 12)
    n = b.groupBy("sample", "chrom", "pos").agg(F.sum("file_order").alias("total"))
    few = B.aligned_bases(spark, sf_dir).groupBy("sample", "chrom", "pos").agg(F.count("*").alias("n")).filter("n <= 12").drop("n")
    return n.join(few, ["sample", "chrom", "pos"], "left_semi")


@query(Q.SEEDED_SAMPLE)
def seeded_sample(spark, sf_dir):
    """Which reads a seeded draw keeps."""
    b = B.aligned_bases(spark, sf_dir).withColumn("file_order", F.struct("file_order", "l_linenumber", "mapq", "distance", "base", "baseq"))
    return R.sample_reads(b, ["sample", "chrom", "pos"], 12, 1).select("sample", "chrom", "pos", F.col("file_order.file_order").alias("file_order"))


@query("SELECT o, chrom, pos FROM (SELECT 0 AS o, chrom, pos FROM pr UNION ALL SELECT 1, chrom, pos - 1 FROM ie WHERE sample = 'T')")
def union_calls(spark, sf_dir):
    """U1, U2."""
    t = N.indel_evidence(N.indel_events(B.reads(spark, sf_dir))).filter("sample = 'T'").select("chrom", (F.col("pos") - 1).alias("pos"))
    return K.vcf_union(B.predictions(spark, sf_dir).select("chrom", "pos"), t).withColumnRenamed("ord", "o")


# -- evaluation


@query("SELECT (SELECT count(*) FROM pr) AS candidates, (SELECT count(*) FROM tr) AS truths, (SELECT count(*) FROM pr JOIN tr ON tr.chrom = pr.chrom AND tr.pos = pr.pos) AS common")
def truth_intersection(spark, sf_dir):
    """J6, U4."""
    return V.truth_overlap(B.predictions(spark, sf_dir).select("chrom", "pos"), B.truth(spark, sf_dir))


@query("SELECT chrom, pos, 1.0::DOUBLE AS label FROM tr UNION ALL SELECT chrom, pos, 0.0::DOUBLE FROM pr WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.chrom = pr.chrom AND tr.pos = pr.pos)")
def goldset_labels(spark, sf_dir):
    """J7, U5, S13."""
    return V.goldset_labels(B.truth(spark, sf_dir), B.predictions(spark, sf_dir))


@query("SELECT pr.chrom, pr.pos, CASE WHEN tr.pos IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label FROM pr LEFT JOIN tr ON tr.chrom = pr.chrom AND tr.pos = pr.pos")
def membership_labels(spark, sf_dir):
    """J8."""
    return V.membership_labels(B.predictions(spark, sf_dir), B.truth(spark, sf_dir))


_LABELLED = ", lb AS (SELECT pr.chrom, pr.pos, pr.idx, CASE WHEN tr.pos IS NULL THEN 0 ELSE 1 END AS label FROM pr LEFT JOIN tr ON tr.chrom = pr.chrom AND tr.pos = pr.pos), sz AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM lb), rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY idx) AS i FROM lb)"


def _labelled(spark, sf_dir):
    p, t = B.predictions(spark, sf_dir), B.truth(spark, sf_dir).select("chrom", "pos", F.lit(1).alias("k"))
    return p.join(t, ["chrom", "pos"], "left").select("chrom", "pos", "idx", "pred_true", F.coalesce("k", F.lit(0)).alias("label"))


@query(_LABELLED + " SELECT chrom, pos, idx, label FROM rk, sz WHERE i <= least(p, q)")
def balance_classes(spark, sf_dir):
    """T8."""
    return V.balanced(_labelled(spark, sf_dir).drop("pred_true"), ["idx"])


@query(_LABELLED + " SELECT chrom, pos, idx, label FROM rk, sz WHERE label = 1 OR i <= p")
def balance_keep_positives(spark, sf_dir):
    """T9."""
    return V.balanced(_labelled(spark, sf_dir).drop("pred_true"), ["idx"], minority_only=False)


_PR = ", sc AS (SELECT pred_true AS s, count(tr.pos) AS p, count(*) - count(tr.pos) AS q FROM pr LEFT JOIN tr ON tr.chrom = pr.chrom AND tr.pos = pr.pos GROUP BY ALL), cu AS (SELECT s AS threshold, (sum(p) OVER w)::BIGINT AS tp, (sum(q) OVER w)::BIGINT AS fp, (sum(p) OVER ())::BIGINT AS total FROM sc WINDOW w AS (ORDER BY s DESC)), pc AS (SELECT threshold, tp, fp, tp::DOUBLE / (tp + fp)::DOUBLE AS precision, tp::DOUBLE / total::DOUBLE AS recall FROM cu), fc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pc)"


@query(_PR + " SELECT * FROM fc")
def pr_curve(spark, sf_dir):
    """W3, A22."""
    return V.pr_curve(_labelled(spark, sf_dir).select(F.col("pred_true").alias("score"), "label"))


@query(_PR + " SELECT * FROM fc ORDER BY f1 DESC, threshold DESC LIMIT 1")
def best_f1(spark, sf_dir):
    """A22, M16."""
    return V.best_threshold(pr_curve(spark, sf_dir))


@query(""", sc AS (SELECT pr.chrom, pred_true AS s, count(tr.pos) AS p, count(*) - count(tr.pos) AS q FROM pr LEFT JOIN tr ON tr.chrom = pr.chrom AND tr.pos = pr.pos GROUP BY ALL),
cu AS (SELECT chrom, s AS threshold, (sum(p) OVER w)::BIGINT AS tp, (sum(q) OVER w)::BIGINT AS fp, (sum(p) OVER (PARTITION BY chrom))::BIGINT AS total, (sum(p + q) OVER (PARTITION BY chrom))::BIGINT AS positions FROM sc WINDOW w AS (PARTITION BY chrom ORDER BY s DESC)),
pc AS (SELECT *, tp::DOUBLE / (tp + fp)::DOUBLE AS precision, CASE WHEN total > 0 THEN tp::DOUBLE / total::DOUBLE ELSE 0 END AS recall FROM cu),
fc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pc)
SELECT chrom AS "set", threshold, f1, precision, recall, total AS mutations, positions FROM fc WHERE chrom IN ('chr1', 'chr2', 'chr3') QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY f1 DESC, threshold DESC) = 1""")
def benchmark_sets(spark, sf_dir):
    """The best threshold of each of some test sets, here the contigs."""
    scores = _labelled(spark, sf_dir).select("chrom", F.col("pred_true").alias("score"), "label")
    return V.benchmarks({c: scores.filter(F.col("chrom") == c) for c in ("chr1", "chr2", "chr3")})


@query("SELECT chrom, pos, floor(avg(pred_true) * 1000000 + 0.25)::BIGINT AS mean_millionths, median(pred_true) AS median_score FROM pr GROUP BY ALL")
def replicate_scores(spark, sf_dir):
    """A19, A20."""
    return V.replicate_scores(B.predictions(spark, sf_dir).withColumnRenamed("pred_true", "score")).select("chrom", "pos", F.floor(F.col("mean_score") * 1000000 + 0.25).alias("mean_millionths"), "median_score")


@query("SELECT chrom, round(avg(-(pred_true * log2(pred_true) + (1 - pred_true) * log2(1 - pred_true))), 6) AS entropy FROM pr WHERE pred_true > 0 AND pred_true < 1 GROUP BY chrom")
def entropy(spark, sf_dir):
    """A23."""
    return B.predictions(spark, sf_dir).groupBy("chrom").agg(F.round(F.avg(E.binary_entropy(F.col("pred_true"))), 6).alias("entropy"))


# -- encodings and tensors


@query("SELECT base, is_reverse, mapq, baseq, count(*) AS n, CASE base WHEN 0 THEN 245 WHEN 2 THEN 175 WHEN 3 THEN 105 ELSE 35 END AS snv, CASE base WHEN 0 THEN 250 WHEN 2 THEN 220 WHEN 3 THEN 190 ELSE 160 END AS matched, CASE base WHEN 0 THEN 130 WHEN 2 THEN 100 WHEN 3 THEN 70 ELSE 40 END AS inserted, floor(255.0::DOUBLE * (least(45, baseq)::DOUBLE / 45.0::DOUBLE))::INT AS quality, floor(255.0::DOUBLE * (least(45, mapq)::DOUBLE / 45.0::DOUBLE))::INT AS mapping, CASE WHEN is_reverse THEN 250 ELSE 125 END AS strand FROM ab GROUP BY base, is_reverse, mapq, baseq")
def colours(spark, sf_dir):
    """X6-X12."""
    b = B.aligned_bases(spark, sf_dir).groupBy("base", "is_reverse", "mapq", "baseq").agg(F.count("*").alias("n"))
    x = _letter(F.col("base"))
    return b.select("*", E.snv_colour(x).alias("snv"), E.match_colour(x).alias("matched"), E.insert_colour(x).alias("inserted"), E.quality_colour(F.col("baseq")).alias("quality"), E.mapq_colour(F.col("mapq")).alias("mapping"), E.strand_colour(F.col("is_reverse")).alias("strand"))


@query("SELECT chrom, pos, distance AS col, avg((base = 0)::INT) AS \"A\", avg((base = 3)::INT) AS \"T\", avg((base = 2)::INT) AS \"G\", avg((base = 1)::INT) AS \"C\" FROM ab GROUP BY ALL")
def allele_fractions(spark, sf_dir):
    """A21."""
    return M.allele_fractions(B.aligned_bases(spark, sf_dir).select("chrom", "pos", F.col("distance").alias("col"), _letter(F.col("base")).alias("base")))


def _sequenced(spark, sf_dir):
    """Bridge reads with bases and qualities."""
    r = B.reads(spark, sf_dir)
    n = F.aggregate(C.parts(F.col("cigar")), F.lit(0).cast("long"), lambda a, x: a + F.when(x["op"] == "D", F.lit(0)).otherwise(x["len"]))
    letters = F.translate(F.md5(F.concat("query_name", F.lit(":"), F.col("ref_start").cast("string")).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    r = r.withColumns({"file_order": F.struct("file_order", "tie", "tie2"), "n": n.cast("int"), "flag": F.when(F.col("is_reverse"), 16).otherwise(0)})
    return r.withColumn("seq", F.substring(F.concat(letters, letters), F.lit(1), F.col("n"))).withColumn("quals", F.transform(F.sequence(F.lit(1), "n"), lambda i: (20 + (i * 7 + F.col("mapq")) % 26).cast("int"))).drop("n").withColumn("ref_end", C.reference_end(F.col("ref_start"), F.col("cigar")))


def _sites(spark, sf_dir):
    return N.indel_candidates(N.indel_evidence(N.indel_events(B.reads(spark, sf_dir))))


def _sums(channels: int = 5) -> M.Then:
    """Channel totals of each tensor, plain and weighted by the place of a cell."""
    names = [f"{k}{c}" for c in range(channels) for k in "cw"]

    def digest(images: np.ndarray) -> list:
        cells = images.reshape(len(images), -1, channels).astype("f8")
        place = np.arange(1, cells.shape[1] + 1, dtype="f8")
        both = np.stack([cells.sum(axis=1), place @ cells], axis=2).reshape(len(cells), 2 * channels)
        return [pa.array([cells.shape[1] * channels] * len(cells), pa.int32()), *both.T.copy()]

    return digest, "cells int, " + ", ".join(f"{n} double" for n in names)


@query(Q.SNV_PX + Q.SNV_SUMS)
def snv_tensors(spark, sf_dir):
    """M1-M6, X4, X5, W5, J3, A18, T6."""
    return M.snv_tensors(_sites(spark, sf_dir), _sequenced(spark, sf_dir), B.reference(spark, sf_dir), B.BLOCK, then=_sums())


@query(Q.FALLEN_PX + Q.FALLEN_SUMS)
def fallen_tensors(spark, sf_dir):
    """Images of few rows where each base falls to the next free one of its column, with channels of allele fractions."""
    from .pipeline import snv_images

    cfg = SnvTensor(rows=Q.FALLEN_ROWS, falling=True, allele_fractions=True)
    return snv_images(_sites(spark, sf_dir), _sequenced(spark, sf_dir), B.reference(spark, sf_dir), B.BLOCK, cfg, then=_sums(9))


@query(Q.SPIKED_PX + Q.SNV_SUMS)
def spiked_tensors(spark, sf_dir):
    """Images with a variant put into the tumor's reads."""
    from .pipeline import snv_images

    reference = B.reference(spark, sf_dir)
    sites = I.with_reference(_sites(spark, sf_dir).select("chrom", "pos"), reference, F.lit(1), B.BLOCK)
    sites = sites.select("chrom", "pos", F.translate(F.upper("ref"), "ACGT", "CGTA").alias("variant"), ((F.col("pos") % 10) / F.lit(10.0)).alias("share"))
    return snv_images(sites, _sequenced(spark, sf_dir), reference, B.BLOCK, spike=True, then=_sums())


@query(Q.INDEL_PX + Q.INDEL_SUMS)
def indel_tensors(spark, sf_dir):
    """M7-M9, A13, A14, W5, W8."""
    return M.indel_tensors(_sites(spark, sf_dir), _sequenced(spark, sf_dir), B.reference(spark, sf_dir), B.BLOCK, then=_sums())


_SWEPT = Q.SITES + """
, bb AS (
  SELECT sample, chrom, mapq, ref_start + ref_off + k AS pos, strpos('ACGT', substr(letters || letters, read_off + k + 1, 1)) AS b, 20 + ((read_off + k + 1) * 7 + mapq) % 26 AS q
  FROM (
    SELECT sq.*, op[i] AS o, ln[i]::BIGINT AS n,
           coalesce(list_sum(list_transform(range(1, i), lambda k: CASE WHEN op[k] IN ('M', 'D') THEN ln[k]::BIGINT ELSE 0 END)), 0)::BIGINT AS ref_off,
           coalesce(list_sum(list_transform(range(1, i), lambda k: CASE WHEN op[k] = 'D' THEN 0 ELSE ln[k]::BIGINT END)), 0)::BIGINT AS read_off
    FROM sq, unnest(range(1, len(op) + 1)) AS u(i)
  ), unnest(range(0, n)) AS v(k) WHERE o = 'M'
)"""


@query(_SWEPT + " SELECT sample, chrom, pos, count(*) FILTER (WHERE b = 1) AS a, count(*) FILTER (WHERE b = 2) AS c, count(*) FILTER (WHERE b = 3) AS g, count(*) FILTER (WHERE b = 4) AS t, count(*) AS depth FROM bb WHERE q >= 22 AND mapq >= 10 GROUP BY ALL")
def sweep_pileup(spark, sf_dir):
    """A1, A3, F1 over whole reads, counted in batches."""
    reads = _sequenced(spark, sf_dir)
    return W.coverage_sweep(reads.filter(P.passes_check(F.col("flag"), F.col("mapq"))))


@query(_SWEPT + """, pp AS (
  SELECT chrom, pos, """ + ", ".join(f"[{', '.join(f"count(*) FILTER (WHERE sample = '{s}' AND b = {i})" for i in range(1, 5))}] AS {s.lower()}" for s in "NT") + """ FROM bb WHERE q >= 22 AND mapq >= 10 GROUP BY ALL
) SELECT chrom, pos FROM (SELECT *, list_sum(n) AS nd, list_sum(t) AS td, list_position(n, list_max(n)) AS top FROM pp) WHERE nd >= 7 AND td >= 7
  AND len(list_filter([1, 2, 3, 4], lambda j: j <> top AND t[j]::DOUBLE / td::DOUBLE >= 0.035::DOUBLE AND t[j] >= 2 AND n[j]::DOUBLE / nd::DOUBLE <= 0.05::DOUBLE)) > 0""")
def sweep_snv_candidates(spark, sf_dir):
    """F1, A1, A3, A4, J1, F4, F5 from reads to candidates, as the filter command runs them."""
    from .pipeline import snv_candidates

    return snv_candidates(_sequenced(spark, sf_dir))


@query(Q.SITES + """
, pp AS (
  SELECT o AS op, CASE WHEN o <> 'D' THEN read_off + k END AS rp, CASE WHEN o <> 'I' THEN ref_start + ref_off + k END AS gp, CASE WHEN o <> 'D' THEN substr(letters || letters, read_off + k + 1, 1) END AS b
  FROM (
    SELECT sq.*, op[i] AS o, ln[i]::BIGINT AS n,
           coalesce(list_sum(list_transform(range(1, i), lambda k: CASE WHEN op[k] IN ('M', 'D') THEN ln[k]::BIGINT ELSE 0 END)), 0)::BIGINT AS ref_off,
           coalesce(list_sum(list_transform(range(1, i), lambda k: CASE WHEN op[k] = 'D' THEN 0 ELSE ln[k]::BIGINT END)), 0)::BIGINT AS read_off
    FROM sq, unnest(range(1, len(op) + 1)) AS u(i)
  ), unnest(range(0, n)) AS v(k) WHERE o <> 'S'
) SELECT op, CASE WHEN op = 'D' THEN 10 ELSE CASE b WHEN 'A' THEN 245 WHEN 'G' THEN 175 WHEN 'T' THEN 105 ELSE 35 END END AS value, count(*) AS n, sum(rp)::BIGINT AS read_sum, sum(gp)::BIGINT AS ref_sum FROM pp GROUP BY ALL""")
def trimmed_pairs(spark, sf_dir):
    """Aligned columns without outer soft clips, with the colour that each gets."""
    return T.colour_totals(_sequenced(spark, sf_dir))


@query(""", ww AS (
  SELECT a.chrom, a.block_start + i AS pos, substr(upper(a.seq || coalesce(b.seq, '')), (i + 1)::INT, 12) AS s
  FROM rf a LEFT JOIN rf b ON a.chrom = b.chrom AND b.block_start = a.block_start + 20, unnest(range(0, 20)) AS u(i)
), cc AS (
  SELECT chrom, pos, b, sum(cos(2 * pi() * 4 * j / 12) * (substr(s, (j + 1)::INT, 1) = b)::INT) AS re, sum(sin(2 * pi() * 4 * j / 12) * (substr(s, (j + 1)::INT, 1) = b)::INT) AS im
  FROM ww, unnest(['A', 'C', 'G', 'T']) AS v(b), unnest(range(0, 12)) AS w(j) WHERE length(s) = 12 GROUP BY ALL
) SELECT chrom, pos, round_even(sum(re * re + im * im), 6) AS power FROM cc GROUP BY chrom, pos""")
def fourier_power(spark, sf_dir):
    """X15, carried out: the power of the period of three."""
    return FP.fourier_power(B.reference(spark, sf_dir), B.BLOCK).select("chrom", "pos", F.bround("power", 6).alias("power"))


@query(Q.INDEL_STATS)
def indel_site_stats(spark, sf_dir):
    """A8, A10, X18, X19."""
    from .pipeline import indel_sites

    return indel_sites(_sites(spark, sf_dir), _sequenced(spark, sf_dir), "T", B.reference(spark, sf_dir), B.BLOCK)


@query(Q.SNV_PX + Q.SNV_NET.sql())
def scored_sites(spark, sf_dir):
    """A small branched network with weights by a rule, as none are public."""
    then = S.scored(spark, Q.SNV_NET.graph(), (100, 70, 5))
    t = M.snv_tensors(_sites(spark, sf_dir), _sequenced(spark, sf_dir), B.reference(spark, sf_dir), B.BLOCK, then=then)
    return t.select("chrom", "pos", F.bround("pred_true", 6).alias("pred_true"))


ENTRY = snv_candidates
DEFAULTS = SnvFilter()


@query(Q.INDEL_PX + Q.INDEL_NET.sql())
def scored_indels(spark, sf_dir):
    """The same over wider images."""
    then = S.scored(spark, Q.INDEL_NET.graph(), (140, 150, 5))
    t = M.indel_tensors(_sites(spark, sf_dir), _sequenced(spark, sf_dir), B.reference(spark, sf_dir), B.BLOCK, then=then)
    return t.select("chrom", "pos", F.bround("pred_true", 6).alias("pred_true"))


@query(Q.SNV_PX + f"SELECT s.*, (k.p IS NOT NULL)::INT::DOUBLE AS label FROM ({Q.SNV_SUMS}) s LEFT JOIN (SELECT DISTINCT chrom AS c, pos * 20 + 10 AS p FROM tr) k ON k.c = s.chrom AND k.p = s.pos")
def training_set(spark, sf_dir):
    """Tensors with the labels of their sites."""
    labels = V.membership_labels(_sites(spark, sf_dir), _true_indels(spark, sf_dir))
    t = M.snv_tensors(labels, _sequenced(spark, sf_dir), B.reference(spark, sf_dir), B.BLOCK, then=_sums(), keep=("label",))
    return t.select("chrom", "pos", "cells", *[f"{k}{c}" for c in range(5) for k in "cw"], "label")


# -- read rules, totals and indel features


def _true_indels(spark, sf_dir):
    """Truth sites where the bridge's reads have their indels."""
    return B.truth(spark, sf_dir).select("chrom", (F.col("pos") * 20 + 10).alias("pos"))


def _flagged(spark, sf_dir):
    """Bridge reads with flags and ends."""
    r = B.reads(spark, sf_dir)
    return r.withColumns({"flag": (F.col("file_order") * 37 % 4096).cast("int"), "ref_end": F.col("ref_start") + 35})


@query("SELECT sample, count(*) AS n, count(*) FILTER (WHERE ((file_order * 37 % 4096) & 3332) = 0) AS usable FROM rd GROUP BY sample")
def usable_reads(spark, sf_dir):
    """F2."""
    return _flagged(spark, sf_dir).groupBy("sample").agg(F.count("*").alias("n"), F.count_if(P.is_usable(F.col("flag"))).alias("usable"))


@query(", c AS (SELECT cigar || CASE WHEN mapq % 2 = 0 THEN '3S4M' ELSE '4S' END AS cigar FROM rd), p AS (SELECT cigar, regexp_extract_all(cigar, '[MIDNSHP=X]') AS op FROM c) SELECT cigar, len(list_filter(range(2, len(op)), lambda i: op[i] IN ('S', 'H'))) > 0 AS middle, count(*) AS n FROM p GROUP BY ALL")
def clips_in_the_middle(spark, sf_dir):
    """F13."""
    tail = F.when(F.col("mapq") % 2 == 0, F.lit("3S4M")).otherwise(F.lit("4S"))
    c = B.reads(spark, sf_dir).select(F.concat("cigar", tail).alias("cigar"))
    return c.groupBy("cigar", C.clipped_in_the_middle(F.col("cigar")).alias("middle")).agg(F.count("*").alias("n"))


@query("SELECT s.chrom, s.pos, count(r.file_order) AS reads FROM (SELECT chrom, pos * 20 + 10 AS pos FROM tr) s LEFT JOIN (SELECT * FROM rd WHERE ((file_order * 37 % 4096) & 3332) = 0) r ON r.chrom = s.chrom AND r.ref_start <= s.pos AND r.ref_start + 35 > s.pos GROUP BY ALL")
def read_totals(spark, sf_dir):
    """A15, F2, J3."""
    return P.read_totals(_true_indels(spark, sf_dir), _flagged(spark, sf_dir))


@query(", o AS (SELECT sample, chrom, op[i] AS o, ln[i]::BIGINT AS n, ref_start + coalesce(list_sum(list_transform(range(1, i), lambda k: CASE WHEN op[k] = 'I' THEN 0 ELSE ln[k]::BIGINT END)), 0)::BIGINT AS p FROM cg, unnest(range(1, len(op) + 1)) AS u(i) WHERE regexp_matches(cigar, '[ID]')) SELECT sample, chrom, q AS pos, count(*) AS coverage FROM o, unnest(range(p, p + CASE WHEN o = 'M' THEN n ELSE 1 END)) AS w(q) WHERE o IN ('M', 'I', 'D') GROUP BY ALL")
def indel_read_coverage(spark, sf_dir):
    """A6."""
    return N.indel_read_coverage(B.reads(spark, sf_dir))


@query("SELECT e.chrom, e.pos, greatest(count(*) FILTER (WHERE e.op = 'I' AND e.mapq >= 35), count(*) FILTER (WHERE e.op = 'D' AND e.mapq >= 35)) AS freq, count(*) AS n, sum(e.mapq)::BIGINT AS mapq_sum, min(e.mapq) AS mapq_min FROM ev e JOIN (SELECT chrom, pos * 20 + 10 AS pos FROM tr) s ON s.chrom = e.chrom AND s.pos = e.pos GROUP BY ALL")
def true_indel_stats(spark, sf_dir):
    """Frequency and mapping qualities of indels at true positions."""
    return V.true_indel_stats(B.reads(spark, sf_dir), _true_indels(spark, sf_dir))


@query("SELECT chrom, pos, label FROM (SELECT DISTINCT pr.chrom, pr.pos, (tr.pos IS NOT NULL)::INT::DOUBLE AS label FROM pr LEFT JOIN tr ON tr.chrom = pr.chrom AND tr.pos = pr.pos) ORDER BY chrom, pos")
def sorted_labels(spark, sf_dir):
    """T3."""
    return V.membership_labels(B.predictions(spark, sf_dir).select("chrom", "pos").distinct(), B.truth(spark, sf_dir)).orderBy("chrom", "pos")


@query("SELECT sample, chrom, ref_start, r::INT AS replicate, least(count(*), 3) AS n FROM rd, range(2) AS u(r) GROUP BY ALL")
def subsample_sizes(spark, sf_dir):
    """What each replicate draws of a site."""
    site = ["sample", "chrom", "ref_start"]
    return R.subsample(B.reads(spark, sf_dir), site, 3, 2).groupBy(*site, "replicate").agg(F.count("*").alias("n"))


@query(", k AS (SELECT tie, ntile(4) OVER (ORDER BY tie) - 1 AS shard FROM (SELECT DISTINCT tie FROM rd)) SELECT shard::INT AS shard, count(*) AS n, min(rd.tie) AS low, max(rd.tie) AS high FROM rd JOIN k ON k.tie = rd.tie GROUP BY shard")
def key_shards(spark, sf_dir):
    """T10."""
    s = R.sharded(B.reads(spark, sf_dir), "tie", 4)
    return s.groupBy("shard").agg(F.count("*").alias("n"), F.min("tie").alias("low"), F.max("tie").alias("high"))


@query("SELECT DISTINCT 'chrom' || chrom || 'pos' || pos::VARCHAR AS site_key FROM pr")
def site_keys(spark, sf_dir):
    """X16."""
    return B.predictions(spark, sf_dir).select(E.site_key(F.col("chrom"), F.col("pos")).alias("site_key")).distinct()


@query("SELECT first, past, here, CASE WHEN past <> 0 AND first <> 0 THEN least(past - here - 2, here - first) WHEN past <> 0 THEN past - here - 2 WHEN first <> 0 THEN here - first ELSE 99 END AS near, n FROM (SELECT l_linenumber % 3 AS first, l_suppkey % 4 * 9 AS past, l_orderkey % 30 AS here, count(*) AS n FROM lineitem GROUP BY ALL)")
def clip_proximity(spark, sf_dir):
    """X13."""
    rows = B.table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") % 3).alias("first"), (F.col("l_suppkey") % 4 * 9).alias("past"), (F.col("l_orderkey") % 30).alias("here")).agg(F.count("*").alias("n"))
    return rows.withColumn("near", E.clip_proximity(F.col("past"), F.col("first"), F.col("here"), F.lit(2), F.lit(99)))


@query(Q.TANDEM, recursive=True)
def tandem_repeats(spark, sf_dir):
    """X14."""
    seq = F.upper("seq")
    at = B.reference(spark, sf_dir).withColumn("found", E.tandem_repeat(F.substring(seq, 1, 10), F.substring(seq, 11, 10)))
    return at.select("chrom", (F.col("block_start") + 10).alias("pos"), F.col("found.size").alias("size"), F.col("found.repeats").alias("repeats"))
