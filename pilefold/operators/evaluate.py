"""Truth sets, labels, balance and benchmark curves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import IndelFilter
from .candidates import indel_events
from .order import ranked, running_sums, with_neighbours

SITE = ["chrom", "pos"]


def truth_overlap(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: candidates, truths, and how many meet."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    both = candidates.join(truth.select(*SITE), SITE)
    return one(candidates, "candidates").crossJoin(one(truth, "truths")).crossJoin(one(both, "common"))  # three single rows


def goldset_labels(trues: DataFrame, predictions: DataFrame) -> DataFrame:
    """Trues labelled 1, predictions that are no true 0."""
    return trues.select(*SITE, F.lit(1.0).alias("label")).unionByName(predictions.join(trues, SITE, "left_anti").select(*SITE, F.lit(0.0).alias("label")))


def membership_labels(sites: DataFrame, truth: DataFrame) -> DataFrame:
    """Each site with 1 if the truth has it, else 0."""
    known = truth.select(*SITE).distinct().withColumn("_k", F.lit(True))
    return sites.select(*SITE).join(known, SITE, "left").select(*SITE, F.col("_k").isNotNull().cast("double").alias("label"))


def balanced(labelled: DataFrame, order: list, minority_only: bool = True) -> DataFrame:
    """Classes cut to the smaller one's size by an order (a seeded hash shuffles); with minority_only False all positives stay and as many negatives."""
    sizes = labelled.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")).first()
    limit = min(sizes) if minority_only else sizes["p"]
    # Negatives come first in the order, so a positive's rank in its class is what is left after them.
    some = labelled.filter(F.col("label").isin(0, 1))
    rank = F.col("_rank") - F.when(F.col("label") == 1, F.lit(sizes["q"])).otherwise(F.lit(0))
    keep = rank < limit
    return ranked(some, ["label", *order], "_rank").filter(keep if minority_only else (F.col("label") == 1) | keep).drop("_rank")


def pr_curve(scores: DataFrame) -> DataFrame:
    """(threshold, tp, fp, precision, recall, f1) at each distinct score, highest first.

    Counts are summed by score first; running sums go by ranges of scores, however many there are.
    """
    per = scores.groupBy(F.col("score").alias("threshold")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    all_ = scores.agg(F.count_if(F.col("label") == 1).alias("all"))  # one row
    out = running_sums(per, [F.desc("threshold")], {"tp": F.col("p"), "fp": F.col("q")}).crossJoin(all_).drop("p", "q")
    out = out.withColumns({"precision": F.col("tp").cast("double") / (F.col("tp") + F.col("fp")), "recall": F.when(F.col("all") > 0, F.col("tp").cast("double") / F.col("all")).otherwise(F.lit(0.0))})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return out.withColumn("f1", f1).drop("all")


def best_threshold(curve: DataFrame) -> DataFrame:
    return curve.orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def benchmarks(sets: dict[str, DataFrame]) -> DataFrame:
    """(set, threshold, f1, precision, recall, mutations, positions) of each labelled set (score, label) at its best threshold; an empty set has no row. Sets are a few; each one's curve goes by ranges of scores."""
    out = []
    for name, scores in sets.items():
        sizes = scores.agg(F.count_if(F.col("label") == 1).alias("mutations"), F.count("*").alias("positions"))  # one row
        out.append(best_threshold(pr_curve(scores)).select(F.lit(name).alias("set"), "threshold", "f1", "precision", "recall").crossJoin(sizes))
    return reduce(DataFrame.unionByName, out)


def replicate_scores(scores: DataFrame) -> DataFrame:
    """Mean and median of a site's replicate scores."""
    return scores.groupBy(*SITE).agg(F.avg("score").alias("mean_score"), F.percentile("score", F.lit(0.5)).alias("median_score"))


def nearest_indel(events: DataFrame) -> DataFrame:
    """Distance of each distinct indel position to the nearest other one of its sample and contig; null if it is alone."""
    sites = with_neighbours(events.select("sample", "chrom", "pos").distinct(), ["sample", "chrom"], "pos")
    return sites.select("sample", "chrom", "pos", F.least(F.col("pos") - F.col("before"), F.col("after") - F.col("pos")).alias("nearest"))


def disagreement(evidence: DataFrame) -> DataFrame:
    """(chrom, pos, disagree, max_len): percent of a site's evidence unlike its commonest value (insertions by bases, deletions by length)."""
    value = F.when(F.col("kind") == "I", F.col("seq")).otherwise(F.col("len").cast("string"))
    per = evidence.withColumn("v", value).groupBy("chrom", "pos", "kind", "v").agg(F.count("*").alias("n"), F.max("len").alias("len"))
    return per.groupBy("chrom", "pos").agg((100.0 * (F.sum("n") - F.max("n")) / F.sum("n")).alias("disagree"), F.max("len").alias("max_len"))


def true_indel_stats(reads: DataFrame, truth: DataFrame, cfg: IndelFilter = IndelFilter()) -> DataFrame:
    """(chrom, pos, freq, n, mapq_sum, mapq_min) of the true positions that have indels: the larger of insertions and deletions of good reads; mapping qualities of all."""
    events = indel_events(reads.withColumn("_q", F.col("mapq")).withColumn("mapq", F.lit(cfg.min_mapq)), cfg, keep=["_q"])
    good = F.col("_q") >= cfg.min_mapq
    freq = F.greatest(F.count_if(good & (F.col("op") == "I")), F.count_if(good & (F.col("op") == "D")))
    met = events.join(truth.select(*SITE), SITE, "left_semi")
    return met.groupBy(*SITE).agg(freq.alias("freq"), F.count("*").alias("n"), F.sum("_q").alias("mapq_sum"), F.min("_q").alias("mapq_min"))
