"""From files to calls: `python -m pilefold filter ...` writes candidates, `python -m pilefold predict ...` predictions and a VCF;
`python -m pilefold train ...` writes labelled images as .npz files.

All take up where a former run ended: a table that is complete (Spark's _SUCCESS is there) isn't made again,
and predictions are added only for candidates that have none.
"""

from __future__ import annotations

import argparse
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import as_json, settings
from .operators.rows import missing, not_done
from .operators.scoring import load_network
from .plans import pipeline as P
from .session import ship
from .sources import bam, text
from .sources.fasta import IndexedFasta
from .sources.npz import NpzSource
from .sources.store import done as complete
from .sources.store import stored_reads

BLOCK = 65536
TENSORS = {"snv": "SnvTensor", "indel": "IndelTensor"}


def exists(spark: SparkSession, file: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def candidates(spark: SparkSession, reads: DataFrame, out: str, kinds: list[str], regions: DataFrame | None = None, contigs: DataFrame | None = None, given: dict | None = None) -> None:
    """out/<kind>.candidates, TSV of chrom and pos in order."""
    given = given or settings(None)
    for kind in kinds:
        if not complete(spark, f"{out}/{kind}.candidates"):
            find = partial(P.snv_candidates, in_order=True) if kind == "snv" else P.indel_candidates  # the store has its reads in order
            found = find(reads, given["SnvFilter" if kind == "snv" else "IndelFilter"], regions=regions, contigs=contigs)
            text.write_tsv(found.orderBy("chrom", "pos"), f"{out}/{kind}.candidates")


def predictions(spark: SparkSession, reads: DataFrame, reference: DataFrame, out: str, scorers: dict, given: dict | None = None, **how) -> dict[str, DataFrame]:
    """out/<kind>.predictions, TSV of chrom, pos and score; rows are added for candidates that have none."""
    made, given = {}, given or settings(None)
    for kind, scorer in scorers.items():
        todo, path = text.read_candidates(spark, f"{out}/{kind}.candidates").distinct(), f"{out}/{kind}.predictions"
        left = not_done(todo, text.read_predictions(spark, path)) if complete(spark, path) else todo
        if not left.isEmpty():
            P.predict(left, reads, reference, BLOCK, kind, scorer, cfg=given[TENSORS[kind]], **how).write.mode("append").csv(path, sep="\t")
        made[kind] = text.read_predictions(spark, path)
        if short := missing(todo, made[kind]):
            raise RuntimeError(f"{short} {kind} candidates have no prediction")
    return made


def training(spark: SparkSession, reads: DataFrame, reference: DataFrame, out: str, kind: str, given: dict, labels: str, spikes: str | None = None, seed: int = 0) -> None:
    """out/<kind>.training, .npz files; labels: TSV of chrom, position from 1 and label; spikes: of chrom, position from 1 and base. The images are committed as a whole, and a table with the parameters says that they were."""
    if complete(spark, f"{out}/{kind}.trained"):
        return
    more = spark.read.schema("chrom string, pos long, variant string").csv(spikes, sep="\t").withColumn("pos", F.col("pos") - 1) if spikes else None
    cfg = given[TENSORS[kind]]
    rows = P.training_data(text.read_truth(spark, labels, label=2), reads, reference, BLOCK, kind, cfg, more, seed)
    spark.dataSource.register(NpzSource)
    rows.write.format("npz").option("shape", ",".join(map(str, cfg.shape))).mode("overwrite").save(f"{out}/{kind}.training")
    text.write_tsv(spark.createDataFrame([(kind, as_json(cfg))], "kind string, parameters string"), f"{out}/{kind}.trained")


def main(args: list[str] | None = None, scorers: dict | None = None) -> None:
    """scorers: functions by kind, instead of the networks that --<kind>_model names."""
    p = argparse.ArgumentParser(prog="pilefold")
    p.add_argument("stage", choices=["filter", "predict", "train"])
    for name in ("sample_name", "normal_bam", "tumor_bam", "output_dir", "reference"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--region_bed", help="targets; with the same ones, predict uses the reads that filter decoded")
    p.add_argument("-snv", action="store_true")
    p.add_argument("-indel", action="store_true")
    for kind in ("snv", "indel"):
        p.add_argument(f"--{kind}_model", nargs="+", help="weights.npz [architecture.json [mean.npy std.npy]]; indels need the architecture")
    p.add_argument("--replicates", type=int, default=1, help="draws of the reads of deep sites whose scores are averaged")
    p.add_argument("--update_batch_norm", type=int, nargs="?", const=1000, default=0, metavar="SITES", help="batch norms get statistics of so many sites first")
    p.add_argument("--settings", help="JSON: parameters by stage, such as {\"SnvTensor\": {\"falling\": true}}")
    p.add_argument("--labels", help="train: TSV of chrom, position and label; all positives and as many negatives are taken")
    p.add_argument("--spikes", help="train, SNVs: TSV of chrom, position and base to put into the tumor's reads, as positives")
    p.add_argument("--seed", type=int, default=0, help="train: of the negatives and of the shares of put-in bases")
    a = p.parse_args(args)
    kinds = [k for k, on in zip(("snv", "indel"), P.modes(a.snv, a.indel)) if on]
    if a.stage == "predict" and scorers is None:
        for k in kinds:
            given = getattr(a, f"{k}_model") or []
            if len(given) not in (1, 2, 4) or (k == "indel" and len(given) < 2):
                p.error(f"--{k}_model: weights.npz{'' if k == 'indel' else ' ['} architecture.json{' [mean.npy std.npy]' if k == 'indel' else ' [mean.npy std.npy]]'}, or leave the kind out with -{'snv' if k == 'indel' else 'indel'}")
    if a.stage == "train" and (not a.labels or (a.spikes and "indel" in kinds)):
        p.error("train takes --labels; --spikes go with -snv")
    given = settings(a.settings)
    spark = ship(SparkSession.builder.appName("pilefold").getOrCreate())
    out, regions = f"{a.output_dir}/{a.sample_name}", text.read_bed(spark, a.region_bed) if a.region_bed else None
    reads = stored_reads(spark, a.normal_bam, a.tumor_bam, out, regions)
    if a.stage == "filter":
        candidates(spark, reads, out, kinds, regions, bam.contigs(spark, a.normal_bam, a.tumor_bam), given)
        return
    reference = IndexedFasta(spark, a.reference, BLOCK) if exists(spark, f"{a.reference}.fai") else text.read_fasta(spark, a.reference, BLOCK)
    if a.stage == "train":
        for k in kinds:
            training(spark, reads, reference, out, k, given, a.labels, a.spikes, a.seed)
        return
    if scorers is None:
        scorers = {k: load_network(*getattr(a, f"{k}_model")) for k in kinds}
    made = predictions(spark, reads, reference, out, {k: scorers[k] for k in kinds}, given, replicates=a.replicates, refresh=a.update_batch_norm)
    rows = P.call(made.get("snv"), made.get("indel"), reads, reference, BLOCK, given["Calling"])
    text.write_vcf(rows, f"{out}/{a.sample_name}.vcf", a.sample_name, a.reference, a.normal_bam, a.tumor_bam)


if __name__ == "__main__":
    main()
