"""Text formats: SAM, FASTA and its index, BED, TSV tables, set items; VCF out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import VERSION
from ..functions import cigar as C


def read_sam(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """Alignment records of a SAM text in the reads schema. file_order: the record's place; within a file it rises with the lines."""
    raw = spark.read.text(path).filter(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("file_order"))
    f = lambda i: F.get("f", F.lit(i))
    star = lambda c: F.when(c != "*", c)
    quals = F.when(f(10) != "*", F.transform(F.split(f(10), ""), lambda q: F.ascii(q) - 33))
    out = raw.select(
        F.lit(sample).alias("sample"), "file_order", f(0).alias("query_name"), f(1).cast("int").alias("flag"), star(f(2)).alias("chrom"), (f(3).cast("long") - 1).alias("ref_start"),
        f(4).cast("int").alias("mapq"), star(f(5)).alias("cigar"), star(f(9)).alias("seq"), F.filter(quals, lambda q: q >= 0).cast("array<int>").alias("quals"),
    )
    return out.withColumn("ref_end", F.when(F.col("cigar").isNotNull(), C.reference_end(F.col("ref_start"), F.col("cigar")))).select("sample", "file_order", "query_name", "flag", "chrom", "ref_start", "ref_end", "mapq", "cigar", "seq", "quals")


def read_fasta(spark: SparkSession, path: str, block: int = 65536) -> DataFrame:
    """(chrom, block_start, seq) of FASTA files, read by lines in Spark's splits: no contig is ever in one row or task.

    Places are running sums inside a split; what goes from split to split (the contig that is open and how
    long it is so far) is one row a split. Contigs without bases give no row.
    """
    split = ["file", "part"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("i"))
    title = F.col("value").startswith(">")
    lines = lines.select(*split, "i", F.when(title, F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("name"), F.when(title, "").otherwise(F.regexp_replace("value", r"\s", "")).alias("s"))
    inside = W.partitionBy(*split).orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = lines.withColumns({"own": F.last("name", True).over(inside), "run": F.count("name").over(inside)})
    begins = F.sum(F.length("s")).over(W.partitionBy(*split, "run").orderBy("i")) - F.length("s")
    lines = lines.withColumn("at", begins)
    runs = lines.groupBy(*split, "run").agg(F.max("own").alias("own"), F.sum(F.length("s")).alias("n"))
    tails = runs.groupBy(*split).agg(F.max_by(F.struct("own", "n"), "run").alias("t")).select(*split, "t.own", "t.n")
    order = W.partitionBy("file").orderBy("part")
    tails = tails.withColumn("g", F.count("own").over(order)).withColumns({"name": F.last("own", True).over(order), "sum": F.sum("n").over(W.partitionBy("file", "g").orderBy("part"))})
    open_ = tails.select(*split, F.lag("name").over(order).alias("o_name"), F.coalesce(F.lag("sum").over(order), F.lit(0)).alias("o_at"))
    placed = lines.filter(F.length("s") > 0).join(open_, split).select(F.coalesce("own", "o_name").alias("chrom"), (F.col("at") + F.when(F.col("run") == 0, F.col("o_at")).otherwise(F.lit(0))).alias("at"), "s")
    cut = placed.withColumn("b", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.length("s") - 1) / block))))
    first = F.greatest(F.col("at"), F.col("b") * block)
    piece = F.substring("s", (first - F.col("at") + 1).cast("int"), ((F.col("b") + 1) * block - first).cast("int"))
    whole = cut.select("chrom", "b", F.struct(first.alias("at"), piece.alias("s")).alias("p")).groupBy("chrom", "b").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return whole.select("chrom", (F.col("b") * block).alias("block_start"), F.array_join(F.transform("ps", lambda p: p["s"]), "").alias("seq"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(idx, chrom, start, end exclusive) in file order; further columns are ignored."""
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("f"), F.monotonically_increasing_id().alias("idx"))
    return rows.select("idx", F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).cast("long").alias("start"), F.get("f", F.lit(2)).cast("long").alias("end"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chrom string, pos long").csv(path, sep="\t")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chrom string, pos long, pred_true double").csv(path, sep="\t")


def read_truth(spark: SparkSession, path: str, first: int = 0, header: bool = False, label: int | None = None) -> DataFrame:
    """(chrom, pos 0-based[, label]) from 1-based rows whose chrom is in column `first`."""
    rows = spark.read.option("header", header).option("inferSchema", False).csv(path, sep="\t")
    c = [F.col(f"`{x}`") for x in rows.columns]
    return rows.select(c[first].cast("string").alias("chrom"), (c[first + 1].cast("long") - 1).alias("pos"), *([c[label].cast("double").alias("label")] if label is not None else []))


def read_set_items(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos 0-based, label) from lines chrom/pos/label."""
    f = F.split(F.trim("value"), "/")
    return spark.read.text(path).filter(F.trim("value") != "").select(F.get(f, F.lit(0)).alias("chrom"), (F.get(f, F.lit(1)).cast("long") - 1).alias("pos"), F.get(f, F.lit(2)).cast("double").alias("label"))


def pair_samples(names: DataFrame) -> DataFrame:
    """(patient, normal, tumor) from file names (patient, name) that say -N or normal, -T or tumor: patients with exactly one of each."""
    low = F.lower("name")
    normal, tumor = F.col("name").contains("-N") | low.contains("normal"), F.col("name").contains("-T") | low.contains("tumor")
    per = names.groupBy("patient").agg(F.count_if(normal).alias("n"), F.count_if(tumor).alias("t"), F.max(F.when(normal, F.col("name"))).alias("normal"), F.max(F.when(tumor, F.col("name"))).alias("tumor"))
    return per.filter("n = 1 and t = 1").select("patient", "normal", "tumor")


def write_tsv(df: DataFrame, path: str, single: bool = False) -> None:
    """Headerless TSV; Spark's commit protocol replaces temporary names and renames."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, sep="\t")


#: The header that goes before VCF rows.
VCF_HEADER = [
    "##fileformat=VCFv4.2",
    '##FILTER=<ID=PASS,Description="Score of at least 0.5">',
    '##FILTER=<ID=REJECT,Description="Score below 0.5">',
    '##INFO=<ID=TYPE,Number=1,Type=String,Description="SNV or INDEL">',
    '##INFO=<ID=SCORE,Number=1,Type=Float,Description="Score of the call">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Depth">',
    '##FORMAT=<ID=RO,Number=1,Type=Integer,Description="Reads of the reference allele">',
    '##FORMAT=<ID=AO,Number=A,Type=Integer,Description="Reads of the alternate allele">',
    '##FORMAT=<ID=AF,Number=1,Type=Float,Description="Allele frequency">',
]


def write_vcf(rows: DataFrame, path: str, sample: str, reference: str = "", normal: str = "", tumor: str = "", compat: bool = False) -> None:
    """A folder with one VCF text: header, then rows by (ord, pos, chrom). compat ends rows with a tab. One file is what readers want: calls, thousands to a million short lines, go through one task."""
    columns = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample"]
    ran = [f"##fileDate={datetime.now():%Y%B%d, %H:%M:%S}", f"##source=pilefold v{VERSION}", f"##reference={reference}", f"##normalBAM={normal}", f"##tumorBAM={tumor}"]
    head = [VCF_HEADER[0], *ran, *VCF_HEADER[1:], "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]
    spark = rows.sparkSession
    top = spark.createDataFrame([(i - len(head), 0, "", h) for i, h in enumerate(head)], "ord int, pos long, chrom string, value string")
    line = F.concat(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]), F.lit("\t" if compat else ""))
    order = F.col("ord") if "ord" in rows.columns else F.lit(0)
    body = rows.select(order.cast("int").alias("ord"), F.col("pos").cast("long"), "chrom", line.alias("value"))
    top.unionByName(body).orderBy("ord", "pos", "chrom").coalesce(1).select("value").write.mode("overwrite").text(path)
