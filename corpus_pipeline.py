"""A corpus pipeline of five operators: language ID, line dedup, MinHash near-dedup, mixing to target weights, BPE.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All columns of docs are kept, whatever their names; an empty table gives an empty one. This module is part of
the corpus operators and can't be imported without pilefold.llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pilefold.llm import bpe, langid, lines, minhash, mixing
from pilefold.llm.common import saved
from pilefold.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a language (null or empty text, no letter, or most letters in words that fit none and no language leading) go; clean mixes of languages stay, and so do all rows with letters if no row has a lang. Learned from a bounded sample of the rows that have one."""
    return langid.keep_identified(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least ten documents share go; documents stay, with what is left of their text (a null text as "")."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_rest")
    out = lines.dedup_lines(docs.select("doc_id", "text", rest), min_docs=10)
    fresh = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[fresh.get(c, F.col("_rest").getField(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id. Rows without words or id are in no group; rows that repeat an id stay or go together."""
    gone = minhash.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; null is a source of its own, and a source without words goes."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of ids and of the text decoded from them; a null text counts as empty."""
    return bpe.encode_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [("language ID", language), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("mixing", mixing_sources), ("BPE", tokens)]

#: Language ID and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage-{i}")
    return docs
