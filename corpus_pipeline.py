"""A corpus pipeline of five training-data operators over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and reads
it back as the next stage's docs. All stages but the last return the columns of documents. No stage fits itself on labels.
An empty table, null texts and ids, and extra columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, langid, packing, quality, suffix
from millrace.llm.lineage import drop, stage
from millrace.session import ship

LEAST_LANGUAGE_SCORE, LEAST_QUALITY = 0.5, 0.5


def _with_column(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language stays uncertain (score below 0.5). Learns from the
    documents' own lang column; a document with a null lang is judged like any other."""
    ship(spark)
    model = langid.fit(docs.where(F.col("doc_id").isNotNull()))
    p = _with_column(docs, "_language")
    out = docs.withColumn(p, langid.predict(model, docs))
    return out.where((F.col(p)["lang"] != langid.UND) & (F.col(p)["score"] >= LEAST_LANGUAGE_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the scorer finds more likely bad than good."""
    ship(spark)
    model = quality.fit(docs)
    p = _with_column(docs, "_quality")
    out = docs.withColumn(p, quality.judge(model, docs))
    return out.where(F.col(p)["score"] >= LEAST_QUALITY).select(*[F.col(f"`{c}`") for c in docs.columns])


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest id; rows with a null id stay."""
    ship(spark)
    gone = jaccard.join(docs).where(~F.col("kept")).select(F.col("key").alias("doc_id"))
    out = docs.join(gone, "doc_id", "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 bytes or more that a document with a smaller id holds; n_chars follows the text."""
    ship(spark)
    out = suffix.dedup_texts(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens; one row for each piece."""
    import public_tokenizers

    ship(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The language and quality models have no SQL form; tests hold run() against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        before, docs = docs, stage(step(spark, docs, sf_dir), name)
        drop(before)
    return docs
