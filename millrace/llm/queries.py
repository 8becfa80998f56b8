"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import bpe, chat, flac, jaccard, langid, neardup, packing, quality, suffix, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score (probability of good quality), weak_score (the labellers' posterior; null without words), kept."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs)
    out = docs.select("doc_id", quality.judge(model, docs).alias("q"))
    return out.select("doc_id", F.col("q.score").alias("score"), F.col("q.weak").alias("weak_score"), (F.col("q.score") >= 0.5).alias("kept"))


def op2_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return bpe.encode_digests(docs, _vocabulary("byte_bpe_50k.json")).withColumnRenamed("key", "doc_id")


def op3_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, kept: five-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard.join(_table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, _vocabulary("word_bpe_49k.json"))).withColumnRenamed("key", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(_remainder(5) == 0, F.lit(False))
    labels = _table(spark, sf_dir, "labels").where(~held).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    out = docs.select("doc_id", held.alias("held_out"), toxicity.score(model, docs).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(flac.media(_table(spark, sf_dir, "documents"))).withColumnRenamed("key", "doc_id")


def op7_itq_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("key", "vec_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(_remainder(4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held & F.col("doc_id").isNotNull()))
    out = docs.select("doc_id", held.alias("held_out"), langid.predict(model, docs).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_digests(_table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat.format_conversations(rows.unionByName(own))
    out = out.withColumn("full", chat.formatted(F.col("segments"))).withColumn("turns", chat.read_turns(F.col("full"))).withColumn("loss", chat.read_loss(F.col("segments")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("full").cast("long").alias("formatted_chars"),
    )


CHAT_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS opens FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(text, '<(&*)\|', '<&\1|', 'g')) + 8
    + CASE WHEN opens THEN 10 + length(replace(replace(role, '%', '%25'), '|', '%7C')) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_bpe_chunks": op2_bpe_chunks,
    "op3_jaccard_forest": op3_jaccard_forest,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_flac_media": op6_flac_media,
    "op7_itq_neardup": op7_itq_neardup,
    "op8_language_id": op8_language_id,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_chat_format": op10_chat_format,
}
ORACLE_SQL = {"op10_chat_format": CHAT_SQL}
