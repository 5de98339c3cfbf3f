"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, but for the
last, which returns token ids. Null or empty texts: language ID rejects them, so later
stages see none unless line dedup empties a text; such rows stay, with size 0 in the mix,
which takes nothing of them. Rows with a null doc_id are kept by every stage that decides by
doc_id. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import bpe, language_id, line_dedup, minhash_dedup, mixing
from treeloom.llm.common import Workspace

#: Least product of the two levels' scores. With two families of two languages the winner of a level has 0.5 at least, so only texts without a letter go.
LEAST_SCORE = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language; those without a letter or with no decided language go."""
    model = language_id.fit(docs.where(~language_id.held_out()).select("doc_id", "text", "lang"))
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest"), "text")
    known = language_id.predict(rows, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return known.select(*(F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines that an earlier document holds; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs).select(*(F.col(f"`{c}`") for c in docs.columns))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8) stays: that of the smallest doc_id."""
    gone = minhash_dedup.near_duplicates(docs, percent=80).where("NOT kept").select(F.col("id").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's target share; a document that is taken twice is two rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return mixing.mixed_documents(docs, weights=mixing.quality_weights(labels))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of each row."""
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), *bpe.default_vocabulary())
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", dedup_near),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can't express the learned and hashed stages; tests/llm/test_pipeline.py holds each of them against a brute-force version on sf0.001.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
