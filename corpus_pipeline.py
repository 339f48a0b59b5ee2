"""The corpus pipeline: toxic documents go, one document of each group of near duplicates stays, secrets are masked, sources are
mixed to their weights, and what is left is encoded. Each stage takes what the one before kept.

All stages take null ids, texts and sources, empty and very long texts, ids and rows that repeat, empty tables and columns beside
those of ``documents``, which are not read and not passed on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm import jaccard, mixing, pieces, secrets, toxicity
from intervale.llm.common import shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below one half; the network learns from the labels of the documents it is given. Null and empty texts
    score the labels' base rate; without texts of both labels there is nothing to learn and every row stays."""
    docs = docs.select(*COLUMNS)
    rows, base = toxicity.sample(docs, table(spark, sf_dir, "labels"))
    if len({label for _, label in rows}) < 2:
        return docs
    return toxicity.scored(docs, toxicity.train(rows, base), "toxic_score").where("toxic_score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id. Rows with a null id, and those without words, stay; of rows that
    repeat an id that with the smallest digest of its text stays."""
    return jaccard.keep_one(docs.select(*COLUMNS))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of a secret is replaced by a mark; n_chars follows the text, and is null where that is. All rows stay."""
    clean = secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row each time the mix starts a document, in shards shuffled each for itself. Null sources are a source of their own; rows
    without words are not drawn; rows that repeat are drawn each for itself."""
    return mixing.mixed_rows(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training rows: doc_id, source and the ids of the whole text; none for null and empty ones."""
    return pieces.encode_texts(docs.select(*COLUMNS)).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("encode", encode),
]

#: Neither a trained network nor the ids of a tokenizer can be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
