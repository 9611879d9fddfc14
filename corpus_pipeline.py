"""A corpus pipeline of five stages: language ID, line dedup, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns the kept rows; all but the last keep the columns of docs.
Stages hold for null, empty and very long texts, repeated rows and extra columns as their operators say:
language ID drops what it rejects (no text, no letter, near no centroid), line dedup rewrites texts, near
dedup keeps the smallest id of a group, mixing repeats rows that it takes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, linededup, mixing, neardup, pieces
from millrace.llm.queries import PIECE_MODEL
from millrace.llm.workspace import new_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled rows, drops rejected documents; the predicted language replaces lang."""
    found = langid.identify(docs, langid.learn(docs))
    lang = F.when(F.col("rejected"), F.col("lang")).otherwise(F.col("lang_pred"))
    return found.where(~F.col("rejected")).withColumn("lang", lang).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three or more documents share, except in the last one; n_chars follows."""
    found = linededup.dedup_lines(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ids, their number, and whether they decode to the text."""
    model = pieces.read_model(PIECE_MODEL)
    both = pieces.round_trip(docs, model)
    return both.withColumns({"n_ids": F.size("ids").cast("long"), "round_trip": F.coalesce(F.col("decoded") == F.col("text"), F.lit(False))}).drop("decoded")


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("mixing sources", mix_sources), ("SentencePiece", tokens)]

#: Language ID, near-dedup and tokens are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each stage's rows written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "corpus")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
