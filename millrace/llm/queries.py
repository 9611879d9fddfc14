"""The registered queries of this subpackage: thin digests of the operators' outputs, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import kneserney, langid, licenses, linededup, media, mixing, neardup, pieces, quality, warc
from millrace.llm.oracles import ORACLES

PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _held_out(folds: int):
    return F.crc32(F.col("doc_id").cast("string")) % folds == 0


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its ids, their number and digest, and the digest of the text that they decode to."""
    model = pieces.read_model(PIECE_MODEL)
    both = pieces.round_trip(_documents(spark, sf_dir).select("doc_id", "text"), model, keep=["doc_id"])
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir), percent=85)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.schedule(_documents(spark, sf_dir), "doc_id", "source", "text")
    each = found.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows"))))  # one row for each document
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    found = media.features(stored)
    code = F.zip_with("times", "codes", lambda t, c: F.concat_ws(":", t, c))
    return found.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.array_join(code, " ").alias("feature"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records, _ = warc.read(warc.write(pages))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", _held_out(10))
    model = kneserney.train(docs.where(~F.col("held_out")))
    found = kneserney.score(docs, model, keep=["doc_id", "held_out"])
    return found.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree source/thousand/hundred/name, where every hundredth is that folder's licence file."""
    docs = _documents(spark, sf_dir)
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    group = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), group(1000), group(100), name)
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"), id_col="doc_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", _held_out(5))
    model = langid.learn(docs.where(~F.col("held_out")))
    return langid.identify(docs, model, keep=["doc_id", "held_out"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_minhash_near_dedup, op3_quality_rules, op4_line_dedup, op5_source_mixing, op6_media_columns, op7_warc, op8_lm_scoring, op9_license_scan, op10_language_id, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
