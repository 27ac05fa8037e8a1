"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lexical, lines, near_dup, packing, pii, quality_model, rules, substring, token_files, urls, warc, whitening
from .oracles import ORACLES
from .shared import folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_recurring(_table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return out.select("doc_id", "n_lines", "n_dropped", "is_copy", F.sha2("text", 256).alias("kept_sha256"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages")).drop("component")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, _table(spark, sf_dir, "labels")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path, with_ids=False)


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return decontaminate.mark(docs, decontaminate.find(docs, _table(spark, sf_dir, "benchmark")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.clean_lines(_table(spark, sf_dir, "documents"), with_text=False).drop("cleaned")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "warc")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.fetch(warc.index(spark, path), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_line_dedup, op3_url_filter, op4_quality_classifier, op5_token_files, op6_pii_surrogates, op7_decontamination, op8_best_fit_packing, op9_quality_rules, op10_near_dedup, op11_warc_packages, op12_embedding_whitening, op13_lexical_search)}

__all__ = ["ORACLES", "QUERIES"]
