"""Queries of the text problems 8 to 10, each over the whole table documents with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm import langid, mixing, tokenizer
from vitalframe.session import cut, table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(table(spark, sf_dir, "documents"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The round trip: ids decoded by concatenating their pieces."""
    ids = tokenizer.encode(table(spark, sf_dir, "documents"))
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), tokenizer.decode_ids(F.col("ids"), tokenizer.vocabulary_path()).alias("text"))


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens), encoded once."""
    ids = tokenizer.encode(table(spark, sf_dir, "documents"), carry=("source",))
    return cut(ids.select("doc_id", "source", F.size("ids").alias("n_tokens")))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(sized_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id", "source", "n_tokens")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, targets = sized_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(sized, targets, "doc_id", "source", "n_tokens"), targets, "doc_id", "n_tokens", sized)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.label_segments(table(spark, sf_dir, "documents"))
    return found.filter("n_segments > 1 or label_lang is null or label_lang <> lang").select("doc_id", "seg_no", "lang")


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.label_segments(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p8_ids, p8_decoded, p9_mix, p9_shares, p10_found, p10_segments)}
#: None of these can be expressed in SQL on whole tables in reasonable time; tests/llm holds them against brute force.
SQL: dict[str, str] = {}
