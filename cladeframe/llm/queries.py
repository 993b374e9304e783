"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, licenses, line_dedup, mixing, pii, quality_classifier, quality_rules, secrets, simhash, warc
from .common import scratch, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply(docs, model, ["doc_id"])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), at)
    return warc.parsed(spark, at)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.apply(table(spark, sf_dir, "documents"), ["doc_id"]).drop("matches")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.apply(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.apply(docs, pii.fit(docs), ["doc_id"])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.apply(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.apply(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.apply(table(spark, sf_dir, "documents"), ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}
