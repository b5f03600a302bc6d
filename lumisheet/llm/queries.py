"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, langid, licences, metric_join, pieces, pii, quality, repeats, sharding, simhash, spelling, whitening
from .common import table


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op2_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op6_label_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(table(spark, sf_dir, "documents"))


def op7_html_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digest(table(spark, sf_dir, "pages"))


def op4_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.digest(table(spark, sf_dir, "embeddings"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op5_sentencepiece_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op11_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(table(spark, sf_dir, "documents"))


def op12_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op10_decontaminate, op3_language_id, op2_simhash_vptree, op6_label_sharding, op1_pii_weak_supervision, op9_licence_scan, op7_html_tag_paths, op4_metric_join, op8_suffix_array, op5_sentencepiece_suffix_array, op11_spelling_trie, op12_byte_cnn_quality, op13_whitening)}

ORACLE_SQL: dict[str, str] = {"op10_decontaminate": decontaminate.ORACLE, "op4_metric_join": metric_join.ORACLE, "op9_licence_scan": licences.oracle(), "op8_suffix_array": repeats.ORACLE, "op11_spelling_trie": spelling.ORACLE}
