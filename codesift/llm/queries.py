"""The corpus operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codesift.llm import html_text, language, mixing, neighbours, phrases, pieces, quality_model, quality_rules, runs, secrets, simhash, substrings, url_filter
from codesift.llm.common import read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read(spark, sf_dir, "documents"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(read(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.page_filter(read(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(read(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(read(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_report(read(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_report(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_nearest_vectors": op2_nearest_vectors,
    "op3_language_id": op3_language_id,
    "op4_html_text": op4_html_text,
    "op5_url_filter": op5_url_filter,
    "op6_quality_rules": op6_quality_rules,
    "op7_source_mix": op7_source_mix,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
# The others train models, hash or draw, which SQL does not express; tests compare them with plain versions.
ORACLE = {
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op6_quality_rules": quality_rules.oracle_sql(),
    "op11_phrase_mining": phrases.ORACLE_SQL,
    "op12_substring_dedup": substrings.ORACLE_SQL,
}
