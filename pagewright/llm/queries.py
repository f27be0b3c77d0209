"""Queries over the driver's tables, one for each corpus operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bbit, chosen_path, decontam, filter_audit, html_tree, langid, packing, ppm, radix_dedup, sharding, spelling, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_table(spark, sf_dir, "pages"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(_table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_html_extraction, op3_exact_dedup, op4_language_id, op5_ngram_jaccard_join, op6_decontamination, op7_sharding, op8_toxicity, op9_best_fit_packing, op10_lm_scoring, op11_spelling_variants, op12_minhash_near_dedup, op13_filter_interaction_audit)}
ORACLES = {"op1_warc": warc.ORACLE, "op3_exact_dedup": radix_dedup.ORACLE, "op5_ngram_jaccard_join": chosen_path.ORACLE, "op6_decontamination": decontam.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op12_minhash_near_dedup": bbit.ORACLE, "op13_filter_interaction_audit": filter_audit.ORACLE}
