"""The queries of this subpackage and their SQL, for the driver contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, filter_audit, hierarchical_packing, language_id, license_scan, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, spelling, warc
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.predict_languages(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "held_out", "lang_pred", "score", "size(spans) AS n_spans")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.round_trip(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("rules", F.array_join("rules", ","))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchical_packing.pieces(hierarchical_packing.pack_sequences(table(spark, sf_dir, "documents")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality_classifier, op3_decontamination, op4_warc, op5_token_packing, op6_mixing, op7_quality_rules, op8_near_dedup, op9_license_scan, op10_line_dedup, op11_filter_audit, op12_best_fit_packing, op13_spelling_variants)}

ORACLES = {
    "op4_warc": warc.ORACLE,
    "op10_line_dedup": line_dedup.oracle(),
    "op11_filter_audit": filter_audit.ORACLE,
    "op6_mixing": mixing.oracle(),
    "op7_quality_rules": quality_rules.oracle(),
    "op8_near_dedup": near_dedup.ORACLE,
}
