"""The queries of this package, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import ann, bpe, jaccard, jpeg, katz, licenses, merkle, mixing, passages, quality, ranked, secrets, spelling
from llm.tables import table


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit_pages(table(spark, sf_dir, "pages"))


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", (quality.remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= quality.ACCEPTED).cast("int").alias("predicted"))


def op3_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"))


def op4_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


def op5_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_columns(table(spark, sf_dir, "documents"))


def op6_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(table(spark, sf_dir, "documents"))


def op7_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


def op8_shifted_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents"))


def op10_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op12_wavelet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_merkle_fixity, op2_rule_ensemble, op3_katz_backoff, op4_collinear_chaining, op5_progressive_jpeg, op6_trigram_secrets, op7_forced_boundary_bpe, op8_shifted_hilbert, op9_chosen_path_join, op10_curriculum_mix, op11_license_rules, op12_wavelet_search, op13_spelling_variants)
}
ORACLES: dict[str, str] = {"op1_merkle_fixity": merkle.PAGES_SQL, "op10_curriculum_mix": mixing.MIX_SQL, "op11_license_rules": licenses.scan_sql(), "op12_wavelet_search": ranked.RANK_SQL, "op13_spelling_variants": spelling.VARIANTS_SQL}
