"""The queries of this subpackage and their SQL. The queries are thin: operators with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import containment, html_text, language_id, line_dedup, mixing, mpeg_audio, simhash_pivots, token_counts, token_tables, url_rules


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", (~language_id.learnable(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.apply_rules(table(spark, sf_dir, "pages"), url_rules.rule_table(spark))


def op4_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tables.tokens_on_disk(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mpeg_audio.stored_and_read(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "duration_us", "crc_bad", "seek")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_pivots.near_duplicates(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_language_id, op3_url_rules, op4_token_tables, op5_mpeg_audio, op6_main_text, op7_decontaminate, op8_mix, op9_simhash, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_rules": url_rules.ORACLE, "op7_decontaminate": containment.ORACLE, "op8_mix": mixing.ORACLE}
