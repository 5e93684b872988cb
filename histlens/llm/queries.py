"""The registered queries of this subpackage: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, langid, lines, minhash, mixing, ppm, quality, secrets, spans
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base_failed is policy "base"; kept is policy "v1", which enforces those two rules as well; kept_v2 enforces all rules."""
    led = quality.ledger(table(spark, sf_dir, "documents"))
    for version, name in (("base", "base_kept"), ("v1", "kept"), ("v2", "kept_v2")):
        led = quality.apply_policy(led, quality.POLICIES[version], name)
    return led.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_bullet_lines", "n_ellipsis_lines", "n_stop_words", "NOT base_kept AS base_failed", "kept", "kept_v2", "fail_bits")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.digest(docs, lines.keep_bitmaps(docs))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup(table(spark, sf_dir, "documents"), with_text=False)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from folds 0 and 2 of 3; fold 1 is held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.fold() != 1))
    return langid.identify(docs, model).select("doc_id", (F.coalesce(langid.fold(), F.lit(1)) == 1).alias("held_out"), "lang_pred", "score")


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each rendered turn."""
    return chat.format_preferences(chat.neighbours_paired(table(spark, sf_dir, "conversations")))


def op10_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from nine folds of ten; fold 0 is held out."""
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(langid.fold(n=10), F.lit(0))
    return ppm.score(docs, fold != 0, order=4).select("doc_id", (fold == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_secret_scan, op2_mix_sources, op3_quality_ledger, op4_line_dedup, op5_minhash_dedup, op6_span_dedup, op7_decontaminate, op8_language_id, op9_preference_format, op10_ppm_score)
    return {f.__name__: f for f in ops}
