"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes what the one before kept. All but the last return the columns of ``documents`` (further columns pass
through); the last returns the mix: doc_id, size, source_size, target, taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histlens.llm import decontaminate, langid, lines, minhash, mixing
from histlens.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, no letter, or an unsure network) go; ``lang`` is what the network says of the others."""
    return langid.accepted(docs, langid.fit(docs.where(langid.fold() != 1)), label="lang")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go; n_chars follows the text that is left."""
    left = lines.rewritten(docs, lines.keep_bitmaps(docs))
    return left.withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the least doc_id. Linked are sets of 5-word shingles at 0.8 or more."""
    extra = minhash.near_duplicates(docs, minhash.Params(percent=80)).where("NOT kept").select(F.col("doc_id").alias("_d"))
    return docs.join(extra, docs["doc_id"].eqNullSafe(extra["_d"]), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
]
#: Language ID is a trained network: SQL can't express it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
