"""Strings in, verdicts out: the service surface over tables of JSON or text histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import dsl
from .model import Histories, Level, from_nested
from .plans import check as checks
from .plans import trace
from .sources import json_files


def _with_errors(verdicts: DataFrame, bad: DataFrame) -> DataFrame:
    """Undecodable inputs as failed rows of kind Parse, their message as the code."""
    return verdicts.unionByName(bad.select("h", F.lit(False).alias("ok"), F.lit("Parse").alias("error_kind"), F.col("message").alias("error_code")), allowMissingColumns=True)


def check_json(df: DataFrame, level: Level | str, key: str = "h", text: str = "json", compat: bool = True) -> DataFrame:
    """check()'s rows for ``df(key, text)`` of JSON histories, raw or wrapped."""
    decoded = json_files.decode(df, key, text)
    return _with_errors(checks.check(from_nested(decoded.where("message IS NULL")), level, compat=compat), decoded.where("message IS NOT NULL"))


def check_text(df: DataFrame, level: Level | str, key: str = "h", text: str = "text", compat: bool = True) -> DataFrame:
    """check()'s rows for ``df(key, text)`` of histories in the text form; variables keep their names."""
    parsed = dsl.parse_texts(df, key, text)
    return _with_errors(checks.check(from_nested(parsed.where("message IS NULL")), level, compat=compat), parsed.where("message IS NOT NULL"))


def trace_json(df: DataFrame, level: Level | str, key: str = "h", text: str = "json") -> DataFrame:
    """(h, trace) for JSON histories; those that don't decode are left out."""
    return trace.traces(from_nested(json_files.decode(df, key, text).where("message IS NULL")), level)


def numbered(hs: Histories) -> Histories:
    """Variables by number, from 0 in order of first appearance in each history."""
    ids = dsl.dictionary(hs)
    events = hs.events.join(ids, ["h", "variable"]).select("h", "txn", "pos", "op", F.col("id").cast("string").alias("variable"), "version")
    return Histories(events, hs.txns, hs.hist)


def text_to_json(df: DataFrame, key: str = "h", text: str = "text", compact: bool = False) -> DataFrame:
    """(h, json) with numbered variables for every text that parses."""
    return json_files.encode(numbered(dsl.read_histories(df, key, text)), compact)
