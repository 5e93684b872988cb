"""History files: JSON (a wrapper object, or the sessions alone) and the text form; readers, writers, and the schema.

An event is ``{"Read": {"variable", "version"}}`` / ``{"Write": {...}}`` or ``["r" | "w", variable, version]``; both are read anywhere.
Files that can't be decoded become error rows.
"""

from __future__ import annotations

import json
import pathlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dsl import format_histories, parse_texts
from ..model import Histories, from_nested, to_nested, version_of, version_text

PARAMS = "struct<id: long, n_node: long, n_variable: long, n_transaction: long, n_event: long>"


def _event(v: Column) -> Column:
    """An event struct from a VARIANT of either encoding; null if it is neither."""
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    number = lambda path: version_of(get(path, "decimal(20,0)"))
    tag = get("$[0]", "string")
    tagged = lambda k: get(f"$.{k}.variable", "string").isNotNull()
    op = F.when(tag == "r", "R").when(tag == "w", "W").when(tagged("Read"), "R").when(tagged("Write"), "W")
    variable = F.coalesce(F.when(tag.isin("r", "w"), get("$[1]", "string")), get("$.Read.variable", "string"), get("$.Write.variable", "string"))
    version = F.coalesce(F.when(tag.isin("r", "w"), number("$[2]")), number("$.Read.version"), number("$.Write.version"))
    ok = op.isNotNull() & variable.isNotNull() & ((op == "R") | version.isNotNull())
    return F.when(ok, F.struct(op.alias("op"), variable.alias("variable"), version.alias("version")))


def decode(df: DataFrame, key: str = "h", text: str = "json") -> DataFrame:
    """h, sessions, params, info, start, end, message from JSON of either shape; message says what is wrong."""
    v = F.try_parse_json(F.col(text))
    whole = df.select(F.col(key).alias("h"), v.alias("v"))
    data = F.coalesce(F.try_variant_get("v", "$.data", "array<array<struct<events: array<variant>, committed: boolean>>>"), F.try_variant_get("v", "$", "array<array<struct<events: array<variant>, committed: boolean>>>"))
    wrapped = whole.select(
        "h", data.alias("d"), F.try_variant_get("v", "$.params", PARAMS).alias("params"), F.try_variant_get("v", "$.info", "string").alias("info"),
        *(F.try_variant_get("v", f"$.{c}", "timestamp").alias(c) for c in ("start", "end")),
    )
    txn = lambda t: F.struct(F.transform(t["events"], _event).alias("events"), F.coalesce(t["committed"], F.lit(True)).alias("committed"))
    out = wrapped.withColumn("sessions", F.transform("d", lambda s: F.transform(s, txn)))
    bad = F.exists("sessions", lambda s: F.exists(s, lambda t: t["events"].isNull() | F.exists(t["events"], lambda e: e.isNull())))
    message = F.when(F.col("d").isNull(), "not a history").when(bad, "unknown event")
    return out.select("h", F.when(message.isNull(), F.col("sessions")).alias("sessions"), "params", "info", "start", "end", message.alias("message"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """h (the file), sessions, message, line, column for every .json, .hist and .txt file below ``path``."""
    # not the text reader: it drops a file's last newline, which the text form needs
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("h"), F.decode("content", "UTF-8").alias("value"))
    none = F.lit(None).cast("int")
    as_json = decode(files.where("h LIKE '%.json'"), "h", "value").select("h", "sessions", "message", none.alias("line"), none.alias("column"))
    as_text = parse_texts(files.where("h LIKE '%.hist' OR h LIKE '%.txt'"), "h", "value")
    return as_json.unionByName(as_text)


def encode(hs: Histories, compact: bool = False) -> DataFrame:
    """h, json: sessions with tagged events, or 3-tuples if ``compact``. Numeric variables stay numbers."""

    def event(e: Column) -> Column:
        name = F.when(e["variable"].rlike("^[0-9]+$"), e["variable"]).otherwise(F.to_json(F.struct(e["variable"].alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["variable"].alias("x")))) - 6))
        version = F.coalesce(version_text(e["version"]), F.lit("null"))
        if compact:
            return F.concat(F.lit('["'), F.lower(e["op"]), F.lit('",'), name, F.lit(","), version, F.lit("]"))
        return F.concat(F.lit('{"'), F.when(e["op"] == "R", "Read").otherwise("Write"), F.lit('":{"variable":'), name, F.lit(',"version":'), version, F.lit("}}"))

    def txn(t: Column) -> Column:
        return F.concat(F.lit('{"events":['), F.array_join(F.transform(t["events"], event), ","), F.lit('],"committed":'), t["committed"].cast("string"), F.lit("}"))

    sessions = F.transform("sessions", lambda s: F.concat(F.lit("["), F.array_join(F.transform(s, txn), ","), F.lit("]")))
    return to_nested(hs).select("h", F.concat(F.lit("["), F.array_join(sessions, ","), F.lit("]")).alias("json"))


def write_json(hs: Histories, path: str, compact: bool = False) -> None:
    """One history a line, below a folder for each history."""
    encode(hs, compact).write.mode("overwrite").partitionBy("h").text(path)


def write_text(hs: Histories, path: str) -> None:
    format_histories(hs).write.mode("overwrite").partitionBy("h").text(path)


def write_wrapped(made: DataFrame, folder: str, info: str = "generated") -> None:
    """``{id}.json`` in a local folder for each history of ``made(id, sessions, params, start, end)``: the wrapper object, indented.
    Histories come to the driver one at a time."""
    data = encode(from_nested(made, "id", "sessions")).withColumnRenamed("h", "id")
    heads = made.withColumn("info", F.lit(info)).select("id", F.to_json(F.struct("params", "info", "start", "end")).alias("head"))
    out = pathlib.Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    for r in heads.join(data, "id").toLocalIterator():
        (out / f"{r['id']}.json").write_text(json.dumps(json.loads(r["head"]) | {"data": json.loads(r["json"])}, indent=2) + "\n")


def write_tables(hs: Histories, path: str) -> None:
    for name in ("events", "txns", "hist"):
        getattr(hs, name).write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str) -> Histories:
    return Histories(*(spark.read.parquet(f"{path}/{name}") for name in ("events", "txns", "hist")))


def json_schema() -> str:
    """JSON Schema of a history's sessions."""
    u64 = {"type": "integer", "minimum": 0}
    access = lambda version: {"type": "object", "properties": {"variable": u64, "version": version}, "required": ["variable"]}
    read, write = access({"type": ["integer", "null"], "minimum": 0}), access(u64)
    write["required"] = ["variable", "version"]
    tagged = [{"type": "object", "properties": {k: v}, "required": [k], "additionalProperties": False} for k, v in (("Read", read), ("Write", write))]
    pair = {"type": "array", "prefixItems": [{"enum": ["r", "w"]}, u64, {"type": ["integer", "null"]}], "minItems": 3, "maxItems": 3}
    txn = {"type": "object", "properties": {"events": {"type": "array", "items": {"anyOf": [*tagged, pair]}}, "committed": {"type": "boolean"}}, "required": ["events", "committed"]}
    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "array", "items": {"type": "array", "items": txn}}, indent=2)
