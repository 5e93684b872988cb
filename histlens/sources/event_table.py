"""Histories projected from an event table ``(event_id, ts, user_id, event_type, value, props)``.

A history is an hour; its sessions are users modulo ``SESSIONS``, numbered densely; two events make a transaction; a
variable is the property k modulo ``VARIABLES``. Purchases and sign-ups write version event_id + 1, everything else reads the
variable's latest write before it. ``stale`` makes every 11th event read the write before that; ``all_committed`` drops
the rule by which some transactions abort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Histories, session_of, txn_id

SESSIONS, VARIABLES, EPOCH = 4, 5, "2024-01-01"


def project(events: DataFrame, stale: bool = False, all_committed: bool = False) -> Histories:
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))) / 3_600_000_000)
    base = events.select(
        hour.cast("long").alias("h"), (F.col("user_id") % SESSIONS).alias("u"), "ts", "event_id", F.when(F.col("event_type").isin("purchase", "signup"), "W").otherwise("R").alias("op"),
        (F.get_json_object("props", "$.k").cast("long") % VARIABLES).cast("string").alias("variable"),
    )
    order = Window.partitionBy("h").orderBy("ts", "event_id")
    mine = Window.partitionBy("h", "u").orderBy("ts", "event_id")
    before = Window.partitionBy("h", "variable").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    written = F.when(F.col("op") == "W", F.col("event_id") + 1)
    ranked = base.withColumn("s", F.dense_rank().over(Window.partitionBy("h").orderBy("u"))).withColumn("rn", F.row_number().over(mine) - 1)
    last = F.last(written, ignorenulls=True).over(before)
    seen = ranked.withColumn("last", last)
    # the write before the latest: the latest write that the latest writer itself saw
    prior = seen.withColumn("prior", F.last(F.when(F.col("op") == "W", F.coalesce("last", F.lit(-1))), ignorenulls=True).over(before)) if stale else seen.withColumn("prior", F.lit(None).cast("long"))
    read = F.when((F.col("event_id") % 11 == 0) & (F.col("prior") > 0), F.col("prior")).otherwise(F.col("last")) if stale else F.col("last")
    flat = prior.select("h", txn_id("s", F.floor(F.col("rn") / 2)).alias("txn"), (F.col("rn") % 2).cast("long").alias("pos"), "op", "variable", F.when(F.col("op") == "W", F.col("event_id") + 1).otherwise(read).alias("version"))
    txns = flat.select("h", "txn").distinct()
    t = F.col("txn")
    ok = F.lit(True) if all_committed else (F.col("h") * 31 + session_of(t) * 7 + t.bitwiseAND(F.lit((1 << 32) - 1))) % 13 != 0
    return Histories(flat, txns.withColumn("committed", ok), flat.groupBy("h").agg(F.max(session_of(t)).cast("int").alias("n_sessions")))


def read(spark: SparkSession, sf_dir: str, stale: bool = False, all_committed: bool = False) -> Histories:
    return project(spark.read.parquet(f"{sf_dir}/events.parquet"), stale, all_committed)
