"""Witnesses as tables, and their independent validation by joins: what the order must satisfy, not how it was found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ROOT, Histories, Level, txn_id
from ..operators import relations, validate


def order_rows(checked: DataFrame, level: Level) -> DataFrame:
    """h, i, txn, is_write from check()'s passing rows at a strong level."""
    if level == Level.SNAPSHOT_ISOLATION:
        rows = checked.where("ok AND split_order IS NOT NULL").select("h", F.posexplode("split_order").alias("i", "x"))
        return rows.select("h", "i", txn_id(F.col("x.txn.session_id"), F.col("x.txn.session_height")).alias("txn"), "x.is_write")
    rows = checked.where("ok AND commit_order IS NOT NULL").select("h", F.posexplode("commit_order").alias("i", "x"))
    return rows.select("h", "i", txn_id(F.col("x.session_id"), F.col("x.session_height")).alias("txn"), F.lit(True).alias("is_write"))


def consecutive(order: DataFrame) -> DataFrame:
    """h, i, src, dst: an order's neighbours as edges."""
    nxt = order.select("h", (F.col("i") - 1).alias("i"), F.col("txn").alias("dst"))
    return order.join(nxt, ["h", "i"]).select("h", "i", F.col("txn").alias("src"), "dst")


def invalid_orders(hs: Histories, order: DataFrame, level: Level) -> DataFrame:
    """h, why: what an order of a strong level breaks; nothing for a valid one.

    ``missing``: not every transaction (half) once. ``visibility``: against session or write-read order. ``overwritten``: a write
    between a read's source and the read. ``overlap``: writers of one variable whose spans overlap (snapshot isolation).
    A prefix order places writes only: a transaction may read at any point before its write and after the writes it must see, so it is
    held to the earliest.
    """
    split = level == Level.SNAPSHOT_ISOLATION
    at = order.groupBy("h", "txn").agg(F.min(F.when(~F.col("is_write") if split else F.col("is_write"), F.col("i"))).alias("r"), F.max(F.when(F.col("is_write"), F.col("i"))).alias("w"), F.count(F.lit(1)).alias("n"))
    want = hs.txns.join(order.select("h").distinct(), "h", "left_semi").select("h", "txn")
    missing = want.join(at, ["h", "txn"], "left").where(f"n IS NULL OR n <> {2 if split else 1} OR r IS NULL OR w IS NULL" + (" OR r > w" if split else "")).select("h", F.lit("missing").alias("why"))
    resolved = validate.resolve_reads(hs)
    root = want.select("h").distinct().select("h", F.lit(ROOT).cast("long").alias("txn"), F.lit(-1).alias("r"), F.lit(-1).alias("w"))
    pos = at.select("h", "txn", "r", "w").unionByName(root)
    as_ = lambda k: pos.select("h", F.col("txn").alias(k), F.col("r").alias(f"{k}_r"), F.col("w").alias(f"{k}_w"))
    vis = relations.visibility_base(hs, resolved, closed=False)
    if level == Level.PREFIX:  # just behind the last write to see
        seen = vis.join(pos.select("h", F.col("txn").alias("src"), "w"), ["h", "src"]).groupBy("h", F.col("dst").alias("txn")).agg((F.max("w") + 1).alias("r"))
        pos = pos.drop("r").join(seen, ["h", "txn"], "left").withColumn("r", F.coalesce("r", F.lit(0)))
    crossed = vis.join(as_("src"), ["h", "src"]).join(as_("dst"), ["h", "dst"]).where("src_w >= dst_w" if level == Level.PREFIX else "src_w >= dst_r").select("h", F.lit("visibility").alias("why"))
    reads = relations.write_read(resolved).select("h", "variable", "src", "dst").join(as_("src"), ["h", "src"]).join(as_("dst"), ["h", "dst"])
    other = relations.writes(hs).select("h", "variable", F.col("txn").alias("other")).join(as_("other"), ["h", "other"])
    over = reads.join(other, ["h", "variable"]).where("other <> src AND other <> dst AND src_w < other_w AND other_w < dst_r").select("h", F.lit("overwritten").alias("why"))
    out = missing.union(crossed).union(over)
    if split:
        one = relations.writes(hs).select("h", "variable", F.col("txn").alias("a")).join(as_("a"), ["h", "a"])
        two = other.select("h", "variable", F.col("other").alias("b"), F.col("other_r").alias("b_r"), F.col("other_w").alias("b_w"))
        out = out.union(one.join(two, ["h", "variable"]).where("a < b AND NOT (a_w < b_r OR b_w < a_r)").select("h", F.lit("overlap").alias("why")))
    return out.distinct()
