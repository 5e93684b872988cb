"""Structural validation: which write each read sees, and every way in which that is not allowed.

All operators share one resolved table; violations are rows, so that all of a history's are known, and the first is
chosen by an order: duplicate writes come first, then rules of local reads, then rules of external reads, each in event order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import ROOT, Histories

#: Error codes in use. Two more of the model are reserved and never raised.
SAME_VERSION_WRITE, INCOMPLETE, LOCAL_READ, UNCOMMITTED, OVERWRITTEN, NON_REPEATABLE = "SameVersionWrite", "IncompleteHistory", "InconsistentLocalRead", "UncommittedWrite", "OverwrittenRead", "NonRepeatableRead"
RESERVED = ("UnsuccessfulEventRead", "UnsuccessfulTransactionRead")


def same_version_writes(hs: Histories) -> DataFrame:
    """h, txn, pos, other_txn, other_pos: each write that repeats a (variable, version), with the one just before it."""
    w = Window.partitionBy("h", "variable", "version").orderBy("txn", "pos")
    writes = hs.events.where("op = 'W'").withColumn("o", F.lag(F.struct("txn", "pos")).over(w))
    return writes.where("o IS NOT NULL").select("h", "txn", "pos", F.col("o.txn").alias("other_txn"), F.col("o.pos").alias("other_pos"))


def resolve_reads(hs: Histories) -> DataFrame:
    """h, txn, pos, variable, version, w_txn, w_pos: the write each read sees. Uninitialised reads, and reads of version 0 that nobody
    wrote, see the root (w_txn 0); a null w_txn is a read of a version that nobody wrote. Of duplicate writes the last is seen."""
    reads = hs.events.where("op = 'R'").select("h", "txn", "pos", "variable", "version")
    writes = hs.events.where("op = 'W'").groupBy("h", "variable", "version").agg(F.max(F.struct("txn", "pos")).alias("w"))
    seen = reads.join(writes, ["h", "variable", "version"], "left")
    root = F.col("version").isNull() | ((F.col("version") == 0) & F.col("w").isNull())
    return seen.select("h", "txn", "pos", "variable", "version", F.when(root, F.lit(ROOT)).otherwise(F.col("w.txn")).cast("long").alias("w_txn"), F.col("w.pos").alias("w_pos"))


def final_writes(hs: Histories) -> DataFrame:
    """h, txn, variable, version, pos: the last write of each variable by each committed transaction."""
    done = hs.txns.where("committed").select("h", "txn")
    last = hs.events.where("op = 'W'").groupBy("h", "txn", "variable").agg(F.max(F.struct("pos", "version")).alias("l"))
    return last.join(done, ["h", "txn"], "left_semi").select("h", "txn", "variable", "l.version", "l.pos")


def incomplete_reads(resolved: DataFrame) -> DataFrame:
    return resolved.where("w_txn IS NULL").select("h", "txn", "pos", "variable", "version")


def inconsistent_local_reads(hs: Histories, resolved: DataFrame) -> DataFrame:
    """h, txn, pos, w_txn, w_pos: versioned reads that see a write of their own transaction, but not its latest one
    before them."""
    before = Window.partitionBy("h", "txn", "variable").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = hs.events.withColumn("own_pos", F.last(F.when(F.col("op") == "W", F.col("pos")), ignorenulls=True).over(before)).where("op = 'R' AND version IS NOT NULL").select("h", "txn", "pos", "own_pos")
    both = resolved.where("w_txn IS NOT NULL").join(own, ["h", "txn", "pos"])
    return both.where("w_txn = txn AND (own_pos IS NULL OR own_pos <> w_pos)").select("h", "txn", "pos", "w_txn", "w_pos")


def _external(hs: Histories, resolved: DataFrame) -> DataFrame:
    """Reads of a write, with the position of their writer's final write of the variable if it is committed."""
    final = final_writes(hs).select("h", F.col("txn").alias("w_txn"), "variable", F.col("pos").alias("final_pos"))
    return resolved.where(f"w_txn IS NOT NULL AND w_txn <> {ROOT}").join(final, ["h", "w_txn", "variable"], "left")


def dirty_reads(hs: Histories, resolved: DataFrame) -> DataFrame:
    """h, txn, pos, w_txn, w_pos: reads from a transaction that didn't commit a write of the variable."""
    return _external(hs, resolved).where("final_pos IS NULL").select("h", "txn", "pos", "w_txn", "w_pos")


def overwritten_reads(hs: Histories, resolved: DataFrame) -> DataFrame:
    """h, txn, pos, w_txn, w_pos, final_pos: reads of a committed transaction's write that isn't its last of the variable, own ones too."""
    return _external(hs, resolved).where("final_pos <> w_pos").select("h", "txn", "pos", "w_txn", "w_pos", "final_pos")


def non_repeatable_reads(hs: Histories, resolved: DataFrame) -> DataFrame:
    """h, txn, pos, w_txn, w_pos, first_txn, first_pos: reads that see another event than the transaction did before: its latest own write, or
    else the write its first read saw."""
    w = Window.partitionBy("h", "txn", "variable").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    seen = resolved.select("h", "txn", "pos", F.struct("w_txn", F.coalesce("w_pos", F.lit(0).cast("long")).alias("w_pos")).alias("seen"))
    all_ = hs.events.join(seen, ["h", "txn", "pos"], "left")
    own = F.last(F.when(F.col("op") == "W", F.struct(F.col("txn").alias("w_txn"), F.col("pos").alias("w_pos"))), ignorenulls=True).over(w)
    first = F.first(F.when(F.col("op") == "R", F.col("seen")), ignorenulls=True).over(w)
    expected = all_.withColumn("e", F.coalesce(own, first)).where("op = 'R' AND e IS NOT NULL AND seen.w_txn IS NOT NULL AND e <> seen")
    return expected.select("h", "txn", "pos", F.col("seen.w_txn").alias("w_txn"), F.col("seen.w_pos").alias("w_pos"), F.col("e.w_txn").alias("first_txn"), F.col("e.w_pos").alias("first_pos"))


def violations(hs: Histories, resolved: DataFrame | None = None) -> DataFrame:
    """h, stage, txn, pos, code of every structural violation (stages 0: duplicate writes, 1: local reads, 2: external reads)."""
    resolved = resolve_reads(hs) if resolved is None else resolved
    parts = [(0, SAME_VERSION_WRITE, same_version_writes(hs)), (1, INCOMPLETE, incomplete_reads(resolved)), (1, LOCAL_READ, inconsistent_local_reads(hs, resolved)), (2, UNCOMMITTED, dirty_reads(hs, resolved)), (2, OVERWRITTEN, overwritten_reads(hs, resolved))]
    out = None
    for stage, code, df in parts:
        rows = df.select("h", F.lit(stage).alias("stage"), "txn", "pos", F.lit(code).alias("code"))
        out = rows if out is None else out.unionByName(rows)
    return out


def first_error(hs: Histories, resolved: DataFrame | None = None) -> DataFrame:
    """h, code, txn, pos: what is reported of each history that isn't valid."""
    first = violations(hs, resolved).groupBy("h").agg(F.min(F.struct("stage", "txn", "pos", "code")).alias("v"))
    return first.select("h", "v.code", "v.txn", "v.pos")
