"""The four weaker levels as joins and fixpoints over all histories: no history needs to fit a task.

Cycles are found on tables of reach (a row for each transaction and session), not on closures of pairs. Each level returns (h, ok, error_kind,
error_level, error_code), one row a history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Histories, Level
from ..operators import reach, relations, validate
from ..operators.written import written


@dataclass(frozen=True)
class Stage:
    """Histories that failed so far, with their errors, the shared resolved reads, and the transactions that count."""

    resolved: DataFrame
    failed: DataFrame
    counted: Histories


def _failed(h: DataFrame, kind: str, level: str | None, code) -> DataFrame:
    return h.select("h", F.lit(kind).alias("error_kind"), F.lit(level).cast("string").alias("error_level"), (F.lit(code).cast("string") if code is None or isinstance(code, str) else code).alias("error_code"))


def _with(stage: Stage, more: DataFrame) -> Stage:
    return Stage(stage.resolved, stage.failed.unionByName(more.join(stage.failed, "h", "left_anti")), stage.counted)


def verdicts(hs: Histories, stage: Stage) -> DataFrame:
    return hs.hist.select("h").join(stage.failed, "h", "left").select("h", F.col("error_kind").isNull().alias("ok"), "error_kind", "error_level", "error_code")


def _cyclic(rows: DataFrame) -> DataFrame:
    return reach.on_cycles(reach.composed(rows)).select("h").distinct()


def _sound(stage: Stage) -> tuple[Histories, DataFrame]:
    """What is left of histories that haven't failed yet."""
    fine = stage.counted.where_histories(stage.counted.hist.join(stage.failed, "h", "left_anti"))
    return fine, stage.resolved.join(stage.failed, "h", "left_anti")


def committed_read(hs: Histories, compat: bool = True) -> Stage:
    counted = hs if compat else hs.committed()
    resolved = written(validate.resolve_reads(Histories(counted.events.where("op = 'R'").unionByName(hs.events.where("op = 'W'")), hs.txns, hs.hist)), "resolved")
    judged = hs if compat else Histories(counted.events.unionByName(hs.events.join(counted.txns, ["h", "txn"], "left_anti").where("op = 'W'")), hs.txns, hs.hist)
    bad = written(_failed(validate.first_error(judged, resolved), "NonAtomic", None, F.col("code")), "invalid")
    order = relations.committed_order(counted, resolved.where("w_txn IS NOT NULL"), compat)
    loops = _cyclic(reach.edges_of(order).unionByName(reach.chain(counted)))
    return _with(Stage(resolved, bad, counted), _failed(loops, "Cycle", Level.COMMITTED_READ, None))


def repeatable_read(hs: Histories, compat: bool = True) -> Stage:
    stage = committed_read(hs, compat)
    return _with(stage, _failed(validate.non_repeatable_reads(stage.counted, stage.resolved).select("h").distinct(), "NonAtomic", None, validate.NON_REPEATABLE))


def atomic_read(hs: Histories, compat: bool = True) -> Stage:
    """Visibility is session order and write-read order as they are, without what follows from both together."""
    stage = repeatable_read(hs, compat)
    stage = Stage(stage.resolved, written(stage.failed, "failed"), stage.counted)
    fine, resolved = _sound(stage)
    wr = written(relations.write_read(resolved), "wr")
    return _with(stage, _failed(_cyclic(reach.atomic_rows(fine, wr)), "Cycle", Level.ATOMIC_READ, None))


def causal_reach(hs: Histories, resolved: DataFrame) -> DataFrame:
    """The least transitive visibility closed under write-write order, as a table of reach."""
    wr, writes = written(relations.write_read(resolved), "wr"), written(relations.writes(hs), "writes")
    now = reach.composed(reach.chain(hs).unionByName(reach.edges_of(wr)))
    while True:
        more = reach.writers_before(writes, wr, now).join(now.withColumnRenamed("least", "known"), ["h", "txn", "s"], "left").where("known IS NULL OR least < known").drop("known")
        more = written(more, "ww")
        if not more.limit(1).count():
            return now
        now = reach.composed(now.unionByName(more))


def causal(hs: Histories, compat: bool = True) -> Stage:
    stage = repeatable_read(hs, compat)
    stage = Stage(stage.resolved, written(stage.failed, "failed"), stage.counted)
    fine, resolved = _sound(stage)
    return _with(stage, _failed(reach.on_cycles(causal_reach(fine, resolved)).select("h").distinct(), "Cycle", Level.CAUSAL, None))


PLANS = {Level.COMMITTED_READ: committed_read, Level.REPEATABLE_READ: repeatable_read, Level.ATOMIC_READ: atomic_read, Level.CAUSAL: causal}


def check(hs: Histories, level: Level, compat: bool = True) -> DataFrame:
    """A history without transactions passes every level. Without ``compat`` aborted transactions count for nothing but reads of their writes."""
    return verdicts(hs, PLANS[level](hs, compat))
