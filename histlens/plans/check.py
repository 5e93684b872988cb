"""Checks of all histories at once, per-history rows in and out.

``check`` packs each history into one row (its events meet in one shuffle on ``h``) and decides it in memory with the exact
kernel, Arrow batches at a time. ``saturation`` has the four weaker levels as joins for histories too large for one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import SHIFT, Histories, Level, parse_level
from . import ordering
from .kernel import History, Relations, Verdict, check_levels, linearize, saturate

#: How the three strongest levels are decided: by search over frontiers, or by order constraints.
ENGINES = {"search": linearize, "ordering": ordering.solve}

PACKED = "events array<struct<txn: long, pos: long, op: string, variable: string, version: long>>, txns array<struct<txn: long, committed: boolean>>, n_sessions int"
TXN_ID = "struct<session_id: long, session_height: long>"
RESULT = (
    "level string, ok boolean, error_kind string, error_level string, error_code string, error_where array<long>, witness_kind string, "
    f"commit_order array<{TXN_ID}>, split_order array<struct<txn: {TXN_ID}, is_write: boolean>>, saturation_edges array<struct<src: {TXN_ID}, dst: {TXN_ID}>>"
)


def packed(hs: Histories) -> DataFrame:
    """h, events, txns, n_sessions: one row a history."""
    ev = hs.events.groupBy("h").agg(F.collect_list(F.struct("txn", "pos", "op", "variable", "version")).alias("events"))
    tx = hs.txns.groupBy("h").agg(F.collect_list(F.struct("txn", "committed")).alias("txns"))
    return hs.hist.join(tx, "h", "left").join(ev, "h", "left").select("h", "events", "txns", "n_sessions")


def to_history(events, txns, n_sessions) -> History:
    at = lambda e, k: e[k]
    get = lambda v: None if v is None or v != v else int(v)
    return History(
        [(int(at(e, "txn")), int(at(e, "pos")), at(e, "op"), at(e, "variable"), get(at(e, "version"))) for e in (() if events is None else events)],
        {int(at(t, "txn")): bool(at(t, "committed")) for t in (() if txns is None else txns)},
        int(n_sessions),
    )


def ident(txn: int) -> dict[str, int]:
    return {"session_id": txn >> SHIFT, "session_height": txn & ((1 << SHIFT) - 1)}


def row_of(level: Level, v: Verdict, witness: bool) -> dict:
    split = level == Level.SNAPSHOT_ISOLATION
    has_order, has_edges = witness and v.ok and v.order is not None, witness and v.ok and v.edges is not None
    split = split and has_order and bool(v.order)
    return {
        "level": str(level), "ok": v.ok, "error_kind": v.kind, "error_level": None if v.level is None else str(v.level), "error_code": v.code,
        "error_where": None if v.where is None else [int(x) for x in v.where],
        "witness_kind": "SplitCommitOrder" if split else "CommitOrder" if has_order else "SaturationOrder" if has_edges else None,
        "commit_order": [ident(t) for t, w in v.order if w] if has_order and not split else None,
        "split_order": [{"txn": ident(t), "is_write": w} for t, w in v.order] if split else None,
        "saturation_edges": [{"src": ident(a), "dst": ident(b)} for a, b in v.edges] if has_edges else None,
    }


def check(hs: Histories, *levels: Level | str, compat: bool = True, witness: bool = True, budget: int | None = None, engine: str = "search") -> DataFrame:
    """h and RESULT, a row for each history and level (all seven by default).

    The search goes to its end unless ``budget`` bounds its nodes; ``ok`` is null where it ran out: unknown is never reported as a
    violation. An error may carry a
    weaker level than the one asked for. ``engine`` is one of ENGINES; their verdicts are equal, their witnesses need not be. ``error_where`` is (transaction, position) of a structural error or an edge on a cycle.
    """
    wanted = [parse_level(x) for x in levels] or list(Level)
    rows, solve = packed(hs), ENGINES[engine]

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                for level, v in check_levels(to_history(r.events, r.txns, r.n_sessions), wanted, compat, budget, witness, solve).items():
                    out.append({"h": r.h, **row_of(level, v, witness)})
            if out:
                yield pd.DataFrame(out)

    return rows.mapInPandas(decide, f"h {dict(rows.dtypes)['h']}, {RESULT}")


def level_summary(hs: Histories, compat: bool = True, budget: int | None = None) -> DataFrame:
    """h, strongest (null: none), first_failed, error_kind, error_code and a flag a level: by one pass over each history.

    Where ``budget`` nodes were not enough for a level its flag is null: such a level is neither passed nor failed.
    """
    names, rows = [str(x) for x in Level], packed(hs)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                got = check_levels(to_history(r.events, r.txns, r.n_sessions), None, compat, budget, False)
                failed = next((x for x in Level if got[x].ok is False), None)
                passed = [str(x) for x in Level if got[x].ok]
                bad = got[failed] if failed else Verdict(True)
                out.append((r.h, passed[-1] if passed else None, None if failed is None else str(failed), bad.kind, bad.code, *(got[x].ok for x in Level)))
            yield pd.DataFrame(out, columns=["h", "strongest", "first_failed", "error_kind", "error_code", *(x.replace("-", "_") for x in names)])

    flags = ", ".join(f"{x.replace('-', '_')} boolean" for x in names)
    return rows.mapInPandas(decide, f"h {dict(rows.dtypes)['h']}, strongest string, first_failed string, error_kind string, error_code string, {flags}")


def causal_steps(hs: Histories) -> DataFrame:
    """h, step, phase, src, dst: the pairs each round of the causal check adds; the last round (phase ww) has none and says so by nulls.
    Histories with structural errors have no steps."""
    rows = packed(hs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                one = to_history(r.events, r.txns, r.n_sessions)
                if one.structural_error() or one.non_repeatable():
                    continue
                steps: list = []
                saturate(Relations(one), steps)
                for k, found in enumerate(steps):
                    out += [(r.h, k, "vis", a, b) for a, b in found] or [(r.h, k, "ww", None, None)]
            if out:
                yield pd.DataFrame(out, columns=["h", "step", "phase", "src", "dst"]).astype({"src": "Int64", "dst": "Int64"})

    return rows.mapInPandas(run, f"h {dict(rows.dtypes)['h']}, step int, phase string, src long, dst long")
