"""Traces for display: a history, its verdict, witness edges and committed-order edges as one JSON text a history."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.dsl import ParseError, parse
from ..model import Histories, Level, parse_level, unwrapped
from .check import ident, packed, row_of, to_history
from .kernel import check_levels


def sessions_of(hist) -> list[list[dict]]:
    """Per transaction: id, last read and last write of each variable, events, committed."""
    out: list[list[dict]] = [[] for _ in range(hist.n_sessions)]
    by: dict[int, list] = {t: [] for t in sorted(hist.committed)}
    for t, _, op, x, v in hist.events:
        by[t].append((op, x, None if v is None else unwrapped(v)))
    for t, events in by.items():
        out[ident(t)["session_id"] - 1].append({
            "id": ident(t), "reads": {x: v for op, x, v in events if op == "R"}, "writes": {x: v for op, x, v in events if op == "W"},
            "events": [{"type": op, "variable": x, "version": v} for op, x, v in events], "committed": hist.committed[t],
        })
    return out


def trace(hist, level: Level, compat: bool = True) -> dict:
    v = check_levels(hist, [level], compat)[level]
    out: dict = {"ok": v.ok, "level": str(level), "session_count": hist.n_sessions, "transaction_count": len(hist.committed), "sessions": sessions_of(hist)}
    edge = lambda e: [ident(e[0]), ident(e[1])]
    structural = hist.structural_error()
    out["wr_edges"] = [] if structural or not hist.committed else [edge(e) for e in sorted(hist.committed_order(compat))]
    row = row_of(level, v, True)
    if v.ok:
        kind = row["witness_kind"]
        if kind == "SaturationOrder":
            out["witness"], out["witness_edges"] = {kind: [edge(e) for e in v.edges]}, [edge(e) for e in v.edges]
        else:
            steps = v.order if kind == "SplitCommitOrder" else [x for x in v.order if x[1]]
            out["witness"] = {kind: [[ident(t), w] if kind == "SplitCommitOrder" else ident(t) for t, w in steps]}
            out["witness_edges"] = [edge((a[0], b[0])) for a, b in zip(steps, steps[1:], strict=False) if a[0] != b[0]]
    else:
        out["error"] = {"kind": v.kind, "level": None if v.level is None else str(v.level), "code": v.code, "where": v.where}
    return out


def traces(hs: Histories, level: Level | str, compat: bool = True) -> DataFrame:
    """h, trace (JSON)."""
    wanted, rows = parse_level(level), packed(hs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": pdf.h, "trace": [json.dumps(trace(to_history(r.events, r.txns, r.n_sessions), wanted, compat)) for r in pdf.itertuples(index=False)]})

    return rows.mapInPandas(run, f"h {dict(rows.dtypes)['h']}, trace string")


def trace_text(text: str, level: Level | str) -> str:
    """The trace of one history in the text form, or its parse error."""
    from ..model import SHIFT
    from .kernel import History

    try:
        sessions = parse(text)
    except ParseError as e:
        return json.dumps({"ok": False, "error": str(e)})
    events, committed = [], {}
    for s, txns in enumerate(sessions, 1):
        for t, txn in enumerate(txns):
            i = (s << SHIFT) + t
            committed[i] = txn["committed"]
            events += [(i, p, e["op"], e["variable"], e["version"]) for p, e in enumerate(txn["events"])]
    return json.dumps(trace(History(events, committed, len(sessions)), parse_level(level)))
