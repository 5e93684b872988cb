"""A monitor over an event stream: histories are checked when the watermark says they are complete.

``stream(h, txn, pos, op, variable, version, committed, n_sessions, ts)`` is gathered by history in sessions of event time: a history is
complete when none of its events came for ``gap``, late ones up to ``late``. So no edge of a clock's hour parts a history. Gathering
is a native stateful aggregation (its state is a list a history); each closed history goes through the same kernel as in batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Level
from ..plans.check import to_history
from ..plans.kernel import check_levels


def monitored(stream: DataFrame, gap: str = "1 hour", late: str = "10 minutes", compat: bool = True, budget: int | None = None) -> DataFrame:
    """h, start, strongest, first_failed, unknown (levels for which ``budget`` nodes were not enough): a row for each closed history, in append mode."""
    event = F.struct("txn", "pos", "op", "variable", "version")
    closed = (
        stream.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("window"), "h")
        .agg(F.collect_list(event).alias("events"), F.collect_set(F.struct("txn", "committed")).alias("txns"), F.max("n_sessions").alias("n_sessions"))
        .select("h", F.col("window.start").alias("start"), "events", "txns", "n_sessions")
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                got = check_levels(to_history(r.events, r.txns, r.n_sessions), None, compat, budget, False)
                passed = [str(x) for x in Level if got[x].ok]
                failed = [str(x) for x in Level if got[x].ok is False]
                unknown = [str(x) for x in Level if got[x].ok is None]
                out.append((r.h, r.start, passed[-1] if passed else None, failed[0] if failed else None, unknown))
            yield pd.DataFrame(out, columns=["h", "start", "strongest", "first_failed", "unknown"])

    return closed.mapInPandas(decide, f"h {dict(closed.dtypes)['h']}, start timestamp, strongest string, first_failed string, unknown array<string>")
