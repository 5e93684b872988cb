"""Data model: levels, the three canonical tables, and transaction ids.

A history is three long tables keyed by ``h`` (its id):

``events(h, txn, pos, op, variable, version)``  one row an event; ``op`` is R or W, a null version only on reads
``txns(h, txn, committed)``                     keeps transactions without events
``hist(h, n_sessions)``                         keeps sessions without transactions

``txn`` packs (session, height) into one BIGINT, session * 2^32 + height: sessions count from 1, heights from 0, so ids
sort by session, then height, and 0 is the root, the transaction that wrote every variable's initial state.

Versions are unsigned 64-bit numbers, of which only equality counts. A BIGINT holds them by their bits: those from 2^63 on are negative
in tables, and come out as they went in wherever histories are written as text or JSON.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHIFT, ROOT = 32, 0


class Level(StrEnum):
    """Weakest first."""

    COMMITTED_READ = "committed-read"
    REPEATABLE_READ = "repeatable-read"
    ATOMIC_READ = "atomic-read"
    CAUSAL = "causal"
    PREFIX = "prefix"
    SNAPSHOT_ISOLATION = "snapshot-isolation"
    SERIALIZABLE = "serializable"

    @property
    def rank(self) -> int:
        return list(Level).index(self)


def parse_level(name: str) -> Level:
    try:
        return Level(name)
    except ValueError:
        raise ValueError(f"unknown consistency level {name!r}; one of {', '.join(Level)}") from None


def wrapped(version: int) -> int:
    """An unsigned version as a table holds it."""
    return version - (1 << 64) if version >= 1 << 63 else version


def unwrapped(version: int) -> int:
    return version + (1 << 64) if version < 0 else version


def version_text(version: Column) -> Column:
    """A table's version as its unsigned decimal number."""
    return F.when(version < 0, (version.cast("decimal(20,0)") + F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string")).otherwise(version.cast("string"))


def version_of(number: Column) -> Column:
    """An unsigned decimal(20,0) as a table's version; null if it is none."""
    large = F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(number.between(F.lit(0), F.lit(str((1 << 64) - 1)).cast("decimal(20,0)")), F.when(number < large, number).otherwise(number - large - large)).cast("long")


def txn_id(session: Column | str, height: Column | str) -> Column:
    s, t = (F.col(x) if isinstance(x, str) else x for x in (session, height))
    return F.shiftleft(s.cast("long"), SHIFT) + t.cast("long")


def session_of(txn: Column | str) -> Column:
    return F.shiftright(F.col(txn) if isinstance(txn, str) else txn, SHIFT)


def height_of(txn: Column | str) -> Column:
    return (F.col(txn) if isinstance(txn, str) else txn).bitwiseAND(F.lit((1 << SHIFT) - 1))


EVENT = T.StructType([T.StructField("op", T.StringType()), T.StructField("variable", T.StringType()), T.StructField("version", T.LongType())])
TXN = T.StructType([T.StructField("events", T.ArrayType(EVENT)), T.StructField("committed", T.BooleanType())])
#: A nested history: sessions of transactions of events.
SESSIONS = T.ArrayType(T.ArrayType(TXN))


@dataclass(frozen=True)
class Histories:
    events: DataFrame
    txns: DataFrame
    hist: DataFrame

    def where_histories(self, keep: DataFrame) -> Histories:
        """Only the histories of ``keep(h)``."""
        return Histories(*(t.join(keep.select("h"), "h", "left_semi") for t in (self.events, self.txns, self.hist)))

    def committed(self) -> Histories:
        """Without aborted transactions; the others keep their ids, so heights may have gaps."""
        done = self.txns.where("committed")
        return Histories(self.events.join(done.select("h", "txn"), ["h", "txn"], "left_semi"), done, self.hist)

    def persisted(self) -> Histories:
        return Histories(self.events.persist(), self.txns.persist(), self.hist.persist())


def from_nested(df: DataFrame, key: str = "h", sessions: str = "sessions") -> Histories:
    """``df(key, sessions SESSIONS)`` to the long tables: explodes only, no shuffle. A null history has no sessions."""
    base = df.select(F.col(key).alias("h"), F.coalesce(F.col(sessions), F.array().cast(SESSIONS)).alias("ss"))
    txns = base.select("h", F.posexplode("ss").alias("s", "ts")).select("h", (F.col("s") + 1).alias("s"), F.posexplode("ts").alias("t", "x"))
    txns = txns.select("h", txn_id("s", "t").alias("txn"), "x")
    events = txns.select("h", "txn", F.posexplode("x.events").alias("pos", "e")).select("h", "txn", F.col("pos").cast("long").alias("pos"), "e.op", "e.variable", "e.version")
    return Histories(events, txns.select("h", "txn", F.coalesce("x.committed", F.lit(True)).alias("committed")), base.select("h", F.size("ss").alias("n_sessions")))


def to_nested(hs: Histories) -> DataFrame:
    """(h, sessions): the inverse of from_nested(); empty sessions and transactions come back."""
    ev = F.struct("pos", F.struct("op", "variable", "version").alias("e"))
    per_txn = hs.events.groupBy("h", "txn").agg(F.transform(F.sort_array(F.collect_list(ev)), lambda x: x["e"]).alias("events"))
    full = hs.txns.join(per_txn, ["h", "txn"], "left").select("h", session_of("txn").alias("s"), height_of("txn").alias("t"), F.struct(F.coalesce("events", F.array().cast(T.ArrayType(EVENT))).alias("events"), "committed").alias("x"))
    per_session = full.groupBy("h", "s").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda x: x["x"]).alias("txns"))
    held = per_session.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("s", "txns"))).alias("m"))
    none = F.array().cast(T.ArrayType(TXN))
    sessions = F.when(F.col("n_sessions") == 0, F.array().cast(SESSIONS)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest("n_sessions", F.lit(1))), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), none)))
    return hs.hist.join(held, "h", "left").select("h", sessions.alias("sessions"))
