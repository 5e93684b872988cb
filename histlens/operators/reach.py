"""Reachability between transactions as ``reach(h, txn, s, least)``: the least height in session ``s`` that a path from ``txn`` leads to.

A session's transactions are a chain, so whoever reaches one reaches all later ones: a row for each transaction and session says all
that the pairs of a closure would, in sessions times transactions rows at most. Paths double each round, so a round more than the logarithm
of the longest path is enough, long sessions included. The root comes before everything and never after; it is left out here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import ROOT, Histories, height_of, session_of, txn_id
from . import graph, relations
from .written import written


def edges_of(pairs: DataFrame) -> DataFrame:
    """``pairs(h, src, dst)`` as rows of reach, not yet composed."""
    inner = pairs.where(f"src <> {ROOT}").select("h", F.col("src").alias("txn"), session_of("dst").alias("s"), height_of("dst").alias("least"))
    return inner.groupBy("h", "txn", "s").agg(F.min("least").alias("least"))


def chain(hs: Histories) -> DataFrame:
    """Each transaction's next one in its session."""
    following = F.lead("txn").over(Window.partitionBy("h", session_of("txn")).orderBy("txn"))
    return hs.txns.select("h", "txn", following.alias("next")).where("next IS NOT NULL").select("h", "txn", session_of("txn").alias("s"), height_of("next").alias("least"))


def least_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h", "txn", "s").agg(F.min("least").alias("least"))


def composed(rows: DataFrame) -> DataFrame:
    """All that paths of ``rows`` reach."""
    now, said = written(least_of(rows), "reach"), None
    while True:
        told = now.agg(F.count(F.lit(1)).alias("n"), F.sum("least").alias("total")).first()
        if said == told:
            return now
        said = told
        over = now.select("h", "txn", txn_id("s", "least").alias("mid"))
        further = over.join(now.select("h", F.col("txn").alias("mid"), "s", "least"), ["h", "mid"]).select("h", "txn", "s", "least")
        now = written(least_of(now.select("h", "txn", "s", "least").unionByName(further)), "reach")


def on_cycles(reach: DataFrame) -> DataFrame:
    """h, v: transactions that reach themselves."""
    return reach.where((F.col("s") == session_of("txn")) & (F.col("least") <= height_of("txn"))).select("h", F.col("txn").alias("v"))


def pairs_of(hs: Histories, reach: DataFrame) -> DataFrame:
    """h, src, dst: every pair, the root's too. As large as the closure it lists."""
    ends = hs.txns.select("h", F.col("txn").alias("dst"), session_of("txn").alias("s"), height_of("txn").alias("height"))
    inner = reach.select("h", F.col("txn").alias("src"), "s", "least").join(ends, ["h", "s"]).where("height >= least").select("h", "src", "dst")
    return inner.unionByName(hs.txns.select("h", F.lit(ROOT).cast("long").alias("src"), F.col("txn").alias("dst")))


def writers_before(writes: DataFrame, reads: DataFrame, reach: DataFrame) -> DataFrame:
    """Rows of reach for write-write order: a writer that reaches a reader of its variable comes before the write that is read.

    ``writes(h, txn, variable)``; ``reads(h, variable, src, dst)``. Of a session's later readers only the least height that they read from in
    each session matters, so writers look up a running minimum, and pairs of writers and readers are never listed.
    """
    inner = reads.where(f"src <> {ROOT}")
    seen = inner.select("h", "variable", session_of("dst").alias("s"), session_of("src").alias("to"), height_of("dst").alias("at"), height_of("src").alias("from"))
    targets = seen.select("h", "variable", "s", "to").distinct()
    asks = writes.select("h", "txn", "variable").join(reach, ["h", "txn"]).join(targets, ["h", "variable", "s"])
    asks = asks.select("h", "variable", "s", "to", F.col("least").alias("at"), F.lit(None).cast("long").alias("from"), "txn")
    order = Window.partitionBy("h", "variable", "s", "to").orderBy(F.col("at").desc(), F.col("txn").asc_nulls_first())
    found = seen.withColumn("txn", F.lit(None).cast("long")).unionByName(asks).withColumn("found", F.min("from").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = found.where("txn IS NOT NULL AND found IS NOT NULL").select("h", "txn", F.col("to").alias("s"), F.col("found").alias("least"))
    # the own write and later ones of its session are behind it anyway
    return least_of(rows.where((F.col("s") != session_of("txn")) | (F.col("least") < height_of("txn"))))


def atomic_rows(hs: Histories, wr: DataFrame) -> DataFrame:
    """Rows of reach, not yet composed, of visibility as it is (session order and write-read order) and its write-write order: of the edges
    to one session the first, as the others follow by its chain."""
    links, writes = chain(hs), relations.writes(hs)
    # a writer that a reader reads from sees that reader alone, and nothing behind it
    direct = writes.select("h", "variable", F.col("txn").alias("a")).join(wr.select("h", F.col("src").alias("a"), F.col("dst").alias("r")).distinct(), ["h", "a"])
    through = direct.join(wr.select("h", "variable", F.col("dst").alias("r"), F.col("src").alias("b")), ["h", "variable", "r"]).where("b <> 0 AND a <> b AND a <> r").select("h", F.col("a").alias("src"), F.col("b").alias("dst"))
    return links.unionByName(edges_of(wr)).unionByName(writers_before(writes, wr, links)).unionByName(edges_of(through))


def cycles(rows: DataFrame, most: int = graph.MOST) -> DataFrame:
    """h, v, first: transactions on cycles of ``rows``, not yet composed; ``first`` are those on a cycle with the history's least. Histories
    of up to ``most`` rows are solved in tasks, larger ones composed."""
    rows = written(rows.select("h", "txn", "s", "least"), "rows")
    large = graph.larger(rows, most)
    near = rows if large is None else rows.join(large, "h", "left_anti")
    found = written(graph.components(near.select("h", F.col("txn").alias("src"), txn_id("s", "least").alias("dst"))), "components")
    least = found.groupBy("h").agg(F.min("component").alias("m"))
    out = found.join(least, "h").select("h", "v", (F.col("component") == F.col("m")).alias("first"))
    if large is None:
        return out
    reach = composed(rows.join(large, "h", "left_semi"))
    on = written(on_cycles(reach), "on")
    start = on.groupBy("h").agg(F.min("v").alias("m"))
    ahead = reach.join(start.select("h", F.col("m").alias("txn")), ["h", "txn"]).select("h", "s", F.col("least").alias("to"))
    back = reach.join(start, "h").where((F.col("s") == session_of("m")) & (F.col("least") <= height_of("m"))).select("h", F.col("txn").alias("v"), F.lit(True).alias("back"))
    both = on.withColumn("s", session_of("v")).join(ahead, ["h", "s"], "left").join(back, ["h", "v"], "left")
    return out.union(both.select("h", "v", F.coalesce((F.col("to") <= height_of("v")) & F.col("back"), F.lit(False)).alias("first")))


def first_edge(hs: Histories, wr: DataFrame, on: DataFrame) -> DataFrame:
    """h, src, dst: the least edge on a cycle of each history, from ``on`` (cycles() of atomic_rows()). It leaves the least transaction on
    any; all of that one's edges are looked at, those that atomic_rows() leaves out too."""
    part = written(on.where("first").select("h", "v"), "first")
    start = written(part.groupBy("h").agg(F.min("v").alias("m")), "start")
    later = part.join(start, "h").where((session_of("v") == session_of("m")) & (F.col("v") > F.col("m"))).select("h", "m", F.col("v").alias("dst"))
    seen = wr.select("h", F.col("src").alias("m"), F.col("dst")).join(start, ["h", "m"]).select("h", "m", "dst").distinct()
    reads = wr.where(f"src <> {ROOT}").select("h", "variable", F.col("src").alias("w"), F.col("dst").alias("r"))
    behind = relations.writes(hs).withColumnRenamed("txn", "m").join(start, ["h", "m"]).join(reads, ["h", "variable"]).where("w <> m AND r <> m")
    behind = behind.join(seen.select("h", "m", F.col("dst").alias("r"), F.lit(True).alias("direct")), ["h", "m", "r"], "left")
    through = behind.where(F.col("direct").isNotNull() | ((session_of("r") == session_of("m")) & (F.col("r") > F.col("m")))).select("h", "m", F.col("w").alias("dst"))
    edges = later.unionByName(seen).unionByName(through).join(part.select("h", F.col("v").alias("dst")), ["h", "dst"], "left_semi")
    return edges.groupBy("h").agg(F.min("dst").alias("dst"), F.min("m").alias("src")).select("h", "src", "dst")
