"""Relations between transactions, as edge tables (h, [variable,] src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import ROOT, Histories, session_of, txn_id
from .written import written


def external_reads(resolved: DataFrame) -> DataFrame:
    """h, variable, writer, txn: what each transaction reads from another one (or the root)."""
    return resolved.where("w_txn <> txn").select("h", "variable", F.col("w_txn").alias("writer"), "txn").distinct()


def writes(hs: Histories) -> DataFrame:
    """h, txn, variable: committed or not."""
    return hs.events.where("op = 'W'").select("h", "txn", "variable").distinct()


def session_order(hs: Histories) -> DataFrame:
    """h, src, dst: every earlier transaction of a session before every later one, the root before all. Quadratic in a session by
    definition; session_chain() has the covering pairs only."""
    t = hs.txns.select("h", "txn", session_of("txn").alias("s"))
    later = t.select("h", "s", F.col("txn").alias("dst"))
    pairs = t.join(later, ["h", "s"]).where("txn < dst").select("h", F.col("txn").alias("src"), "dst")
    return pairs.union(t.select("h", F.lit(ROOT).cast("long").alias("src"), F.col("txn").alias("dst")))


def session_chain(hs: Histories) -> DataFrame:
    """h, src, dst: the root before each first transaction, each transaction before the session's next, heights with gaps included."""
    before = F.lag("txn").over(Window.partitionBy("h", session_of("txn")).orderBy("txn"))
    return hs.txns.select("h", F.coalesce(before, F.lit(ROOT).cast("long")).alias("src"), F.col("txn").alias("dst"))


def write_read(resolved: DataFrame) -> DataFrame:
    """h, variable, src, dst."""
    return external_reads(resolved).select("h", "variable", F.col("writer").alias("src"), F.col("txn").alias("dst"))


def write_read_union(resolved: DataFrame) -> DataFrame:
    return write_read(resolved).select("h", "src", "dst").distinct()


def visibility_base(hs: Histories, resolved: DataFrame, closed: bool = True) -> DataFrame:
    """Session order and write-read order; ``closed``: with all of session order, not only its chain."""
    return (session_order(hs) if closed else session_chain(hs)).unionByName(write_read_union(resolved)).distinct()


def write_write(hs: Histories, wr: DataFrame, vis: DataFrame) -> DataFrame:
    """h, variable, src, dst: of two writers of a variable, src comes first if dst sees it, or if somebody who sees src reads the
    variable from dst. The root is no writer here."""
    w = writes(hs)
    src, dst = w.select("h", "variable", F.col("txn").alias("src")), w.select("h", "variable", F.col("txn").alias("dst"))
    direct = src.join(vis, ["h", "src"]).join(dst, ["h", "variable", "dst"]).where("src <> dst").select("h", "variable", "src", "dst")
    readers = wr.where(f"src <> {ROOT}").select("h", "variable", F.col("src").alias("w"), F.col("dst").alias("r"))
    seen = vis.select("h", "src", F.col("dst").alias("r"))
    through = readers.join(seen, ["h", "r"]).join(src, ["h", "variable", "src"]).where("src <> w AND src <> r")
    # the second writer is a writer by being read from; it must also be one of the history
    through = through.select("h", "variable", "src", F.col("w").alias("dst")).join(dst, ["h", "variable", "dst"], "left_semi")
    return direct.unionByName(through.select("h", "variable", "src", "dst")).distinct()


def read_write(hs: Histories, wr: DataFrame, vis: DataFrame) -> DataFrame:
    """h, variable, src, dst: a reader of w's write comes before another writer that w comes before, or that sees the reader."""
    w = writes(hs).select("h", "variable", F.col("txn").alias("dst"))
    readers = wr.where(f"src <> {ROOT}").select("h", "variable", F.col("src").alias("w"), F.col("dst").alias("src"))
    pairs = readers.join(w, ["h", "variable"]).where("w <> dst AND src <> dst")
    by_writer = pairs.join(vis.select("h", F.col("src").alias("w"), "dst"), ["h", "w", "dst"], "left_semi")
    by_reader = pairs.join(vis.select("h", "src", "dst"), ["h", "src", "dst"], "left_semi")
    return by_writer.unionByName(by_reader).select("h", "variable", "src", "dst").distinct()


def _by_session(t: DataFrame, txn: str) -> DataFrame:
    return t.withColumn("s", session_of(txn))


def plain_write_write(hs: Histories, wr: DataFrame) -> DataFrame:
    """write_write() where visibility is session order and write-read order as they are. Of a session's writers all before the last reader
    of a write (or before the write itself) come before it, so a row for each write and session stands for them until pairs are listed;
    each pair is made once, and session order, with its pairs of transactions that write something else, never is."""
    w = written(writes(hs), "writes")
    readers = wr.where(f"src <> {ROOT}").join(w.withColumnRenamed("txn", "src"), ["h", "variable", "src"], "left_semi")
    upto = _by_session(w.select("h", "variable", F.col("txn").alias("dst"), F.col("txn").alias("upto")), "upto")
    upto = upto.unionByName(_by_session(readers.select("h", "variable", F.col("src").alias("dst"), F.col("dst").alias("upto")), "upto"))
    upto = written(upto.groupBy("h", "variable", "s", "dst").agg(F.max("upto").alias("upto")), "upto")
    src = w.select("h", "variable", F.col("txn").alias("src"))
    ordered = _by_session(src, "src").join(upto, ["h", "variable", "s"]).where("src < upto AND src <> dst").select("h", "variable", "src", "dst")
    # whoever sees a writer by reading from it: a writer of the same variable, or a reader of it
    seen = wr.where(f"src <> {ROOT}").select("h", "src", F.col("dst").alias("r")).distinct().join(src, ["h", "src"])
    direct = seen.withColumnRenamed("r", "dst").join(w.withColumnRenamed("txn", "dst"), ["h", "variable", "dst"])
    through = seen.join(readers.select("h", "variable", F.col("src").alias("dst"), F.col("dst").alias("r")), ["h", "variable", "r"])
    near = _by_session(direct.select("h", "variable", "src", "dst").unionByName(through.select("h", "variable", "src", "dst")).where("src <> dst").distinct(), "src")
    near = near.join(upto, ["h", "variable", "s", "dst"], "left").where("upto IS NULL OR src >= upto").select("h", "variable", "src", "dst")
    return ordered.unionByName(near)


def plain_read_write(hs: Histories, wr: DataFrame) -> DataFrame:
    """read_write() where visibility is session order and write-read order as they are, with a row for each reader and session: ``least``,
    the first write there that it reads, and ``own``, itself in its own session; ``only`` is the write read if there is just one."""
    w = written(writes(hs), "writes").select("h", "variable", F.col("txn").alias("dst"))
    readers = written(wr.where(f"src <> {ROOT}").select("h", "variable", F.col("src").alias("w"), F.col("dst").alias("src")), "readers")
    ones = readers.groupBy("h", "variable", "src").agg(F.when(F.min("w") == F.max("w"), F.min("w")).alias("only"))
    none = F.lit(None).cast("long")
    after = _by_session(readers, "w").select("h", "variable", "s", "src", F.col("w").alias("least"), none.alias("own"), none.alias("only"))
    after = after.unionByName(_by_session(ones, "src").select("h", "variable", "s", "src", none.alias("least"), F.col("src").alias("own"), "only"))
    after = written(after.groupBy("h", "variable", "s", "src").agg(F.min("least").alias("least"), F.max("own").alias("own"), F.max("only").alias("only")), "after")
    behind = F.coalesce(F.expr("dst > least OR (dst > own AND (only IS NULL OR dst <> only))"), F.lit(False))
    ordered = after.join(_by_session(w, "dst"), ["h", "variable", "s"]).where((F.col("src") != F.col("dst")) & behind).select("h", "variable", "src", "dst")
    # other writers that read from the write, or from its reader
    seen = wr.where(f"src <> {ROOT}").select("h", F.col("src").alias("by"), "dst").distinct().join(w, ["h", "dst"])
    by_writer = readers.withColumnRenamed("w", "by").join(seen, ["h", "variable", "by"]).where("src <> dst").select("h", "variable", "src", "dst")
    by_reader = ones.join(seen.withColumnRenamed("by", "src"), ["h", "variable", "src"]).where("only IS NULL OR dst <> only").select("h", "variable", "src", "dst")
    near = _by_session(by_writer.unionByName(by_reader).distinct(), "dst").join(after, ["h", "variable", "s", "src"], "left").where(~behind)
    return ordered.unionByName(near.select("h", "variable", "src", "dst"))


def committed_order(hs: Histories, resolved: DataFrame, compat: bool = True) -> DataFrame:
    """h, src, dst: the order that read committed asks for: chains of sessions (from the root, for empty sessions too), writers before
    readers, and the writer read before, of two successive external reads of a variable in one transaction, before the one read after.
    ``compat`` keeps that last edge when both are the same writer, which makes repeated reads fail."""
    ext = resolved.where(f"w_txn <> txn AND w_txn <> {ROOT}")
    previous = F.lag("w_txn").over(Window.partitionBy("h", "txn", "variable").orderBy("pos"))
    order = ext.select("h", previous.alias("src"), F.col("w_txn").alias("dst")).where("src IS NOT NULL" + ("" if compat else " AND src <> dst"))
    starts = hs.hist.where("n_sessions > 0").select("h", F.explode(F.sequence(F.lit(1), "n_sessions")).alias("s")).select("h", F.lit(ROOT).cast("long").alias("src"), txn_id("s", F.lit(0)).alias("dst"))
    reads = ext.select("h", F.col("w_txn").alias("src"), F.col("txn").alias("dst"))
    return session_chain(hs).where(f"src <> {ROOT}").unionByName(starts).unionByName(reads).unionByName(order).distinct()
