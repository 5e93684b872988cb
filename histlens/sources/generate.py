"""Generated histories: seeded random ones, and a fixed workload of a given shape, by expressions and windows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import SHIFT, Histories, from_nested, to_nested, txn_id


def _draw(seed: int, what: int, of: int) -> Column:
    """A number below ``of`` for each event, by the seed and the event's place."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), "h", "node", "t", "e"), F.lit(of))


def random_histories(spark: SparkSession, n_hist: int, n_node: int, n_variable: int, n_transaction: int, n_event: int, seed: int = 0) -> Histories:
    """Session 1 first writes version 0 of every variable. Then each event draws a variable and a side of a coin: on heads a
    transaction's first read of the variable returns what was latest before the transaction, else the variable's next version is written."""
    if n_variable < 1:
        raise ValueError("a history needs a variable")
    hist = spark.range(n_hist).select(F.col("id").alias("h"))
    upto = lambda n: F.filter(F.sequence(F.lit(0).cast("long"), F.lit(max(n, 1) - 1).cast("long")), lambda i: i < n)
    txns = hist.select("h", F.explode(upto(n_node)).alias("node")).select("h", "node", F.explode(upto(n_transaction)).alias("t"))
    # session 1's heights begin behind its first transaction
    place = txn_id(F.col("node") + 1, F.col("t") + F.when(F.col("node") == 0, 1).otherwise(0)).alias("txn")
    drawn = txns.select("h", "node", "t", place, F.explode(upto(n_event)).alias("e"))
    drawn = drawn.select("h", "txn", "e", (F.col("node") * n_transaction + F.col("t")).alias("turn"), _draw(seed, 1, n_variable).alias("x"), (_draw(seed, 2, 2) == 0).alias("heads"))
    nth = F.row_number().over(Window.partitionBy("h", "txn", "x", "heads").orderBy("e"))
    sided = drawn.withColumn("op", F.when(F.col("heads") & (nth == 1), "R").otherwise("W"))
    write = F.when(F.col("op") == "W", 1).otherwise(0)
    mine = F.sum(write).over(Window.partitionBy("h", "x").orderBy("turn", "e").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.sum(write).over(Window.partitionBy("h", "x").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    events = sided.select("h", "txn", F.col("e").alias("pos"), "op", F.col("x").cast("string").alias("variable"), F.when(F.col("op") == "W", mine).otherwise(F.coalesce(before, F.lit(0))).cast("long").alias("version"))
    start = F.lit(1 << SHIFT).cast("long").alias("txn")
    first = hist.where(F.lit(n_node > 0))
    initial = first.select("h", start, F.explode(upto(n_variable)).alias("pos")).select("h", "txn", "pos", F.lit("W").alias("op"), F.col("pos").cast("string").alias("variable"), F.lit(0).cast("long").alias("version"))
    every = first.select("h", start).unionByName(txns.select("h", place)).withColumn("committed", F.lit(True))
    return Histories(initial.unionByName(events), every, hist.withColumn("n_sessions", F.lit(n_node)))


def generate(spark: SparkSession, n_hist: int, n_node: int, n_variable: int, n_transaction: int, n_event: int, seed: int = 0) -> DataFrame:
    """id, sessions, params, start, end, seconds. History ``id`` depends on the seed and its id alone; all are made by one plan, whose time they carry."""
    made = to_nested(random_histories(spark, n_hist, n_node, n_variable, n_transaction, n_event, seed)).withColumnRenamed("h", "id")
    params = F.struct("id", *(F.lit(v).cast("long").alias(k) for k, v in (("n_node", n_node), ("n_variable", n_variable), ("n_transaction", n_transaction), ("n_event", n_event))))
    timed = made.withColumns({"start": F.current_timestamp(), "end": F.current_timestamp()})
    return timed.withColumn("params", params).withColumn("seconds", (F.unix_micros("end") - F.unix_micros("start")) / 1e6)


def histories(made: DataFrame) -> Histories:
    return from_nested(made, "id", "sessions")


def workload(spark: SparkSession, n_hist: int, sessions: int, txns: int, events: int, variables: int = 10) -> Histories:
    """The same regular history ``n_hist`` times, by expressions alone: transaction k (counted through all sessions) touches variables
    (k + e) mod ``variables``; even e read the latest version, odd e write the next one."""
    per = txns * events
    flat = spark.range(n_hist * sessions * per).select(F.floor(F.col("id") / (sessions * per)).alias("h"), (F.col("id") % (sessions * per)).alias("i"))
    k, e = F.floor(F.col("i") / events), F.col("i") % events
    rows = flat.select("h", "i", (F.shiftleft((F.floor(k / txns) + 1).cast("long"), SHIFT) + k % txns).alias("txn"), e.alias("pos"), F.when(e % 2 == 0, "R").otherwise("W").alias("op"), ((k + e) % variables).cast("string").alias("variable"))
    w = F.sum(F.when(F.col("op") == "W", 1).otherwise(0)).over(Window.partitionBy("h").orderBy("i"))
    counted = rows.withColumn("n", F.when(F.col("op") == "W", w))
    last = F.last("n", ignorenulls=True).over(Window.partitionBy("h", "variable").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    done = counted.select("h", "txn", "pos", "op", "variable", last.cast("long").alias("version"))
    return Histories(done, done.select("h", "txn").distinct().withColumn("committed", F.lit(True)), done.select("h").distinct().withColumn("n_sessions", F.lit(sessions)))
