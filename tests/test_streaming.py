from pyspark.sql import functions as F

from histlens.streaming.monitor import monitored


def test_closed_histories_are_checked(spark, tmp_path):
    src = tmp_path / "in"
    base = "TIMESTAMP '2024-01-01 00:00:00'"
    rows = [("a", 1 << 32, 0, "W", "x", 1, True, 2, 0), ("a", 2 << 32, 0, "R", "x", 1, True, 2, 10), ("b", 1 << 32, 0, "W", "x", 1, False, 2, 0), ("b", 2 << 32, 0, "R", "x", 1, True, 2, 5), ("late", 1 << 32, 0, "W", "x", 1, True, 1, 9000)]
    df = spark.createDataFrame(rows, "h string, txn long, pos long, op string, variable string, version long, committed boolean, n_sessions int, sec int")
    df.withColumn("ts", F.expr(f"{base} + make_interval(0, 0, 0, 0, 0, 0, sec)")).drop("sec").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    q = monitored(stream).writeStream.format("memory").queryName("verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r["h"]: (r["strongest"], r["first_failed"]) for r in spark.table("verdicts").collect()}
    assert got == {"a": ("serializable", None), "b": (None, "committed-read")}


def test_a_history_over_a_full_hour_is_one(spark, tmp_path):
    """A write just before an hour's end and its read just after; a pause of more than the gap parts histories of one name."""
    rows = [("a", 1 << 32, 0, "W", "x", 1, True, 2, 3590), ("a", 2 << 32, 0, "R", "x", 1, True, 2, 3660), ("a", 1 << 32, 0, "W", "x", 2, True, 1, 20000), ("late", 1 << 32, 0, "W", "x", 1, True, 1, 90000)]
    df = spark.createDataFrame(rows, "h string, txn long, pos long, op string, variable string, version long, committed boolean, n_sessions int, sec int")
    df.withColumn("ts", F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, sec)")).drop("sec").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = monitored(stream).writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted((r["h"], r["start"].hour, r["strongest"], r["first_failed"]) for r in spark.table("hours").collect())
    assert got == [("a", 0, "serializable", None), ("a", 5, "serializable", None)]


def test_budget_gives_unknown(spark, tmp_path):
    rows = [("a", 1 << 32, 0, "W", "x", 1, True, 2, 0), ("a", 2 << 32, 0, "R", "x", 1, True, 2, 10), ("late", 1 << 32, 0, "W", "x", 1, True, 1, 9000)]
    df = spark.createDataFrame(rows, "h string, txn long, pos long, op string, variable string, version long, committed boolean, n_sessions int, sec int")
    df.withColumn("ts", F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, sec)")).drop("sec").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = monitored(stream, budget=0).writeStream.format("memory").queryName("open_verdicts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r["h"]: (r["strongest"], r["first_failed"], r["unknown"]) for r in spark.table("open_verdicts").collect()}
    assert got == {"a": ("causal", None, ["prefix", "snapshot-isolation", "serializable"])}
