"""What the text operators share: table access, written intermediate tables, stable hashing."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import numpy as np
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts define it: space and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything else.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as it takes to clash with no column of ``df``."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A session without one gets a temporary folder in local mode (tests), and an
    error on a cluster, whose machines don't see each other's folders."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="histlens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: lineage ends here and a lost executor costs a re-read.

    Tables are removed when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/histlens/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd"} | (options or {})).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """At the driver's end, if its JVM still answers."""
    with contextlib.suppress(Py4JError, OSError, AttributeError):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


SALT = 16


def met(many: DataFrame, few: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``few``, which has a row a key: a key's rows are dealt over SALT keys by their ``by``."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")
    return many.withColumn("_salt", salt).join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [*on, "_salt"], how).drop("_salt")


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of ``hashes(x)`` modulo ``bits``, as bits / 64 longs: bounded whatever the table's size."""
    slot = F.pmod("x", F.lit(bits))
    parts = hashes.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    for r in parts.collect():
        out[r["k"]] = r["bits"]
    return out


def in_bitmap(h: Column, held: np.ndarray) -> Column:
    """Whether the bit of hash ``h`` is set: true for all that were put in, and for few others while the bitmap isn't full."""
    slot = F.pmod(h, F.lit(len(held) * 64))
    longs = F.split(F.lit(",".join(map(str, held.tolist()))), ",").cast("array<long>")  # folded to an array; a literal array goes element by element
    word = F.get(longs, F.shiftright(slot, 6).cast("int"))
    return F.getbit(word, slot.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() would also change other letters, so it only serves texts that are all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8; bytes.split() and bytes.lower() know ASCII only, as wanted."""
    return text.encode().lower().split() if text else []


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """An invertible finaliser over uint64 (shift, multiply, shift)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs_hashed(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each run of ``n`` consecutive word hashes; one for the whole where there are fewer; none for none."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out
