"""Line dedup: lines that many documents share are dropped everywhere but in the largest doc_id that holds them.

A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code points that
are found in at least ``min_docs`` documents count.

1. Every document emits (128-bit key hash, document, position) for its long enough lines; no text is moved.
2. The rows are range-partitioned by (hash, document) and sorted by hash, document descending, position. A streamed pass
   reads each run of equal hashes: its first document is the one that keeps the line, the rest is dropped once
   ``min_docs`` documents were seen. The document is part of the range key, so a hot line is spread over partitions.
3. A run that touches a partition's edge may go on in the next one. Its rows are passed on as undecided, and decided by one
   aggregate over them: two runs at most for each partition, so that side is broadcast.
4. Dropped positions become one compressed bitmap of kept lines a document; texts are only rewritten where asked.

Documents are counted by doc_id: rows that repeat one count once, whatever their texts, and the lines of all of them stay or go together;
bitmaps are by doc_id and a hash of the text. Null or empty text is one empty line. A null doc_id sorts below all and is one document.
An empty table gives an empty result. Other columns pass through ``rewritten``, whatever their names. Memory follows the longest
text, or a key's lines in ``min_docs`` documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, free_name, written

FIELDS = "h1 long, h2 long, doc_id long, t long, pos int"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc_id, t (a hash of the text), pos of every line whose key has ``min_chars`` code points or more."""
    lines = docs.where(F.char_length("text") >= min_chars).select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    long = lines.where(F.char_length("line") >= min_chars).select("doc_id", "t", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return long.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "t", "pos")


def streamed(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Decides the runs of one sorted partition: rows to drop come out as soon as their run has ``min_docs`` documents.

    Rows of the partition's first run pass undecided, as read; of its last run those before it had ``min_docs`` documents, or else one row
    (pos -1) that stands for them. ``docs`` of undecided rows: the documents that a row adds to its run. Between batches the open
    run's key, first and last document and number of documents are kept, and its rows while it has fewer than ``min_docs``.
    """
    key, first_run, first_doc, last_doc, n_docs = None, True, None, None, 0
    waiting: list[tuple[list[np.ndarray], np.ndarray]] = []

    def told(cols: list[np.ndarray], undecided: bool, docs: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(cols[0])
        arrays = [*map(pa.array, cols), pa.array(np.full(n, undecided)), pa.array(np.zeros(n, np.int64) if docs is None else docs.astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["h1", "h2", "doc_id", "t", "pos", "undecided", "docs"])

    def others(cols: list[np.ndarray]) -> pa.RecordBatch:
        drop = cols[2] != first_doc
        return told([c[drop] for c in cols], False)

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        n = len(cols[0])
        if not n:
            continue
        edge = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
        bounds = [0, *edge.tolist(), n]
        parts = [(0, bounds[1])] if len(bounds) == 2 else [(0, bounds[1]), (bounds[-2], n)]
        for part, (a, b) in enumerate(parts):
            if part and len(bounds) > 3:  # all runs that lie within this batch, at once
                c = [x[bounds[1] : bounds[-2]] for x in cols]
                begin = np.asarray(bounds[1:-2]) - bounds[1]
                size = np.diff(np.append(begin, len(c[0])))
                new = np.append(True, c[2][1:] != c[2][:-1])
                new[begin] = True
                hit = np.repeat(np.add.reduceat(new.astype(np.int64), begin) >= min_docs, size) & (c[2] != np.repeat(c[2][begin], size))
                if hit.any():
                    yield told([x[hit] for x in c], False)
            run = [x[a:b] for x in cols]
            if key != (run[0][0], run[1][0]):
                first_run = key is None
                key, first_doc, last_doc, n_docs = (run[0][0], run[1][0]), run[2][0], None, 0
                waiting.clear()
            new = np.append(last_doc is None or run[2][0] != last_doc, run[2][1:] != run[2][:-1])
            n_docs, last_doc = n_docs + int(new.sum()), run[2][-1]
            if first_run:
                yield told(run, True, new)
                continue
            waiting.append((run, new))
            if n_docs >= min_docs:
                for some, _ in waiting:
                    yield others(some)
                waiting.clear()
    if key is not None and not first_run:
        for some, new in waiting:
            yield told(some, True, new)
        if not waiting:
            yield told([np.array([key[0]]), np.array([key[1]]), np.array([first_doc]), np.array([0]), np.array([-1], np.int32)], True, np.array([n_docs]))


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, t, pos of every line to drop."""
    lines = written(keyed_lines(docs, min_chars), "lines")  # range partitioning reads its input twice
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(n, "h1", "h2", F.col("doc_id").desc()).sortWithinPartitions("h1", "h2", F.col("doc_id").desc(), "t", "pos")
    out = written(dealt.mapInArrow(lambda b: streamed(b, min_docs), f"{FIELDS}, undecided boolean, docs long"), "line-runs")
    open_ = out.where("undecided")
    # a row for each run at a partition's edge, two a partition at most
    runs = open_.groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    late = open_.where("pos >= 0").join(F.broadcast(runs), ["h1", "h2"]).where("doc_id <> keeper")
    return out.where("NOT undecided").select("doc_id", "t", "pos").unionByName(late.select("doc_id", "t", "pos"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, t, kept: a zlib-compressed little-endian bitmap for each document that loses lines; a set bit is a line to keep,
    and lines beyond its end stay."""

    @F.pandas_udf("binary")
    def packed(positions):
        def one(at):
            bits = np.ones(int(at.max()) // 8 * 8 + 8, np.uint8)
            bits[at] = 0
            return zlib.compress(np.packbits(bits, bitorder="little").tobytes())

        return positions.map(one)

    drops = dropped_lines(docs, min_chars, min_docs)
    return drops.groupBy("doc_id", "t").agg(F.collect_set("pos").alias("at")).select("doc_id", "t", packed("at").alias("kept"))


def kept_positions(bitmap: bytes | None, n: int) -> np.ndarray:
    """Whether each of ``n`` lines stays."""
    keep = np.ones(n, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little").astype(bool)[:n]
        keep[: len(bits)] = bits
    return keep


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, name: str = "keep_bitmap") -> DataFrame:
    """``docs`` and its rows' bitmaps (null: all lines stay). Moves each text once."""
    d, t = free_name(docs, "d"), free_name(docs, "t")
    maps = bitmaps.select(F.col("doc_id").alias(d), F.col("t").alias(t), F.col("kept").alias(name))
    same = (F.coalesce(docs["doc_id"], F.lit(-(1 << 63))) == maps[d]) & (F.xxhash64(docs["text"]) == maps[t])
    return docs.join(maps, same, "left").drop(d, t)


def digest(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The contract's columns."""

    def rows(batches):
        for batch in batches:
            total, gone, sha = [], [], []
            for text, bitmap in zip(batch.column(1), batch.column(2), strict=True):
                lines = (text.as_py() or "").split("\n")
                keep = kept_positions(bitmap.as_py(), len(lines))
                total.append(len(lines))
                gone.append(int(len(lines) - keep.sum()))
                sha.append(hashlib.sha256("\n".join(x for x, k in zip(lines, keep, strict=True) if k).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return with_bitmaps(docs.select("doc_id", "text"), bitmaps).mapInArrow(rows, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def rewritten(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with dropped lines taken out of ``text``; a null text stays null."""

    @F.pandas_udf("string")
    def kept_text(text, bitmap):
        def one(t, b):
            if t is None or b is None:
                return t
            lines = t.split("\n")
            return "\n".join(x for x, k in zip(lines, kept_positions(b, len(lines)), strict=True) if k)

        return text.combine(bitmap, one)

    keep = free_name(docs, "keep")
    joined = with_bitmaps(docs, bitmaps, keep)
    text = F.when(F.col(keep).isNull(), F.col("text")).otherwise(kept_text("text", keep))
    return joined.withColumn("text", text).select(*docs.columns)
