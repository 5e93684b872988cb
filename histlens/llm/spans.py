"""Substring dedup by sliding sentence spans.

A sentence ends at ``.``, ``!`` or ``?`` before white space, or at a line's end; pieces without a word belong to the sentence
before. A span is a run of two or more consecutive sentences of at least ``min_words`` words (one sentence is enough with ``alone_words``).
From every sentence the shortest span that begins there is taken, and to every sentence the shortest that ends there, so that a repeated
run is covered to its first and last sentence. Spans are compared by a 128-bit hash of their words.
Sentences covered by a span that isn't the first with its words are removed: first by doc_id, then by place in the text.

1. Every text is cut and hashed once: a written table of a row a document, with its distinct spans and what repeats within the text.
2. Spans meet by hash in counts, pre-aggregated, so that a common passage costs a row a task.
3. Repeated spans, a key each, meet the documents' spans over SALT keys, so that one in every document isn't one task's; spans are
   first tested against a bitmap of the repeated hashes (2^22 bits, whatever the table). They go to their documents as (start, length).

Null or empty texts have no sentences. Rows that repeat a doc_id count as one place: a span they share stays in all of them
unless a smaller doc_id has it. A null doc_id sorts below all. An empty table gives an empty result. Other columns are ignored.
Memory follows the longest text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, in_bitmap, met, written

END = re.compile(r"[.!?]+[\x20\x09-\x0D]+|[\x20\x09-\x0D]*\n[\x20\x09-\x0D]*")
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Params:
    min_words: int = 20
    min_sentences: int = 2
    alone_words: int = 50


def sentences(text: str | None) -> tuple[list[int], list[list[bytes]]]:
    """Where each sentence ends (white space after it included) and its words."""
    text = text or ""
    ends, words, start = [], [], 0
    for end in [*(m.end() for m in END.finditer(text)), len(text)]:
        found = text[start:end].encode().split()
        if found:
            ends.append(end)
            words.append(found)
        elif ends:
            ends[-1] = end
        start = end
    return ends, words


def spans(words: list[list[bytes]], p: Params) -> list[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, digest) of the shortest spans from every sentence and to every sentence, in order."""
    n = [len(w) for w in words]
    joined = [b" ".join(w) for w in words]
    places = set()
    j, total = 0, 0  # total: words of sentences i..j-1
    for i in range(len(n)):
        while j < len(n) and (total < p.min_words or j - i < p.min_sentences and total < p.alone_words):
            total += n[j]
            j += 1
        if total >= p.min_words and (j - i >= p.min_sentences or total >= p.alone_words):
            places.add((i, j))
        total -= n[i]
    i, total = len(n), 0  # total: words of sentences i..j-1
    for j in range(len(n), 0, -1):
        while i > 0 and (total < p.min_words or j - i < p.min_sentences and total < p.alone_words):
            i -= 1
            total += n[i]
        if total >= p.min_words and (j - i >= p.min_sentences or total >= p.alone_words):
            places.add((i, j))
        total -= n[j - 1]
    return [(i, j - i, xxhash.xxh3_128_digest(b" ".join(joined[i:j]))) for i, j in sorted(places)]


def _distinct(found: list[tuple[int, int, bytes]]) -> tuple[list[tuple[int, int, bytes]], list[tuple[int, int]]]:
    """First spans of a text, and those that repeat an earlier one of it."""
    seen, first, again = set(), [], []
    for i, n, d in found:
        if d in seen:
            again.append((i, n))
        else:
            seen.add(d)
            first.append((i, n, d))
    return first, again


COVER = "array<struct<start: int, n: int>>"


def span_rows(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, t (a hash of the text), h1, h2, start, n (arrays: the document's distinct spans), again (repeats within the text)."""
    longs, ints, cover = pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                cols: list[list] = [[], [], [], [], []]
                for text in part.column(1):
                    first, again = _distinct(spans(sentences(text.as_py())[1], p))
                    h = np.frombuffer(b"".join(d for *_, d in first), np.int64).reshape(-1, 2)
                    for column, x in zip(cols, (h[:, 0], h[:, 1], [i for i, *_ in first], [n for _, n, _ in first], [{"start": i, "n": n} for i, n in again]), strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(c, k) for c, k in zip(cols, (longs, longs, ints, ints, cover), strict=True))], names=["doc_id", "t", "h1", "h2", "start", "n", "again"])

    held = docs.where(F.col("text") != "").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("t"))
    return held.mapInArrow(rows, f"doc_id long, t long, h1 array<long>, h2 array<long>, start array<int>, n array<int>, again {COVER}")


def repeated_spans(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, t, covers array<struct<start, n>>: each document's spans that a smaller doc_id has too, or that repeat in its text."""
    table = written(span_rows(docs, p), "spans")
    at = lambda c: F.get(F.col(c), F.col("i")).alias(c)
    found = table.select("doc_id", "t", "h2", "start", "n", F.posexplode("h1").alias("i", "h1")).select("doc_id", "t", "h1", at("h2"), at("start"), at("n"))
    counts = found.select("h1", "h2", "doc_id").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first"))
    shared = written(counts.where("rows > 1").select("h1", "h2", "first"), "shared")
    held = bitmap(shared.select(F.col("h1").alias("x")), 1 << 22)
    later = met(found.where(in_bitmap(F.col("h1"), held)), shared, ["h1", "h2"], "doc_id").where("doc_id <> first").select("doc_id", "t", "start", "n")
    own = table.select("doc_id", "t", F.inline("again"))
    return later.unionByName(own).groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "n")).alias("covers"))


def removed(text: str | None, covers: list[dict] | None) -> tuple[list[int], np.ndarray]:
    """Where sentences end, and which of them go."""
    ends, _ = sentences(text)
    gone = np.zeros(len(ends), bool)
    for c in covers or ():
        gone[c["start"] : c["start"] + c["n"]] = True
    return ends, gone


def kept_text(text: str | None, ends: list[int], gone: np.ndarray) -> str:
    if not ends:
        return text or ""
    starts = [0, *ends[:-1]]
    return "".join(text[a:b] for a, b, g in zip(starts, ends, gone, strict=True) if not g)


def dedup(docs: DataFrame, p: Params = Params(), with_text: bool = True) -> DataFrame:
    """doc_id, n_sentences, n_removed, kept_sha256 (and text, what is left) for every row of ``docs(doc_id, text)``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone_n, sha, left = [], [], [], []
            for text, covers in zip(batch.column("text"), batch.column("covers"), strict=True):
                text = text.as_py()
                ends, gone = removed(text, covers.as_py())
                kept = kept_text(text, ends, gone)
                total.append(len(ends))
                gone_n.append(int(gone.sum()))
                sha.append(hashlib.sha256(kept.encode()).hexdigest())
                left.append(None if text is None else kept)
            cols = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone_n, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(left, pa.string())] if with_text else cols, names=names)

    names = ["doc_id", "n_sentences", "n_removed", "kept_sha256"] + ["text"] * with_text
    covers = repeated_spans(docs, p).withColumnsRenamed({"doc_id": "_d", "t": "_t"})
    same = (F.coalesce(docs["doc_id"], F.lit(NO_ID)) == covers["_d"]) & (F.xxhash64(docs["text"]) == covers["_t"])
    joined = docs.select("doc_id", "text").join(covers, same, "left").select("doc_id", "text", "covers")
    return joined.mapInArrow(rows, "doc_id long, n_sentences long, n_removed long, kept_sha256 string" + ", text string" * with_text)
