"""Scoring by prediction by partial matching: a pretrained byte-context trie gives each document its code length.

The trie has the contexts of 0 to ``order`` previous symbols over 256 bytes (A-Z lower-cased, UTF-8) and an edge symbol that
stands before a text and ends it. A node's counts n, with N their sum and d the number of distinct symbols, give a symbol
n / (N + d) and the escape d / (N + d) (method C); symbols that a longer context offered are excluded below; last, what is
left is uniform. Counts cover all training text.

1. *Learn.* One pass over the training rows counts words and the grams of ORDER (2) to ``order`` previous symbols; partial counts meet by
   key and become one written table of a row a word or context, the latter with what followed it packed into bytes.
2. *Ask.* One pass over all rows cuts each input partition into batches of about BATCH_BYTES and writes the rows with their batch's
   number, and the batch's distinct words and contexts: each crosses once for a batch, not for a document.
3. *Score.* What is known of the asked keys goes to the batch's partition; batches are dealt there by number, one each, sorted so
   that what is known comes first and texts stream. A gram that was seen has n / (N + d); for contexts of which some gram
   wasn't, the whole distribution over all orders is worked out.

Contexts of up to ORDER symbols are a trie of at most 257^3 counts whatever the corpus, which comes to the driver and goes
out again; the longer ones and the words grow with the corpus and stay distributed. Words are told apart by 63 bits of a hash.

A null text is empty: it has the end token only. Rows that repeat are scored and counted each, in the batches of their places.
Without training rows every symbol has 1/257 and no token is known. An empty table gives an empty result. Columns other than doc_id
and text are for ``training`` only and don't come out. Memory follows a batch's distinct keys, or the longest text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashes_of, words_of, written

ORDER, EDGE, SYMBOLS = 2, 256, 257
BATCH_BYTES, CHUNK_BYTES = 16 << 20, 4 << 20
ADDED = 0.1
#: Keys: contexts are code * 8 + order, words are negative, and this one counts the training texts.
TEXTS = 0
FOLLOWER = np.dtype([("sym", "<u2"), ("n", "<u8")])


def symbols(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols, each text as ``order`` edges, its bytes and an edge, and where each text starts."""
    parts, starts, at = [], [], 0
    edge = np.full(order, EDGE, np.int16)
    for t in texts:
        data = np.frombuffer((t or "").encode().lower(), np.uint8)
        parts += [edge, data, edge[:1]]
        starts.append(at)
        at += len(data) + order + 1
    return np.concatenate(parts).astype(np.int64), np.array(starts, np.int64)


def grams(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(code of ``order`` previous symbols and the symbol) for every byte and end, and where each text's begin."""
    s, starts = symbols(texts, order)
    code = s[: len(s) - order].copy()
    for i in range(1, order + 1):
        code *= SYMBOLS
        code += s[i : len(s) - order + i]
    inside = np.ones(len(s), bool)
    for i in range(order):
        inside[starts + i] = False
    return code[inside[order:]], starts - order * np.arange(len(starts))


def summed(code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    at, distinct = pd.factorize(code)
    return distinct, np.bincount(at, n, len(distinct)).astype(np.int64)


def word_keys(words: list[bytes]) -> np.ndarray:
    return (hashes_of(words) >> np.uint64(1)).view(np.int64) + np.int64(-(1 << 63))


def word_key(word: bytes) -> int:
    return (xxhash.xxh3_64_intdigest(word) >> 1) - (1 << 63)


def model_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """key, n, followers (binary, FOLLOWER records by symbol; null for words) over ``docs(text)``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held, size, texts = [], 0, 0

        def told(key: np.ndarray, sym: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(sym.astype(np.int16)), pa.array(n)], names=["key", "sym", "n"])

        def told_words() -> pa.RecordBatch:
            out = told(word_keys(list(words)), np.zeros(len(words)), np.fromiter(words.values(), np.int64, len(words)))
            words.clear()
            return out

        def fold() -> None:
            found.append(summed(grams(held, order)[0]))
            held.clear()

        def told_grams() -> Iterator[pa.RecordBatch]:
            code, n = (np.concatenate(x) for x in zip(*found, strict=True))
            for o in range(order, ORDER - 1, -1):
                code, n = summed(code % SYMBOLS ** (o + 1), n)
                yield told(code // SYMBOLS * 8 + o, code % SYMBOLS, n)
            found.clear()

        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                words.update(words_of(t))
                held.append(t)
                size += len(t or "")
                texts += 1
                if size >= CHUNK_BYTES:
                    fold()
                    size = 0
                    if sum(len(x) for x, _ in found) > 6_000_000:
                        yield from told_grams()
                if len(words) > 400_000:
                    yield told_words()
        if held:
            fold()
        if texts:
            yield from told_grams()
            yield told_words()
            yield told(np.array([TEXTS]), np.zeros(1), np.array([texts]))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (key, sym); the last key of a batch waits for the next one."""
        rest: list[np.ndarray] | None = None

        def told(key: np.ndarray, sym: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (sym[1:] != sym[:-1])
            at = np.flatnonzero(new)
            key, sym, n = key[at], sym[at], np.add.reduceat(n, at)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            is_context = key[first] > TEXTS
            packed = np.empty(len(key), FOLLOWER)
            packed["sym"], packed["n"] = sym, n
            size = np.diff(np.append(first, len(key))) * is_context
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32) * FOLLOWER.itemsize
            data = packed[np.repeat(is_context, np.diff(np.append(first, len(key))))]
            valid = pa.py_buffer(np.packbits(is_context, bitorder="little").tobytes())
            blobs = pa.Array.from_buffers(pa.binary(), len(first), [valid, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(np.add.reduceat(n, first)), blobs], names=["key", "n", "followers"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut:
                yield told(*(c[:cut] for c in cols))
            rest = [c[cut:] for c in cols]
        if rest is not None:
            yield told(*rest)

    found = docs.select("text").mapInArrow(partial, "key long, sym short, n long")
    return found.repartition("key").sortWithinPartitions("key", "sym").mapInArrow(merged, "key long, n long, followers binary")


def unpacked(key: np.ndarray, followers: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(gram code, count) of contexts and what followed them."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0)
    offsets = np.frombuffer(followers.buffers()[1], np.int32)[followers.offset : followers.offset + len(followers) + 1]
    each = np.frombuffer(followers.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(FOLLOWER)
    of = np.repeat(key // 8, np.diff(offsets) // FOLLOWER.itemsize)
    return of * SYMBOLS + each["sym"], each["n"].astype(np.float64)


class LongContexts:
    """The contexts that a batch got back: ``key`` and what followed each."""

    def __init__(self, key: np.ndarray, followers: pa.BinaryArray, order: int, trie: Trie) -> None:
        self.order, self.trie = order, trie
        code, n = unpacked(key, followers)
        of = np.repeat(key % 8, np.diff(np.frombuffer(followers.buffers()[1], np.int32)[followers.offset : followers.offset + len(followers) + 1]) // FOLLOWER.itemsize) if len(key) else key
        self.level: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for o in range(ORDER + 1, order + 1):
            mine = of == o
            by = np.argsort(code[mine])
            self.level[o] = code[mine][by], n[mine][by]
        code, n = self.level[order]
        owner, _ = pd.factorize(code // SYMBOLS)
        total, distinct = np.bincount(owner, n), np.bincount(owner)
        self.logp = np.log10(n / (total + np.where(distinct < SYMBOLS, distinct, 0))[owner]) if len(code) else np.zeros(0)

    def counts(self, context: np.ndarray, o: int) -> np.ndarray:
        """(contexts, SYMBOLS): what followed each of ``context``, of ``o`` symbols, sorted or not."""
        code, n = self.level[o] if o > ORDER else (self.trie.gram, self.trie.n)
        lo, hi = np.searchsorted(code, context * SYMBOLS), np.searchsorted(code, (context + 1) * SYMBOLS)
        out = np.zeros((len(context), SYMBOLS))
        row = np.repeat(np.arange(len(context)), hi - lo)
        at = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        out[row, code[at] % SYMBOLS] = n[at]
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """log10 probability of each text, its end included."""
        code, starts = grams(texts, self.order)
        at, distinct = pd.factorize(code)
        known, logp = self.level[self.order][0], np.empty(len(distinct))
        place = np.searchsorted(known, distinct)
        seen = np.zeros(len(distinct), bool)
        if len(known):
            place = np.minimum(place, len(known) - 1)
            seen = known[place] == distinct
            logp[seen] = self.logp[place[seen]]
        rest = np.flatnonzero(~seen)
        of, contexts = pd.factorize(distinct[rest] // SYMBOLS)
        by = np.argsort(of, kind="stable")
        for a in range(0, len(contexts), 1024):
            some = contexts[a : a + 1024]
            lo, hi = np.searchsorted(of[by], [a, a + len(some)])
            levels = [self.counts(some % SYMBOLS**o, o) for o in range(self.order, ORDER - 1, -1)]
            p = np.log10(distribution([*levels, self.trie.n1[some % SYMBOLS], self.trie.n0]))
            logp[rest[by[lo:hi]]] = p[of[by[lo:hi]] - a, distinct[rest[by[lo:hi]]] % SYMBOLS]
        return np.add.reduceat(logp[at], starts, dtype=np.float64) if len(starts) else np.zeros(0)


def distribution(levels: list[np.ndarray]) -> np.ndarray:
    """Probabilities (rows, SYMBOLS) from the counts of a context and its suffixes, longest first; each (rows or 1, SYMBOLS)."""
    rows = levels[0].shape[0]
    p = np.zeros((rows, SYMBOLS))
    open_ = np.ones((rows, SYMBOLS), bool)
    weight = np.ones((rows, 1))
    for n in levels:
        n = np.where(open_, n, 0).astype(np.float64)
        total, distinct = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        left = open_.sum(1, keepdims=True) - distinct
        escapes = np.where(left > 0, distinct, 0)  # with no symbol left there is nothing to escape to
        scale = np.maximum(total + escapes, 1)
        p += weight * n / scale
        weight = np.where(total > 0, weight * escapes / scale, weight)
        open_ &= n == 0
    return p + weight * open_ / np.maximum(open_.sum(1, keepdims=True), 1)


class Trie:
    """log10 probabilities: a row for each context of two symbols that was seen, else its suffix's row."""

    def __init__(self, gram: np.ndarray, n: np.ndarray) -> None:
        first, middle, last = gram // SYMBOLS**2, gram // SYMBOLS % SYMBOLS, gram % SYMBOLS
        n0 = np.bincount(last, n, SYMBOLS)[None]
        n1 = np.bincount(middle * SYMBOLS + last, n, SYMBOLS**2).reshape(SYMBOLS, SYMBOLS)
        pairs = np.unique(first * SYMBOLS + middle)
        by = np.argsort(gram)
        self.gram, self.n, self.n1, self.n0 = gram[by], n[by], n1, n0
        self.row = np.concatenate([np.arange(SYMBOLS)] * SYMBOLS).astype(np.int32)
        self.row[pairs] = SYMBOLS + np.arange(len(pairs))
        self.logp = np.empty((SYMBOLS + len(pairs), SYMBOLS), np.float32)
        self.logp[:SYMBOLS] = np.log10(distribution([n1, n0]))
        order = np.argsort(first * SYMBOLS + middle, kind="stable")
        key = (first * SYMBOLS + middle)[order]
        for a in range(0, len(pairs), 1024):
            some = pairs[a : a + 1024]
            lo, hi = np.searchsorted(key, [some[0], some[-1] + 1])
            n2 = np.zeros((len(some), SYMBOLS))
            at = order[lo:hi]
            np.add.at(n2, (np.searchsorted(some, key[lo:hi]), last[at]), n[at])
            self.logp[SYMBOLS + a : SYMBOLS + a + len(some)] = np.log10(distribution([n2, n1[some % SYMBOLS], n0]))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """log10 probability of each text, its end included."""
        code, starts = grams(texts)
        each = self.logp[self.row[code // SYMBOLS], code % SYMBOLS]
        return np.add.reduceat(each, starts, dtype=np.float64) if len(starts) else np.zeros(0)


def fit(counts: DataFrame) -> Trie:
    """The trie of contexts of ORDER symbols, at most 257^2 rows of ``model_counts``."""
    found = counts.where(f"key > {TEXTS} AND key % 8 = {ORDER}").select("key", "followers").toArrow().combine_chunks()
    if not found.num_rows:
        return Trie(np.zeros(0, np.int64), np.zeros(0))
    return Trie(*unpacked(found.column("key").chunk(0).to_numpy(), found.column("followers").chunk(0).cast(pa.binary())))


def batched(docs: DataFrame, order: int) -> DataFrame:
    """part, chunk (the batch), key, is_doc, doc_id, text: the rows of ``docs(doc_id, text)``, and each batch's distinct words and contexts."""
    id_type = dict(docs.dtypes)["doc_id"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, size = TaskContext.get().partitionId(), 0, 0
        words: set[bytes] = set()
        contexts: list[np.ndarray] = []
        held: list[str | None] = []
        held_size = 0

        def told(key: pa.Array, ids: pa.Array, texts: pa.Array, is_doc: bool) -> pa.RecordBatch:
            n = len(key)
            same = lambda x, kind: pa.array(np.full(n, x, kind))
            return pa.RecordBatch.from_arrays([same(part, np.int64), same(chunk, np.int64), key, same(is_doc, bool), ids, texts], names=["part", "chunk", "key", "is_doc", "doc_id", "text"])

        def fold() -> None:
            if held and order > ORDER:
                contexts.append(pd.unique(grams(held, order)[0] // SYMBOLS))
            held.clear()

        def asked(id_kind: pa.DataType) -> pa.RecordBatch:
            fold()
            keys = [word_keys(list(words))]
            code = np.concatenate(contexts) if contexts else np.zeros(0, np.int64)
            for o in range(order, ORDER, -1):
                code = pd.unique(code % SYMBOLS**o)
                keys.append(code * 8 + o)
            words.clear()
            contexts.clear()
            key = np.concatenate(keys)
            return told(pa.array(key), pa.nulls(len(key), id_kind), pa.nulls(len(key), pa.string()), False)

        kind = None
        for batch in batches:
            kind, begin = batch.column(0).type, 0
            texts = batch.column(1).cast(pa.string())
            for i, t in enumerate(texts):
                t = t.as_py()
                words.update(words_of(t))
                held.append(t)
                size += len(t or "")
                held_size += len(t or "")
                if held_size >= CHUNK_BYTES:
                    fold()
                    held_size = 0
                if size >= BATCH_BYTES:
                    yield told(pa.nulls(i + 1 - begin, pa.int64()), batch.column(0)[begin : i + 1], texts[begin : i + 1], True)
                    yield asked(kind)
                    begin, size, held_size, chunk = i + 1, 0, 0, chunk + 1
            if begin < batch.num_rows:
                yield told(pa.nulls(batch.num_rows - begin, pa.int64()), batch.column(0)[begin:], texts[begin:], True)
        if kind is not None and (words or held or contexts):
            yield asked(kind)

    return docs.select("doc_id", "text").mapInArrow(rows, f"part long, chunk long, key long, is_doc boolean, doc_id {id_type}, text string")


class Values(dict):
    """Words' log10 probabilities, looked up by key at first use; None for unknown ones."""

    def __init__(self, known: dict[int, float]) -> None:
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> float | None:
        self[word] = found = self.known.get(word_key(word))
        return found


def score(docs: DataFrame, training: Column, order: int = ORDER) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs(doc_id, text)``; ``training`` picks the
    rows to learn from, ``order`` (2 to 6) is the length of the longest context in symbols."""
    spark = docs.sparkSession
    counts = written(model_counts(docs.where(training), order), "model")
    total = counts.where(f"key <= {TEXTS}").agg(F.sum("n").alias("n"), F.count_if(F.col("key") < TEXTS).alias("v"), F.sum(F.when(F.col("key") == TEXTS, F.col("n"))).alias("ends")).first()
    # an end a text: the row of TEXTS counts them
    n_all, ends = int(total["n"] or 0), int(total["ends"] or 0)
    vocabulary = int(total["v"]) + (ends > 0)
    below = math.log10(n_all + ADDED * (vocabulary + 1))
    unknown, end = math.log10(ADDED) - below, math.log10(ends + ADDED) - below
    trie = spark.sparkContext.broadcast(fit(counts))

    table = written(batched(docs, order), "batches")
    size = table.agg(F.max("part").alias("p"), F.max("chunk").alias("c"), F.count_distinct("part", "chunk").alias("n")).first()
    parts, chunks = int(size["p"] or 0) + 1, int(size["c"] or 0) + 1
    # a partition a batch; where one input partition has far more batches than the others, numbers are folded
    n = max(1, min(parts * chunks, 2 * int(size["n"])))
    place = F.pmod(F.col("chunk") * parts + F.col("part"), F.lit(n)).cast("int")
    known = table.where("NOT is_doc").select("part", "chunk", "key").join(counts, "key").select("part", "chunk", F.lit(False).alias("is_doc"), "key", "n", "followers", F.lit(None).cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), F.lit(None).cast("string").alias("text"))
    texts = table.where("is_doc").select("part", "chunk", "is_doc", "key", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("followers"), "doc_id", "text")
    dealt = known.unionByName(texts).repartitionById(n, place).sortWithinPartitions("part", "chunk", "is_doc")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got, model, values = None, [], None, None

        def ready() -> tuple:
            key = np.concatenate([k for k, *_ in got]) if got else np.zeros(0, np.int64)
            n = np.concatenate([n for _, n, _ in got]) if got else np.zeros(0)
            blobs = pa.concat_arrays([b for *_, b in got]).cast(pa.binary()) if got else pa.array([], pa.binary())
            words = key < TEXTS
            known_words = dict(zip(key[words].tolist(), (np.log10(n[words] + ADDED) - below).tolist(), strict=True))
            longer = trie.value
            if order > ORDER:
                longer = LongContexts(key[~words], blobs.filter(pa.array(~words)), order, trie.value)
            got.clear()
            return longer, Values(known_words)

        for batch in batches:
            batch_of = np.stack([batch.column("part").to_numpy(), batch.column("chunk").to_numpy(), batch.column("is_doc").to_numpy(zero_copy_only=False)])
            edges = [0, *(np.flatnonzero((batch_of[:, 1:] != batch_of[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                mine = batch_of[0, a], batch_of[1, a]
                if mine != now:
                    now, model, values = mine, None, None
                    got.clear()
                rows = batch.slice(a, b - a)
                if not batch_of[2, a]:
                    got.append((rows.column("key").to_numpy(), rows.column("n").to_numpy(), rows.column("followers")))
                    continue
                if model is None:
                    model, values = ready()
                yield _scored(rows, model, values)

    def _scored(rows: pa.RecordBatch, model, values: Values) -> pa.RecordBatch:
        tokens, hits, base, code = [], [], [], []
        held: list[str | None] = []
        size = 0
        for t in rows.column("text"):
            t = t.as_py()
            words = words_of(t)
            got = [x for x in map(values.__getitem__, words) if x is not None]
            tokens.append(len(words) + 1)
            hits.append(len(got) + (ends > 0))
            base.append(math.fsum(got) + (len(words) - len(got)) * unknown + end)
            held.append(t)
            size += len(t or "")
            if size > 2 << 20:
                code.append(model.score(held))
                held, size = [], 0
        if held:
            code.append(model.score(held))
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64()), pa.array([n_all] * len(tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(np.concatenate(code), pa.float64())],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return dealt.mapInArrow(scored, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
