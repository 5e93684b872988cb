"""Mixing sources to target weights, in words.

Sources, ordered by code point with null last, get weights (5, 2, 1 unless given), repeating, and share ``share`` times all words; a
target stops at ``most`` times its source's size and the excess goes to the others by weight.

1. *Pack.* A source's texts, dealt into buckets of about ``bucket_docs`` rows by a hash, are laid end to end within a bucket
   and their words cut into blocks of ``block`` (a bucket's last block is shorter). Blocks are numbered through all buckets of a source.
2. *Draw.* A source supplies floor(target * blocks / size) slots. Output shards of ``shard_slots`` slots draw their source
   counts from a multinomial over what each source has still to supply; a draw beyond that supply is drawn again.
3. *Permute and join.* A source's slot k is block perm(k mod blocks) in pass k div blocks; perm is a keyed four-round
   Feistel network, another one for each pass. Slots join blocks by (source, index); a shard's slots are permuted likewise.

``shards`` returns the mix itself, a row a slot with its block's words; ``mix`` counts in it what was taken of each document.

So no block is used more than ceil(slots / blocks) <= ``most`` times and no document exceeds ``most`` times its size; a
source's words differ from its target by less than the unevenness of its last pass. Seeded by data and parameters alone.

Null or empty texts have size 0 and take nothing. Rows that repeat a doc_id are separate documents. An empty table, or one
without words, gives targets of 0. Other columns are ignored. Memory follows a batch of texts, the longest text included, and a block.
What comes to the driver is a row a source, and the shards' counts by source: there are at most SHARDS shards, so on corpora of more than
SHARDS * shard_slots slots a shard is larger than ``shard_slots``; that bounds the plan and changes no document's share.
Texts are shuffled twice: by bucket, and as blocks by index. Blocks are numbered by running sums over groups of LEVEL buckets, then over
groups, so that a source's buckets don't meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, written

WEIGHTS = (5, 2, 1)
Weights = Sequence[float] | Mapping[str | None, float]
SHARDS, LEVEL = 10_000, 1024


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Targets that share ``share * sum(sizes)`` by weight, none above ``most`` times its size."""
    caps, out = [most * s for s in sizes], [0.0] * len(sizes)
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        total = sum(weights[i] for i in open_)
        if not total:
            break
        full = [i for i in open_ if left * weights[i] / total > caps[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = caps[i]
        left -= sum(caps[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def shard_counts(slots: list[int], shard_slots: int, seed: int) -> np.ndarray:
    """(shards, sources): multinomial draws over what each source has still to supply, whose columns sum to ``slots``."""
    left = np.array(slots, np.int64)
    size = max(shard_slots, -(-int(left.sum()) // SHARDS))
    rng, rows = np.random.default_rng(seed), []
    while left.sum():
        got, want = np.zeros_like(left), min(size, int(left.sum()))
        while want:
            rest = left - got
            got += np.minimum(rng.multinomial(want, rest / rest.sum()), rest)
            want = min(size, int(left.sum())) - int(got.sum())
        rows.append(got)
        left = left - got
    return np.array(rows, np.int64).reshape(len(rows), len(slots))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n) at ``index``: Feistel rounds over the least even-bit power of two, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    x, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        y = x[todo]
        left, right = y >> np.uint64(half), y & low
        for r in range(4):
            left, right = right, left ^ (mixed(right + np.uint64((key * 4 + r) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & low)
        x[todo] = (left << np.uint64(half)) | right
        todo[todo] = x[todo] >= n
    return x.astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), h."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len((t.as_py() or "").encode().split()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64()), batch.column("h")], names=["doc_id", "source", "size", "h"])

    types = dict(docs.dtypes)
    return docs.select("doc_id", "source", "text", F.xxhash64("doc_id", "text").alias("h")).mapInArrow(rows, f"doc_id {types['doc_id']}, source {types['source']}, size long, h long")


def blocks_of(placed: DataFrame, block: int) -> DataFrame:
    """s, b, k, parts: the blocks of each bucket's words, whose parts are (row, doc_id, words), from ``placed(s, b, h, doc_id, text)``.

    A bucket's rows come in order, and texts stream through: held are a batch's blocks and one unfinished block.
    """
    id_type = dict(placed.dtypes)["doc_id"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, row, k, room = None, 0, 0, block
        done: list[tuple[int, int, int, int]] = []  # blocks' s, b, k and number of parts
        parts: list[tuple[int, object, bytes]] = []  # of the blocks in ``done``, then of the unfinished one
        n_open, size = 0, 0

        def told(types: pa.Schema) -> pa.RecordBatch:
            ended = len(parts) - n_open
            rs, ids, words = zip(*parts[:ended], strict=True)
            s, b, ks, n = zip(*done, strict=True)
            structs = pa.StructArray.from_arrays([pa.array(rs, pa.int64()), pa.array(ids, types.field("doc_id").type), pa.array(words, pa.binary()).cast(pa.string())], names=["row", "doc_id", "words"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), structs)
            del parts[:ended]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(b, pa.int64()), pa.array(ks, pa.int64()), lists], names=["s", "b", "k", "parts"])

        types = None
        for batch in batches:
            types = batch.schema
            for s, b, i, t in zip(batch.column("s").to_pylist(), batch.column("b").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if (s, b) != bucket:
                    if n_open:
                        done.append((*bucket, k, n_open))
                    bucket, row, k, room, n_open = (s, b), 0, 0, block, 0
                row += 1
                words = (t.as_py() or "").encode().split()
                at = 0
                while at < len(words):
                    some = words[at : at + room]
                    parts.append((row, i, b" ".join(some)))
                    size += len(parts[-1][2])
                    n_open += 1
                    at += len(some)
                    room -= len(some)
                    if not room:
                        done.append((*bucket, k, n_open))
                        k, room, n_open = k + 1, block, 0
                if size > 4 << 20 and done:
                    yield told(types)
                    size = 0
        if n_open:
            done.append((*bucket, k, n_open))
            n_open = 0
        if done:
            yield told(types)

    ordered = placed.select("s", "b", "h", "doc_id", "text").repartition("s", "b").sortWithinPartitions("s", "b", "h", "doc_id")
    return ordered.mapInArrow(rows, f"s int, b long, k long, parts array<struct<row: long, doc_id: {id_type}, words: string>>")


def _built(docs: DataFrame, weights: Weights, share: float, most: float, block: int, bucket_docs: int, shard_slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The mix (shard, slot, s, source, index, b, parts) and the rows it is from (s, b, row, doc_id, size, source_size, target)."""
    spark = docs.sparkSession
    sizes_of = written(sized(docs), "sizes")
    per_source = sizes_of.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    sizes = [int(r["size"]) for r in per_source]
    weight = [weights[r["source"]] if isinstance(weights, Mapping) else weights[i % len(weights)] for i, r in enumerate(per_source)]
    goal = targets(sizes, weight, share, most)
    names = spark.createDataFrame([(i, r["source"], sizes[i], float(goal[i]), max(1, -(-int(r["n"]) // bucket_docs))) for i, r in enumerate(per_source)], "s int, source string, source_size long, target double, buckets int").coalesce(1)

    def dealt(rows: DataFrame, *cols: str) -> DataFrame:
        return rows.join(F.broadcast(names), rows["source"].eqNullSafe(names["source"])).select("s", F.pmod("h", F.col("buckets")).alias("b"), "h", "doc_id", *cols)

    # a bucket holds about bucket_docs rows whatever the source's share, so this window's groups stay small
    order = Window.partitionBy("s", "b").orderBy("h", "doc_id")
    laid = written(dealt(sizes_of, "size", "source_size", "target").withColumn("row", F.row_number().over(order).cast("long")), "laid")

    totals = laid.groupBy("s", "b").agg(F.sum("size").alias("words")).select("s", "b", F.ceil(F.col("words") / block).cast("long").alias("blocks"))
    totals = written(totals.withColumn("g", F.floor(F.col("b") / LEVEL)), "totals")
    inside, across = Window.partitionBy("s", "g").orderBy("b"), Window.partitionBy("s").orderBy("g")  # a row for LEVEL * bucket_docs documents
    groups = totals.groupBy("s", "g").agg(F.sum("blocks").alias("n")).select("s", "g", (F.sum("n").over(across) - F.col("n")).alias("base"))
    running = totals.select("s", "g", "b", "blocks", (F.sum("blocks").over(inside) - F.col("blocks")).alias("at"))
    firsts = written(running.join(groups, ["s", "g"]).select("s", "b", "blocks", (F.col("base") + F.col("at")).alias("first")), "buckets")
    n_blocks = [0] * len(sizes)
    for r in firsts.groupBy("s").agg(F.sum("blocks").alias("n")).collect():
        n_blocks[r["s"]] = int(r["n"])

    slots = [int(g * n // z) if z else 0 for g, n, z in zip(goal, n_blocks, sizes, strict=True)]
    counts = shard_counts(slots, shard_slots, seed)
    begins = np.cumsum(counts, axis=0) - counts
    before = np.cumsum(counts, axis=1) - counts
    plan = [(k, int(counts[k].sum()), s, int(before[k, s]), int(begins[k, s]), int(counts[k, s]), n_blocks[s]) for k in range(len(counts)) for s in range(len(sizes)) if counts[k, s]]
    drawn = spark.createDataFrame(plan, "shard int, slots long, s int, before long, begin long, n long, blocks long")

    def slots_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard, held, s, first, begin, n, blocks in pdf.itertuples(index=False):
                for at in range(begin, begin + n, 1 << 16):
                    k = np.arange(at, min(at + (1 << 16), begin + n))
                    slot = permuted(first + k - begin, held, seed + 7919 * (shard + 1))
                    for turn in np.unique(k // blocks):
                        now = k // blocks == turn
                        yield pd.DataFrame({"shard": shard, "slot": slot[now], "s": s, "index": permuted(k[now] % blocks, blocks, seed + 1000 * s + int(turn))}).astype({"shard": "int32", "s": "int32"})

    kind = "shard int, slot long, s int, index long"
    used = drawn.repartition(max(1, min(len(plan), spark.sparkContext.defaultParallelism * 4))).mapInPandas(slots_of, kind) if plan else spark.createDataFrame([], kind)
    hashed = docs.select("doc_id", "text", "source", F.xxhash64("doc_id", "text").alias("h"))
    packed = blocks_of(dealt(hashed, "text"), block).join(F.broadcast(firsts.select("s", "b", "first")), ["s", "b"])
    blocks = packed.select("s", "b", (F.col("first") + F.col("k")).alias("index"), "parts")
    # both sides by (s, index): a block is read at most ``most`` times and a bit, so no key is hot
    out = blocks.hint("merge").join(used, ["s", "index"]).join(F.broadcast(names.select("s", "source")), "s")
    return out.select("shard", "slot", "s", "source", "index", "b", "parts"), laid


def shards(docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = 32, bucket_docs: int = 2048, shard_slots: int = 1 << 14, seed: int = 17, weights: Weights = WEIGHTS) -> DataFrame:
    """shard, slot, source, index, text, parts array<struct<row, doc_id, words>>: a row for each slot of each output shard.

    ``text`` is the block's words with a blank between; ``parts`` has them by document. Slots of a shard are numbered from 0, sources mixed.
    ``weights`` are by source, or by its place in the order and repeating.
    """
    out, _ = _built(docs, weights, share, most, block, bucket_docs, shard_slots, seed)
    return out.select("shard", "slot", "source", "index", F.concat_ws(" ", "parts.words").alias("text"), "parts")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, block: int = 32, bucket_docs: int = 2048, shard_slots: int = 1 << 14, seed: int = 17, weights: Weights = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs(doc_id, text, source)``: the words of it that ``shards`` holds."""
    out, laid = _built(docs, weights, share, most, block, bucket_docs, shard_slots, seed)
    part = out.select("s", "b", F.explode("parts").alias("part")).select("s", "b", "part.row", F.size(F.split("part.words", " ")).alias("n"))
    taken = part.groupBy("s", "b", "row").agg(F.sum("n").alias("taken"))
    return laid.join(taken, ["s", "b", "row"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
