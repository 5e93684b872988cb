"""Graph operators over edge tables, for all histories at once.

Distributed fixpoints run a job a round and cut lineage by a written table in the shared folder. ``closure`` takes paths of
twice the length each round. ``topo_levels`` and ``components`` take time in proportion to the edges: histories are dealt to tasks
whole, several a call; what is beyond a task's size goes another exact way (levels by peeling, cycles by tables of reach).
Per-history graphs that are small by nature (sessions, not events) go through grouped maps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .written import written


def closure(edges: DataFrame) -> DataFrame:
    """h, src, dst: all pairs joined by a path. Semi-naive: new pairs extend by all pairs known, in log(depth) rounds."""
    known = written(edges.select("h", "src", "dst").distinct(), "closure")
    new = known
    while True:
        step = new.join(known.select("h", F.col("src").alias("dst"), F.col("dst").alias("to")), ["h", "dst"]).select("h", "src", F.col("to").alias("dst"))
        back = known.select("h", "src", F.col("dst").alias("mid")).join(new.select("h", F.col("src").alias("mid"), "dst"), ["h", "mid"]).select("h", "src", "dst")
        new = written(step.union(back).distinct().join(known, ["h", "src", "dst"], "left_anti"), "delta")
        if not new.limit(1).count():
            return known
        known = written(known.union(new), "closure")


def cyclic(closed: DataFrame) -> DataFrame:
    """h of every history whose closed relation has a cycle."""
    return closed.where("src = dst").select("h").distinct()


def cycle_vertices(closed: DataFrame) -> DataFrame:
    return closed.where("src = dst").select("h", F.col("src").alias("v"))


def cycle_edge(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """h, src, dst: the least edge of each cyclic history that lies on a cycle."""
    on = edges.join(closed.select("h", F.col("src").alias("dst"), F.col("dst").alias("src")), ["h", "src", "dst"], "left_semi").union(edges.where("src = dst").select(edges.columns))
    return on.groupBy("h").agg(F.min(F.struct("src", "dst")).alias("e")).select("h", "e.src", "e.dst")


#: Edges of one history that a task takes, and rows that a call takes at least, if there are as many.
MOST, CHUNK = 2_000_000, 250_000
Solve = Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def larger(edges: DataFrame, most: int) -> DataFrame | None:
    """h of histories with more than ``most`` edges, None if there are none."""
    found = written(edges.groupBy("h").count().where(F.col("count") > most).select("h"), "larger")
    return found if found.limit(1).count() else None


def _whole(rows: DataFrame, solve: Solve, value: str) -> DataFrame:
    """h, v and ``value`` by ``solve`` over ``rows(h, src, dst)``, a null dst for a vertex alone. ``solve`` gets whole histories as one graph
    of n vertices, numbered by h, then v; it returns numbers of vertices, and the level (-1: null) or component of each."""
    kind = dict(rows.dtypes)["h"]

    def solved(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        at = np.zeros(table.num_rows, np.int64)
        at[starts[1:]] = 1
        at = np.cumsum(at)
        src, edge = table["src"].to_numpy(), pc.is_valid(table["dst"]).to_numpy()
        dst = pc.fill_null(table["dst"], 0).to_numpy()[edge]
        ids, no = np.unique(np.concatenate([src, dst]), return_inverse=True)
        keys, no = np.unique(np.concatenate([at, at[edge]]) * len(ids) + no, return_inverse=True)
        found, said = solve(len(keys), no[: len(src)][edge], no[len(src) :])
        h = table["h"].combine_chunks().take(pa.array(starts[keys[found] // len(ids)]))
        told = pa.array(said, mask=said < 0) if value == "level" else pa.array(ids[keys[said] % len(ids)])
        return pa.RecordBatch.from_arrays([h, pa.array(ids[keys[found] % len(ids)]), told], names=["h", "v", value])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < CHUNK or not batch.num_rows or held[0]["h"][0] == batch["h"][-1]:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(table)
            if len(starts) > 1:  # the last history may go on in the next batch
                yield solved(table.slice(0, starts[-1]), starts[:-1])
                table = table.slice(starts[-1])
            held, n = table.to_batches(), table.num_rows
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield solved(table, _starts(table))

    ids = rows.where("h IS NOT NULL AND src IS NOT NULL").select("h", F.col("src").cast("long"), F.col("dst").cast("long"))
    return ids.repartition("h").sortWithinPartitions("h").mapInArrow(stream, f"h {kind}, v long, {value} {'int' if value == 'level' else 'long'}")


def _starts(table: pa.Table) -> np.ndarray:
    """Where each history's rows begin."""
    h = table["h"].combine_chunks()
    return np.concatenate([[0], 1 + np.flatnonzero(pc.not_equal(h.slice(1), h.slice(0, len(h) - 1)).to_numpy(zero_copy_only=False))])


def _peel(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Rounds of removing vertices without a predecessor left; -1 where none comes."""
    level, left = np.full(n, -1, np.int32), np.bincount(dst, minlength=n)
    after = dst[np.argsort(src, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
    ready, k = np.flatnonzero(left == 0), 0
    while len(ready):
        level[ready] = k
        many = first[ready + 1] - first[ready]
        to = after[np.repeat(first[ready] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        np.subtract.at(left, to, 1)
        ready, k = np.unique(to[left[to] == 0]), k + 1
    return level


def _levels(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(n), _peel(n, src, dst)


def _strong(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex on a cycle, with the least one of its strongly connected component."""
    inner = (_peel(n, src, dst) < 0) & (_peel(n, dst, src) < 0)
    keep = inner[src] & inner[dst]
    src, dst = src[keep], dst[keep]
    order = np.argsort(src, kind="stable")
    after, first = dst[order].tolist(), np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]).tolist()
    seen, low, component, held, count = [0] * n, [0] * n, [-1] * n, [], 0
    at = first[:-1]
    for root in np.flatnonzero(inner).tolist():
        if seen[root]:
            continue
        count += 1
        seen[root] = low[root] = count
        held.append(root)
        path = [root]
        while path:
            v = path[-1]
            if at[v] < first[v + 1]:
                w = after[at[v]]
                at[v] += 1
                if not seen[w]:
                    count += 1
                    seen[w] = low[w] = count
                    held.append(w)
                    path.append(w)
                elif component[w] < 0 and seen[w] < low[v]:
                    low[v] = seen[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == seen[v]:
                part = []
                while not part or part[-1] != v:
                    part.append(held.pop())
                least = min(part)
                for w in part:
                    component[w] = least
    named = np.array(component)
    size, own = np.bincount(named[inner], minlength=n), np.zeros(n, bool)
    own[src[src == dst]] = True
    found = np.flatnonzero(inner & ((size[named] > 1) | own))
    return found, named[found]


def components(edges: DataFrame) -> DataFrame:
    """h, v, component: every vertex on a cycle, with the least vertex of its strongly connected component. A history is solved in one task."""
    return _whole(edges, _strong, "component")


def topo_levels(edges: DataFrame, vertices: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """h, v, level: rounds of removing vertices without a predecessor left; a null level is on a cycle or behind one. Histories of up to
    ``most`` edges are solved in tasks; in larger ones a layer is a job."""
    e = written(edges.select("h", "src", "dst"), "edges")
    large = larger(e, most)
    near = e if large is None else e.join(large, "h", "left_anti")
    if vertices is not None:
        alone = vertices.select("h", F.col("v").alias("src"), F.lit(None).cast("long").alias("dst"))
        near = near.union(alone if large is None else alone.join(large, "h", "left_anti"))
    out = _whole(near, _levels, "level")
    if large is None:
        return out
    return out.union(peeled_levels(e.join(large, "h", "left_semi"), None if vertices is None else vertices.join(large, "h", "left_semi")))


def peeled_levels(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """topo_levels(), a layer a job, for histories of any size."""
    e = edges.select("h", "src", "dst").distinct()
    ends = e.select("h", F.col("src").alias("v")).union(e.select("h", F.col("dst").alias("v")))
    left = written((ends if vertices is None else ends.union(vertices.select("h", "v"))).distinct(), "left")
    e, out, level = written(e, "edges"), None, 0
    while True:
        ready = written(left.join(e.select("h", F.col("dst").alias("v")), ["h", "v"], "left_anti"), "ready")
        if not ready.limit(1).count():
            rest = left.withColumn("level", F.lit(None).cast("int"))
            return rest if out is None else out.union(rest)
        done = ready.withColumn("level", F.lit(level))
        out = done if out is None else out.union(done)
        left = written(left.join(ready, ["h", "v"], "left_anti"), "left")
        e = written(e.join(ready.withColumnRenamed("v", "src"), ["h", "src"], "left_anti"), "edges")
        level += 1


def incremental_closure(closed: DataFrame, added: DataFrame) -> DataFrame:
    """The closure of ``closed`` (already closed) and ``added``: what reaches an added edge's start, times what its end reaches."""
    while True:
        ins = added.select("h", F.col("src").alias("u"), F.col("dst").alias("v"))
        before = closed.select("h", F.col("dst").alias("u"), "src").union(ins.select("h", "u", F.col("u").alias("src"))).distinct()
        after = closed.select("h", F.col("src").alias("v"), "dst").union(ins.select("h", "v", F.col("v").alias("dst"))).distinct()
        new = written(ins.join(before, ["h", "u"]).join(after, ["h", "v"]).select("h", "src", "dst").distinct().join(closed, ["h", "src", "dst"], "left_anti"), "added")
        if not new.limit(1).count():
            return closed
        closed, added = written(closed.union(new), "closure"), new


def communication_graph(accesses: DataFrame) -> DataFrame:
    """h, a, b: sessions a < b that touch a common variable, from ``accesses(h, variable, s)``. Each session is joined once per variable."""
    one = accesses.select("h", "variable", "s").distinct()
    other = one.select("h", "variable", F.col("s").alias("b"))
    return one.join(other, ["h", "variable"]).where("s < b").select("h", F.col("s").alias("a"), "b").distinct()


def connected_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """h, v, component (its least vertex), for an undirected graph ``edges(h, a, b)``."""
    both = written(edges.select("h", F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("h", F.col("b").alias("v"), F.col("a").alias("w"))).distinct(), "both")
    labels = written(vertices.select("h", "v").distinct().withColumn("component", F.col("v")), "labels")
    while True:
        near = both.join(labels.select("h", F.col("v").alias("w"), "component"), ["h", "w"]).groupBy("h", "v").agg(F.min("component").alias("near"))
        stepped = written(labels.join(near, ["h", "v"], "left").select("h", "v", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component")), "labels")
        labels = stepped.select("h", "v", "component")
        if not stepped.where("old <> component").limit(1).count():
            return labels


def blocks(vertices: list[int], edges: list[tuple[int, int]]) -> tuple[set[int], list[frozenset[int]], list[frozenset[int]]]:
    """Articulation points, blocks of three vertices or more or of two with one of them shared, and what belongs to no group (single
    vertices, single edges) of an undirected graph."""
    near: dict[int, list[int]] = {v: [] for v in vertices}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    cut: set[int] = set()
    groups: list[frozenset[int]] = []
    alone: list[frozenset[int]] = []
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        found: list[frozenset[int]] = []
        held, children = [root], 0
        stack = [(root, None, iter(sorted(near[root])))]
        while stack:
            v, parent, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] >= order[parent]:
                        block = {parent}
                        while True:
                            x = held.pop()
                            block.add(x)
                            if x == v:
                                break
                        found.append(frozenset(block))
                        if parent != root:
                            cut.add(parent)
                        else:
                            children += 1
                            if children > 1:
                                cut.add(root)
            elif w not in order:
                order[w] = low[w] = len(order)
                held.append(w)
                stack.append((w, v, iter(sorted(near[w]))))
            elif w != parent:
                low[v] = min(low[v], order[w])
        if not found:
            alone.append(frozenset([root]))
        elif len(found) == 1 and len(found[0]) == 2:
            alone.append(found[0])
        else:
            groups += found
    return cut, groups, alone


def biconnected_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """h, block array<long>: all groups of sessions. A graph's vertices are the sessions of one history, so a group is small."""
    rows = vertices.select("h", F.col("v").alias("a"), F.lit(None).cast("long").alias("b")).union(edges.select("h", "a", "b"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = pdf[pdf.b.notna()]
        vs = sorted({int(x) for x in pdf.a} | {int(x) for x in pairs.b})
        _, groups, alone = blocks(vs, [(int(a), int(b)) for a, b in zip(pairs.a, pairs.b, strict=True)])
        return pd.DataFrame({"h": pdf.h.iloc[0], "block": [sorted(g) for g in sorted({*groups, *alone}, key=sorted)]})

    return rows.groupBy("h").applyInPandas(one, f"h {dict(vertices.dtypes)['h']}, block array<long>")


def blocks_overlap(block_rows: DataFrame) -> DataFrame:
    """h, overlap: whether some session is in two blocks."""
    return block_rows.select("h", F.explode("block").alias("s")).groupBy("h").agg((F.count("s") != F.count_distinct("s")).alias("overlap"))
