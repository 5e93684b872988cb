"""Near-duplicates by b-bit MinHash: candidates from bands, estimates from packed low bits, links confirmed on whole sets.

A document's set holds its distinct 5-word shingles (A-Z lower-cased; fewer words: the whole sequence as one; none: empty,
linked with nothing). Two documents are linked if ``100 * |A & B| >= percent * |A | B|``.

1. One pass computes, for each document, ``bands * rows`` minima, the low ``BITS`` bits of each packed into longs, a hash per
   band, and a 128-bit identity of the set. Documents with equal sets are one class from here on, which has a number of its own;
   the text of its least (doc_id, text hash) stands for it.
2. In every band bucket each class is paired with two hubs (the least and the largest number), never all with all.
   Pairs whose bits agree too rarely for the threshold (six standard deviations below it) are left out; the rest is
   confirmed on the whole texts of both, a hub's pairs dealt over several groups of about GROUP.
3. Components of the links, and of classes that share a doc_id. Classes of buckets that still hold more than one component may have links
   that no hub showed. Their sets are joined exactly: in any order common to all, linked sets share one of their first shingles. The
   order is by a count sketch of fixed size, rare ones first, then by hash. Each posting list of several components
   is first paired with its class of the fewest earlier shingles, then, where components still differ, in blocks of about GROUP by GROUP
   across components. Heavily edited copies have first shingles of their own and so make no pairs.

With 24 bands of 4 rows a pair at 0.85 shares no bucket with a probability of 2e-8.

Rows that repeat a doc_id are one vertex, with the links of all its texts; they get one component. Null doc_ids are one vertex below all
others. Null and empty texts are components of their own id. An empty table gives an empty result. Other columns are ignored. Memory
follows a group of GROUP texts, or the longest text's set. Keys that many rows share (buckets, lists, ids) meet their facts over SALT
keys; equal sets meet their class by its identity, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, hashes_of, in_bitmap, met, mixed, runs_hashed, words_of, written
from .graph import components

BITS = 2
ODD_BITS = 0x5555555555555555
NO_ID = -(1 << 63)
#: Bits of the filter that keeps the texts of unpaired documents out of shuffles; full, it lets all pass and the join decides.
FILTER = 1 << 22
#: Counters of the sketch that orders shingles; any contents give an order, so collisions cost time only.
SKETCH = 1 << 18
GROUP = 256


@dataclass(frozen=True)
class Params:
    percent: int = 85
    shingle: int = 5
    bands: int = 24
    rows: int = 4
    seed: int = 11

    @property
    def slots(self) -> int:
        return self.bands * self.rows

    @property
    def least_matches(self) -> int:
        """Equal slots, of all, below which a pair at the threshold practically never falls."""
        p = self.percent / 100
        p += (1 - p) / (1 << BITS)  # equal by chance
        return max(0, int(self.slots * p - 6 * (self.slots * p * (1 - p)) ** 0.5))


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    return np.unique(runs_hashed(hashes_of(words_of(text)), n))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", F.xxhash64("text").alias("t"))


def signatures(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, d1, d2 (the set's identity), sig array<long> (packed low bits), band array<long>; null for empty sets."""
    rng = np.random.default_rng(p.seed)
    a = rng.integers(0, 1 << 63, p.slots, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, p.slots, np.uint64)
    words = -(-p.slots * BITS // 64)
    per = 64 // BITS

    def chunk(ids: list, ts: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets])
        full = np.flatnonzero(n)
        cols: dict[str, list] = {k: [None] * len(sets) for k in ("d1", "d2", "sig", "band")}
        if len(full):
            h = np.concatenate([sets[i] for i in full])
            at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            minima = np.empty((p.slots, len(full)), np.uint64)
            for i in range(p.slots):
                minima[i] = np.minimum.reduceat(h * a[i] + b[i], at)
            d1, d2 = np.add.reduceat(mixed(h + np.uint64(1)), at), np.add.reduceat(mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
            low = mixed(minima) & np.uint64((1 << BITS) - 1)
            sig = np.zeros((len(full), words), np.uint64)
            for i in range(p.slots):
                sig[:, i // per] |= low[i] << np.uint64(i % per * BITS)
            band = np.empty((len(full), p.bands), np.uint64)
            for k in range(p.bands):
                x = np.full(len(full), k + 1, np.uint64)
                for i in range(k * p.rows, (k + 1) * p.rows):
                    x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + minima[i])
                band[:, k] = x
            for j, i in enumerate(full):
                cols["d1"][i], cols["d2"][i] = int(d1[j].view(np.int64)), int(d2[j].view(np.int64))
                cols["sig"][i], cols["band"][i] = sig[j].view(np.int64), band[j].view(np.int64)
        long, longs = pa.int64(), pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, long), pa.array(ts, long), pa.array(n, long), pa.array(cols["d1"], long), pa.array(cols["d2"], long), pa.array(cols["sig"], longs), pa.array(cols["band"], longs)],
            names=["doc_id", "t", "n_shingles", "d1", "d2", "sig", "band"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ts, sets, size = [], [], [], 0
            for i, t, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                ts.append(t)
                sets.append(shingle_set(text.as_py(), p.shingle))
                size += len(sets[-1])
                if size > 200_000:
                    yield chunk(ids, ts, sets)
                    ids, ts, sets, size = [], [], [], 0
            if ids:
                yield chunk(ids, ts, sets)

    return _keyed(docs).mapInArrow(rows, "doc_id long, t long, n_shingles long, d1 long, d2 long, sig array<long>, band array<long>")


def matches(a: str, b: str, p: Params) -> str:
    """SQL: equal slots of two packed signatures."""
    longs = -(-p.slots * BITS // 64)
    odd = " + ".join(f"bit_count(({x} | shiftrightunsigned({x}, 1)) & {ODD_BITS}L)" for x in (f"({a}[{i}] ^ {b}[{i}])" for i in range(longs)))
    return f"({p.slots} - ({odd}))"


def estimate(a: str, b: str, p: Params = Params()) -> str:
    """SQL: similarity estimated from equal slots, corrected for those equal by chance."""
    chance = 1 / (1 << BITS)
    return f"(({matches(a, b, p)} / {p.slots}D - {chance}) / {1 - chance})"


def texts_of(docs: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """cid, text of the classes ``ids(cid)``, as a written table; the texts of others are dropped before the shuffle, but for few."""
    wanted = written(classes.join(ids, "cid", "left_semi").select("cid", F.col("rep").alias("doc_id"), "t"), "wanted")
    place = F.xxhash64("doc_id", "t")
    held = bitmap(wanted.select(place.alias("x")), FILTER)
    return written(_keyed(docs).where(in_bitmap(place, held)).join(wanted, ["doc_id", "t"]).dropDuplicates(["cid"]).select("cid", "text"), "texts")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, p: Params) -> DataFrame:
    """Those of ``pairs(a, hub)`` that are linked on whole sets, as (a, b). Texts of paired documents only are moved."""
    texts = texts_of(docs, classes, pairs.select(F.col("a").alias("cid")).union(pairs.select("hub")).distinct())
    groups = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
    dealt = met(pairs, groups, ["hub"], "a").select("a", "hub", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int").alias("group"))
    others = dealt.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("other")), "a")
    hubs = groups.join(texts.select(F.col("cid").alias("hub"), "text"), "hub").select(F.col("hub").alias("h"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.col("text").alias("mine"))

    def linked(one: pa.Table, many: pa.Table) -> pa.Table:
        ok = []
        mine = shingle_set(one.column("mine")[0].as_py(), p.shingle) if one.num_rows and many.num_rows else None
        for text in many.column("other"):
            other = shingle_set(text.as_py(), p.shingle)
            common = 0 if mine is None else len(np.intersect1d(mine, other, assume_unique=True))
            ok.append(common > 0 and 100 * common >= p.percent * (len(mine) + len(other) - common))
        keep = many.filter(pa.array(ok, pa.bool_()))
        return pa.table({"a": keep.column("a"), "b": keep.column("hub")})

    return hubs.groupBy("h", "g").cogroup(others.groupBy("hub", "group")).applyInArrow(linked, "a long, b long")


def first_shingles(docs: DataFrame, classes: DataFrame, ids: DataFrame, p: Params) -> DataFrame:
    """g, cid, at, n: the first shingles of each class of ``ids(cid)``, of ``n`` shingles; one at place ``at`` is followed by n - at - 1 others.

    Sets that are linked overlap in ``percent`` of each, so they share one of the first ``n - ceil(n * percent / 100) + 1`` shingles in
    any order common to all. A shingle whose counter is 1 is in one set only and left out.
    """

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sets = [shingle_set(t.as_py(), p.shingle).view(np.int64) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("cid"), pa.array(sets, pa.list_(pa.int64()))], names=["cid", "gs"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SKETCH, np.int64)
        for batch in batches:
            n += np.bincount(batch.column("gs").flatten().to_numpy().view(np.uint64) % np.uint64(SKETCH), minlength=SKETCH)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    sets = written(texts_of(docs, classes, ids).mapInArrow(to_sets, "cid long, gs array<long>"), "sets")
    sketch = np.zeros(SKETCH, np.int64)
    for r in sets.mapInArrow(counted, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow().to_batches():
        sketch[r.column("at").to_numpy()] = r.column("n").to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(sketch)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for cid, gs in zip(batch.column("cid").to_pylist(), batch.column("gs"), strict=True):
                g = gs.values.to_numpy()
                seen = held.value[g.view(np.uint64) % np.uint64(SKETCH)]
                order = np.lexsort((g, seen))[: len(g) - -(-len(g) * p.percent // 100) + 1]
                at = np.flatnonzero(seen[order] > 1)
                for column, x in zip(out, (g[order[at]], np.full(len(at), cid), at, np.full(len(at), len(g))), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], names=["g", "cid", "at", "n"])

    return sets.mapInArrow(firsts, "g long, cid long, at long, n long")


def _can_link(p: Params) -> str:
    """SQL: the shingles from the common one on are enough for an overlap at the threshold (it may be the first in common)."""
    return " AND ".join(f"{100 + p.percent} * ({n} - {at}) >= {p.percent} * (na + nb)" for n, at in (("na", "ia"), ("nb", "ib")))


def mixed_lists(found: DataFrame) -> DataFrame:
    """The rows of ``found(g, cid, at, n, comp)`` in posting lists of several components, each with its list's size, least component and
    lightest class."""
    lists = found.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.min(F.struct("at", "cid", "n", "comp")).alias("hub")).where("least <> most").drop("most")
    return met(found, lists, ["g"], "cid")


def lightest_pairs(found: DataFrame, p: Params) -> DataFrame:
    """a, hub: each class with, among those that share a first shingle, the one that has the fewest earlier ones."""
    pairs = mixed_lists(found).select(F.col("cid").alias("a"), "comp", F.col("at").alias("ia"), F.col("n").alias("na"), F.col("hub.cid").alias("hub"), F.col("hub.comp").alias("hub_comp"), F.col("hub.at").alias("ib"), F.col("hub.n").alias("nb"))
    return pairs.where(f"a <> hub AND comp <> hub_comp AND {_can_link(p)}").select("a", "hub").distinct()


def pairs_across(found: DataFrame, p: Params) -> DataFrame:
    """a, hub: classes of different components that share a first shingle early enough to be linked. A list meets itself in blocks of about
    GROUP by GROUP, and only rows outside its least component are looked up in it."""
    held = mixed_lists(found).withColumn("k", F.ceil(F.col("size") / GROUP).cast("int")).withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    one = held.where("comp <> least").select("g", F.col("mine").alias("i"), every.alias("j"), F.col("cid").alias("a"), F.col("comp").alias("ca"), F.col("at").alias("ia"), F.col("n").alias("na"))
    other = held.select("g", F.col("mine").alias("j"), every.alias("i"), F.col("cid").alias("hub"), F.col("comp").alias("cb"), F.col("at").alias("ib"), F.col("n").alias("nb"), "least")
    return one.join(other, ["g", "i", "j"]).where(f"ca <> cb AND (cb = least OR a < hub) AND {_can_link(p)}").select("a", "hub").distinct()


def shared_ids(members: DataFrame) -> DataFrame:
    """a, b: classes that hold rows of one doc_id, each with the least of them."""
    held = members.where("cid IS NOT NULL").select("doc_id", "cid").distinct()
    several = held.groupBy("doc_id").agg(F.min("cid").alias("b"), F.max("cid").alias("most")).where("b <> most").drop("most")
    return met(held, several, ["doc_id"], "cid").where("cid <> b").select(F.col("cid").alias("a"), "b")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept."""
    sigs = written(signatures(docs, p), "signatures")
    of = ["d1", "d2", "n_shingles"]
    same = sigs.where("n_shingles > 0").groupBy(of).agg(F.min(F.struct("doc_id", "t")).alias("at"), F.any_value("sig").alias("sig"), F.any_value("band").alias("band"))
    classes = written(same.select(*of, F.monotonically_increasing_id().alias("cid"), F.col("at.doc_id").alias("rep"), "at.t", "sig", "band"), "classes")
    members = written(sigs.select("doc_id", *of).join(classes.select(*of, "cid", "rep"), of, "left").select("doc_id", "n_shingles", "cid", "rep"), "members")
    sig = classes.select("cid", "sig")

    banded = classes.select("cid", F.explode("band").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("cid").alias("least"), F.max("cid").alias("largest")).where("least <> largest")
    crowded = written(met(banded, buckets, ["band"], "cid"), "crowded")

    def likely(pairs: DataFrame) -> DataFrame:
        """``pairs`` whose low bits agree often enough."""
        both = pairs.join(sig.withColumnsRenamed({"cid": "a", "sig": "sa"}), "a").join(sig.withColumnsRenamed({"cid": "hub", "sig": "sb"}), "hub")
        return both.where(f"{matches('sa', 'sb', p)} >= {p.least_matches}").select("a", "hub")

    stars = crowded.select(F.col("cid").alias("a"), F.explode(F.array("least", "largest")).alias("hub")).where("hub <> a").distinct()
    tried = written(likely(stars), "stars")
    links = written(confirmed(tried, docs, classes, p).union(shared_ids(members)), "links")
    comps = components(links)

    def with_comp(rows: DataFrame) -> DataFrame:
        return rows.join(comps.withColumnRenamed("v", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))

    placed = written(with_comp(crowded.select("band", "cid")), "placed")
    several = placed.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("band")
    rest = written(met(placed, several, ["band"], "cid").select("cid").distinct(), "rest")
    if rest.limit(1).count():
        firsts = written(first_shingles(docs, classes, rest, p), "firsts")
        for choose in (lightest_pairs, pairs_across):
            new = choose(with_comp(firsts), p).join(tried, ["a", "hub"], "left_anti").join(tried.select(F.col("a").alias("hub"), F.col("hub").alias("a")), ["a", "hub"], "left_anti")
            more = written(likely(new), "more")
            if more.limit(1).count():
                tried = written(tried.union(more.select("a", "hub")), "tried")
                links = written(links.union(confirmed(more, docs, classes, p)), "links")
                comps = components(links)

    found = comps.join(classes.select(F.col("cid").alias("v"), "rep"), "v")
    least = found.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = found.select(F.col("v").alias("cid"), "comp").join(least, "comp").select("cid", "component_id")
    out = members.join(named, "cid", "left")
    out = out.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_shingles", F.nullif(F.coalesce("component_id", "rep", "doc_id"), F.lit(NO_ID)).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
