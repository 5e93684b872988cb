"""Operators that compare documents, against plain versions over the same small corpus."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_corpus import ITEMS, components, hits, kept_lines, lower, rows, sha, words
from pyspark.sql import functions as F

from histlens.llm import chat, decontaminate, lines, minhash, mixing, ppm, spans


def by_row(df, *cols):
    """Counts of result rows, for rows that repeat a doc_id."""
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


def test_lines(docs, none):
    got = by_row(lines.digest(docs, lines.keep_bitmaps(docs)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    plain = kept_lines(rows())
    assert got == Counter((d[0], n, k, sha(t)) for d, (n, k, t) in zip(rows(), plain, strict=True))
    assert sum(k for _, k, _ in plain) > 20
    out = lines.rewritten(docs, lines.keep_bitmaps(docs))
    assert out.columns == docs.columns
    assert by_row(out, "doc_id", "text") == Counter((d[0], None if d[1] is None else t) for d, (_, _, t) in zip(rows(), plain, strict=True))
    assert lines.digest(none, lines.keep_bitmaps(none)).count() == 0


def test_lines_over_many_partitions(spark):
    """One line in every document, spread over partitions by the range of documents."""
    hot = "this very line is found in each of the documents of this table"
    df = spark.createDataFrame([(i, f"{hot}\nown line of document number {i}, long enough\n{hot}") for i in range(400)], "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r["doc_id"]: r["n_dropped"] for r in lines.digest(df, lines.keep_bitmaps(df)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: 0 if i == 399 else 2 for i in range(400)}


def test_lines_of_repeated_ids_and_clashing_columns(spark):
    """Documents are counted by id; columns may have any names; the largest id may have several rows."""
    hot = "a line of more than forty characters that all of them share"
    five = [(7, hot)] * 5 + [(9, hot)]
    many = [(i, f"{hot}\n{i}") for i in range(4)] + [(9, f"x\n{hot}"), (9, hot), (None, hot), (None, f"y\n{hot}")]
    for data in (five, many):
        df = spark.createDataFrame([(*d, 1, "a", b"k", 0.5) for d in data], "doc_id long, text string, d long, _t string, keep binary, _keep double")
        got = lines.rewritten(df, lines.keep_bitmaps(df))
        assert got.columns == df.columns and by_row(got, "doc_id", "text") == Counter((i, t) for (i, _), (*_, t) in zip(data, kept_lines(data), strict=True))
        assert by_row(lines.digest(df, lines.keep_bitmaps(df)), "doc_id", "n_dropped") == Counter((i, n) for (i, _), (_, n, _) in zip(data, kept_lines(data), strict=True))
    assert [n for _, n, _ in kept_lines(five)] == [0] * 6 and [n for _, n, _ in kept_lines(many)] == [1] * 4 + [0, 0, 1, 1]


def test_line_runs_are_streamed():
    """Sorted rows in batches of every size give the same decisions, and a long run comes out batch by batch."""
    import pyarrow as pa

    rng = random.Random(5)
    keys = [rng.randrange(12) for _ in range(300)]
    rows_ = sorted((k, 0, -rng.randrange(15), 0, i) for i, k in enumerate(keys))
    rows_ = [(a, b, -d, t, p) for a, b, d, t, p in rows_]
    table = lambda part: pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int32() if i == 4 else pa.int64()) for i in range(5)], names=["h1", "h2", "doc_id", "t", "pos"])
    want = {r for r in rows_ if len({x[2] for x in rows_ if x[0] == r[0]}) >= 5 and r[2] != max(x[2] for x in rows_ if x[0] == r[0])}
    for cut in (1, 3, 50, 300):
        for split in (0, 40, 150):  # two partitions
            out = []
            for part in (rows_[:split], rows_[split:]):
                out += [r for b in lines.streamed(iter([table(part[i : i + cut]) for i in range(0, len(part), cut)]), 5) for r in b.to_pylist()]
            docs_, keeper = Counter(), {}
            for r in out:
                if r["undecided"]:
                    docs_[r["h1"]] += r["docs"]
                    keeper[r["h1"]] = max(keeper.get(r["h1"], -1), r["doc_id"])
            got = {(r["h1"], 0, r["doc_id"], 0, r["pos"]) for r in out if not r["undecided"] or r["pos"] >= 0 and docs_[r["h1"]] >= 5 and r["doc_id"] != keeper[r["h1"]]}
            at = rows_[split][0] if split else None
            same_doc = split and rows_[split - 1][0] == at and rows_[split - 1][2] == rows_[split][2]
            assert got == want or same_doc  # a range never parts a document's rows of a key
    sizes = [b.num_rows for b in lines.streamed(iter([table([(1, 0, 99, 0, 0)]), *(table([(2, 0, 1000 - 10 * k - i, 0, k) for i in range(10)]) for k in range(20)), table([(3, 0, 0, 0, 0)])]), 5)]
    assert max(sizes) <= 10 and sum(sizes) >= 200


def test_bitmaps():
    import zlib as z

    packed = z.compress(np.packbits([1, 0, 1, 1, 1, 1, 1, 1], bitorder="little").tobytes())
    assert lines.kept_positions(packed, 3).tolist() == [True, False, True] and lines.kept_positions(packed, 10)[8:].all() and lines.kept_positions(None, 2).all()


def test_near_duplicates(docs, none):
    want = components(rows())
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows()) and len(set(want.values())) < len(want) - 5
    for r in got:
        assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == want[r["doc_id"]])
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Copies whose links go around the hubs: chains of small edits far from the first text."""
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    data = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            w[rng.randrange(120)] = f"v{rng.randrange(5000)}"
        data.append((i, " ".join(w)))
        if i % 10 == 9:
            base = list(w)
    want = components(data)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_of_repeated_ids(spark):
    """An id with two texts links the documents near either; null ids are one vertex."""
    rng = random.Random(6)
    prose = lambda: [f"w{rng.randrange(9000)}" for _ in range(200)]
    near = lambda w: [*w[:-1], "other"]
    a, b, c, d = prose(), prose(), prose(), prose()
    data = [(1, a), (1, b), (2, near(a)), (3, near(b)), (4, prose()), (1, a), (5, c), (6, near(c)), (None, d), (None, near(c)), (7, near(d)), (8, [])]
    data = [(i, " ".join(w)) for i, w in data]
    want = components(data)
    for k in (1, 5):
        got = by_row(minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(k)), "doc_id", "component_id", "kept")
        assert got == Counter((i, want[i], i == want[i]) for i, _ in data) and {want[1], want[2], want[3]} == {1} and want[6] is None and want[7] is None


def test_pairs_across_lists_in_blocks(spark, monkeypatch):
    """With groups of four, lists of dozens of classes still meet wholly."""
    monkeypatch.setattr(minhash, "GROUP", 4)
    rng = random.Random(9)
    rows_ = [(g, c, rng.randrange(3), 12, rng.choice([0, 0, c])) for g in range(3) for c in rng.sample(range(60), 30)]
    df = spark.createDataFrame(rows_, "g long, cid long, at long, n long, comp long")
    got = {frozenset((r["a"], r["hub"])) for r in minhash.pairs_across(df, minhash.Params()).collect()}
    can = lambda x, y: all(185 * (12 - r[2]) >= 85 * 24 for r in (x, y))
    assert got == {frozenset((x[1], y[1])) for x in rows_ for y in rows_ if x[0] == y[0] and x[4] != y[4] and can(x, y)}


def test_estimate(spark):
    rng = np.random.default_rng(1)
    p = minhash.Params(bands=64)
    a = [f"a{x}" for x in rng.integers(0, 10**6, 800)]
    df = spark.createDataFrame([(0, " ".join(a)), (1, " ".join([*a[:700], *(f"b{i}" for i in range(100))]))], "doc_id long, text string")
    one, two = (r["sig"] for r in minhash.signatures(df, p).orderBy("doc_id").collect())
    x, y = (minhash.shingle_set(t) for t in (r["text"] for r in df.orderBy("doc_id").collect()))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    est = spark.createDataFrame([(one, two)], "a array<long>, b array<long>").select(F.expr(minhash.estimate("a", "b", p))).first()[0]
    assert abs(est - true) < 0.15


def plain_sentences(t):
    """Ends and words of sentences, read character by character."""
    t, pieces, begin, k = t or "", [], 0, 0
    blank = " \t\n\x0b\x0c\r"
    while k < len(t):
        if t[k] in ".!?":
            e = k
            while e < len(t) and t[e] in ".!?":
                e += 1
            f = e
            while f < len(t) and t[f] in blank:
                f += 1
            if f > e:
                pieces.append((begin, f))
                begin = f
            k = max(f, e)
        elif t[k] in blank:
            e = k
            while e < len(t) and t[e] in blank:
                e += 1
            if "\n" in t[k:e]:
                pieces.append((begin, e))
                begin = e
            k = e
        else:
            k += 1
    pieces.append((begin, len(t)))
    out = []
    for a, b in pieces:
        w = words(t[a:b])
        if w:
            out.append([b, w])
        elif out:
            out[-1][0] = b
    return [e for e, _ in out], [w for _, w in out]


def plain_spans(docs):
    """(doc_id, n_sentences, n_removed, text) by row: every run of sentences is looked at."""
    key = lambda d: -1 if d is None else d
    ok = lambda w, i, j: sum(map(len, w[i:j])) >= 20 and (j - i >= 2 or sum(map(len, w[i:j])) >= 50)
    read = [(d[0], d[1], *plain_sentences(d[1])) for d in docs]
    found, where = [], defaultdict(set)
    for d, _, _, w in read:
        runs = set()
        for k in range(len(w)):
            runs |= {min(((k, j) for j in range(k + 1, len(w) + 1) if ok(w, k, j)), default=None), max(((i, k + 1) for i in range(k + 1) if ok(w, i, k + 1)), default=None)} - {None}
        found.append(sorted((i, j, " ".join(sum(w[i:j], []))) for i, j in runs))
        for i, _, x in found[-1]:
            where[x].add((key(d), i))
    out = []
    for (d, t, ends, _), fs in zip(read, found, strict=True):
        gone, mine = set(), set()
        for i, j, x in fs:
            if key(d) != min(where[x])[0] or x in mine:
                gone |= set(range(i, j))
            mine.add(x)
        keep = "".join(t[a:b] for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if k not in gone) if ends else t or ""
        out.append((d, len(ends), len(gone), keep))
    return out


def test_spans(docs, none):
    data = [d for d in rows() if d[0] != 45]  # the plain version looks at all pairs of sentences
    plain = plain_spans(data)
    got = by_row(spans.dedup(docs.where("doc_id IS NULL OR doc_id <> 45")), "doc_id", "n_sentences", "n_removed", "kept_sha256")
    assert got == Counter((d, n, g, sha(t)) for d, n, g, t in plain)
    left = {d: t for d, _, _, t in plain}
    assert [i for i in range(28, 36) if "The third one has some more words" in left[i]] == [28] and left[50] == rows()[50][1]
    assert spans.dedup(none).count() == 0


def test_spans_reach_the_ends_of_a_passage(spark):
    """Sentences of 30, 30, 3 and 3 words before other text: all four go, and nothing beside them."""
    line = lambda k, n: " ".join(f"{k}{i}" for i in range(n)) + ". "
    passage = line("a", 30) + line("b", 30) + line("c", 3) + line("d", 3)
    data = [(i, f"own{i} begins. {passage}own{i} ends with more words here {line(f'x{i}', 25)}") for i in range(3)] + [(9, line("long", 20000)), (10, line("long", 20000))]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"h1": F.lit(1), "t": F.lit("x"), "_salt": F.lit(2)})
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in spans.dedup(df).collect()}
    assert got[0] == (0, data[0][1]) and [got[i][0] for i in (1, 2)] == [4, 4] and all(got[i][1] == data[i][1].replace(passage, "") for i in (1, 2))
    assert got[9][0] == 0 and got[10] == (1, "")


def test_spans_within_a_text(spark):
    text = "One two three four five six seven eight nine ten. Eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty. "
    whole = text + "Something else stands here. " + text
    r = spans.dedup(spark.createDataFrame([(1, whole)], "doc_id long, text string")).first()
    assert (r["n_sentences"], r["n_removed"], r["text"]) == (5, 2, text + "Something else stands here. ")


def test_decontamination(docs, items, none):
    got = by_row(decontaminate.contamination(docs, items), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = Counter()
    for d in rows():
        n, h, ids = hits(d[1], ITEMS)
        want[d[0], n, h, len(ids), sha(",".join(ids)), h > 0] += 1
    assert got == want and sum(k[5] for k in want) == 2
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and left.count() == len(rows()) - 2
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_overlapping_windows(spark, items):
    t = ITEMS[0][1]
    texts = [t + " " + t, " ".join(t.split()[2:13]), " ".join(t.split()[:9]), t.replace("country", "x")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination(df, items).collect()}
    assert got == {i: (hits(x, ITEMS)[1], len(hits(x, ITEMS)[2])) for i, x in enumerate(texts)}


def test_proximity(spark, items):
    shuffled = " ".join(reversed(ITEMS[5][1].split()))
    df = spark.createDataFrame([(1, shuffled), (2, "nothing of the kind")], "doc_id long, text string")
    assert {r["item_id"] for r in decontaminate.proximity_matches(df, items).collect()} == {"5"}


def test_proximity_against_all_places(spark):
    """Few words, so that every window is near somewhere: each place of each window's rarest term."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    data, questions = [(i, text(rng.choice([3, 30, 90]))) for i in range(60)], [(f"q{i}", text(rng.choice([2, 10, 14]))) for i in range(12)]
    n = Counter(w for _, t in data for w in t.split())
    reach, want = 9 + 5, set()
    for item, q in questions:
        w = q.split()
        size = min(10, len(w))
        for a in range(len(w) - size + 1):
            win = w[a : a + size]
            for d, t in data:
                dw = t.split()
                rare = min(win, key=lambda x: (n[x], win.index(x)))
                for p, x in enumerate(dw):
                    if x == rare and set(win) <= set(dw[max(0, p - reach) : p + reach + 1]):
                        want.add((d, item))
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    docs, items = frame(data, "doc_id long, text string"), frame(questions, "item_id string, text string")
    got = {(r["d"], r["item_id"]) for r in decontaminate.proximity_matches(docs, items).collect()}
    assert got == want and 20 < len(want)
    told = {r["doc_id"]: (r["n_hit"], r["n_items"], r["n_near_items"]) for r in decontaminate.contamination(docs, items).collect()}
    near = Counter(d for d, _ in want)
    for d, t in data:
        _, hit, ids = hits(t, questions)
        assert told[d] == (hit, len(ids), near[d])
    assert sum(h > 0 for h, *_ in told.values()) > 3


def test_clean_with_clashing_columns(spark, items):
    df = spark.createDataFrame([(1, ITEMS[0][1], "x", 1, 2), (2, "fine", "y", 3, 4), (None, None, None, None, None)], "doc_id long, text string, d string, _d long, t long")
    left = decontaminate.clean(df, items)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {2, None}


def test_mix(docs, none):
    got = mixing.mix(docs, block=8, bucket_docs=7, shard_slots=64)
    first, again = by_row(got, *got.columns), by_row(mixing.mix(docs.repartition(5), block=8, bucket_docs=7, shard_slots=64), *got.columns)
    assert first == again and sum(first.values()) == len(rows())
    assert Counter((k[0], k[1]) for k in first.elements()) == Counter((d[0], len(words(d[1]))) for d in rows())
    assert all(k[4] <= 2 * k[1] for k in first)
    by_target = defaultdict(lambda: [0, 0])
    for d, size, source_size, target, taken in first.elements():
        by_target[source_size, target][0] += size
        by_target[source_size, target][1] += taken
    assert len(by_target) == 3 and all(z == s for (s, _), (z, _) in by_target.items())
    assert sum(t for _, t in by_target) == pytest.approx(1.5 * sum(z for z, _ in by_target.values()))
    assert all(abs(taken - t) <= 0.05 * t + 16 for (_, t), (_, taken) in by_target.items())
    assert mixing.mix(none).count() == 0
    assert mixing.mix(docs.where("doc_id IN (40, 41, 42)")).agg(F.sum("taken")).first()[0] == 0


def test_mix_holds_the_words(docs, none):
    """The mix itself: shards of numbered slots, each with a block of its source's words; what ``mix`` tells is counted in it."""
    small = dict(block=8, bucket_docs=7, shard_slots=64)
    got = mixing.shards(docs, **small).collect()
    place = Counter((r["shard"], r["slot"]) for r in got)
    by_shard = Counter(r["shard"] for r in got)
    assert set(place.values()) == {1} and all({x for k, x in place if k == s} == set(range(n)) for s, n in by_shard.items())
    assert len(by_shard) > 3 and all(n == 64 for s, n in by_shard.items() if s != max(by_shard))
    assert len({r["source"] for r in got if r["shard"] == 0}) > 1
    texts = defaultdict(list)
    for d in rows():
        texts[d[0]].append((d[3], " ".join(words(d[1]))))
    taken = Counter()
    for r in got:
        assert r["text"] == " ".join(p["words"] for p in r["parts"]) and 0 < len(r["text"].split(" ")) <= 8
        for p in r["parts"]:
            taken[p["doc_id"]] += len(p["words"].split(" "))
            assert any(s == r["source"] and f" {p['words']} " in f" {t} " for s, t in texts[p["doc_id"]])
    blocks = defaultdict(set)
    for r in got:
        blocks[r["source"], r["index"]].add(r["text"])
    assert all(len(x) == 1 for x in blocks.values())
    told = Counter()
    for r in mixing.mix(docs, **small).collect():
        told[r["doc_id"]] += r["taken"]
    assert +told == taken
    assert mixing.shards(none).count() == 0


def test_blocks_are_numbered_in_two_levels(docs, monkeypatch):
    """Groups of two buckets number the same blocks as one group of all."""
    small = dict(block=8, bucket_docs=3, shard_slots=64)
    whole = by_row(mixing.mix(docs, **small), "doc_id", "size", "taken")
    monkeypatch.setattr(mixing, "LEVEL", 2)
    assert by_row(mixing.mix(docs, **small), "doc_id", "size", "taken") == whole


def test_mix_takes_weights(docs):
    only_b = {r["source"] for r in mixing.shards(docs, share=0.1, block=8, bucket_docs=7, weights={"a": 0, "b": 1, None: 0}).collect()}
    assert only_b == {"b"}
    goal = lambda w: {r["source_size"]: r["target"] for r in mixing.mix(docs, share=0.1, weights=w).collect()}
    one = goal((1, 1, 1))
    assert len(one) == 3 and len({round(x, 6) for x in one.values()}) == 1


def test_targets_and_draws():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == [20, 50 / 3 + 0, 25 / 3] or sum(mixing.targets([10, 10, 10], [5, 2, 1])) == pytest.approx(45)
    t = mixing.targets([100, 1, 1000], [5, 2, 1])
    assert t[0] == 200 and t[1] == 2 and t[2] == pytest.approx(1.5 * 1101 - 202)
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0, 0]
    counts = mixing.shard_counts([300, 5, 0, 95], 64, 3)
    assert counts.sum(0).tolist() == [300, 5, 0, 95] and (counts.sum(1)[:-1] == 64).all()
    assert mixing.shard_counts([0, 0], 64, 3).shape == (0, 2)
    for n in (1, 2, 3, 7, 100, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 5)) == list(range(n))


def test_preferences(spark):
    turns = [
        (1, "chosen", 0, "user", "q"), (1, "chosen", 1, "assistant", "a"), (1, "chosen", 2, "user", "more"), (1, "chosen", 3, "assistant", "good"),
        (1, "rejected", 0, "user", "q"), (1, "rejected", 1, "assistant", "a"), (1, "rejected", 2, "user", "more"), (1, "rejected", 3, "assistant", "bad"), (1, "rejected", 4, "user", "?"),
        (2, "chosen", 0, "user", None), (2, "rejected", 0, "user", ""), (3, "chosen", 0, "user", "alone"), (4, "chosen", 0, None, "same"), (4, "rejected", 0, None, "same"),
        (5, "chosen", 0, "user", "x"), (5, "chosen", 0, "user", "x"), (5, "rejected", 0, "user", "x"),
    ]
    df = spark.createDataFrame(turns, "pair long, side string, turn long, role string, text string")
    out = chat.format_preferences(df)
    got = defaultdict(list)
    for r in out.orderBy("pair", "part", "turn").collect():
        got[r["pair"], r["part"]].append((r["turn"], r["rendered"], r["loss"]))
    assert [t for t, *_ in got[1, "prompt"]] == [0, 1, 2] and not any(x[2] for x in got[1, "prompt"])
    assert got[1, "chosen"] == [(3, "<|im_start|>assistant\ngood<|im_end|>\n", True)] and [x[2] for x in got[1, "rejected"]] == [True, False]
    assert (2, "prompt") not in got and (3, "prompt") not in got and len(got[4, "prompt"]) == 1 and (4, "chosen") not in got
    assert len(got[5, "chosen"]) == 2 and len(got[5, "rejected"]) == 1
    whole = {r["pair"]: r for r in chat.documents(out).collect()}
    r = whole[1]
    assert r["prompt"].count("<|im_start|>") == 3 and [r["chosen"][s["start"] : s["end"]] for s in r["chosen_loss"]] == ["good<|im_end|>"]
    assert chat.format_preferences(df.limit(0)).count() == 0


def test_ppm(docs, none):
    fold = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 != 0
    data = rows()
    learned = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(0)) != 0
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 3), round(r["score"], 2)) for r in ppm.score(docs, learned).collect())
    c, ends = Counter(), 0
    counts = [defaultdict(Counter) for _ in range(3)]
    seq = lambda t: (256, 256, *lower(t).encode(), 256)
    for d in data:
        if fold(d[0]):
            c.update(words(lower(d[1])))
            ends += 1
            s = seq(d[1])
            for j in range(2, len(s)):
                for o in range(3):
                    counts[o][s[j - o : j]][s[j]] += 1
    n, v = sum(c.values()) + ends, len(c) + 1

    def symbol(s, j):
        seen, w = set(), 1.0
        for o in (2, 1, 0):
            k = {x: m for x, m in counts[o].get(s[j - o : j], {}).items() if x not in seen}
            if k:
                total, d = sum(k.values()), len(k) if 257 - len(seen) - len(k) else 0
                if s[j] in k:
                    return math.log10(w * k[s[j]] / (total + d))
                w *= d / (total + d)
                seen |= set(k)
        return math.log10(w / (257 - len(seen)))

    want = Counter()
    for d in data:
        w, s = words(lower(d[1])), seq(d[1])
        base = sum(math.log10((m + 0.1) / (n + 0.1 * (v + 1))) for m in [*(c[x] for x in w), ends])
        want[d[0], len(w) + 1, sum(x in c for x in w) + 1, n, round(base, 3), round(sum(symbol(s, j) for j in range(2, len(s))), 2)] += 1
    assert sum(got.values()) == sum(want.values())
    near = lambda a, b: a[:4] == b[:4] and abs(a[4] - b[4]) < 0.01 and abs(a[5] - b[5]) < 0.05 + 1e-5 * abs(b[5])
    order = lambda x: (str(x[0]), x[1])
    assert all(near(a, b) for a, b in zip(sorted(got.elements(), key=order), sorted(want.elements(), key=order), strict=True))
    assert ppm.score(none, learned).count() == 0
    blank = ppm.score(docs, F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in blank)


def test_ppm_of_long_contexts(docs, none):
    """Order 4 against a plain version; its contexts stay distributed."""
    data = [d for d in rows() if d[0] != 45]
    learn = lambda d: d[0] is not None and d[0] % 3 != 0
    seq = lambda t: (256,) * 4 + (*lower(t).encode(), 256)
    counts = defaultdict(Counter)
    for d in filter(learn, data):
        s = seq(d[1])
        for j in range(4, len(s)):
            for o in range(5):
                counts[s[j - o : j]][s[j]] += 1

    def symbol(s, j):
        seen, w = set(), 1.0
        for o in (4, 3, 2, 1, 0):
            k = {x: m for x, m in counts.get(s[j - o : j], {}).items() if x not in seen}
            if k:
                total, n = sum(k.values()), len(k) if 257 - len(seen) - len(k) else 0
                if s[j] in k:
                    return math.log10(w * k[s[j]] / (total + n))
                w *= n / (total + n)
                seen |= set(k)
        return math.log10(w / (257 - len(seen)))

    want = sorted((str(d[0]), sum(symbol(seq(d[1]), j) for j in range(4, len(seq(d[1]))))) for d in data)
    learned = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    got = sorted((str(r["doc_id"]), r["score"]) for r in ppm.score(docs.where("doc_id IS NULL OR doc_id <> 45"), learned, order=4).collect())
    assert [d for d, _ in got] == [d for d, _ in want] and all(abs(x - y) < 0.05 for (_, x), (_, y) in zip(got, want, strict=True))
    blank = ppm.score(docs.where("doc_id = 41"), F.lit(False), order=4).first()
    assert blank["score"] == pytest.approx(-math.log10(257)) and ppm.score(none, learned, order=4).count() == 0


def test_ppm_rows_are_distributions():
    rng = np.random.default_rng(0)
    gram = np.unique(rng.integers(0, 257**3, 500))
    trie = ppm.Trie(gram, rng.integers(1, 50, len(gram)).astype(float))
    assert np.allclose((10.0 ** trie.logp.astype(float)).sum(1), 1, atol=1e-4)
    assert np.allclose(ppm.distribution([np.ones((1, 257))]), 1 / 257)
