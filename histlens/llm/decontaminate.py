"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

Words are A-Z lower-cased runs of letters, digits and non-ASCII characters, told apart by 64 bits of a hash. A window is ``window``
consecutive words of a benchmark item (an item of fewer words, but not none, is one window).

1. *Forward lists.* Every document is cut into words once; its word hashes by position are a written table.
2. *Term statistics.* Occurrences in the documents of every term that the benchmark has. A window with a term that no document has is out.
3. *Postings.* The positional inverted index, a written table (term, document, sorted positions) of the ``depth`` rarest terms of each window.
   The lists of commoner terms would hold much of the corpus and decide next to nothing; those terms are read off the forward list.
4. *Intersection.* From the rarest term's list on, the next rarer lists are joined by (term, document) and intersected: shifted by the
   terms' offsets for phrases, within ``reach`` words for proximity. What is left meets its forward lists, which decide every other term.

A *phrase* match is a window in its order. A *proximity* match is an occurrence of a window's rarest term with all words of the
window, in any order, at most ``window - 1 + slack`` words away.

Terms are tested against a bitmap of hashes before they leave their row (2^20 bits whatever the benchmark's size; false
positives fall out in a join), and only forward lists of candidate documents are moved (2^22 bits likewise). A term's postings
are dealt over SALT keys, so that one in every document isn't one task's.

Null texts, and such without words, have no words and no hits. A document is a row, told apart by doc_id and a hash of its text: rows that
repeat get equal results. Items that repeat an item_id are one item in counts; an item without an id has hits, but counts as none.
Empty tables on either side give zero hits (or no rows, without documents). A text's words are one array, so memory follows the longest
text. ``contamination`` ignores other columns of ``docs``; ``clean`` passes them all through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bitmap, free_name, in_bitmap, written

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BITMAP, FILTER = 1 << 20, 1 << 22
NO_ID = -(1 << 63)
DEPTH, SALT, SLACK = 3, 16, 5


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def _hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda x: F.xxhash64(x))


def forward_lists(docs: DataFrame) -> DataFrame:
    """doc_id, d (doc_id, never null), t (a hash of the text), w: the documents' word hashes by position, as a written table."""
    lists = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("t"), _hashed(F.col("text")).alias("w"))
    # words repeat: a larger dictionary than Parquet's usual one takes the hashes of a whole file
    return written(lists, "forward", {"parquet.dictionary.page.size": str(8 << 20)})


def term_counts(lists: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: occurrences in ``lists`` of each of the distinct ``terms(term)``."""
    bits = bitmap(terms.select(F.col("term").alias("x")), BITMAP)
    found = lists.select(F.explode("w").alias("term")).where(in_bitmap(F.col("term"), bits)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def item_windows(items: DataFrame, window: int = 10) -> DataFrame:
    """win (word hashes), ids (of the items that have it): every distinct window."""
    words = items.select(F.col("item_id").cast("string").alias("item"), _hashed(F.col("text")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    each = words.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - length), lambda s: F.slice("w", s + 1, length))).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item").alias("ids"))


def by_rarity(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """win, ids, terms array<struct<n, o, term>> with the rarest first, of windows whose terms all occur."""
    each = windows.select("win", F.posexplode("win").alias("o", "term")).join(counts, "term")
    ranked = each.groupBy("win").agg(F.sort_array(F.collect_list(F.struct("n", "o", "term"))).alias("terms"))
    return windows.join(ranked.where("terms[0].n > 0"), "win")


def postings(lists: DataFrame, terms: DataFrame) -> DataFrame:
    """term, d, t, at (sorted positions) of ``terms(term)``, and of the few terms that share a bit with one, as a written table."""
    bits = bitmap(terms.select(F.col("term").alias("x")), BITMAP)
    each = lists.select("d", "t", F.posexplode("w").alias("at", "term")).where(in_bitmap(F.col("term"), bits))
    return written(each.groupBy("term", "d", "t").agg(F.sort_array(F.collect_set("at")).alias("at")), "postings")


def intersected(index: DataFrame, ranked: DataFrame, depth: int, reach: int) -> DataFrame:
    """win, ids, d, t, at (places of the rarest term that have the next rarer ones near), starts (where the window may begin)."""
    nth = lambda i, k: F.get(F.col("terms"), F.lit(i))[k]
    cols = [c for i in range(depth) for c in (nth(i, "term").alias(f"term{i}"), nth(i, "o").alias(f"o{i}"))]
    asked = ranked.select("win", "ids", *cols, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    first = index.select(F.col("term").alias("term0"), F.pmod("d", F.lit(SALT)).cast("int").alias("salt"), "d", "t", "at")
    met = first.join(asked, ["term0", "salt"])
    met = met.withColumn("starts", F.filter(F.transform("at", lambda p: p - F.col("o0")), lambda s: s >= 0))
    for i in range(1, depth):
        lists = index.select(F.col("term").alias(f"term{i}"), "d", "t", F.col("at").alias("next"))
        met = met.join(lists, [f"term{i}", "d", "t"], "left").where(f"term{i} IS NULL OR next IS NOT NULL")
        near = F.filter("at", lambda p: F.exists("next", lambda q: F.abs(q - p) <= reach))
        shifted = F.array_intersect("starts", F.transform("next", lambda q: q - F.col(f"o{i}")))  # noqa: B023
        none = F.col(f"term{i}").isNull()  # a window of fewer terms
        met = met.withColumns({"at": F.when(none, F.col("at")).otherwise(near), "starts": F.when(none, F.col("starts")).otherwise(shifted)}).drop("next").where(F.size("at") > 0)
    return met.select("win", "ids", "d", "t", "at", "starts")


def matches(lists: DataFrame, items: DataFrame, window: int = 10, slack: int = SLACK, depth: int = DEPTH) -> DataFrame:
    """d, t, ids, length, near (places of proximity matches), starts (of phrase matches) of each document and window that match, as a written table."""
    reach = window - 1 + slack
    windows = written(item_windows(items, window), "windows")
    counts = written(term_counts(lists, windows.select(F.explode("win").alias("term")).distinct()), "terms")
    ranked = written(by_rarity(windows, counts), "ranked")
    index = postings(lists, ranked.select(F.explode(F.transform(F.slice("terms", 1, depth), lambda x: x["term"])).alias("term")).distinct())
    met = written(intersected(index, ranked, depth, reach), "candidates")
    place = F.xxhash64("d", "t")
    held = bitmap(met.select(place.alias("x")).distinct(), FILTER)
    whole = lists.where(in_bitmap(place, held)).select("d", "t", "w").join(met.select("d", "t").distinct(), ["d", "t"], "left_semi").dropDuplicates(["d", "t"])
    both = met.join(whole, ["d", "t"])
    w, win = F.col("w"), F.col("win")
    near = F.filter("at", lambda p: F.size(F.array_except(win, F.slice(w, F.greatest(p - reach, F.lit(0)) + 1, F.least(p, F.lit(reach)) + reach + 1))) == 0)
    starts = F.filter("starts", lambda s: F.slice(w, s + 1, F.size(win)) == win)
    return written(both.select("d", "t", "ids", F.size("win").alias("length"), near.alias("near"), starts.alias("starts")).where("size(near) > 0"), "matches")


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """d, t, item_id (as a string; null for items without), first, last: windows of items that documents hold."""
    found = matches(forward_lists(docs), items, window)
    return _phrases(found).select("d", "t", F.explode_outer("ids").alias("item_id"), "first", "last").distinct()


def _phrases(found: DataFrame) -> DataFrame:
    each = found.select("d", "t", "ids", "length", F.explode("starts").alias("first"))
    return each.select("d", "t", "ids", "first", (F.col("first") + F.col("length") - 1).alias("last"))


def proximity_matches(docs: DataFrame, items: DataFrame, window: int = 10, slack: int = SLACK) -> DataFrame:
    """d, t, item_id (as a string), at: places of a window's rarest term that have all its words near, in any order."""
    found = matches(forward_lists(docs), items, window, slack)
    return found.select("d", "t", F.explode_outer("ids").alias("item_id"), "near").select("d", "t", "item_id", F.explode("near").alias("at")).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, slack: int = SLACK) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items (items with proximity matches, phrases included) for every
    row of ``docs(doc_id, text)``."""
    lists = forward_lists(docs.select("doc_id", "text"))
    found = matches(lists, items.select("item_id", "text"), window, slack)
    spans = F.sort_array(F.collect_set(F.struct("first", "last")))
    hits = _phrases(found).groupBy("d", "t").agg(spans.alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    covered = F.aggregate("spans", start, lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(x["first"] - 1, a["end"]))).cast("long").alias("n"), F.greatest(a["end"], x["last"]).cast("long").alias("end")), lambda a: a["n"])
    exact = F.when(F.size("starts") > 0, F.col("item"))
    named = found.select("d", "t", "starts", F.explode_outer("ids").alias("item")).groupBy("d", "t").agg(F.sort_array(F.collect_set(exact)).alias("ids"), F.count_distinct("item").alias("n_near"))
    per = named.join(hits.select("d", "t", covered.alias("n_hit")), ["d", "t"], "left")
    per = per.select("d", "t", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), "n_near")
    out = lists.select("doc_id", "d", "t", F.size("w").cast("long").alias("n_words")).join(per, ["d", "t"], "left")
    zero = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", zero)
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.coalesce("n_near", zero).alias("n_near_items"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with all their columns."""
    bad = _phrases(matches(forward_lists(docs.select("doc_id", "text")), items.select("item_id", "text"), window)).select("d", "t").distinct()
    d, t = free_name(docs, "d"), free_name(docs, "t")
    bad = bad.withColumnsRenamed({"d": d, "t": t})
    return docs.join(bad, (F.coalesce(docs["doc_id"], F.lit(NO_ID)) == bad[d]) & (F.xxhash64(docs["text"]) == bad[t]), "left_anti")
