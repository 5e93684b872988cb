"""Secret scans: pattern spans, and spans whose value is expensive to guess in a credential's context.

A value that follows a credential's name (``pwd:``, ``passphrase =``, ``login is`` ...) is scored by dynamic programming over its
characters: the least log10 guesses of all ways to cut it into

* dictionary words, by rank; capitals and signs for letters cost factors of two,
* dates and years,
* repeats: two or more copies of a unit (of three for one character), which costs what the unit costs alone, times their number,
* keyboard walks of three keys or more, by length and turns,
* brute-force spans, a character each.

Every segment costs a choice between the five kinds. Values at or above ``min_log10_guesses`` become spans of kind ``guess``.

The dictionary is a list of common passwords and, in ``find_secrets``, the ``TOP`` most frequent words of the documents' own whole
texts (of three to WORD letters; ties by code point): so it has the languages of the corpus, and its size is bounded whatever theirs.

Null and empty texts have no spans. A text is scanned whole, one row at a time, so memory follows the longest text. Rows are
independent but for the dictionary: repeated rows give equal results, an empty table gives an empty table, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGES = ".,;:!?()[]{}<>\"'`*_-"
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Runs are maximal either way, so a minimum length here equals dropping short matches of the open patterns.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|credentials?|login)["']?\x20*(?::=|=>|[:=]|\x20is\x20)\x20*["']?([^\s"'<>,;|]{6,})""",
    re.ASCII | re.IGNORECASE,
)

# Words common in passwords, the most common first.
COMMON_WORDS = (
    "password", "admin", "welcome", "login", "letmein", "monkey", "dragon", "master", "secret", "love", "qwerty", "test", "hello", "sunshine",
    "princess", "football", "baseball", "shadow", "michael", "superman", "batman", "trust", "iloveyou", "starwars", "summer", "winter", "spring",
    "autumn", "flower", "freedom", "whatever", "killer", "pepper", "ginger", "cookie", "cheese", "coffee", "orange", "purple", "silver", "golden",
    "internet", "computer", "server", "system", "root", "user", "guest", "default", "change", "changeme", "temp", "demo", "service", "manager",
    "access", "pass", "word", "key", "token", "blue", "green", "red", "black", "white", "house", "tiger", "eagle", "horse", "correct", "battery",
    "staple", "apple", "banana", "star", "moon", "sun", "fire", "water", "earth", "light", "dark", "angel", "lucky", "happy", "money", "power",
    "music", "soccer", "hockey", "london", "paris", "berlin", "madrid", "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december", "monday", "friday", "sunday", "company", "office", "example", "sample", "the", "and", "you",
    "for", "my", "me", "is", "it", "in", "of", "to", "one", "two", "three", "key", "dog", "cat", "man", "woman", "boy", "girl",
)
# Keyboard rows, and letters often written as signs.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@8310!$57", "aabeioisst")

#: log10 costs: a choice between kinds of segment, a date in two centuries, a year.
SEGMENT, DAY, YEAR = math.log10(5), math.log10(200 * 365.25), math.log10(200)
#: Longest word, walk and unit of a repeat: longer ones are cut like anything else. Words taken from the corpus.
WORD, WALK, UNIT, TOP = 24, 48, 1024, 20_000
#: Forms of dates and their costs; a separator costs a choice of four.
DATES = (
    (re.compile(r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])", re.ASCII), DAY),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d", re.ASCII), DAY),
    (re.compile(r"(?:19|20)\d\d", re.ASCII), YEAR),
)


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(KEY_ROWS):
        for x, key in enumerate(row):
            beside = {row[i] for i in (x - 1, x + 1) if 0 <= i < len(row)}
            for other, shift in ((y - 1, (0, 1)), (y + 1, (-1, 0))):
                if 0 <= other < len(KEY_ROWS):
                    beside |= {KEY_ROWS[other][x + s] for s in shift if 0 <= x + s < len(KEY_ROWS[other])}
            near[key] = beside
    return near


NEAR = _neighbours()
AT = {key: (y, x) for y, row in enumerate(KEY_ROWS) for x, key in enumerate(row)}


def _one(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100)


def segments(value: str, ranks: dict[str, int]) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 guesses) of every word, date and walk, from every start to every end."""
    low, n = value.lower() if len(value.lower()) == len(value) else value, len(value)
    plain, two = low.translate(LEET), math.log10(2)
    near = [i + 1 < n and low[i + 1] in NEAR.get(low[i], ()) for i in range(n)]
    for i in range(n):
        caps = signs = 0
        for j in range(i + 1, min(n, i + WORD) + 1):
            caps, signs = caps + value[j - 1].isupper(), signs + (low[j - 1] != plain[j - 1])
            if j - i > 1 and (rank := ranks.get(plain[i:j])):
                yield i, j, math.log10(rank) + two * (1 if caps in (1, j - i) else caps) + two * signs
        if value[i].isdigit():
            for form, cost in DATES:
                if m := form.match(value, i):
                    yield i, m.end(), cost + (math.log10(4) if m.lastindex and m[1] else 0)
        j, turns, step = i, 0, None
        while j < n - 1 and near[j] and j + 1 - i < WALK:
            way = (AT[low[j + 1]][0] - AT[low[j]][0], AT[low[j + 1]][1] - AT[low[j]][1])
            turns, step, j = turns + (way != step), way, j + 1
            if j - i >= 2:
                yield i, j + 1, math.log10(47 * (j + 1 - i)) + turns * math.log10(4)


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(unit, first, end) of every longest stretch that has the period ``unit`` and holds two copies of it (three of one character)."""
    n, out = len(value), []
    code = np.frombuffer(value.encode("utf-32-le"), np.uint32)
    for p in range(1, min(UNIT, n // 2) + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], (code[p:] == code[:-p]).view(np.int8), [0]])))
        for a, b in zip(same[::2].tolist(), same[1::2].tolist(), strict=True):
            if b - a >= (p if p > 1 else 2):
                unit = value[a : a + p]
                if (unit + unit).find(unit, 1) == p:  # a unit that repeats itself costs no less than its own unit
                    out.append((p, a, b + p))
    return out


def guess_cost(value: str, ranks: dict[str, int] | None = None, _known: dict[str, float] | None = None) -> float:
    """The least log10 guesses over all cuts of ``value``; 0 for the empty value."""
    ranks, known = RANKS if ranks is None else ranks, {} if _known is None else _known
    if value in known:
        return known[value]
    n = len(value)
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in segments(value, ranks):
        ends.setdefault(j, []).append((i, cost))
    runs = repeats(value)
    copies = np.log10(np.arange(1, n + 1))
    best = np.full(n + 1, math.inf)  # the cheapest way to here, whatever it ends in
    best[0], brute = 0.0, math.inf  # the cheapest that ends in a brute-force span, which goes on without a new choice
    for e in range(1, n + 1):
        brute = min(brute, float(best[e - 1]) + SEGMENT) + _one(value[e - 1])
        least = brute
        for start, cost in ends.get(e, ()):
            least = min(least, float(best[start]) + cost + SEGMENT)
        for p, first, end in runs:
            fewest = 2 if p > 1 else 3
            if first + fewest * p <= e <= end:
                unit = guess_cost(value[e - p : e], ranks, known)
                whole = (e - first) // p
                starts = best[e - fewest * p :: -p][: whole - fewest + 1]
                least = min(least, float((starts + copies[fewest - 1 : whole]).min()) + unit + SEGMENT)
        best[e] = least
    known[value] = float(best[n])
    return known[value]


RANKS: dict[str, int] = {}
for _word in COMMON_WORDS:
    RANKS.setdefault(_word, len(RANKS) + 1)


def scan(text: str | None, min_log10_guesses: float = 8.0, ranks: dict[str, int] | None = None) -> list[tuple[int, int, str, float | None]]:
    """(start, end, kind, log10 guesses) by start, then kind as listed. A base span covers its match, a guess its value."""
    text = text or ""
    found = [(*m.span(), "assign", None) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(*m.span(), "access", None) for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex", None) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".)]}")
        if len(value) >= 6 and (cost := guess_cost(value, ranks)) >= min_log10_guesses:
            found.append((m.start(1), m.start(1) + len(value), "guess", cost))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def frequent_words(docs: DataFrame, top: int = TOP) -> list[str]:
    """The ``top`` most frequent words of ``docs(text)``, most frequent first: lower-cased, of 3 to WORD letters, ties by code point."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            clean: Counter[str] = Counter()
            for w, n in seen.items():  # signs around words are cut off once a distinct word, not once an occurrence
                w = w.strip(EDGES).lower()
                if 3 <= len(w) <= WORD and w.isalpha():
                    clean[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(clean.keys(), pa.string()), pa.array(clean.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0):
                seen.update((t.as_py() or "").split())
                if len(seen) > 400_000:
                    yield told()
        yield told()

    counts = docs.select("text").mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counts.orderBy(F.col("n").desc(), "word").limit(top).collect()]


def find_secrets(docs: DataFrame, min_log10_guesses: float = 8.0, words: Sequence[str] | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, spans array<struct<start, end, kind, log10_guesses>>. ``words`` by rank: common
    passwords and the documents' frequent words if not given."""
    ranks: dict[str, int] = {}
    for w in [*COMMON_WORDS, *frequent_words(docs)] if words is None else words:
        ranks.setdefault(w, len(ranks) + 1)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("log10_guesses", pa.float64())]))
    id_type = dict(docs.dtypes)["doc_id"]

    def rows(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            found = [[dict(zip(("start", "end", "kind", "log10_guesses"), x, strict=True)) for x in scan(t.as_py(), min_log10_guesses, ranks)] for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {id_type}, spans array<struct<start: long, end: long, kind: string, log10_guesses: double>>")


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from find_secrets()."""

    def rows(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_log10_guesses")}
            for found in batch.column(1).to_pylist():
                told = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in found]
                for k in KINDS:
                    out[f"n_{k}"].append(sum(x == k for x, _ in told))
                out["base_sha256"].append(hashlib.sha256(",".join(x for k, x in told if k != "guess").encode()).hexdigest())
                out["spans"].append(",".join(x for _, x in told))
                out["max_log10_guesses"].append(max((s["log10_guesses"] for s in found if s["kind"] == "guess"), default=None))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])

    return spans.mapInArrow(rows, f"doc_id {dict(spans.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_log10_guesses double")
