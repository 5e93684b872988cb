"""Quality rules as a bitmask ledger: every rule is measured once; policies and ablations only read bits.

``ledger`` stores measurements and ``fail_bits`` (bit i set: rule i failed). A policy is a named version with a mask of
the rules that it enforces; ``apply_policy`` keeps a document iff ``fail_bits & mask = 0``. ``ablation`` aggregates the
bits of a ledger: how many documents each rule fails, fails alone, and would be kept without it.

Only DataFrame functions: one pass over the text, no shuffle (ablation: one partial aggregate). Null text counts as
having no words. ``n_letters`` counts the characters of words that are no digits, signs or marks of ASCII, ``n_stop_words`` the different
stop words that occur, in lower case; bullets and ellipses are told by a line's first and last characters other than spaces. Repeated rows give repeated results; an empty table gives an empty ledger (and zero counts). Columns other than doc_id
and text are ignored. A text's words are one array, so memory follows the longest text.

Repeated 3-word windows are found per row: window hashes (64 bits) are sorted with their positions and compared with
their neighbours, n log n in the words of a text. Two different windows of one text would have to share a hash to matter
(about n^2 / 2^65).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RUN

SYMBOLS = "#*$%&|<>"
WINDOW = 3
#: Characters of ASCII that are no letters; all beyond ASCII count as letters.
NO_LETTERS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalpha())
BULLETS = ("-", "*", "\u2022")
ELLIPSES = ("...", "\u2026")
#: Frequent words of the languages dealt with (English, German, Spanish, French), of which running text holds some.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "der", "die", "und", "das", "ein", "nicht", "de", "la", "que", "el", "los", "en", "le", "les", "et", "un", "des", "une")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements


#: Order fixes the bits: only ever append.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("short_words", "word_chars < 3 * n_words"),
    Rule("long_words", "word_chars > 12 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines AND 10 * n_repeat_words > 3 * n_words"),
    Rule("few_letters", "10 * n_letters < 7 * word_chars"),
    Rule("bullets", "10 * n_bullet_lines > 9 * n_lines"),
    Rule("ellipses", "10 * n_ellipsis_lines > 3 * n_lines"),
    Rule("few_stop_words", "n_stop_words < 2"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
#: Versioned policies: masks of enforced rules.
POLICIES = {
    "base": BIT["too_few_words"] | BIT["repeated_windows"],
    "v1": sum(BIT[r] for r in ("too_few_words", "repeated_windows", "symbols", "short_words", "long_words", "duplicate_lines")),
    "v2": sum(BIT.values()),
}


def _shift(a: Column, by: int) -> Column:
    """The elements of ``a`` after the first ``by``."""
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements, in long."""
    blank = F.translate(F.col("text"), SPACE, "")
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        F.filter(F.split("text", SPACE_RUN), lambda w: w != "").alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.ltrim(F.translate(x, SPACE[1:], " ")) != "").alias("lines"),
        F.char_length(blank).alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        F.char_length(F.translate(blank, NO_LETTERS, "")).alias("n_letters"),
    )
    w, flat = F.col("w"), lambda x: F.translate(x, SPACE[1:], " ")
    n_bullet = F.size(F.filter("lines", lambda x: F.substring(F.ltrim(flat(x)), 1, 1).isin(*BULLETS)))
    n_ellipsis = F.size(F.filter("lines", lambda x: F.rtrim(flat(x)).endswith(ELLIPSES[0]) | F.rtrim(flat(x)).endswith(ELLIPSES[1])))
    n_stop = F.size(F.array_intersect(w, F.array(*map(F.lit, STOP_WORDS))))
    hashed = F.transform(F.arrays_zip(w.alias("a"), _shift(w, 1).alias("b"), _shift(w, 2).alias("c")), lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")))
    sized = read.select("doc_id", "word_chars", "n_symbols", "n_letters", n_bullet.alias("n_bullet_lines"), n_ellipsis.alias("n_ellipsis_lines"), n_stop.alias("n_stop_words"), F.size(w).alias("n_words"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.sort_array(F.slice(hashed, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)))).alias("s"))
    # s is used three times below, so the optimizer leaves it a column of its own
    s = F.col("s")
    none = F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i"))
    beside = F.arrays_zip(s.alias("x"), F.concat(F.array(none), s).alias("p"), F.concat(_shift(s, 1), F.array(none)).alias("n"))
    twice = F.transform(F.filter(beside, lambda x: (x["x"]["h"] == x["p"]["h"]) | (x["x"]["h"] == x["n"]["h"])), lambda x: x["x"]["i"])
    starts = sized.select("*", F.sort_array(twice).alias("at")).drop("s")
    at = F.col("at")
    gaps = F.zip_with(at, _shift(at, 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))  # the last has no next one: null, taken as a whole window
    return starts.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_letters", "n_bullet_lines", "n_ellipsis_lines", "n_stop_words")), F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(WINDOW))).alias("n_repeat_words"))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements and fail_bits of every row of ``docs(doc_id, text)``."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return measure(docs).withColumn("fail_bits", out)


def apply_policy(ledger_df: DataFrame, mask: int, name: str = "kept") -> DataFrame:
    return ledger_df.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablation(ledger_df: DataFrame, mask: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule, n_failed, n_failed_alone, n_kept_without for every enforced rule: one aggregate over the bits."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    used = [(i, r) for i, r in enumerate(rules) if mask >> i & 1]
    sums = [F.count_if(bits.bitwiseAND(F.lit(1 << i).cast("long")) != 0).alias(f"f{i}") for i, _ in used]
    sums += [F.count_if(bits == (1 << i)).alias(f"a{i}") for i, _ in used]
    one = ledger_df.agg(F.count_if(bits == 0).alias("kept"), *sums)
    rows = [F.struct(F.lit(r.name).alias("rule"), F.col(f"f{i}").alias("n_failed"), F.col(f"a{i}").alias("n_failed_alone"), (F.col("kept") + F.col(f"a{i}")).alias("n_kept_without")) for i, r in used]
    return one.select(F.inline(F.array(*rows)))
