"""Preference formatting: the common beginning of a chosen and a rejected conversation once, then both endings, masked.

``turns(pair, side, turn, role, text)`` holds each pair's two conversations, side ``chosen`` or ``rejected``. The prompt is
the longest run of first turns, in order of ``turn``, on which both sides agree in role and text. It is rendered once (from
the chosen side); what follows is rendered for each side. Assistant turns of the endings carry the loss; everything else
is masked.

Output is a row a turn (``part``: prompt, chosen or rejected), so that a conversation of any length, even one with a third of
all turns, is never gathered: sides are compared by (pair, turn) with pre-aggregated counts, and the first turn that
differs goes back to its pair's rows by a join. ``documents`` strings the rows together where conversations are known to be short.

A turn's value is its place: gaps are fine if both sides have them. Several rows of one side at one turn must agree as
multisets (compared by 128 bits of hashes of role and text). Null roles render as ``unknown`` and null texts as empty, but
a null differs from an empty string in comparison. A null turn sorts first. A pair with one side only has no prompt.
An empty table gives an empty result. Other columns are ignored, whatever their names. A turn's text is never split: memory follows the longest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SIDES = ("chosen", "rejected")


def first_difference(turns: DataFrame) -> DataFrame:
    """pair, differs: the least turn at which the sides don't agree, null turns as the least of all; no row for pairs that agree throughout."""
    chosen = F.col("side") == "chosen"
    signed = lambda h: F.sum(F.when(chosen, h).otherwise(-h))
    what = F.struct("role", "text")
    lanes = [F.shiftright(F.xxhash64(F.lit(seed), F.to_json(what, {"ignoreNullFields": "false"})), 20) for seed in (1, 2, 3)]
    at = turns.groupBy("pair", "turn").agg(F.sum(F.when(chosen, 1).otherwise(-1)).alias("n"), *(signed(h).alias(f"l{i}") for i, h in enumerate(lanes)))
    return at.where("n <> 0 OR l0 <> 0 OR l1 <> 0 OR l2 <> 0").groupBy("pair").agg(F.min("turn").alias("differs"), F.count_if(F.col("turn").isNull()).alias("nulls"))


def format_preferences(turns: DataFrame) -> DataFrame:
    """pair, part, turn, role, rendered, loss (whether its content is trained on)."""
    first = first_difference(turns).withColumnRenamed("pair", "_pair")
    held = turns.select("pair", "side", "turn", "role", "text").join(first, F.col("pair").eqNullSafe(F.col("_pair")), "left")
    agrees = F.col("differs").isNull() & (F.coalesce("nulls", F.lit(0)) == 0) | (F.coalesce("nulls", F.lit(0)) == 0) & (F.col("turn").isNull() | (F.col("turn") < F.col("differs")))
    part = F.when(agrees, F.lit("prompt")).otherwise(F.col("side"))
    role = F.coalesce("role", F.lit("unknown"))
    rendered = F.concat(F.lit(OPEN), role, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE + "\n"))
    return held.where(~agrees | (F.col("side") == "chosen")).select("pair", part.alias("part"), "turn", role.alias("role"), rendered.alias("rendered"), (~agrees & (role == "assistant")).alias("loss"))


def neighbours_paired(conversations: DataFrame) -> DataFrame:
    """Turns for format_preferences() from ``conversations(conv_id, turn, role, text)``, which states no preference: conversation 2k is
    chosen over 2k + 1. Rows without a conv_id pair with nothing and are left out."""
    conv = F.col("conv_id")
    return conversations.where(conv.isNotNull()).select(F.floor(conv / 2).alias("pair"), F.when(F.pmod(conv, F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text")


def documents(formatted: DataFrame) -> DataFrame:
    """pair, prompt, chosen, rejected, and for both endings the loss spans (start, end in code points): for short conversations."""
    def side(name: str) -> list:
        rows = F.sort_array(F.collect_list(F.when(F.col("part") == name, F.struct("turn", "role", "rendered", "loss"))))
        return [F.array_join(F.transform(rows, lambda x: x["rendered"]), "").alias(name), rows.alias(f"_{name}")]

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def spans(name: str):
        def step(a, x):
            end = a["at"] + F.char_length(x["rendered"])
            begin = a["at"] + F.char_length(x["role"]) + len(OPEN) + 1
            return F.struct(end.alias("at"), F.when(x["loss"], F.concat(a["spans"], F.array(F.struct(begin.alias("start"), (end - 1).alias("end"))))).otherwise(a["spans"]).alias("spans"))

        return F.aggregate(f"_{name}", start, step, lambda a: a["spans"]).alias(f"{name}_loss")

    cols = [c for name in ("prompt", *SIDES) for c in side(name)]
    return formatted.groupBy("pair").agg(*cols).select("pair", "prompt", *SIDES, *(spans(s) for s in SIDES))
