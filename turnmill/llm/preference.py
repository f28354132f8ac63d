"""Preference formatting with SQL functions only.

For a chosen and a rejected conversation, the longest common prefix of turns is
rendered once as the prompt; what follows in each is its completion. A
completion comes with its loss mask in run lengths: the texts of its assistant
turns are trained on, everything else (role marks, other turns) is masked, and
so is the whole prompt.

Cases: a null array counts as no turns; turns are equal if role and text are
(nulls equal nulls); a null role renders as `unknown`, a null text as empty;
conversations without a difference give empty completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.coalesce(turn["text"], F.lit(""))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("\n"))), "")


def mask(turns: Column) -> Column:
    """The rendered text's lengths in code points, masked (-) and trained on (+) in turn: for each turn its head, its text and the line end."""
    runs = F.transform(turns, lambda t: F.concat(F.lit("-"), F.length(_head(t)), F.when(t["role"].eqNullSafe("assistant"), ",+").otherwise(",-"), F.length(_body(t)), F.lit(",-1")))
    return F.array_join(runs, ",")


def common_turns(chosen: Column, rejected: Column) -> Column:
    """The number of leading turns that are equal in both."""
    shorter = F.least(F.size(chosen), F.size(rejected))
    same = F.transform(F.slice(chosen, F.lit(1), shorter), lambda t, i: t["role"].eqNullSafe(F.get(rejected, i)["role"]) & t["text"].eqNullSafe(F.get(rejected, i)["text"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(shorter.cast("long"))


def format_pairs(pairs: DataFrame, id_column: str = "pair_id") -> DataFrame:
    """(id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask) of rows with turn arrays `chosen` and `rejected`."""
    empty = F.array().cast(TURNS)
    both = pairs.select(id_column, *(F.coalesce(F.col(c).cast(TURNS), empty).alias(c) for c in ("chosen", "rejected")))
    both = both.withColumn("n_prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(F.col(c), (F.col("n_prompt_turns") + 1).cast("int"), F.greatest(F.size(c), F.lit(1)))
    cut = both.select(id_column, "n_prompt_turns", F.slice("chosen", F.lit(1), F.col("n_prompt_turns").cast("int")).alias("prompt"), rest("chosen").alias("chosen"), rest("rejected").alias("rejected"))
    return cut.select(id_column, "n_prompt_turns", render(F.col("prompt")).alias("prompt"), *(render(F.col(c)).alias(c) for c in ("chosen", "rejected")), *(mask(F.col(c)).alias(f"{c}_mask") for c in ("chosen", "rejected")))


def reply_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from a table of turns (conv_id, turn, role, text): each conversation up to its last assistant turn is chosen, and the
    same with the last assistant turn of its neighbour (conv_id with the lowest bit flipped) in that place is rejected; without such
    a turn in the neighbour, the rejected one ends before it. Conversations without an assistant turn make no pair; rows without
    conv_id belong to none; equal rows stay; turns are ordered by (turn, role, text), a null turn first."""
    turns = conversations.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**62))).alias("turn"), "role", "text"))).alias("turns"))
    plain = turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    said = F.transform(F.col("turns"), lambda t, i: F.when(t["role"].eqNullSafe("assistant"), i).otherwise(F.lit(-1)))
    last = plain.withColumn("last", F.array_max(said)).filter("last >= 0")
    replies = last.select(F.expr("conv_id ^ 1").alias("conv_id"), F.slice("turns", F.col("last") + 1, F.lit(1)).alias("reply"))
    none = F.array().cast(TURNS)
    before = F.slice("turns", F.lit(1), F.col("last"))
    return last.join(replies, "conv_id", "left").select(F.col("conv_id").alias("pair_id"), F.slice("turns", F.lit(1), F.col("last") + 1).alias("chosen"), F.concat(before, F.coalesce("reply", none)).alias("rejected"))
