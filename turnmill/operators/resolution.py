"""Resolution: the thread that leads to a conversation's last decision becomes one system turn."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import is_system
from . import similarity, tools

LOOK_BACK = 20
LINKED = 0.3
SOURCE = "resolution_detector"


def description(own: Column) -> Column:
    """What follows the first phrase in list order that the text has, up to the first full stop and 200 characters; the text's first
    120 characters if nothing follows; `decision recorded` if that is empty."""
    body = text.strip(own)
    low = F.lower(body)
    after = F.lit(None).cast("string")
    for phrase in reversed(text.DECISIONS):
        rest = F.substr(body, F.instr(low, F.lit(phrase)) + len(phrase))
        after = F.when(low.contains(phrase), F.regexp_replace(rest, r"^[ :—\-\t]+|[ :—\-\t]+\z", "")).otherwise(after)
    cut = F.substring(text.strip(F.regexp_replace(after, r"(?s)\..*", "")), 1, 200)
    found = F.when(F.coalesce(after, F.lit("")) != "", cut).otherwise(F.substring(body, 1, 120))
    return F.when(found == "", "decision recorded").otherwise(found)


def points(turns: DataFrame) -> DataFrame:
    """The turns with `idx`, their place in the conversation, and `res`, the place of the last decision (null: none, or the first turn)."""
    rows = turns.withColumn("idx", F.row_number().over(Window.partitionBy("conv_id").orderBy("pos")) - 1).withColumn("_own", text.of_turn())
    hit = ~is_system() & ~text.only_asks(F.col("_own")) & text.decides(F.col("_own"))
    last = F.max(F.when(hit, F.col("idx"))).over(Window.partitionBy("conv_id"))
    return rows.withColumn("res", F.when(last > 0, last))


def threads(rows: DataFrame) -> DataFrame:
    """(conv_id, res, start): the thread goes back over turns linked to the decision, or to the turn before it; none if that is a system
    turn. rows: from `points`."""
    held = rows.filter("res is not null")
    answer = held.filter("idx = res").select("conv_id", F.col("_own").alias("_res"))
    near = held.filter((F.col("idx") < F.col("res")) & (F.col("idx") >= F.col("res") - LOOK_BACK)).join(answer, "conv_id")
    keys = ["conv_id", "idx"]
    cosine = similarity.pair_cosine(near.filter(~is_system() & ~text.blank(F.col("_own"))), keys, "_own", "_res")
    near = near.join(cosine, keys, "left")
    bad = is_system() | (F.coalesce("cosine", F.lit(0.0)) < LINKED)
    found = near.groupBy("conv_id", "res").agg(F.max(F.when(bad, F.col("idx"))).alias("last_bad"), F.min("idx").alias("first"), F.max(F.when((F.col("idx") == F.col("res") - 1) & ~is_system(), F.col("idx"))).alias("before"))
    start = F.coalesce(F.col("last_bad") + 1, F.col("first"))
    return found.select("conv_id", "res", F.when(start < F.col("res"), start).otherwise(F.col("before")).alias("start")).filter("start is not null")


def resolution(turns: DataFrame, conv_type: str = "chat", subject: Callable[[Column], Column] | None = None) -> DataFrame:
    """Replaces each resolved thread. Chat needs an agreeing user and an agreeing assistant turn in it; a structured turn in it keeps it
    whole. `subject` names the thread from the decision's text; `Topic` without it."""
    if conv_type == "rag_doc":
        return turns
    rows = points(turns)
    found = threads(rows)
    spans = tools.preserved(rows.filter("res is not null").drop("res").join(found, "conv_id"), "_kept").withColumn("_agrees", text.agrees(F.col("_own")))
    within = (F.col("idx") >= F.col("start")) & (F.col("idx") <= F.col("res") + 1)
    by = lambda role: F.max((within & F.col("role").eqNullSafe(role) & F.col("_agrees")).cast("int"))
    follows = F.max(((F.col("idx") == F.col("res") + 1) & F.col("role").eqNullSafe("assistant") & F.col("_agrees")).cast("int"))
    facts = spans.groupBy("conv_id", "start", "res").agg(by("user").alias("user"), by("assistant").alias("assistant"), follows.alias("follows"))
    if conv_type == "chat":
        facts = facts.filter("user = 1 and assistant = 1")
    facts = facts.select("conv_id", "start", "res", (F.col("res") + F.col("follows")).alias("end"))
    inside = spans.select("conv_id", "idx", "pos", "_own", "_kept").join(facts, "conv_id").filter("idx between start and end")
    name = subject(F.col("_text")) if subject else F.lit("Topic")
    facts = inside.groupBy("conv_id", "start", "end").agg(F.min("pos").alias("pos"), F.max("pos").alias("_to"), F.max(F.col("_kept").cast("int")).alias("_kept"), F.max(F.when(F.col("idx") == F.col("res"), F.col("_own"))).alias("_text")).filter("_kept = 0")
    facts = facts.withColumn("content", F.concat(F.lit("RESOLVED: "), name, F.lit(" — "), description(F.col("_text")))).select("conv_id", "pos", "_to", "content")
    rest = turns.join(facts.select("conv_id", F.col("pos").alias("_from"), "_to"), "conv_id", "left").filter("_from is null or pos not between _from and _to").drop("_from", "_to")
    made = facts.select("conv_id", "pos", "content", F.lit("system").alias("role"), F.lit(1.0).alias("importance"), F.lit(False).alias("resolved"), F.lit(False).alias("compressed"), F.lit(False).alias("has_tool_key"), F.lit(SOURCE).alias("source"))
    return rest.unionByName(made, allowMissingColumns=True).select(*turns.columns)
