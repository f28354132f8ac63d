"""Repetition: of two similar turns the earlier goes, an anti join on similar pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import is_system
from . import similarity, tools

LEAST_WORDS = 10


def threshold(aggressiveness: float) -> float:
    return 0.95 - aggressiveness * 0.25


def similar_pairs(turns: DataFrame, bound: float | None, by_role: bool = True) -> DataFrame:
    """(conv_id, grp, a, b, similarity) among turns of at least LEAST_WORDS words: within the user's and within the assistant's turns,
    or within all turns but system ones."""
    rows = turns.filter(F.col("role").isin("user", "assistant") if by_role else ~is_system())
    rows = rows.select("conv_id", (F.col("role") if by_role else F.lit("all")).alias("grp"), "pos", text.of_turn().alias("_text")).filter(text.word_count(F.col("_text")) >= LEAST_WORDS)
    return similarity.group_pairs(rows, ["conv_id", "grp"], "pos", "_text", bound)


def repetition(turns: DataFrame, conv_type: str = "chat", aggressiveness: float = 0.6, role_aware: bool = True) -> DataFrame:
    """Without the turns that a later one repeats; structured turns and members of tool groups stay."""
    pairs = similar_pairs(turns, threshold(aggressiveness), role_aware and conv_type != "rag_doc")
    repeated = pairs.select("conv_id", F.col("a").alias("pos")).distinct().withColumn("_repeated", F.lit(True))
    rows = tools.preserved(tools.with_groups(turns), "_preserved").join(repeated, ["conv_id", "pos"], "left")
    gone = F.col("_repeated").isNotNull() & ~F.col("_preserved") & (F.col("tool_group_size") == 1)
    return rows.filter(~gone).select(*turns.columns)
