"""Filler: phrases without content, and assistant turns that only acknowledge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import is_system


def filler(turns: DataFrame, conv_type: str = "chat") -> DataFrame:
    """Chat and agent: tool turns pass, acknowledging assistant turns go, and so do turns that end empty; a user's turn then keeps its
    text. rag_doc: every turn but system ones is stripped, and goes if it ends empty."""
    own = text.of_turn()
    out = turns.withColumn("_own", own).withColumn("_new", text.without_fillers(F.col("_own")))
    bare = text.blank(F.col("_new"))
    if conv_type == "rag_doc":
        passes, gone = is_system(), bare
        keeps = F.lit(False)
    else:
        passes = is_system() | text.tool_marked()
        user = F.col("role").eqNullSafe("user")
        gone = (F.col("role").eqNullSafe("assistant") & text.acknowledges(F.col("_own"))) | (bare & ~user)
        keeps = bare & user
    changed = ~passes & ~keeps & (F.col("_new") != F.col("_own"))
    out = out.withColumn("_gone", ~passes & gone).filter(~F.col("_gone"))
    return out.withColumns(text.written_back(F.col("_new"), changed)).drop("_own", "_new", "_gone")
