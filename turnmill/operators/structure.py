"""Structure: JSON made compact, repeated lines and spaces squeezed. System turns are left alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonops, text
from ..schema import is_result, is_system


def structure(turns: DataFrame, strength: float = 0.5) -> DataFrame:
    """Per row; UDFs get null for guarded rows, since they run for every row."""
    own = text.of_turn()
    out = turns.withColumns({
        "_new": jsonops.compact(strength)(F.when(~is_system(), own)),
        "_calls": jsonops.minify_arguments()(F.when(~is_system(), F.col("tool_calls_json"))),
    })
    changed = F.coalesce(F.col("_new") != own, F.lit(False))
    out = out.withColumns(text.written_back(F.col("_new"), changed))
    calls = F.coalesce(F.col("_calls") != F.col("tool_calls_json"), F.lit(False))
    out = out.withColumns({
        "tool_calls_json": F.coalesce("_calls", "tool_calls_json"),
        "compressed": F.col("compressed") | calls,
        "original_content": F.when(calls, F.coalesce("original_content", "content")).otherwise(F.col("original_content")),
    })
    return out.drop("_new", "_calls")


def result_payloads(turns: DataFrame) -> DataFrame:
    """Adds `payload`: a result turn's content as compact JSON, for sinks that keep the original message."""
    return turns.withColumn("payload", jsonops.minify()(F.when(is_result(), text.of_turn())))
