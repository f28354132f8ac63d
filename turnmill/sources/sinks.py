"""Sinks: turns become message lists again, in the shape they came in."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import RESULT_ROLES


def _ordered(turns: DataFrame, value: Column) -> DataFrame:
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: x["v"]).alias("messages"))


def to_strings(turns: DataFrame) -> DataFrame:
    """(conv_id, messages array<string>)."""
    return _ordered(turns, text.of_turn())


def to_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, messages array<struct<role, content>>)."""
    return _ordered(turns, F.struct("role", text.of_turn().alias("content")))


def block_json(block: Column) -> Column:
    """A block as its message form: text is rebuilt, others come from what was read."""
    return F.when(block["type"] == "text", F.to_json(F.struct(F.lit("text").alias("type"), block["content"].alias("text")))).otherwise(F.coalesce(block["raw_json"], F.to_json(F.struct(block["type"].alias("type"), block["content"].alias("content")))))


def _patched(raw: str | None, role: str, content: str | None, blocks: str | None, calls: str | None) -> str:
    message = json.loads(raw) if raw else {}
    had = message.get("content", "")
    message["role"] = message["role"] if str(message.get("role", "")).lower() == role else role
    if blocks is not None:
        message["content"] = json.loads(blocks)
    else:
        message["content"] = None if had is None and not content else content
    if calls is not None:
        message["tool_calls"] = json.loads(calls)
    if role in RESULT_ROLES and isinstance(message["content"], str):
        message["content"] = content
    return json.dumps(message, ensure_ascii=False)


def to_json(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): a JSON array of messages; keys that no stage knows are kept, null contents that are still empty too."""
    def run(raw: pd.Series, role: pd.Series, content: pd.Series, blocks: pd.Series, calls: pd.Series) -> pd.Series:
        return pd.Series([_patched(*x) for x in zip(raw, role, content, blocks, calls, strict=True)], dtype=object)

    blocks = F.when(F.col("blocks").isNotNull(), F.concat(F.lit("["), F.array_join(F.transform("blocks", block_json), ","), F.lit("]")))
    one = F.pandas_udf(run, "string")("raw_json", "role", "content", blocks, "tool_calls_json")
    rows = _ordered(turns.withColumn("_one", one), F.col("_one"))
    return rows.select("conv_id", F.concat(F.lit("["), F.array_join("messages", ","), F.lit("]")).alias("messages"))


def to_python(turns: DataFrame, like: list[list]) -> list[list]:
    """Message lists on the driver, each in the shape of its input; a turn made by a stage takes the shape of its list's others."""
    out: list[list] = [[] for _ in like]
    shapes = [type(m[0]) if m else dict for m in like]
    rows = turns.select("conv_id", "pos", "role", "content", "raw_json", "tool_calls_json", text.of_turn().alias("own"), F.when(F.col("blocks").isNotNull(), F.concat(F.lit("["), F.array_join(F.transform("blocks", block_json), ","), F.lit("]"))).alias("parts")).orderBy("conv_id", "pos")
    for r in rows.toLocalIterator():
        shape = shapes[r.conv_id]
        if shape is str:
            out[r.conv_id].append(r.own)
        elif shape is tuple:
            out[r.conv_id].append((r.role, r.own))
        elif shape is dict:
            out[r.conv_id].append(json.loads(_patched(r.raw_json, r.role, r.content, r.parts, r.tool_calls_json)))
        else:
            source = like[r.conv_id][r.pos] if r.raw_json is not None and r.pos < len(like[r.conv_id]) else None
            if source is not None and hasattr(source, "model_copy"):
                out[r.conv_id].append(source.model_copy(update={"content": r.own}))
            else:
                import copy

                made = copy.copy(source) if source is not None else copy.copy(like[r.conv_id][0])
                made.content = r.own
                if source is None and hasattr(made, "type"):
                    made.type = r.role
                out[r.conv_id].append(made)
    return out
