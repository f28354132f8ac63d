"""The table of turns: one row a turn, ordered by `pos` within `conv_id`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "array<struct<type:string,content:string,mime_type:string,raw_json:string>>"

#: Column: type. A plain turn has content and null blocks, a turn of blocks has null content.
TURNS = {
    "conv_id": "bigint",
    "pos": "bigint",
    "role": "string",
    "content": "string",
    "blocks": BLOCKS,
    "tool_calls_json": "string",
    "tool_call_id": "string",
    "name": "string",
    "raw_json": "string",
    "has_tool_key": "boolean",
    "ts": "timestamp",
    "importance": "double",
    "resolved": "boolean",
    "compressed": "boolean",
    "original_content": "string",
    "source": "string",
}
DEFAULTS = {"importance": 1.0, "resolved": False, "compressed": False, "has_tool_key": False}

SYSTEM = "system"
RESULT_ROLES = ("tool", "function")
ROLES = ("user", "assistant", "system", "tool", "function")
CONTEXT_TYPES = ("chat", "rag_doc", "agent")


def canonical(turns: DataFrame) -> DataFrame:
    """All columns of TURNS, in order and typed; missing ones get their default. Other columns follow."""
    have = set(turns.columns)
    columns = [F.coalesce(F.col(c).cast(t), F.lit(DEFAULTS[c])).alias(c) if c in have and c in DEFAULTS else F.col(c).cast(t).alias(c) if c in have else F.lit(DEFAULTS.get(c)).cast(t).alias(c) for c, t in TURNS.items()]
    return turns.select(*columns, *(c for c in turns.columns if c not in TURNS))


def is_system() -> Column:
    return F.col("role").eqNullSafe(SYSTEM)


def is_result() -> Column:
    return F.col("role").isin(*RESULT_ROLES)
