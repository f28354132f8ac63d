"""Sources: messages in any of their shapes become rows of turns.

Readers take a DataFrame with `conv_id` and a column of messages: an array of
message structs or JSON, of strings, or of (role, content) pairs. `from_python`
takes message lists of the driver, objects too.
"""

from __future__ import annotations

import datetime as dt
import json
import warnings
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BLOCKS, ROLES, TURNS, canonical

TOOL_KEYS = ("tool_calls", "tool_call", "tool_use", "tool_result", "tool_call_id")
OBJECT_ROLES = {"human": "user", "ai": "assistant", "system": "system", "tool": "tool", "function": "function"}


def from_table(table: DataFrame, conv_id: str = "conv_id", pos: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns of a table with one row a turn."""
    return canonical(table.select(F.col(conv_id).alias("conv_id"), F.col(pos).alias("pos"), F.lower(F.coalesce(F.col(role), F.lit("user"))).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content")))


def from_documents(table: DataFrame, group: Column, query: Column | None = None) -> DataFrame:
    """Chunks of documents as the assistant turns of a rag_doc conversation by `group`, and a last user turn if a query is given."""
    rows = table.select(group.cast("bigint").alias("conv_id"), F.col("doc_id").alias("pos"), F.lit("assistant").alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    if query is not None:
        rows = rows.unionByName(table.groupBy(group.cast("bigint").alias("conv_id")).agg((F.max("doc_id") + 1).alias("pos"), F.first(query).alias("content")).withColumn("role", F.lit("user")).select("conv_id", "pos", "role", "content"))
    return canonical(rows)


def from_strings(frame: DataFrame, column: str = "messages") -> DataFrame:
    """array<string>: user and assistant in turn."""
    rows = frame.select("conv_id", F.posexplode(column).alias("pos", "content"))
    return canonical(rows.withColumn("role", F.when(F.col("pos") % 2 == 0, "user").otherwise("assistant")))


def from_pairs(frame: DataFrame, column: str = "messages") -> DataFrame:
    """array<struct<role, content>>."""
    rows = frame.select("conv_id", F.posexplode(column).alias("pos", "m"))
    return canonical(rows.select("conv_id", "pos", F.lower(F.coalesce("m.role", F.lit("user"))).alias("role"), F.coalesce("m.content", F.lit("")).alias("content")))


def _json(path: str) -> Column:
    return F.get_json_object("m", path)


def from_json(frame: DataFrame, column: str = "messages") -> DataFrame:
    """A JSON array of messages, or an array<string> of JSON messages; elements that are no object are skipped. A content that is an
    array becomes blocks; tool fields and the time are taken out; the message itself stays in raw_json."""
    kind = dict(frame.dtypes)[column]
    each = F.col(column) if kind.startswith("array") else F.expr(f"from_json(`{column}`, 'array<string>')")
    rows = frame.select("conv_id", F.posexplode(each).alias("pos", "m")).filter(F.coalesce(F.trim("m").startswith("{"), F.lit(False)))
    content = _json("$.content")
    is_blocks = F.col("m").rlike(r'"content"\s*:\s*\[') & F.coalesce(content.startswith("["), F.lit(False))
    parsed = F.from_json(content, F.lit("array<string>"))
    block = lambda b: F.struct(
        F.when(F.get_json_object(b, "$.type").isin("image_url", "image"), "image").otherwise(F.coalesce(F.get_json_object(b, "$.type"), F.lit("text"))).alias("type"),
        F.coalesce(F.get_json_object(b, "$.text"), F.get_json_object(b, "$.image_url.url"), F.get_json_object(b, "$.content"), F.lit("")).alias("content"),
        F.get_json_object(b, "$.mime_type").alias("mime_type"),
        b.alias("raw_json"),
    )
    keyed = F.lit(False)
    for key in TOOL_KEYS:
        keyed = keyed | F.array_contains(F.coalesce(F.json_object_keys("m"), F.array()), key)
    out = rows.select(
        "conv_id",
        "pos",
        F.lower(F.coalesce(_json("$.role"), F.lit("user"))).alias("role"),
        F.when(~is_blocks, F.coalesce(content, F.lit(""))).alias("content"),
        F.when(is_blocks, F.transform(parsed, block)).cast(BLOCKS).alias("blocks"),
        _json("$.tool_calls").alias("tool_calls_json"),
        _json("$.tool_call_id").alias("tool_call_id"),
        _json("$.name").alias("name"),
        F.col("m").alias("raw_json"),
        keyed.alias("has_tool_key"),
        when(F.coalesce(_json("$.timestamp"), _json("$.created_at"), _json("$.ts"))).alias("ts"),
    )
    return canonical(out)


def when(value: Column) -> Column:
    """A time as epoch seconds or ISO text; null if it is neither."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00")), F.timestamp_seconds(F.expr("1") * value.try_cast("double")))


def _block(b: Any) -> dict:
    if not isinstance(b, dict):
        return {"type": "text", "content": str(b), "mime_type": None, "raw_json": None}
    kind = b.get("type", "text")
    if kind == "text":
        body = b.get("text", "")
    elif kind in ("image_url", "image"):
        image = b.get("image_url")
        kind, body = "image", image.get("url", "") if isinstance(image, dict) else image or b.get("content", "")
    else:
        body = b.get("text") or b.get("content") or ""
    return {"type": kind, "content": body if isinstance(body, str) else json.dumps(body, ensure_ascii=False), "mime_type": b.get("mime_type"), "raw_json": json.dumps(b, ensure_ascii=False, default=str)}


def _time(m: dict) -> dt.datetime | None:
    value = next((m[k] for k in ("timestamp", "created_at", "ts") if m.get(k) is not None), None)
    try:
        if isinstance(value, int | float) and not isinstance(value, bool):
            return dt.datetime.fromtimestamp(value, dt.UTC)
        return value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value.replace("Z", "+00:00")) if isinstance(value, str) else None
    except (ValueError, OverflowError, OSError):
        return None


def _message(m: dict) -> dict:
    role = str(m.get("role") or "user").lower()
    if role not in ROLES:
        warnings.warn(f"unknown role {role!r}", stacklevel=4)
    body = m.get("content")
    blocks = [_block(b) for b in body] if isinstance(body, list) else None
    return {
        "role": role,
        "content": None if blocks is not None else "" if body is None else body if isinstance(body, str) else str(body),
        "blocks": blocks,
        "tool_calls_json": json.dumps(m["tool_calls"], ensure_ascii=False) if isinstance(m.get("tool_calls"), list) else None,
        "tool_call_id": None if m.get("tool_call_id") is None else str(m["tool_call_id"]),
        "name": m.get("name"),
        "raw_json": json.dumps(m, ensure_ascii=False, default=str),
        "has_tool_key": any(k in m for k in TOOL_KEYS),
        "ts": _time(m),
    }


def rows_of(messages: list) -> list[dict]:
    """The turns of one message list. Its first element decides the shape."""
    if messages is None:
        raise TypeError("messages must not be None")
    if not isinstance(messages, list):
        raise TypeError(f"messages must be a list, not {type(messages).__name__}")
    if not messages:
        return []
    first = messages[0]
    if isinstance(first, str):
        found = [{"role": "assistant" if i % 2 else "user", "content": str(m)} for i, m in enumerate(messages)]
    elif isinstance(first, tuple):
        found = [{"role": str(m[0]).lower(), "content": str(m[1])} for m in messages if len(m) >= 2]
    elif isinstance(first, dict):
        found = []
        for m in messages:
            if isinstance(m, dict):
                found.append(_message(m))
            else:
                warnings.warn(f"skipped an element of type {type(m).__name__}", stacklevel=3)
    elif hasattr(first, "content"):
        found = [_message({"role": OBJECT_ROLES.get(getattr(m, "type", None)) or getattr(m, "role", None) or "user", "content": m.content, **{k: getattr(m, k) for k in ("tool_calls", "tool_call_id", "name") if getattr(m, k, None)}}) for m in messages]
    else:
        raise TypeError(f"messages of type {type(first).__name__} are not known")
    return [{"pos": i, **m} for i, m in enumerate(found)]


def from_python(spark: SparkSession, conversations: list[list]) -> DataFrame:
    """Turns of message lists; conv_id is the list's place."""
    rows = [{"conv_id": i, **m} for i, messages in enumerate(conversations) for m in rows_of(messages)]
    names = ["conv_id", "pos", "role", "content", "blocks", "tool_calls_json", "tool_call_id", "name", "raw_json", "has_tool_key", "ts"]
    schema = ", ".join(f"{n} {TURNS[n]}" for n in names)
    return canonical(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema))


def read(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Turns of files: a table of turns, or rows with conv_id and messages, in any format that Spark reads."""
    table = spark.read.format(format).options(**options).load(path)
    kinds = dict(table.dtypes)
    if "messages" not in kinds:
        return from_table(table) if "turn" in kinds else canonical(table)
    kind = kinds["messages"]
    if kind.startswith("array<struct"):
        return from_json(table.withColumn("messages", F.transform("messages", lambda m: F.to_json(m))))
    return from_json(table)
