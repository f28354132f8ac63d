"""JSON and fence compaction as Arrow-batched UDFs, in which null stays null: key order, number forms and repeated keys must come out as `json` has them, which
the SQL functions' variant type does not give."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

FENCE = re.compile(r"(```[\s\S]*?```)")
JSON_TAGS = ("", "json", "jsonc")
LINES_FROM, SPACES_FROM, STRIP_FROM = 0.35, 0.55, 0.75


def minified(text: str) -> str | None:
    """The text as compact JSON, or None if it is not an object or array."""
    body = text.strip()
    if body[:1] not in ("{", "["):
        return None
    try:
        out = json.dumps(json.loads(body), separators=(",", ":"), ensure_ascii=False)
        out.encode()  # half of a surrogate pair cannot be stored
        return out
    except (ValueError, RecursionError):
        return None


def fence_minified(part: str) -> str:
    """A whole fence whose first tag word is one of JSON_TAGS, with its JSON compact."""
    if len(part) < 6 or not part.endswith("```"):
        return part
    tag, line, body = part[3:-3].partition("\n")
    if not line or (tag.split() or [""])[0].lower() not in JSON_TAGS:
        return part
    compact = minified(body.removesuffix("\n"))
    return part if compact is None else f"```{tag}\n{compact}\n```"


def plain_compacted(text: str, strength: float) -> str:
    out = re.sub(r"\n{3,}", "\n\n", text)
    if strength >= LINES_FROM:
        lines = out.splitlines()
        if len(lines) > 1:
            out = "\n".join(x for x, before in zip(lines, [None, *lines], strict=False) if x != before or not x.strip())
    if strength >= SPACES_FROM:
        out = re.sub(r"[ \t]{2,}", " ", out)
    return out.strip() if strength >= STRIP_FROM else out


def compacted(text: str, strength: float) -> str:
    """Whole JSON texts compact; else fences by their tag, and the prose between them squeezed as far as the strength says."""
    if not text.strip():
        return text
    whole = minified(text)
    if whole is not None:
        return whole
    out = []
    for part in FENCE.split(text):
        if part.startswith("```"):
            out.append(fence_minified(part))
        else:
            compact = minified(part)
            out.append(plain_compacted(part, strength) if compact is None else compact)
    return "".join(out)


def _udf(f, kind: str):
    def run(column: pd.Series) -> pd.Series:
        return column.map(f, na_action="ignore")

    return F.pandas_udf(run, kind)


def compact(strength: float):
    """UDF: the compacted text."""
    return _udf(lambda x: compacted(x, strength), "string")


def minify():
    """UDF: compact JSON, or the text itself."""
    return _udf(lambda x: x if (m := minified(x)) is None else m, "string")


def minify_fence():
    """UDF for one fence."""
    return _udf(lambda x: fence_minified(x) if x.startswith("```") else x, "string")


def is_json():
    """UDF: an object or array as a whole."""
    return _udf(lambda x: minified(x) is not None, "boolean")


def _arguments(calls_json: str) -> str:
    try:
        calls = json.loads(calls_json)
    except ValueError:
        return calls_json
    if not isinstance(calls, list):
        return calls_json
    changed = False
    for call in calls:
        function = call.get("function") if isinstance(call, dict) else None
        if isinstance(function, dict) and isinstance(function.get("arguments"), str):
            compact_ = minified(function["arguments"])
            if compact_ is not None and compact_ != function["arguments"]:
                function["arguments"], changed = compact_, True
    return json.dumps(calls, ensure_ascii=False) if changed else calls_json


def minify_arguments():
    """UDF: a tool_calls array with each call's JSON arguments compact; unchanged otherwise."""
    return _udf(_arguments, "string")


def _ids(calls_json: str) -> list[str]:
    try:
        calls = json.loads(calls_json)
    except ValueError:
        return []
    return list(dict.fromkeys(str(c["id"]) for c in calls if isinstance(c, dict) and c.get("id") is not None)) if isinstance(calls, list) else []


def call_ids():
    """UDF: the ids of a tool_calls array, in order."""
    return _udf(_ids, "array<string>")


def _payload(calls_json: str) -> str:
    try:
        calls = json.loads(calls_json)
    except ValueError:
        return ""
    return json.dumps(calls, ensure_ascii=False) if isinstance(calls, list) and calls else ""


def call_payload():
    """UDF: the tool_calls array as it is counted in tokens; empty if it is no array or empty."""
    return _udf(_payload, "string")
