"""The optional model tier: duplicate removal and summaries by a pluggable backend, one conversation at a time."""

from __future__ import annotations

import json
import re
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

MODES = ("replace_all", "dedupe_only", "summarize_only")
SOURCE = "model_tier"
LEAST_CHARS = 1500
LEAST_TOKENS = 64


class Backend(Protocol):
    """What a model must do; instances are pickled to the executors."""

    def deduplicate(self, turns: list[str]) -> list[int]: ...

    def summarize(self, content: str, max_tokens: int) -> str: ...


class Mock:
    """A deterministic backend: keeps the last of equal texts, and summarises by the first characters."""

    def deduplicate(self, turns: list[str]) -> list[int]:
        return sorted({t: i for i, t in enumerate(turns)}.values())

    def summarize(self, content: str, max_tokens: int) -> str:
        return "Summary: " + content[: 4 * max_tokens]


def keep_indices(reply: str | None, n: int) -> list[int]:
    """The indices that a reply names: a JSON array, else every run of digits; those out of range are left out, and all are kept if none is left."""
    if n <= 1:
        return list(range(max(n, 0)))
    body = (reply or "").strip()
    found: list | None = None
    if body.startswith("["):
        try:
            found = json.loads(body)
        except ValueError:
            found = None
    if not isinstance(found, list):
        found = [int(x) for x in re.findall(r"\d+", body)]
    return sorted({i for i in found if isinstance(i, int) and 0 <= i < n}) or list(range(n))


def numbered(turns: Column, most: int = 800) -> Column:
    """The texts of an array as numbered lines of at most `most` characters each."""

    def line(t: Column, i: Column) -> Column:
        flat = F.regexp_replace(text.strip(t), "\n", " ")
        return F.concat(i.cast("string"), F.lit(": "), F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat))

    return F.array_join(F.transform(turns, line), "\n")


def model_tier(turns: DataFrame, backend: Backend, mode: str = "replace_all", least_chars: int = LEAST_CHARS, max_tokens: int = 2048) -> DataFrame:
    """The turns after the backend's pass. System turns come first and stay; a failing or silent backend leaves the conversation as it is.
    Adds `tier_applied`, `tier_before`, `tier_after` and `tier_warning` to every row."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    rows = turns.withColumn("_own", text.of_turn()).withColumns({"tier_applied": F.lit(False), "tier_before": F.lit(0).cast("bigint"), "tier_after": F.lit(0).cast("bigint"), "tier_warning": F.lit(None).cast("string")})
    schema = rows.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        system, others = pdf[pdf["role"] == "system"], pdf[pdf["role"] != "system"]
        if others.empty:
            return pdf
        warning, after = None, 0
        kept = others
        if mode != "summarize_only":
            try:
                keep = backend.deduplicate(list(others["_own"]))
            except Exception:  # a backend can fail in any way
                keep, warning = [], "deduplicate failed; all turns kept"
            valid = sorted({i for i in keep if type(i) is int and 0 <= i < len(others)}) or list(range(len(others)))
            kept, after = others.iloc[valid], len(valid)

        def done(parts: list[pd.DataFrame], applied: bool) -> pd.DataFrame:
            out = pd.concat(parts, ignore_index=True)
            if applied:
                out["pos"] = range(len(out))
            return out.assign(tier_applied=applied, tier_before=len(others), tier_after=after, tier_warning=warning)

        if mode == "dedupe_only":
            return done([system, kept], True)
        combined = "\n\n".join(f"{r}: {t}" for r, t in zip(kept["role"], kept["_own"], strict=True))
        if 0 < least_chars and len(combined) < least_chars:
            return done([pdf], False)
        try:
            summary = (backend.summarize(combined, max_tokens=max(LEAST_TOKENS, max_tokens)) or "").strip()
        except Exception:
            summary, warning = "", "summarize failed; result without the tier"
        if not summary:
            return done([pdf], False)
        made = pd.DataFrame([{**dict.fromkeys(pdf.columns), "conv_id": pdf.at[0, "conv_id"], "role": "assistant", "content": summary, "compressed": True, "importance": 1.0, "resolved": False, "has_tool_key": False, "source": SOURCE}])
        return done([system, kept, made] if mode == "summarize_only" else [system, made], True)

    return rows.groupBy("conv_id").applyInPandas(run, schema).drop("_own")
