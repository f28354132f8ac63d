"""Token counts by a pluggable counter.

A counter is a function of a text; "chars4" (a quarter of role, line end and text,
rounded up) is a SQL expression, `bpe(path)` counts by a byte-level BPE file given
as ranks, built once per worker.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The public split pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict[str, object] = {}


def encoding(path: str):
    """This process's encoding of the file."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


@dataclass(frozen=True)
class Counter:
    """Counts tokens; without a path by characters, else by the BPE file."""

    path: str | None = None

    def count(self, text: Column) -> Column:
        if self.path is None:
            return F.ceil(F.length(text) / 4.0).cast("bigint")
        path = self.path
        return F.pandas_udf(lambda s: _counts(s, path), "bigint")(text)

    def cut(self, text: Column, most: Column) -> Column:
        """The text's first `most` tokens."""
        if self.path is None:
            return F.substring(text, F.lit(1), (most * 4).cast("int"))
        path = self.path
        return F.pandas_udf(lambda s, n: _cuts(s, n, path), "string")(text, most)


def _counts(texts: pd.Series, path: str) -> pd.Series:
    own = encoding(path)
    return pd.Series([None if t is None else len(own.encode_ordinary(t)) for t in texts], dtype="Int64")


def _cuts(texts: pd.Series, most: pd.Series, path: str) -> pd.Series:
    own = encoding(path)
    return pd.Series([None if t is None or n is None or n != n else own.decode(own.encode_ordinary(t)[: int(n)]) for t, n in zip(texts, most, strict=True)], dtype=object)


def resolve(name: str | None) -> Counter:
    """The counter of a rank file's path (`.tiktoken`), or by characters for None and "chars4". Names of models are refused: their
    vocabularies are files that the caller has, and a count by characters would pass for one by tokens."""
    if name in (None, "", "chars4"):
        return Counter()
    if name.endswith(".tiktoken"):
        return Counter(name)
    raise ValueError(f"no counter for {name!r}; give the path of a .tiktoken rank file, or chars4")
