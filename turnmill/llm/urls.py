"""URL filter lists as sorted digest arrays.

A list's entries (host and path prefix, such as `example.org/en/1`) are hashed
with 64-bit xxhash; the digests stand sorted in a file beside the entries' full
strings. Each worker maps one such file in memory, once, probes with numpy's
binary search, and confirms every digest hit against the full string, so a
collision cannot decide.

Lists up to MAX_LIST_BYTES are broadcast as that file. Larger lists are joined
by digest (`judge_joined`), with the same results. A column that has the name of
an added one is replaced.

Cases: a null url, or one without `://`, has empty host and path and fits no
entry; of several fitting entries the longest wins, then the first in order.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks

MAX_LIST_BYTES = 64 << 20

HOST = r"^(?s).*?://([^/?#]*)"
PATH = r"^(?s).*?://[^/?#]*([^?#]*)"


_mapped: dict[str, DigestArray] = {}


class DigestArray:
    """Digests in ascending order with the strings they stand for; built as bytes, opened from a mapped file."""

    def __init__(self, buffer: np.ndarray):
        n = struct.unpack("<Q", buffer[:8].tobytes())[0]
        self.digests = buffer[8 : 8 + 8 * n].view(np.uint64)
        self.offsets = buffer[8 + 8 * n : 16 + 16 * n].view(np.uint64)
        self.text = buffer[16 + 16 * n :]

    @staticmethod
    def build(entries: Iterable[str]) -> bytes:
        rows = sorted({(xxhash.xxh64_intdigest(e.encode()), e.encode()) for e in entries})
        ends = np.cumsum([0] + [len(e) for _, e in rows], dtype=np.uint64)
        return struct.pack("<Q", len(rows)) + np.array([d for d, _ in rows], np.uint64).tobytes() + ends.tobytes() + b"".join(e for _, e in rows)

    @classmethod
    def mapped(cls, name: str, content: bytes) -> DigestArray:
        """This process's mapping of the file of that name, which is in no folder."""
        if name not in _mapped:
            file = os.fdopen(os.memfd_create("digests"), "w+b")
            file.write(content)
            file.flush()
            _mapped.clear()
            _mapped[name] = cls(np.memmap(file, np.uint8, "r"))
        return _mapped[name]

    def entry(self, k: int) -> bytes:
        return self.text[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes()

    def contains(self, candidates: list[str]) -> np.ndarray:
        """Whether each candidate is an entry: binary search of all digests at once, then comparison of full strings."""
        raw = [c.encode() for c in candidates]
        digests = np.fromiter((xxhash.xxh64_intdigest(r) for r in raw), np.uint64, len(raw))
        at, to = np.searchsorted(self.digests, digests, "left"), np.searchsorted(self.digests, digests, "right")
        found = at < to
        for i in np.flatnonzero(found):
            found[i] = any(self.entry(k) == raw[i] for k in range(at[i], to[i]))
        return found


def with_parts(frame: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    text = F.coalesce(F.col(url), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return frame.withColumns({"host": F.translate(F.regexp_extract(text, HOST, 1), upper, lower), "path": F.regexp_extract(text, PATH, 1)})


def candidates(host: str, path: str, sizes: list[int]) -> list[str]:
    """The entries that would fit: the host and its parents, each with the path's prefixes of the given sizes; longest first."""
    labels = host.split(".") if host else []
    hosts = [".".join(labels[k:]) for k in range(len(labels))]
    paths = [path[:k] for k in sizes if k <= len(path)]
    return sorted((h + p for h in hosts if h for p in paths), key=lambda x: (-len(x), x))


def _sizes(entries: Iterable[str]) -> list[int]:
    return sorted({len(e) - e.index("/") for e in entries}, reverse=True)


def _judge(content, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray.mapped(*content.value)
        for batch in batches:
            owner: list[int] = []
            tried: list[str] = []
            for i, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                own = candidates(host, path, sizes)
                owner += [i] * len(own)
                tried += own
            fits: list[str | None] = [None] * len(batch)
            if tried:
                for k in np.flatnonzero(array.contains(tried)):
                    if fits[owner[k]] is None:
                        fits[owner[k]] = tried[k]
            yield batch.append_column("entry", pa.array(fits, pa.string()))

    return run


def judge(frame: DataFrame, entries: list[str], max_list_bytes: int = MAX_LIST_BYTES) -> DataFrame:
    """Adds `entry`, the longest fitting list entry or null, to rows with host and path."""
    content = DigestArray.build(entries)
    if len(content) > max_list_bytes:
        return judge_joined(frame, frame.sparkSession.createDataFrame([(e,) for e in entries], "entry string"))
    frame = frame.drop("entry")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema) + ", entry string"
    named = xxhash.xxh3_128_hexdigest(content), content
    return frame.mapInArrow(_judge(frame.sparkSession.sparkContext.broadcast(named), _sizes(entries)), schema)


def judge_joined(frame: DataFrame, entries: DataFrame) -> DataFrame:
    """As `judge`, for a list of any size: candidates are joined to the list by digest and confirmed by the full string."""
    sizes = [r[0] for r in entries.select(F.expr("length(entry) - instr(entry, '/') + 1").alias("n")).distinct().collect()]
    frame = frame.drop("entry")
    number = blocks.unused(frame.columns, "row")
    rows = frame.withColumn(number, F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    paths = F.transform(F.filter(F.array(*[F.lit(n) for n in sizes or [0]]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    tried = rows.select(F.col(number).alias("row"), F.explode(F.filter(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.when(h != "", F.concat(h, p))))), lambda x: x.isNotNull())).alias("tried")).withColumn("digest", F.xxhash64("tried"))
    hits = tried.join(entries.select("entry", F.xxhash64("entry").alias("digest")), "digest").filter("tried = entry")
    first = Window.partitionBy("row").orderBy(F.length("entry").desc(), "entry")
    best = hits.withColumn("rank", F.row_number().over(first)).filter("rank = 1").select(F.col("row").alias(number), "entry")
    return rows.join(best, number, "left").drop(number)
