"""Arrow string columns as flat byte arrays, and vectorised words and hashes over them.

Whole columns are handled as one byte buffer with row offsets; work proceeds in
slices of whole rows of about SLICE_BYTES, so memory is bounded by that and by
the longest single row.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: Rows that a Python worker gets at once from tables that are stored; texts can be long.
BATCH_ROWS = 2048
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Off, equal code of different stages is one class, so loops and rounds do not fill the driver with classes.
_CLASS_IDS = "spark.sql.codegen.useIdInClassName"
#: After each so many stored tables the executors collect their garbage.
COLLECT = 8
_tables = itertools.count(1)

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim(0)
except (OSError, AttributeError):  # another C library
    _libc = None

#: The separators of words: space and \t \n \v \f \r.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Longer ranges are hashed one by one.
LONG_RANGE = 64


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the rows' offsets in them; a null row is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of successive groups of whole rows, of about `limit` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    release()


def release() -> None:
    """Gives memory that was freed back to the system; workers live on after a task, and their executor's memory is one budget."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE, kinds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-separators within each row, and each row's bounds in that list. With kinds, a run is
    also cut between bytes of kinds 1 and 2."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if kinds is not None:
        kind = kinds[data]
        edge[1:-1] |= (kind[1:] | kind[:-1]) == 3
    before = edge[:-1].copy()
    before[1:] |= ~inside[:-1]
    after = edge[1:].copy()
    after[:-1] |= ~inside[1:]
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range. Ranges of up to 7 bytes never collide with one another: bytes and length are one number, scrambled
    by a bijection. Longer ones are scrambled again after each 8 bytes, those beyond LONG_RANGE by xxhash."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    at = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    shift = np.clip(8 - size, 0, 7).astype(np.uint64) << np.uint64(3)
    first = at[starts] << shift >> shift
    value = mix(np.where(size < 8, first | size.astype(np.uint64) << np.uint64(56), first ^ np.uint64(0xD6E8FEB86659FD93)))
    value[size == 0] = mix(np.zeros(1, np.uint64))[0]
    live = np.flatnonzero((size >= 8) & (size <= LONG_RANGE))
    for done in range(8, LONG_RANGE, 8):
        live = live[size[live] > done]
        if not len(live):
            break
        left = np.clip(8 - (size[live] - done), 0, 7).astype(np.uint64) << np.uint64(3)
        value[live] = mix((value[live] * np.uint64(0x9E3779B97F4A7C15)) ^ (at[starts[live] + done] << left >> left))
    several = np.flatnonzero((size >= 8) & (size <= LONG_RANGE))
    value[several] = mix(value[several] + size[several].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(size > LONG_RANGE):
        value[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return value


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' code points and their offsets in code points."""
    first = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=first[1:])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), first[offsets]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of all ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def unused(columns: list[str], name: str) -> str:
    """The name, or one like it that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def helpers(*names: str):
    """For functions from frame to frame that add the named columns and drop them: columns of the frame with these names are out of the
    way meanwhile."""

    def around(run):
        @functools.wraps(run)
        def safe(frame, *args, **kwargs):
            taken = [c for c in frame.columns if c.lower() in names]
            aside = {c: unused([*frame.columns, *names], f"aside_{c}") for c in taken}
            moved = lambda x: aside.get(x, x) if isinstance(x, str) else x
            out = run(frame.withColumnsRenamed(aside), *map(moved, args), **{k: moved(v) for k, v in kwargs.items()})
            return out.withColumnsRenamed({v: k for k, v in aside.items()})

        return safe

    return around


def shared(spark) -> str:
    """A new folder below the shared checkpoint folder; without one, only a session on a local master has a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/turnmill-{uuid.uuid4().hex}"


def stored(spark, frame, codec: str = "zstd", batch: int = BATCH_ROWS, size: int | None = None):
    """The frame written as Parquet below the shared folder and read again: lineage ends there, and a lost executor costs no
    recomputation. Python gets `batch` rows at a time, fewer once they are of `size` bytes. The driver's garbage is collected, which frees the shuffle files of plans that
    are done with."""
    path = shared(spark)
    own = {_BATCH: str(batch), _CLASS_IDS: "false"} | ({} if size is None else {_BYTES: str(size)})
    old = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        frame.write.option("compression", codec).parquet(path)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(frame.schema).parquet(path)
    out.stored_at = path
    gc.collect()
    release()
    spark.sparkContext._jvm.System.gc()
    if next(_tables) % COLLECT == 0:
        collect(spark)
    return out


def collect(spark) -> None:
    """The executors collect their garbage, after which their JVMs give free heap back to the system; else a heap stays as large as it
    ever was, beside the Python workers' memory in one budget. One short task a core reaches every executor as a rule. On a local
    master the driver is the executor."""
    context = spark.sparkContext
    if context._jsc.sc().isLocal():
        context._jvm.System.gc()
    else:
        executors_collect(spark, context.defaultParallelism)


def executors_collect(spark, tasks: int) -> None:
    spark.range(0, tasks, 1, tasks).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def drop(*frames) -> None:
    """Deletes tables of `stored` that nothing reads any more."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
