"""Exact Jaccard join of documents' five-word shingle sets, by set-relation skipping.

Equal sets are one class, joined once. Shingles have one order for all sets: by
the count of their slot in a table of all shingles' counts, then by hash, so
rare ones come first. Similar sets share a shingle of their prefixes in that
order, so only prefixes go into the index lists; a shingle that is alone in its
slot is in no other set and goes into none.

Lists are answered in steps.

1. In each list every set is set against the list's pivot, first within each
   task's documents, then among the tasks' pivots; a set is compared with the
   pivot that most of its lists name. The links found connect nearly all sets
   of a group of copies at a cost in proportion to their number. In long lists
   that are not yet in one component, the same is done again with pivots of
   several random orders.
2. In a list whose sets are not yet in one component, the sets outside its
   largest component are compared with the others. The list is cut into blocks
   by set size with each block's most remaining positions, so blocks that cannot
   reach the needed overlap are skipped whole; pairs are skipped by position, by
   the number of lists they share, and by what the answers for a common pivot
   imply: sets a and b with overlaps x and y with the same pivot share at most
   min(x, y) + min(|a| - x, |b| - y).

   Of the pairs that remain, a set with a similar pivot has its answer derived:
   the pivot's overlap with the other set, plus what only the set shares with
   it, less what only the pivot does. Just the pivot's answer, which all its
   followers use, and pairs without a pivot are computed from whole sets.

Every pair of similar sets is compared, or lies in one component already, so
the components are exact.

Words: A-Z lower-cased, runs of bytes other than 0x20 and 0x09-0x0D. Cases: fewer
than five words make one shingle; no words or a null text make the empty set,
linked with nothing; equal rows are in one component; a null id is never a
component's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, slots
from .components import components

WORDS = 5
#: Similar: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles are gathered up to these numbers before a task indexes or counts them.
GATHER = 1_000_000
COUNTED = 2_000_000
#: Counts are taken for 2^FINE slots in 2^RANGES ranges, and used for as many slots as there are shingles, 2^FINE at most: one byte
#: each, so at most 64 MB are broadcast.
FINE = 26
RANGES = 6
#: Each set in lists of at least LONG sets meets the pivots of ORDERS orders in LISTS of its lists, ROUNDS times, before pairs are
#: looked at.
LONG = 64
ORDERS = 16
LISTS = 3
ROUNDS = 2
#: The filter of wanted names has 16 bits a name, within these powers of two.
FILTER_BITS = (20, 27)
#: Pairs with both their sets that a task holds at once; a set can have a hundred kilobytes and stand in many pairs.
PAIRS = 64
#: A list is met in blocks of about this many sets, with these columns of each.
BLOCK = 512
MEMBER = ("name", "n", "place", "rank", "component", "weight", "cap", "far")

_FACTORS = np.random.default_rng(20240202).integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    for _, _, data, offsets in blocks.slices(*blocks.flat(column)):
        data = blocks.LOWER[data]
        starts, ends, bounds = blocks.words(data, offsets)
        word = blocks.hashes(data, starts, ends)
        n = max(len(word) - WORDS + 1, 0)
        windows = np.zeros(n, np.uint64)
        for k in range(WORDS):
            windows += word[k : k + n] * _FACTORS[k]
        windows = blocks.mix(windows)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= WORDS:
                own = np.sort(windows[a : b - WORDS + 1])
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield own[keep]
            elif b > a:
                yield blocks.mix((word[a:b] * _FACTORS[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield windows[:0]


def digest(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(blocks.mix(np.array([blocks.mix(shingles + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)]) + np.uint64(len(shingles))).view(np.int64)[0])


NAMES = "doc_id long, key long, n long, name long, range int, part long, packed binary"


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of NAMES: (doc_id, key, n, name) of documents; (range, part, packed) of the slots of the sets' shingles here."""
    names_of = [c.split()[0] for c in NAMES.split(", ")]
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size, part = 0, TaskContext.get().partitionId() << 24

    def counted() -> pa.RecordBatch:
        parts = slots.ranges(np.concatenate([(own >> np.uint64(64 - FINE)).astype(np.uint32) for own in held]), FINE, RANGES)
        none = [pa.nulls(len(parts), pa.int64())] * 4
        return pa.RecordBatch.from_arrays([*none, pa.array([k for k, _ in parts], pa.int32()), pa.array([part] * len(parts), pa.int64()), pa.array([x for _, x in parts], pa.binary())], names_of)

    for batch in batches:
        sizes, names = [], []
        for own in shingle_sets(batch.column(1)):
            name = digest(own) if len(own) else None
            sizes.append(len(own))
            names.append(name)
            if name is not None and name not in seen:
                seen.add(name)
                held.append(own)
                size += len(own)
                if size >= COUNTED:
                    yield counted()
                    held, size, part = [], 0, part + 1
                    seen.clear()
        none = [pa.nulls(len(batch), t) for t in (pa.int32(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), *none], names_of)
    if held:
        yield counted()
    held = []
    blocks.release()


def _weights(bits: int):
    """(range, weights) of the counts in 2^bits slots: one byte a slot, counts to 15, then an eighth of a doubling a step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(zstandard.decompress(value.as_py()), np.uint64).reshape(-1, 1 << FINE - bits).sum(1)
                high = 15 + np.floor(8 * np.log2(np.maximum(counts, 16) / 16.0)).astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.where(counts < 16, counts, np.minimum(high, 255)).astype(np.uint8).tobytes()], pa.binary())], ["range", "weights"])

    return run


def prefix_length(n):
    return n - (PERCENT * n + 99) // 100 + 1


def prefix_length_of(n: str):
    return F.col(n) - F.floor((PERCENT * F.col(n) + 99) / 100) + 1


def _pivots(shingle: np.ndarray, name: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """For rows sorted by (shingle, name): the first row of each list, each row's list, and rows in lists of two or more."""
    first = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]])) if len(shingle) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(shingle)))
    return first, np.repeat(np.arange(len(first)), length), np.repeat(length > 1, length)


def _votes(shingle, name, size, place) -> tuple[np.ndarray, ...]:
    """(set, pivot, lists, the set's size) over rows sorted by (shingle, name); pairs that size or position rule out get no vote."""
    first, own, several = _pivots(shingle, name, size, place)
    pivot = first[own]
    rows = np.flatnonzero(several & (np.arange(len(name)) != pivot))
    at = pivot[rows]
    total = size[rows].astype(np.int64) + size[at]
    most = np.minimum(size[rows] - place[rows], size[at] - place[at])
    can = (100 + PERCENT) * most.astype(np.int64) >= PERCENT * total
    rows, at = rows[can], at[can]
    if not len(rows):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    order = np.lexsort((name[at], name[rows]))
    x, p, n = name[rows][order], name[at][order], size[rows][order]
    new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (p[1:] != p[:-1])]))
    return x[new], p[new], np.diff(np.append(new, len(x))), n[new].astype(np.int64)


INDEX = "kind int, bucket int, packed binary, shingle long, name long, other long, n long, place long"
_INDEX = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("packed", pa.binary()), ("shingle", pa.int64()), ("name", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("place", pa.int64())])


def _rows(kind: int, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    arrays = [pa.array(np.full(n, kind, np.int32)) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _INDEX]
    return pa.RecordBatch.from_arrays(arrays, schema=_INDEX)


def _list_rows(shingle, name, size, place, several) -> pa.RecordBatch:
    """Kind 1: members of lists of two or more."""
    return _rows(1, shingle=shingle[several], name=name[several], n=size[several].astype(np.int64), place=place[several].astype(np.int64))


def _index(weights, buckets: int):
    """Rows of INDEX from documents: kind 0, packed rows for the buckets of shingles; kind 1, members of lists that have several sets
    here; kind 2, votes (name, other: its pivot, n: lists, place: the set's size). Only a list's pivot here goes on to the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight_of, shift = weights.value
        shift = np.uint64(shift)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(s) for s, *_ in held])
            shingle = np.concatenate([s for s, *_ in held]).view(np.int64)
            name, n, alone = (np.repeat(np.array([h[k] for h in held], np.int64), lengths) for k in (1, 2, 3))
            n = n.astype(np.int32)
            place = (np.arange(len(shingle)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + alone).astype(np.int32)
            order = np.lexsort((name, shingle))
            shingle, name, n, place = shingle[order], name[order], n[order], place[order]
            first, _, several = _pivots(shingle, name, n, place)
            if several.any():
                yield _list_rows(shingle, name, n, place, several)
                x, p, votes, sizes = _votes(shingle, name, n, place)
                if len(x):
                    yield _rows(2, name=x, other=p, n=votes, place=sizes)
            shingle, name, n, place = shingle[first], name[first], n[first], place[first]
            several = several[first]
            bucket = ((shingle.view(np.uint64) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out, which = [], []
            for k in np.flatnonzero(np.diff(edges)):
                at = order[edges[k] : edges[k + 1]]
                out.append(pack_rows(shingle[at], name[at], n[at], place[at], several[at]))
                which.append(k)
            yield _rows(0, bucket=np.array(which, np.int32), packed=out)

        for batch in batches:
            for own in shingle_sets(batch.column(1)):
                if not len(own):
                    continue
                name = digest(own)
                if name in seen:
                    continue
                seen.add(name)
                weight = weight_of[(own >> shift).astype(np.int64)]
                # own is in order of its hashes, so a stable sort by weight gives the order of all sets.
                order = np.argsort(weight, kind="stable")[: prefix_length(len(own))]
                alone = int(np.searchsorted(weight[order], 2))
                held.append((own[order[alone:]], name, len(own), alone))
                size += len(order) - alone
                if size >= GATHER // 2:
                    yield from flush()
                    held, size = [], 0
                    seen.clear()
        if held:
            yield from flush()
        held = []
        blocks.release()

    return run


def pack_rows(shingle, name, n, place, several) -> bytes:
    """Rows in order of their shingles as compressed columns; sets are numbered within the rows."""
    sets, number = np.unique(name, return_inverse=True)
    sizes = np.zeros(len(sets), np.int32)
    sizes[number] = n
    parts = (np.array([len(shingle), len(sets)], np.int64), np.diff(shingle, prepend=np.int64(0)), sets, sizes, number.astype(np.int32), place.astype(np.int32), several.astype(np.int8))
    return zstandard.compress(b"".join(p.tobytes() for p in parts), 1)


def unpack_rows(packed: bytes) -> tuple[np.ndarray, ...]:
    raw = zstandard.decompress(packed)
    rows, sets = np.frombuffer(raw, np.int64, 2).tolist()
    at, out = 16, []
    for kind, count in ((np.int64, rows), (np.int64, sets), (np.int32, sets), (np.int32, rows), (np.int32, rows), (np.int8, rows)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += count * np.dtype(kind).itemsize
    shingle, names, sizes, number, place, several = out
    with np.errstate(over="ignore"):
        return np.cumsum(shingle), names[number], sizes[number], place, several.astype(bool)


def _meet(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: members of lists that several tasks share, and votes among the tasks' pivots."""
    parts = [unpack_rows(p.as_py()) for batch in tables for p in batch.column("packed")]
    shingle, name, n, place, several = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((name, shingle))
    shingle, name, n, place, several = shingle[order], name[order], n[order], place[order], several[order]
    # One set can come from several tasks.
    new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (name[1:] != name[:-1])])
    shingle, name, n, place = shingle[new], name[new], n[new], place[new]
    _, _, many = _pivots(shingle, name, n, place)
    if many.any():
        yield _list_rows(shingle, name, n, place, many)
        x, p, votes, sizes = _votes(shingle, name, n, place)
        if len(x):
            yield _rows(2, name=x, other=p, n=votes, place=sizes)


def _fetch(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, width = wanted.value
        seen: set[int] = set()
        for batch in batches:
            names, sets = [], []
            for own in shingle_sets(batch.column(1)):
                if not len(own):
                    continue
                name = digest(own)
                slot = name & (1 << width) - 1
                if name in seen or not int(bits[slot >> 6]) >> (slot & 63) & 1:
                    continue
                seen.add(name)
                names.append(name)
                sets.append(own.tobytes())
                if len(names) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["name", "set"])
                    names, sets = [], []
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["name", "set"])
            if len(seen) > GATHER:
                seen.clear()

    return run


def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which elements of the sorted set x are in the sorted set y."""
    if not len(y):
        return np.zeros(len(x), bool)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return y[at] == x


OVERLAPS = "a long, b long, na long, nb long, overlap long, plus binary, minus binary"


def _overlaps(differences: bool):
    """Rows of OVERLAPS of pairs with both sets; for similar ones, if wanted, the elements that only a has and those that only b has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            rows = []
            for i in range(len(batch)):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                n = int(np.count_nonzero(common(x, y) if len(x) <= len(y) else common(y, x)))
                similar = differences and 100 * n >= PERCENT * (len(x) + len(y) - n)
                rows.append((len(x), len(y), n, x[~common(x, y)].tobytes() if similar else None, y[~common(y, x)].tobytes() if similar else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())))], [c.split()[0] for c in OVERLAPS.split(", ")])
        blocks.release()

    return run


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows of a set in a list with a block of the list: (name, n, the block's sets that can be similar to it, their sizes)."""
    wide = len(MEMBER)
    for batch in batches:
        own, reach = (batch.column(wide + k).to_numpy().astype(np.int64) for k in range(2))
        lists = batch.column(wide + 2)
        bounds = lists.offsets.to_numpy()
        length = np.diff(bounds)
        values = lists.flatten()
        y = {c: values.field(c).to_numpy().astype(np.int64) for c in MEMBER}
        x = {c: np.repeat(batch.column(k).to_numpy().astype(np.int64), length) for k, c in enumerate(MEMBER)}
        own, reach = (np.repeat(v, length) for v in (own, reach))
        # One of two similar sets must reach the other's band.
        once = (x["weight"] < y["weight"]) | (x["weight"] == y["weight"]) & (x["component"] < y["component"])
        once &= (x["far"] >= reach) | (y["far"] >= own)
        shared = np.minimum(x["rank"], y["rank"]) + np.minimum(x["n"] - x["place"], y["n"] - y["place"])
        most = np.minimum(shared, np.maximum(x["cap"], y["cap"]))
        fits = 100 * np.minimum(x["n"], y["n"]) >= PERCENT * np.maximum(x["n"], y["n"])
        good = once & fits & ((100 + PERCENT) * most >= PERCENT * (x["n"] + y["n"]))
        number = np.add.reduceat(np.append(good, False).astype(np.int64), bounds[:-1] - bounds[0]) * (length > 0) if len(length) else length
        some = np.flatnonzero(number)
        if len(some):
            edges = np.concatenate([[0], np.cumsum(number[some])]).astype(np.int32)
            names = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(edges * 8), pa.py_buffer(np.ascontiguousarray(y["name"][good]))])
            sizes = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(edges * 4), pa.py_buffer(y["n"][good].astype(np.int32))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), batch.column(1).take(pa.array(some)), names, sizes], ["name", "n", "partners", "sizes"])
    blocks.release()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, total size) of the pairs that share enough lists, from rows of `_partners` in order of their names. All lists that two
    sets share are there, so their number is that of common shingles in both prefixes; the other common ones come after the prefix
    that ends first. What is held is one batch and the last set's partners with their counts."""
    held = [np.zeros(0, np.int64) for _ in range(5)]  # name, n, partner, its size, lists

    def pairs(part: list[np.ndarray]) -> pa.RecordBatch:
        name, n, other, size, lists = part
        beyond = (PERCENT * np.maximum(n, size) + 99) // 100 - 1
        good = (100 + PERCENT) * (lists + beyond) >= PERCENT * (n + size)
        a, b = np.minimum(name, other)[good], np.maximum(name, other)[good]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array((n + size)[good])], ["a", "b", "total"])

    for batch in batches:
        count = np.diff(np.frombuffer(batch.column(2).buffers()[1], np.int32)[batch.column(2).offset :][: len(batch) + 1]) // 8
        other = np.frombuffer(b"".join(x.as_py() for x in batch.column(2)), np.int64)
        size = np.frombuffer(b"".join(x.as_py() for x in batch.column(3)), np.int32).astype(np.int64)
        part = [np.repeat(batch.column(0).to_numpy(), count), np.repeat(batch.column(1).to_numpy(), count), other, size, np.ones(len(other), np.int64)]
        part = [np.concatenate(x) for x in zip(held, part, strict=True)]
        order = np.lexsort((part[2], part[0]))
        part = [x[order] for x in part]
        if not len(part[0]):
            continue
        first = np.flatnonzero(np.concatenate([[True], (part[0][1:] != part[0][:-1]) | (part[2][1:] != part[2][:-1])]))
        part = [x[first] for x in part[:4]] + [np.add.reduceat(part[4], first)]
        last = part[0] == batch.column(0)[len(batch) - 1].as_py()
        held = [x[last] for x in part]
        yield pairs([x[~last] for x in part])
    if len(held[0]):
        yield pairs(held)
    blocks.release()


def derived_overlap(with_pivot: int, other: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> int:
    """The overlap of a set with another from its pivot's: plus holds what only the set has, minus what only the pivot has."""
    return with_pivot + int(np.count_nonzero(common(plus, other))) - int(np.count_nonzero(common(minus, other)))


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, na, nb, overlap) from (a, b, na, nb, the pivot's overlap with b, plus, minus, b's set)."""
    for batch in batches:
        before = batch.column(4).to_pylist()
        plus, minus, other = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(k)] for k in (5, 6, 7))
        n = [derived_overlap(o, y, p, m) for o, y, p, m in zip(before, other, plus, minus, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64())], ["a", "b", "na", "nb", "overlap"])
    blocks.release()


class Join:
    """The join of a table of texts with itself."""

    def __init__(self, frame: DataFrame, id_column: str = "doc_id", column: str = "text"):
        self.spark = frame.sparkSession
        self.texts = frame.select(F.col(id_column).cast("long").alias("doc_id"), F.col(column).cast("string").alias("text"), F.xxhash64(column).alias("key"))

    def keep(self, frame: DataFrame) -> DataFrame:
        return blocks.stored(self.spark, frame)

    def weights(self, made: DataFrame, total: int):
        """The slots' weights and the shift that gives a shingle's slot."""
        bits = min(max(total.bit_length() - 1, RANGES), FINE)
        counts = slots.counts(made.filter("packed is not null"), total, FINE - RANGES, _weights(bits), "range int, weights binary")
        ranges = counts.toArrow().to_pylist()
        table = np.zeros(1 << bits, np.uint8)
        width = 1 << bits - RANGES
        for row in ranges:
            table[row["range"] * width : (row["range"] + 1) * width] = np.frombuffer(row["weights"], np.uint8)
        return self.spark.sparkContext.broadcast((table, 64 - bits))

    def fetch(self, names: DataFrame) -> DataFrame:
        """(name, set) of the names. Texts are read again for sets that pass a filter of their names, whose size follows their number up
        to 16 MB; what it lets through falsely finds no name."""
        names = self.keep(names.distinct())
        width = min(max((16 * names.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
        slot = F.col("name").bitwiseAND(F.lit((1 << width) - 1))
        marks = names.select(F.shiftright(slot, 6).alias("at"), F.expr("shiftleft(1L, cast(name & 63 as int))").alias("mark")).groupBy("at").agg(F.bit_or("mark").alias("mark")).toArrow()
        bits = np.zeros(1 << width - 6, np.uint64)
        bits[marks.column(0).to_numpy()] = marks.column(1).to_numpy().view(np.uint64)
        found = self.texts.mapInArrow(_fetch(self.spark.sparkContext.broadcast((bits, width))), "name long, set binary")
        out = self.keep(found.join(names, "name", "left_semi").groupBy("name").agg(F.first("set").alias("set")))
        blocks.drop(names)
        return out

    def in_parts(self, frame: DataFrame, run, schema: str) -> DataFrame:
        """mapInArrow over PAIRS rows at a time, stored."""
        return blocks.stored(self.spark, frame.mapInArrow(run, schema), batch=PAIRS)

    def compare(self, pairs: DataFrame, sets: DataFrame, differences: bool = False) -> DataFrame:
        """Rows of OVERLAPS of the pairs (a, b), from the whole sets."""
        both = pairs.join(sets.withColumnsRenamed({"name": "a", "set": "sa"}), "a").join(sets.withColumnsRenamed({"name": "b", "set": "sb"}), "b")
        return self.in_parts(both.select("a", "b", "sa", "sb"), _overlaps(differences), OVERLAPS)

    def verify(self, pairs: DataFrame, differences: bool = False) -> DataFrame:
        """As `compare`, with the sets of just these pairs."""
        sets = self.fetch(pairs.select(F.col("a").alias("name")).union(pairs.select("b")))
        out = self.compare(pairs, sets, differences)
        blocks.drop(sets)
        return out

    def derive(self, pairs: DataFrame, answers: DataFrame) -> DataFrame:
        """(a, b, na, nb, overlap) of the pairs. A set with a similar pivot takes the pivot's answer, which is computed once from whole
        sets for all of the pivot's followers, and adds and takes off what differs; other pairs are compared as whole sets."""
        near = answers.filter("plus is not null").select(F.col("a").alias("x"), F.col("b").alias("p"), F.col("na").alias("nx"), "plus", "minus")
        follows = lambda c, to: near.select(F.col("x").alias(c), F.col("p").alias(to))
        turned = pairs.join(follows("a", "pa"), "a", "left").join(follows("b", "pb"), "b", "left")
        swap = F.col("pa").isNull() & F.col("pb").isNotNull()
        turned = self.keep(turned.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("y"), F.coalesce("pa", "pb").alias("p")))
        whole = turned.select(F.coalesce("p", "x").alias("a"), F.col("y").alias("b")).distinct()
        sets = self.fetch(whole.select(F.col("a").alias("name")).union(whole.select("b")))
        asked = self.compare(whole, sets)
        followed = turned.filter("p is not null").join(asked.select(F.col("a").alias("p"), F.col("b").alias("y"), "nb", "overlap"), ["p", "y"])
        followed = followed.join(near.drop("p"), "x").join(sets.withColumnsRenamed({"name": "y", "set": "sy"}), "y")
        made = self.in_parts(followed.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("nx").alias("na"), "nb", "overlap", "plus", "minus", "sy"), _derived, "a long, b long, na long, nb long, overlap long")
        out = self.keep(made.union(turned.filter("p is null").select(F.col("x").alias("a"), F.col("y").alias("b")).join(asked.drop("plus", "minus"), ["a", "b"])))
        blocks.drop(turned, sets, asked, made)
        return out

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, key, n, name) of every row, and (name, root) of every set that is not empty: sets of one component have one root."""
        made = self.keep(self.texts.mapInArrow(_names, NAMES))
        documents = made.filter("n is not null").select("doc_id", "key", "n", "name")
        total = documents.agg(F.sum("n")).first()[0] or 0
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), total // 4_000_000)
        index = self.keep(self.texts.mapInArrow(_index(self.weights(made, total), buckets), INDEX))
        packed = index.filter("kind = 0").select("bucket", "packed")
        meet = self.keep(packed.groupBy("bucket").applyInArrow(_meet_group, INDEX))
        rows = index.filter("kind > 0").drop("packed").union(meet.drop("packed"))
        lists = rows.filter("kind = 1").select("shingle", "name", "n", "place")
        votes = rows.filter("kind = 2").groupBy("name", "other").agg(F.sum("n").alias("votes"), F.max("place").alias("n"))
        # Two similar sets share about a tenth of their shingles in prefixes; pivots with less than half of that are left to step 2.
        votes = votes.filter(20 * F.col("votes") >= F.col("n"))
        first = votes.groupBy("name").agg(F.max_by("other", F.struct("votes", "other")).alias("b")).select(F.col("name").alias("a"), "b")
        # A prefix shingle without a list is in no other prefix, but it can stand behind another set's prefix. Of two sets, that whose
        # prefix ends first has all its common prefix shingles in the other's prefix too, so it shares at most the rest, its `cap`;
        # which one that is stays open, so a pair shares at most the greater cap of the two.
        # `rank` is the number of a set's shingles with lists before this one. Those without, if they come before a shingle of both sets'
        # prefixes, are not in the other set at all.
        by = Window.partitionBy("name")
        lists = lists.distinct().withColumns({"rank": F.row_number().over(by.orderBy("place")).cast("long") - 1, "cap": F.col("n") - (prefix_length_of("n") - F.count("*").over(by))})
        first, lists = self.keep(first), self.keep(lists)
        blocks.drop(index, meet)
        answers = self.verify(first, differences=True)
        linked = 100 * F.col("overlap") >= PERCENT * (F.col("na") + F.col("nb") - F.col("overlap"))
        labels = self.keep(components(answers.filter(linked)))
        long = self.keep(lists.join(lists.groupBy("shingle").agg(F.count("*").alias("members")).filter(F.col("members") >= LONG).select("shingle"), "shingle", "left_semi"))
        sets = self.fetch(long.select("name"))
        for k in range(ROUNDS):
            labels = self.joined(labels, self.compare(self.pivoted(long, labels, k), sets).filter(linked))
        blocks.drop(long, sets)
        found = self.rest(lists, labels, answers)
        more = self.derive(found, answers)
        labels = self.joined(labels, more.filter(linked))
        group = lambda t, c, to: t.join(labels.select(F.col("node").alias(c), F.col("component").alias(to)), c, "left").withColumn(to, F.coalesce(to, c))
        out = self.keep(group(documents.filter("name is not null").select("name").distinct(), "name", "root"))
        blocks.drop(lists, first, answers, found, more)
        return documents, out

    def run(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        documents, sets = self.classes()
        least = documents.filter("name is not null").groupBy("name").agg(F.min("doc_id").alias("least")).join(sets, "name")
        roots = least.groupBy("root").agg(F.min("least").alias("component_id"))
        named = sets.join(roots, "root").select("name", "component_id")
        return documents.join(named, "name", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

    def survivors(self) -> DataFrame:
        """(doc_id, key, copies) of one row of each component, the first by (doc_id, key) with nulls last; copies: its equal rows."""
        documents, sets = self.classes()
        rows = documents.filter("name is not null").groupBy("name", "doc_id", "key").agg(F.count("*").alias("copies"))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "copies")
        first = rows.groupBy("name").agg(F.min(order).alias("first")).join(sets, "name").groupBy("root").agg(F.min("first").alias("first"))
        return first.select("first.doc_id", "first.key", "first.copies")

    def joined(self, labels: DataFrame, links: DataFrame) -> DataFrame:
        """The labels (node, component) after more links (a, b)."""
        of = lambda t, c, to: t.join(labels.select(F.col("node").alias(c), F.col("component").alias(to)), c, "left").withColumn(to, F.coalesce(to, c))
        merged = self.keep(components(of(of(links.select("a", "b"), "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))))
        moved = labels.join(merged.select(F.col("component").alias("to"), F.col("node").alias("component")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        return self.keep(moved.union(merged).distinct())

    def mixed(self, lists: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows of lists whose sets are not all in one component, with `component` and `weight`, the number of its sets."""
        weighed = labels.join(labels.groupBy("component").agg(F.count("*").alias("weight")), "component").withColumnRenamed("node", "name")
        rows = lists.join(weighed, "name", "left").withColumns({"component": F.coalesce("component", "name"), "weight": F.coalesce("weight", F.lit(1).cast("long"))})
        several = rows.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("shingle")
        return rows.join(several, "shingle")

    def pivoted(self, long: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
        """(a, b): each set of the long lists with the pivots of several random orders, in LISTS of its lists. A group whose sets are
        similar to many of the others, but not to all, is joined by this at a cost in proportion to its size; what it leaves is left
        to `rest`."""
        rows = self.keep(self.mixed(long, labels))
        own = F.struct(*(F.col(c).alias(f"p_{c}") for c in ("name", "n", "place", "rank", "component", "cap")))
        pivots = rows.groupBy("shingle").agg(F.array(*[F.min_by(own, F.xxhash64(F.lit(turn * ORDERS + k), "name")) for k in range(ORDERS)]).alias("pivots"))
        few = rows.withColumn("turn", F.row_number().over(Window.partitionBy("name").orderBy(F.xxhash64(F.lit(turn), "shingle")))).filter(F.col("turn") <= LISTS)
        met = few.join(pivots.select("shingle", F.explode("pivots").alias("p")), "shingle").select("name", "n", "place", "rank", "component", "cap", "p.*")
        most = F.least(F.least("rank", "p_rank") + F.least(F.col("n") - F.col("place"), F.col("p_n") - F.col("p_place")), F.greatest("cap", "p_cap"))
        met = met.filter((F.col("component") != F.col("p_component")) & (100 * F.least("n", "p_n") >= PERCENT * F.greatest("n", "p_n")) & ((100 + PERCENT) * most >= PERCENT * (F.col("n") + F.col("p_n"))))
        out = self.keep(met.select(F.least("name", "p_name").alias("a"), F.greatest("name", "p_name").alias("b")).distinct())
        blocks.drop(rows)
        return out

    def rest(self, lists: DataFrame, labels: DataFrame, answers: DataFrame) -> DataFrame:
        """(a, b): the pairs of step 2."""
        needs = 100 + PERCENT
        band = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(100 / PERCENT))).cast("int")
        # The greatest set that a set's cap allows is of band `far`; one of two similar sets must reach the other's band by its own cap.
        far = band(F.greatest(F.floor(needs * F.col("cap") / PERCENT) - F.col("n"), F.lit(1)))
        rows = kept = self.keep(self.mixed(lists, labels).withColumns({"band": band(F.col("n")), "far": far}))
        # Of two sets in a list, the one of the lesser component looks for the other; a list's greatest component looks for none.
        major = rows.groupBy("shingle").agg(F.max_by("component", F.struct("weight", "component")).alias("major"), F.count("*").alias("members"))
        rows = rows.join(major, "shingle")
        # Each list's blocks by size, cut to some BLOCK sets, with the most that a block's sets have before this shingle in lists, and from
        # it on. What two sets share is at most the less of their ranks and the less of what is left from it, in every list of both.
        member = F.struct(*(F.col(c) for c in MEMBER))
        cut = F.pmod(F.xxhash64("name"), F.ceil(F.col("members") / BLOCK)).alias("cut")
        heads = rows.groupBy("shingle", "band", cut).agg(F.max("rank").alias("before"), F.max(F.col("n") - F.col("place")).alias("left"), F.min("n").alias("least"), F.max("cap").alias("most"), F.collect_list(member).alias("members"))
        own = F.col("n") - F.col("place")
        x = rows.filter("component <> major").withColumn("own", F.col("band")).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).drop("members")
        met = x.join(heads, ["shingle", "band"]).filter(needs * F.least(F.least("rank", "before") + F.least(own, F.col("left")), F.greatest("cap", "most")) >= PERCENT * (F.col("n") + F.col("least")))
        partners = met.select(*MEMBER, "own", "band", "members").mapInArrow(_partners, "name long, n long, partners binary, sizes binary")
        pairs = partners.repartition(F.col("name")).sortWithinPartitions("name").mapInArrow(_shared, "a long, b long, total long")
        known = lambda c: answers.select(F.col("a").alias(c), F.col("b").alias(f"p{c}"), F.col("overlap").alias(f"o{c}"), F.col("na").alias(f"n{c}"))
        by_pivot = F.least("oa", "ob") + F.least(F.col("na") - F.col("oa"), F.col("nb") - F.col("ob"))
        left = pairs.join(known("a"), "a", "left").join(known("b"), "b", "left").filter(
            F.coalesce(F.col("pa") != F.col("b"), F.lit(True)) & F.coalesce(F.col("pb") != F.col("a"), F.lit(True)) & F.coalesce((F.col("pa") != F.col("pb")) | (needs * by_pivot >= PERCENT * F.col("total")), F.lit(True))
        )
        out = self.keep(left.select("a", "b"))
        blocks.drop(kept)
        return out


def _meet_group(table: pa.Table) -> pa.Table:
    out = pa.Table.from_batches(list(_meet(iter(table.to_batches()))), schema=_INDEX)
    blocks.release()
    return out


def component_ids(frame: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return Join(frame, id_column, column).run()


@blocks.helpers("_own_key", "_first_id", "_first_key", "_first_copies")
def one_of_each(frame: DataFrame, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """The frame with one row of each component; rows without words are linked with nothing and all stay."""
    first = Join(frame, id_column, column).survivors().withColumnsRenamed({"doc_id": "_first_id", "key": "_first_key", "copies": "_first_copies"})
    worded = F.coalesce(F.col(column).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = frame.filter(worded).withColumn("_own_key", F.xxhash64(column))
    found = own.join(first, (F.col("_own_key") == F.col("_first_key")) & F.col(id_column).cast("long").eqNullSafe(F.col("_first_id")))
    single = found.filter("_first_copies = 1").select(*frame.columns)
    several = found.filter("_first_copies > 1").dropDuplicates(["_first_id", "_first_key"]).select(*frame.columns)
    return single.union(several).union(frame.filter(~worded))
