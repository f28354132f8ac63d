"""Quality by the perplexity of an interpolated modified Kneser-Ney model.

The model is of pairs of lower-cased words, trained on all trusted text, with marks
before and after each text, with all pairs, those seen once too. Below the words' own
probabilities, from how many words they follow, lies a spelling model of byte
frequencies, so every word has a probability. Tasks count the pairs of their texts;
shards by hash of the pair add these counts up.

The interpolated probability of a word is a chain of factors, each of which hangs
on one n-gram only: log p = sum over the orders of the weight of its context, plus
a gain where the n-gram was seen. Weights and gains form one table (key, value),
hashed into shards by n-gram. Documents are cut into blocks; a block sends each
shard the n-grams of its range that a filter of the table's keys lets through (the
others have the value 0), and the shards send back each document's sum. A large table
is built and asked in rounds, a range of the hashes each, so that the disk holds the
table and questions of one range at a time; the rounds' sums are added. Neither counts
nor answers are broadcast or collected. What is: the filter, of at most 2^FILTER_BITS
bits in all rounds, 257 byte counts, and the counts of counts behind the discounts.

A language's threshold is a quantile of the perplexities of trusted documents
that were held out of training, with some slack. Documents above it are rejected.
Perplexities are per character.

Cases: a null or empty text has no perplexity and is rejected; a text without words
is its marks alone; a null language is a language of its own; a language with fewer
than ENOUGH held-out documents takes the threshold of all languages; without trusted
text every document with text is kept; equal rows are judged alike; a document with
several labels is trusted only if all are good.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

BLOCK_BYTES = 3 << 20
HOLD_OUT = 8
QUANTILE = 0.995
ENOUGH = 50
PRIOR = 50
SLACK = 1.1
#: Trusted ids up to this number are broadcast (8 bytes each); more are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: The filter has 16 bits a key, and at most 2^29 (64 MB, a round's part of it at a time); beyond, more n-grams are sent in vain.
FILTER_BITS = 29
#: A shard holds about this many keys.
SHARD_KEYS = 1 << 18
#: A table of more keys than this is built and asked in 2^ROUND_BITS rounds.
ROUND_KEYS = 1 << 20
ROUND_BITS = 2
#: Shards of any model.
LEAST_SHARD_BITS = 5
#: A shard of the counting holds the pairs of about this many words of text.
SHARD_TOKENS = 1 << 20
LEAST_TRAIN_BITS = 3
#: Where a caller of `perplexities` asks for it, pairs that are seen less often count for their context's weight only; `judge` keeps all.
LEAST = 2
#: Rows that wait before they are merged, and rows that are given out at once.
MERGE = 1 << 19
OUT_ROWS = 1 << 16
#: Bits of a word's number and of a key. With n of them in the model, one that is not in it passes for one that is with a chance
#: of n / 2^48.
BITS = 48
#: The marks before and after a text, in place of words.
BEFORE, AFTER = 0, 1

FLOW = "shard int, kind int, block long, body binary"
FLOW_NAMES = ["shard", "kind", "block", "body"]
TABLE, ASKED, WHOLE = 0, 1, 2
PAIRS, WORDS = 0, 1
#: Of kind "pair": packed pairs and their counts, of one part of 2^ROUND_BITS of the keys. Of kind "word": packed rows of WORD. Of kind
#: "of": how many pairs have count a, at 5 that or more.
COUNTS = "kind string, part int, a long, c long, body binary"
PAIR = "a long, b long, c long"
#: Of word a, to be summed: its pairs' counts as the first word and how many of them are 1, 2 and more; how many words it follows; its
#: spelling, infinite where the rows do not know it.
WORD = "a long, total long, n1 long, n2 long, n3 long, cont long, spelt double"


def keys(*words: np.ndarray) -> np.ndarray:
    """The key of n-grams, given by one array a position: the upper BITS bits of Spark's xxhash64 of the words' numbers."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    value = np.full(len(words[0]), 42, np.uint64)
    for w in words:
        value = value + p5 + np.uint64(8)
        value = turn(value ^ turn(w * p2, 31) * p1, 27) * p1 + p4
        value = (value ^ value >> np.uint64(33)) * p2
        value = (value ^ value >> np.uint64(29)) * p3
        value ^= value >> np.uint64(32)
    return value >> np.uint64(64 - BITS)


def tokens(data: np.ndarray, offsets: np.ndarray, spelling: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all rows that have text, each row's between its marks: (word number, row, log probability of the spelling).
    spelling: log probabilities of 256 bytes and of a token's end."""
    low = blocks.LOWER[data]
    starts, ends, bounds = blocks.words(low, offsets)
    total = np.concatenate([[0.0], np.cumsum(spelling[low])])
    rows = np.flatnonzero(np.diff(offsets) > 0)
    each = np.diff(bounds)[rows]
    row = np.repeat(rows.astype(np.int32), each + 2)
    last = np.cumsum(each + 2) - 1
    first = last - each - 1
    inner = np.ones(len(row), bool)
    inner[first] = inner[last] = False
    word = np.zeros(len(row), np.uint64)
    word[last] = AFTER
    word[inner] = np.maximum(blocks.hashes(low, starts, ends) >> np.uint64(64 - BITS), np.uint64(2))
    spelt = np.full(len(row), spelling[256])
    spelt[first] = 0.0
    spelt[inner] += total[ends] - total[starts]
    return word, row, spelt


def before(word: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """The word k places before each token, BEFORE beyond the row's start."""
    out = np.full(len(word), BEFORE, np.uint64)
    out[k:] = np.where(row[k:] == row[:-k], word[:-k], np.uint64(BEFORE))
    return out


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(byte, n) of the words' bytes of a task; byte 256 counts the tokens."""
    n = np.zeros(257, np.int64)
    for batch in batches:
        for _, _, data, offsets in blocks.slices(*blocks.flat(batch.column(0)), BLOCK_BYTES):
            low = blocks.LOWER[data]
            n[:256] += np.bincount(low[~blocks.IS_SPACE[low]], minlength=256)
            n[256] += len(blocks.words(low, offsets)[0]) + int((np.diff(offsets) > 0).sum())
    yield pa.RecordBatch.from_arrays([pa.array(range(257), pa.int32()), pa.array(n)], ["byte", "n"])


def _pairs(spelling: np.ndarray, shard_bits: int):
    """(shard, kind, body) of each slice of texts: its distinct pairs of words with their counts by hash of the pair, and its
    words' spellings by the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange((1 << shard_bits) + 1)
        for batch in batches:
            for _, _, data, offsets in blocks.slices(*blocks.flat(batch.column(0)), BLOCK_BYTES):
                word, row, spelt = tokens(data, offsets, spelling)
                real = np.flatnonzero(word != BEFORE)
                a, b, spelt = before(word, row, 1)[real], word[real], spelt[real]
                shard = (keys(a, b) >> np.uint64(BITS - shard_bits)).astype(np.int32)
                order = np.lexsort((b, a, shard))
                one, two = a[order], b[order]
                new = np.ones(len(order), bool)
                new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                first = np.flatnonzero(new)
                one, two, shard, n = one[first], two[first], shard[order[first]], np.diff(np.append(first, len(order))).astype(np.uint32)
                at = np.searchsorted(shard, edges)
                bodies = [(j, PAIRS, _pack_pairs(one[lo:hi], two[lo:hi], n[lo:hi])) for j, (lo, hi) in enumerate(zip(at, at[1:])) if lo < hi]
                own, first = np.unique(b, return_index=True)
                at = np.searchsorted((own >> np.uint64(BITS - shard_bits)).astype(np.int64), edges)
                bodies += [(j, WORDS, _packed(np.diff(own[lo:hi], prepend=np.uint64(0)), spelt[first[lo:hi]].astype(np.float32))) for j, (lo, hi) in enumerate(zip(at, at[1:])) if lo < hi]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in bodies], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["shard", "kind", "body"])

    return run


def _summed(parts: list, least: bool) -> list[tuple]:
    """Parts (first, second, value) as one, sorted, without repetitions: values are summed, or the least taken."""
    if len(parts) < 2:
        return parts
    one, two, value = (np.concatenate([x[k] for x in parts]) for k in range(3))
    order = np.lexsort((value, two, one) if least else (two, one))
    one, two, value = one[order], two[order], value[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    first = np.flatnonzero(new)
    return [(one[first], two[first], value[first] if least else np.add.reduceat(value, first))]


def _merged(least: int):
    """Rows of COUNTS from all (shard, kind, body) of a task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {PAIRS: [], WORDS: []}
        waiting = {PAIRS: 0, WORDS: 0}
        for batch in batches:
            for kind, body in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind == PAIRS:
                    one, two, n = _unpack_pairs(body.as_py())
                    parts[kind].append((one, two, n.astype(np.int64)))
                else:
                    one, spelt = _unpacked(body.as_py(), "<u8", "<f4")
                    parts[kind].append((np.cumsum(one, dtype=np.uint64), np.zeros(len(one), np.uint64), spelt))
                waiting[kind] += len(one)
                if waiting[kind] > 2 * len(parts[kind][0][0]) + MERGE:
                    parts[kind] = _summed(parts[kind], kind == WORDS)
                    waiting[kind] = 0

        def out(kind: str, **columns):
            n = len(next(iter(columns.values())))
            types = {"kind": pa.string(), "part": pa.int32(), "a": pa.int64(), "c": pa.int64(), "body": pa.binary()}
            columns["kind"] = [kind] * n
            return pa.RecordBatch.from_arrays([pa.array(columns[x], t) if x in columns else pa.nulls(n, t) for x, t in types.items()], list(types))

        heads, tails, spelt = [], [], []
        for one, two, n in _summed(parts.pop(PAIRS), False):
            yield out("of", a=range(1, 6), c=np.bincount(np.minimum(n, 5), minlength=6)[1:])
            word, first = np.unique(one, return_index=True)
            heads.append((word, *(np.add.reduceat(x.astype(np.int64), first) if len(first) else first for x in (n, n == 1, n == 2, n >= 3))))
            tails.append(np.unique(two, return_counts=True))
            part = (keys(one, two) >> np.uint64(BITS - ROUND_BITS)).astype(np.int32)
            for k in range(1 << ROUND_BITS):
                own = np.flatnonzero((part == k) & (n >= least))
                for lo in range(0, len(own), OUT_ROWS):
                    at = own[lo : lo + OUT_ROWS]
                    yield out("pair", part=[k], body=[_pack_pairs(one[at], two[at], n[at])])
            del one, two, n, part
        for word, _, value in _summed(parts.pop(WORDS), True):
            spelt.append((word, value))
        every = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in heads + tails + spelt)]))
        columns = [*np.zeros((5, len(every)), np.int64), np.full(len(every), np.inf, np.float32)]
        for found, into in ((heads, columns[:4]), (tails, columns[4:5]), (spelt, columns[5:])):
            for word, *values in found:
                at = np.searchsorted(every, word)
                for column, value in zip(into, values, strict=True):
                    column[at] = value
        for lo in range(0, len(every), OUT_ROWS):
            s = slice(lo, lo + OUT_ROWS)
            yield out("word", body=[_packed(np.diff(every[s], prepend=np.uint64(0)), *(c[s] for c in columns))])
        blocks.release()

    return run


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of PAIR from packed ones."""
    for batch in batches:
        for body in batch.column(0):
            one, two, n = _unpack_pairs(body.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one.view(np.int64), two.view(np.int64), n.astype(np.int64))], ["a", "b", "c"])


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of WORD from packed ones."""
    for batch in batches:
        for body in batch.column(0):
            word, *counts, spelt = _unpacked(body.as_py(), "<u8", *["<i8"] * 5, "<f4")
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.cumsum(word, dtype=np.uint64).view(np.int64), *counts, spelt.astype(np.float64))], ["a", "total", "n1", "n2", "n3", "cont", "spelt"])


def discounts(of: list[int]) -> list[float]:
    """The modified Kneser-Ney discounts from the numbers of n-grams that occur once to four times; fixed ones where some number is 0."""
    a, b, c, d = of
    if min(of) == 0:
        return [0.5, 1.0, 1.5]
    y = a / (a + 2 * b)
    return [min(max(x, 0.05), k + 0.95) for k, x in enumerate((1 - 2 * y * b / a, 2 - 3 * y * c / b, 3 - 4 * y * d / c))]


def _gain(d: list[float], log_below: Column) -> Column:
    """log(1 + what the discounted count adds / (context's weight * probability below))."""
    c = F.col("c")
    x = F.log((c - F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])) / (F.col("total") * F.col("weight"))) - log_below
    return F.when(x > 30, x).otherwise(F.log1p(F.exp(F.least(x, F.lit(30.0)))))


def _key(*words: str) -> Column:
    """`keys` in SQL."""
    return F.shiftrightunsigned(F.xxhash64(*words), 64 - BITS)


def _weight(d: list[float]) -> Column:
    """The share of a context's counts that its discounts leave to the order below."""
    return (d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")) / F.col("total")


def factors(counts: DataFrame, least: int) -> tuple[float, int, DataFrame, Callable[[int, int], DataFrame]]:
    """(log weight of the spelling, most keys, stored words, (round, round_bits) -> its (key, value)) of a table of COUNTS. A word's key
    occurs twice, for itself and as a context; its value is the sum."""
    spark = counts.sparkSession
    words = counts.filter("kind = 'word'").select("body").mapInArrow(_word_rows, WORD)
    words = words.groupBy("a").agg(*(F.sum(x).alias(x) for x in ("total", "n1", "n2", "n3", "cont")), F.min("spelt").alias("spelt"))
    words = blocks.stored(spark, words, size=BLOCK_BYTES)
    after = words.filter("cont > 0").withColumnsRenamed({"a": "b", "cont": "c"}).select("b", "c", "spelt")
    found = {r[0]: r[1] for r in after.filter("c <= 4").groupBy("c").count().collect()}
    d1 = discounts([found.get(k, 0) for k in range(1, 5)])
    root = after.agg(F.sum("c").alias("total"), *(F.count(F.when(F.col("c") == k if k < 3 else F.col("c") >= 3, 1)).alias(f"n{k}") for k in (1, 2, 3)))
    root = root.select("total", _weight(d1).alias("weight")).first()
    if not root["total"]:
        return 0.0, 0, words, lambda r, round_bits: spark.createDataFrame([], "key long, value float")
    rest = math.log(root["weight"])
    after = after.withColumns({"total": F.lit(root["total"]), "weight": F.lit(root["weight"])})
    after = after.withColumn("gain", _gain(d1, F.col("spelt"))).select("b", "gain", (F.col("gain") + rest + F.col("spelt")).alias("logp"))
    found = {r[0]: r[1] for r in counts.filter("kind = 'of'").groupBy("a").agg(F.sum("c")).collect()}
    d2 = discounts([found.get(k, 0) for k in range(1, 5)])
    d2[: least - 1] = [1.0] * (least - 1)
    context = words.filter("total > 0").select("a", "total", _weight(d2).alias("weight"))
    row = lambda t, key, value: t.select(key.alias("key"), value.cast("float").alias("value"))

    def table(r: int, round_bits: int) -> DataFrame:
        own = range(r << ROUND_BITS - round_bits, r + 1 << ROUND_BITS - round_bits)
        pairs = counts.filter(F.col("part").isin(*own)).select("body").mapInArrow(_pair_rows, PAIR)
        pairs = pairs.join(context, "a").join(after.select("b", "logp"), "b")
        single = row(after, _key("b"), F.col("gain")).union(row(context.filter("weight != 1"), _key("a"), F.log("weight")))
        return row(pairs, _key("a", "b"), _gain(d2, F.col("logp"))).union(single.filter(F.shiftrightunsigned("key", BITS - round_bits) == r))

    return rest, sum(c for k, c in found.items() if k >= least) + 2 * words.count(), words, table


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, byte by byte of their values."""
    return zstandard.compress(b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in columns), 1)


def _unpacked(body: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(body), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return out


def _pack_pairs(one: np.ndarray, two: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs in order of their first words, with counts: the first words as differences, the second ones as places in a list of them.
    Counts take as many bytes as they need."""
    words, at = np.unique(two, return_inverse=True)
    heads = _packed(np.diff(words, prepend=np.uint64(0)))
    wide = int(n.max(initial=0)) >= 1 << 32
    return len(heads).to_bytes(4, "little") + bytes([int(wide)]) + heads + _packed(np.diff(one, prepend=np.uint64(0)), at.astype(np.uint32), n.astype(np.uint64 if wide else np.uint32))


def _unpack_pairs(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    end = 5 + int.from_bytes(body[:4], "little")
    (words,) = _unpacked(body[5:end], "<u8")
    one, at, n = _unpacked(body[end:], "<u8", "<u4", "<u8" if body[4] else "<u4")
    return np.cumsum(one, dtype=np.uint64), np.cumsum(words, dtype=np.uint64)[at], n


def _listed(key: np.ndarray, row: np.ndarray, n: np.ndarray) -> bytes:
    """Lists of rows by key, all sorted: the distinct keys as differences, the lists' lengths, the rows as differences in their list."""
    row = row.astype(np.uint32)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    step = np.diff(row, prepend=np.uint32(0))
    step[first] = row[first]
    heads = _packed(np.diff(key[first], prepend=np.uint64(0)), np.diff(np.append(first, len(key))).astype(np.uint32))
    return len(heads).to_bytes(4, "little") + heads + _packed(step, n)


def _lists(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key, row and number that `_listed` packed."""
    end = 4 + int.from_bytes(body[:4], "little")
    key, size = _unpacked(body[4:end], "<u8", "<u4")
    step, n = _unpacked(body[end:], "<u4", "<u4")
    total = np.cumsum(step, dtype=np.int64)
    ends = np.cumsum(size, dtype=np.int64)
    total -= np.repeat(np.append(0, total[ends[:-1] - 1]), size)
    return np.repeat(np.cumsum(key, dtype=np.uint64), size), total, n


def _shards(shard_bits: int, filter_bits: int):
    """The table's rows of FLOW and, as bits, each shard's range of the filter, from (shard, key, value) with whole shards in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            shard, key, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.argsort(shard, kind="stable")
            found, first = np.unique(shard[order], return_index=True)
            for k, own in zip(found.tolist(), np.split(order, first[1:]), strict=True):
                parts.setdefault(k, []).append((key[own].view(np.uint64), value[own]))
        for k in sorted(parts):
            own = parts.pop(k)
            key, number = np.unique(np.concatenate([x[0] for x in own]), return_inverse=True)
            value = np.bincount(number, np.concatenate([x[1] for x in own])).astype(np.float32)
            bits = np.zeros(1 << filter_bits - shard_bits, bool)
            bits[(key >> np.uint64(BITS - filter_bits)).astype(np.int64) - (k << filter_bits - shard_bits)] = True
            body = _packed(np.diff(key, prepend=np.uint64(0)), value)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([body], pa.binary()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["shard", "body", "bits"])

    return run


def _asks(shard_bits: int, filter_bits: int, round_bits: int, r: int, bits, spelling: np.ndarray, rest: float):
    """Rows of FLOW: for each block of documents one a shard of the round, and one for the block itself. Batch columns: id, text, lang,
    held, key. The first round's sums hold what needs no table."""
    shards = range(r << shard_bits - round_bits, r + 1 << shard_bits - round_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        there = np.frombuffer(zstandard.decompress(bits.value), np.uint8)
        for batch in batches:
            for lo, hi, data, offsets in blocks.slices(*blocks.flat(batch.column(1)), BLOCK_BYTES):
                word, row, spelt = tokens(data, offsets, spelling)
                base = np.zeros(hi - lo) if r else np.bincount(row, spelt + np.where(word == BEFORE, 0.0, rest), hi - lo)
                sizes = np.add.reduceat(np.append((data & 0xC0) != 0x80, False).astype(np.int64), offsets[:-1]) if len(data) else np.zeros(hi - lo, np.int64)
                sizes[np.diff(offsets) == 0] = 0
                w2 = before(word, row, 1)
                found, rows = [], []
                for key in (keys(word), keys(w2, word)):
                    hit = np.flatnonzero(key >> np.uint64(BITS - round_bits) == r)
                    slot = (key[hit] >> np.uint64(BITS - filter_bits)).astype(np.int64) - (r << filter_bits - round_bits)
                    hit = hit[there[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 != 0]
                    found.append(key[hit])
                    rows.append(row[hit])
                del word, w2, spelt
                key, row = np.concatenate(found), np.concatenate(rows)
                order = np.lexsort((row, key))
                key, row = key[order], row[order]
                first = np.ones(len(key), bool)
                first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(first)
                n = np.diff(np.append(first, len(key))).astype(np.uint32)
                key, row = key[first], row[first].astype(np.uint32)
                shard = (key >> np.uint64(BITS - shard_bits)).astype(np.int32)
                at = np.searchsorted(shard, np.arange(shards.start, shards.stop + 1))
                own = [k for k, (a, b) in zip(shards, zip(at, at[1:])) if a < b]
                bodies = [_listed(key[a:b], row[a:b], n[a:b]) for a, b in zip(at, at[1:]) if a < b]
                block = pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(4)[lo:hi], batch.column(2)[lo:hi], batch.column(3)[lo:hi], pa.array(sizes), pa.array(base)], ["doc_id", "key", "lang", "held", "n", "logp"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(block)
                yield pa.RecordBatch.from_arrays([pa.array([*own, number & (1 << shard_bits) - 1], pa.int32()), pa.array([ASKED] * len(own) + [WHOLE], pa.int32()), pa.array([number] * (len(own) + 1), pa.int64()), pa.array([*bodies, sink.getvalue().to_pybytes()], pa.binary())], FLOW_NAMES)
                number += 1

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of FLOW: the asked n-grams of a block become the sums of its documents. A shard's table comes before what asks it."""
    shard, key, value = -1, np.zeros(0, np.uint64), np.zeros(0, np.float32)
    for batch in batches:
        for row in range(len(batch)):
            own, kind, block, body = (batch.column(k)[row].as_py() for k in range(4))
            if kind == TABLE:
                shard = own
                key, value = _unpacked(body, "<u8", "<f4")
                key = np.cumsum(key, dtype=np.uint64)
                continue
            if kind == ASKED:
                asked, doc, n = _lists(body)
                if own != shard:
                    continue
                at = np.minimum(np.searchsorted(key, asked), len(key) - 1)
                gain = np.where(key[at] == asked, value[at], np.float32(0)) * n.astype(np.float64)
                docs, number = np.unique(doc.astype(np.uint32), return_inverse=True)
                body = _packed(docs, np.bincount(number, gain, len(docs)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([body], pa.binary())], FLOW_NAMES)
    del key, value
    blocks.release()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, lang, held, n, logp) of each document of a block, from the block's rows of FLOW."""
    for batch in batches:
        for row in range(len(batch)):
            parts = batch.column(0)[row].as_py()
            whole = pa.ipc.open_stream(next(p["body"] for p in parts if p["kind"] == WHOLE)).read_all().combine_chunks()
            total = whole.column("logp").to_numpy().copy()
            for p in parts:
                if p["kind"] == ASKED:
                    docs, gain = _unpacked(p["body"], "<u4", "<f4")
                    total[docs] += gain
            yield from whole.set_column(5, "logp", pa.array(total)).to_batches()
    blocks.release()


def trusted_ids(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The ids whose labels all say good quality and not toxic."""
    bad = (F.coalesce("quality", F.lit(0)) != 1) | (F.coalesce("toxic", F.lit(0)) != 0)
    return labels.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_trusted")).agg(F.max(bad.cast("int")).alias("bad")).filter("bad = 0").select("_trusted")


def perplexities(frame: DataFrame, trusted: DataFrame, id_column: str = "doc_id", column: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """(doc_id, key, lang, held, n, logp) of every row; key: the hash of its text; held says whether it is trusted but kept out of training.
    The model holds the pairs that are seen `least` times; rarer ones are discounted by 1. With 1 it holds all."""
    spark = frame.sparkSession
    if trusted.count() <= BROADCAST_IDS:
        trusted = F.broadcast(trusted)
    rows = frame.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(column).alias("key")).join(trusted, F.col("id") == F.col("_trusted"), "left")
    out = F.crc32(F.col("id").cast("string").cast("binary")) % HOLD_OUT == 0
    known = F.col("_trusted").isNotNull()
    train = rows.filter(known & ~out).select("text")
    n = np.ones(257)
    found = blocks.stored(spark, train.mapInArrow(_byte_counts, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")), size=BLOCK_BYTES)
    for r in found.collect():
        n[r["byte"]] += r["n"]
    blocks.drop(found)
    spelling = np.log(n / n.sum())
    train_bits = max(LEAST_TRAIN_BITS, math.ceil(math.log2(n[256] / SHARD_TOKENS)))
    packs = train.mapInArrow(_pairs(spelling, train_bits), "shard int, kind int, body binary")
    counts = blocks.stored(spark, packs.repartition(1 << train_bits, "shard").mapInArrow(_merged(least), COUNTS), size=BLOCK_BYTES)
    rest, size, words, table = factors(counts, least)
    round_bits = ROUND_BITS if size > ROUND_KEYS else 0
    shard_bits = max(LEAST_SHARD_BITS, math.ceil(math.log2(max(size, 1) / SHARD_KEYS)))
    filter_bits = max(min(FILTER_BITS, math.ceil(math.log2(16 * max(size, 1)))), shard_bits + 3)
    texts = rows.select("id", "text", "lang", (known & out).alias("held"), "key")
    found = [_round(spark, texts, table, shard_bits, filter_bits, round_bits, r, spelling, rest) for r in range(1 << round_bits)]
    blocks.drop(counts, words)
    if not round_bits:
        return found[0]
    # A row occurs once in each round. Equal rows have equal sums, so their number is kept instead of theirs.
    names = ["doc_id", "key", "lang", "held", "n"]
    every = functools.reduce(DataFrame.union, found).groupBy(*names).agg(F.sum("logp").alias("sum"), (F.count("*") / len(found)).cast("int").alias("times"))
    return every.select(*names, (F.col("sum") / F.col("times")).alias("logp"), F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("col")


def _round(spark, texts: DataFrame, table, shard_bits: int, filter_bits: int, round_bits: int, r: int, spelling: np.ndarray, rest: float) -> DataFrame:
    """(doc_id, key, lang, held, n, logp) of every row of texts, logp of the round's n-grams only."""
    shards = 1 << shard_bits - round_bits
    shard = F.shiftrightunsigned("key", BITS - shard_bits).cast("int").alias("shard")
    kept = table(r, round_bits).select(shard, "key", "value").repartition(shards, "shard").mapInArrow(_shards(shard_bits, filter_bits), "shard int, body binary, bits binary")
    kept = blocks.stored(spark, kept, batch=1 << 16, size=BLOCK_BYTES)
    bits = bytearray(1 << filter_bits - round_bits - 3)
    span = len(bits) // shards
    for x in kept.select("shard", "bits").toLocalIterator():
        at = (x["shard"] - r * shards) * span
        bits[at : at + span] = x["bits"]
    there = spark.sparkContext.broadcast(zstandard.compress(bytes(bits), 3))
    del bits
    asks = texts.mapInArrow(_asks(shard_bits, filter_bits, round_bits, r, there, spelling, rest), FLOW)
    flow = kept.select("shard", F.lit(TABLE).alias("kind"), F.lit(None).cast("long").alias("block"), "body").union(asks)
    flow = flow.repartition(shards, "shard").sortWithinPartitions("shard", "kind", "block").mapInArrow(_answers, FLOW)
    whole = flow.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("kind", "shard", "body"))).alias("parts")).select("parts")
    done = blocks.stored(spark, whole.mapInArrow(_sums, "doc_id long, key long, lang string, held boolean, n long, logp double"), size=BLOCK_BYTES)
    there.destroy()
    blocks.drop(kept)
    return done


def judge(frame: DataFrame, trusted: DataFrame, id_column: str = "doc_id", column: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, key, lang, n_chars, perplexity, adjusted, threshold, kept) of every row. `adjusted` is the perplexity with PRIOR characters
    of the language's mean added, so that a few words alone do not decide; the threshold is its quantile times SLACK."""
    scored = blocks.stored(frame.sparkSession, perplexities(frame, trusted, id_column, column, lang, 1), size=BLOCK_BYTES)
    held = scored.filter("held and n > 0")
    sums = held.groupBy(F.col("lang").alias("_lang")).agg(F.sum("logp").alias("_logp"), F.sum("n").alias("_n"), F.count("*").alias("_docs"))
    total = sums.agg(F.sum("_logp").alias("logp"), F.sum("_n").alias("n")).first()
    mean = -total["logp"] / total["n"] if total["n"] else 0.0
    means = sums.filter(F.col("_docs") >= ENOUGH).select("_lang", (-F.col("_logp") / F.col("_n")).alias("_mean"))
    adjust = lambda t: t.join(means, t["lang"].eqNullSafe(means["_lang"]), "left").drop("_lang").withColumn("bits", F.when(F.col("n") > 0, F.round((-F.col("logp") + PRIOR * F.coalesce("_mean", F.lit(mean))) / (F.col("n") + PRIOR), 4))).drop("_mean")
    own = adjust(held)
    limits = own.groupBy(F.col("lang").alias("_lang")).agg(F.percentile("bits", F.lit(quantile)).alias("_own"), F.count("*").alias("_docs")).filter(F.col("_docs") >= ENOUGH).drop("_docs")
    every = own.agg(F.percentile("bits", F.lit(quantile)).alias("any")).first()["any"]
    out = adjust(scored).join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("limit", F.coalesce(F.col("_own"), F.lit(every).cast("double")) + float(np.log(SLACK)))
    kept = F.when(F.col("bits").isNull(), False).otherwise(F.coalesce(F.col("bits") <= F.col("limit"), F.lit(True)))
    return out.select("doc_id", "key", "lang", F.col("n").alias("n_chars"), F.when(F.col("n") > 0, F.exp(-F.col("logp") / F.col("n"))).alias("perplexity"), F.exp("bits").alias("adjusted"), F.exp("limit").alias("threshold"), kept.alias("kept"))


def accepted(frame: DataFrame, trusted: DataFrame, id_column: str = "doc_id", column: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that `judge` keeps. Equal texts of a language are judged alike, so the rejected ones are known by hash and language."""
    gone = judge(frame, trusted, id_column, column, lang).filter(~F.col("kept")).select(F.col("key").alias("_gone"), F.col("lang").alias("_gone_lang")).distinct()
    return frame.join(gone, (F.xxhash64(column) == F.col("_gone")) & F.col(lang).cast("string").eqNullSafe(F.col("_gone_lang")), "left_anti")
