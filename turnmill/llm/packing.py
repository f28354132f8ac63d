"""Packing by lexical retrieval.

Documents are dealt into shards by range of a lexical key (the least hash of
their words, then the id), so that similar documents and copies stand together
and no key, however common, fills a shard. A shard has about SHARD_BYTES of text,
whatever the input's size. Its inverted index holds all its documents: each
term's postings with their BM25 weights, as a row of weights for terms that many
of its documents have. The index gives a seed's exact scores for all documents of
the shard; the best unused ones fill its window greedily, ties in shard order. A
document that goes beyond the window is cut, and its rest opens the next window
as the seed. A shard's last tokens are cut into sequences whose lengths are
powers of two, so nothing is padded.

Document frequencies and the mean length are those of all documents. Frequencies
are counted in 2^SLOT_BITS slots of the terms' hashes, so what is broadcast is
bounded; rare terms that share a slot weigh somewhat less.

Cases: a null or empty text is its closing id alone; equal rows each take their
own place; documents without a neighbour seed the rest of the window themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, bpe, slots

WINDOW = 4096
CLOSING = 2
K1, B = 1.2, 0.75
SHARD_BYTES = 8 << 20
SLOT_BITS, RANGE_BITS = 22, 4
#: Terms that stand in at least this share of a shard's documents have a row of weights instead of postings.
COMMON = 1 / 16
FEW_ROWS = 64


def idf(df: np.ndarray, documents: int) -> np.ndarray:
    return np.log1p((documents - df + 0.5) / (df + 0.5)).astype(np.float32)


class Index:
    """The inverted index of a shard: `terms` are hashes, of the documents in `row`, in any order."""

    def __init__(self, terms: np.ndarray, row: np.ndarray, rows: int, weight_of, mean: float):
        self.rows = rows
        # One key a place: the hash, whose low bits give way to the row.
        bits = np.uint64(max(rows, 1).bit_length())
        key = terms >> bits << bits | row.astype(np.uint64)
        key.sort()
        sizes = np.bincount(row, minlength=rows)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(key)))
        key = key[first]
        row, key = (key & np.uint64((1 << int(bits)) - 1)).astype(np.int32), key >> bits
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        term = np.cumsum(new) - 1
        df = np.diff(np.append(np.flatnonzero(new), len(key)))
        weight = (weight_of(key << bits) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[row] / max(mean, 1e-9)))).astype(np.float32)
        # A term of one document scores no other.
        shared = df[term] >= 2
        term, row, weight = term[shared], row[shared], weight[shared]
        common = df >= max(2, COMMON * rows)
        own = common[term]
        number = np.cumsum(common) - 1
        self.dense = np.zeros((int(common.sum()), rows), np.float32)
        self.dense[number[term[own]], row[own]] = weight[own]
        by_row = lambda r, x: (x[np.argsort(r, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(r, minlength=rows))]))
        self.common = by_row(row[own], number[term[own]])
        term, self.row, self.weight = term[~own], row[~own], weight[~own]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(df)))])
        self.rare = by_row(self.row, term)

    def scores(self, seed: int) -> np.ndarray:
        """For each distinct term of the seed, its weight in every document, summed."""
        common, bounds = self.common
        rows = common[bounds[seed] : bounds[seed + 1]]
        out = np.zeros(self.rows, np.float32)
        for lo in range(0, len(rows), FEW_ROWS):
            out += self.dense[rows[lo : lo + FEW_ROWS]].sum(0)
        rare, bounds = self.rare
        term = rare[bounds[seed] : bounds[seed + 1]]
        if len(term):
            at = blocks.spread(self.bounds[term], self.bounds[term + 1] - self.bounds[term])
            out += np.bincount(self.row[at], self.weight[at], self.rows).astype(np.float32)
        return out


class Packer:
    """Takes blocks of documents and gives out pieces: (document, start, length, sequence, offset)."""

    def __init__(self, sequence: int, window: int = WINDOW):
        self.window, self.sequence, self.used = window, sequence, 0

    def _place(self, out: list, doc: int, start: int, size: int) -> None:
        while size:
            part = min(size, self.window - self.used)
            out.append((doc, start, part, self.sequence, self.used))
            start, size, self.used = start + part, size - part, self.used + part
            if self.used == self.window:
                self.sequence, self.used = self.sequence + 1, 0

    def pack(self, sizes: np.ndarray, scores) -> list[tuple[int, int, int, int, int]]:
        """The shard's pieces in order, by scores(seed) of all its documents; the seed of an open window is the document that was cut or
        came last without a neighbour."""
        out: list = []
        free = np.ones(len(sizes), bool)
        for first in range(len(sizes)):
            if not free[first]:
                continue
            seed, free[first] = first, False
            self._place(out, seed, 0, int(sizes[seed]))
            own = None
            while self.used:
                if own is None:
                    own = np.where(free, scores(seed), 0)
                best = int(own.argmax())
                if own[best] <= 0:
                    break
                free[best], own[best] = False, 0
                before = self.sequence
                self._place(out, best, 0, int(sizes[best]))
                if self.sequence != before:
                    seed, own = best, None
        return out


def tail_cuts(size: int) -> list[int]:
    """The powers of two that make up a size, largest first."""
    return [1 << k for k in range(size.bit_length() - 1, -1, -1) if size >> k & 1]


def _pack(path: str, with_ids: bool, weights, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.encoder(path, by_library=True)
        table, mean = weights.value
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

        def emit(pieces: list) -> pa.RecordBatch:
            columns = [pa.array([p[k] for p in pieces], pa.int64()) for k in (0, 1, 2)]
            columns.append(pa.array([zlib.crc32(p[6].astype("<u4").tobytes()) for p in pieces], pa.int64()))
            columns += [pa.array([p[k] for p in pieces], pa.int64()) for k in (5, 3, 4)]
            if with_ids:
                ends = np.cumsum([0] + [len(p[6]) for p in pieces], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([p[6] for p in pieces]).astype(np.int32))))
            else:
                columns.append(pa.nulls(len(pieces), pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names)

        doc_ids: list = []
        sizes, tokens, terms, rows = [], [], [], []
        for batch in batches:
            for lo, hi, data, offsets in blocks.slices(*blocks.flat(batch.column(1)), 2 << 20):
                ids, bounds, chunks, ends = own.encode_terms(data, offsets)
                tokens.append(np.insert(ids, bounds[1:], CLOSING).astype(np.uint16 if own.n_ids <= 1 << 16 else np.uint32))
                sizes.append(np.diff(bounds) + 1)
                terms.append(chunks)
                rows.append(np.repeat(np.arange(hi - lo, dtype=np.int32) + len(doc_ids), np.diff(ends)))
                doc_ids += batch.column(0)[lo:hi].to_pylist()
        if not doc_ids:
            return
        size = np.concatenate(sizes)
        ids = np.concatenate(tokens)
        starts = np.concatenate([[0], np.cumsum(size)])
        index = Index(np.concatenate(terms), np.concatenate(rows), len(doc_ids), lambda t: table[(t >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], mean)
        del sizes, tokens, terms, rows
        packer = Packer(TaskContext.get().partitionId() << 32, window)
        done: list = []
        for doc, start, length, sequence, offset in packer.pack(size, index.scores):
            at = starts[doc] + start
            done.append((doc_ids[doc], start, length, sequence, offset, int(size[doc]), ids[at : at + length]))
        # The last window: its tokens in sequences of powers of two.
        full = [p for p in done if p[3] != packer.sequence]
        sequence, at, last = packer.sequence, 0, []
        cuts = tail_cuts(packer.used)
        for doc, start, length, _, _, total, own_ids in done[len(full) :]:
            cut = 0
            while cut < length:
                part = min(length - cut, cuts[0] - at)
                last.append((doc, start + cut, part, sequence, at, total, own_ids[cut : cut + part]))
                cut, at = cut + part, at + part
                if at == cuts[0]:
                    cuts, sequence, at = cuts[1:], sequence + 1, 0
        full += last
        for lo in range(0, len(full), 1024):
            yield emit(full[lo : lo + 1024])
        blocks.release()

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, part, packed) of the slots of each document's distinct terms, and (null, documents, null, terms, bytes) sums."""
    part, documents, terms, size = TaskContext.get().partitionId() << 24, 0, 0, 0
    names = ["range", "part", "packed", "terms", "bytes"]
    held: list[np.ndarray] = []
    many = 0

    def packed() -> pa.RecordBatch:
        out = slots.ranges(np.concatenate(held), SLOT_BITS, RANGE_BITS)
        none = [pa.nulls(len(out), pa.int64())] * 2
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([part] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary()), *none], names)

    for batch in batches:
        for lo, hi, data, offsets in blocks.slices(*blocks.flat(batch.column(0)), 2 << 20):
            chunk, ends = bpe.chunk_hashes(data, offsets)
            key = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(ends)) << np.uint64(SLOT_BITS) | chunk >> np.uint64(64 - SLOT_BITS)
            documents, terms, size = documents + hi - lo, terms + len(chunk), size + len(data)
            key.sort()
            new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
            held.append((key[new] & np.uint64((1 << SLOT_BITS) - 1)).astype(np.uint32))
            many += len(held[-1])
            if many >= 4_000_000:
                yield packed()
                held, many, part = [], 0, part + 1
    if many:
        yield packed()
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.array([documents], pa.int64()), pa.nulls(1, pa.binary()), pa.array([terms], pa.int64()), pa.array([size], pa.int64())], names)


def statistics(texts: DataFrame) -> tuple[np.ndarray, float, int]:
    """Each slot's weight, the mean number of terms and the bytes, over all texts."""
    made = blocks.stored(texts.sparkSession, texts.mapInArrow(_counted, "range int, part long, packed binary, terms long, bytes long"))
    documents, terms, size = made.filter("range is null").agg(F.sum("part"), F.sum("terms"), F.sum("bytes")).first()
    table = np.zeros(1 << SLOT_BITS, np.float32)
    width = SLOT_BITS - RANGE_BITS
    for row in slots.counts(made.filter("range is not null"), terms or 0, width).toArrow().to_pylist():
        table[row["range"] << width : row["range"] + 1 << width] = idf(np.frombuffer(zstandard.decompress(row["counts"]), np.uint64).astype(np.float64), documents)
    blocks.drop(made)
    return table, (terms or 0) / max(documents or 0, 1), size or 0


def _least_hash(column: pa.Array) -> pa.Array:
    """Each text's least word hash; -1 without words."""
    out = [np.zeros(0, np.int64)]
    for _, _, data, offsets in blocks.slices(*blocks.flat(column)):
        starts, ends, bounds = blocks.words(data, offsets)
        least = np.full(len(offsets) - 1, -1, np.int64)
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            least[some] = (np.minimum.reduceat(blocks.hashes(data, starts, ends), bounds[some]) >> np.uint64(1)).astype(np.int64)
        out.append(least)
    return pa.array(np.concatenate(out))


def pack(frame: DataFrame, path: str, id_column: str = "doc_id", column: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): every token of every document in exactly one piece
    (ids null without with_ids). Sequences have WINDOW tokens, or a smaller power of two at a shard's end."""
    least = F.arrow_udf(_least_hash, "long")
    texts = frame.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("string").alias("text"))
    table, mean, size = statistics(texts.select("text"))
    blocks.collect(frame.sparkSession)
    weights = frame.sparkSession.sparkContext.broadcast((table, mean))
    rows = texts.withColumn("key", least("text"))
    shards = rows.repartitionByRange(1 + size // SHARD_BYTES, F.col("key"), F.col("id")).sortWithinPartitions("key", "id", F.xxhash64("text"))
    return shards.select("id", "text").mapInArrow(_pack(path, with_ids, weights, WINDOW), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")
