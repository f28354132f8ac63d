"""Language identification by bit-sliced Bloom filters over character trigrams.

One table of slots serves all languages: a slot holds one bit per language, so
the conjunction of a trigram's slots returns all languages whose filter holds
it. A text's trigrams give a popcount per language; each is corrected for that
language's false positives, which follow from the filled share of its bits, and
the highest decides. The table has SPARSE slots for each distinct trigram and
language, within bounds, so filters stay as sparse as the learned text grows,
and its size in bytes is bounded by the most slots and the number of languages.

A trigram stands in a language's filter if at least LEAST_ROWS of its texts hold
it, and if its share of that language's trigrams is at least RATIO of its share
in the language where it is commonest: a text does not vouch for itself, and
passages in other languages do not fill a filter.

Cases: `und` with score 0 for a null text or one without a letter, and for every
text where nothing was learned; rows without a language or text teach nothing;
ties go to the first language by name; equal rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Slots for each trigram of a language; least and most slots.
SPARSE = 16
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 23
LEAST_ROWS = 2
HASHES = 2
RATIO = 0.2
WORD_BITS = 63
#: The least score of an accepted text: this share of its trigrams is known in its language.
LEAST = 0.35

_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Each code point's lower-case letter, or a space for what is no letter; and whether it is a letter."""
    if not _tables:
        letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        lower = np.full(0x110000, 32, np.int32)
        for c in np.flatnonzero(letter).tolist():
            small = chr(c).lower()
            lower[c] = ord(small) if len(small) == 1 else c
        _tables.extend((lower, letter))
    return _tables[0], _tables[1]


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams around a letter in the middle, the row of each, and whether each row has a letter. Other characters and ends count as spaces."""
    lower, letter = _letters()
    points, starts = blocks.code_points(data, offsets)
    n = len(points)
    rows = len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, bool)
    c = lower[points]
    before, after = np.empty_like(c), np.empty_like(c)
    before[0], before[1:] = 32, c[:-1]
    after[-1], after[:-1] = 32, c[1:]
    inner = starts[(starts > 0) & (starts < n)]
    before[inner], after[inner - 1] = 32, 32
    here = np.flatnonzero(letter[points])
    grams = before[here].astype(np.int64)
    for other in (c, after):
        grams <<= 21
        grams |= other[here]
    row = np.searchsorted(starts, here, "right") - 1
    return grams, row, np.bincount(row, minlength=rows) > 0


def slots(grams: np.ndarray, m: int) -> list[np.ndarray]:
    """The HASHES places of each trigram."""
    value = blocks.mix(grams.astype(np.uint64))
    return [((value >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF)).astype(np.int64) % m for k in range(HASHES)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n, its texts) for each batch; batch columns: text, lang."""
    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        code = langs.indices.to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in blocks.slices(*blocks.flat(batch.column(0)), 2 << 20):
            grams, row, _ = trigrams(data, offsets)
            own = code[lo:hi][row]
            for k in np.unique(own):
                order = np.lexsort((row[own == k], grams[own == k]))
                gram, place = grams[own == k][order], row[own == k][order]
                new = np.concatenate([[True], gram[1:] != gram[:-1]])
                first = np.flatnonzero(new)
                texts = np.add.reduceat((new | np.concatenate([[True], place[1:] != place[:-1]])).astype(np.int64), first)
                n = np.diff(np.append(first, len(gram)))
                yield pa.RecordBatch.from_arrays([pa.array([langs.dictionary[int(k)].as_py()] * len(first), pa.string()), pa.array(gram[first]), pa.array(n.astype(np.int64)), pa.array(texts)], ["lang", "gram", "n", "texts"])


def _place(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(slot, word, mask) of each (gram, k), k: the language's number."""
        for batch in batches:
            grams, k = (batch.column(i).to_numpy() for i in (0, 1))
            for at in slots(grams, m):
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array((k // WORD_BITS).astype(np.int32)), pa.array(np.int64(1) << (k % WORD_BITS).astype(np.int64))], ["slot", "word", "mask"])

    return run


class Filters:
    """The table of slots, the languages in the order of their bits, and each filter's filled share."""

    def __init__(self, langs: list[str], words: list[np.ndarray]):
        self.langs, self.words = langs, words
        self.m = len(words[0]) if words else LEAST_SLOTS
        self.false = np.array([(np.count_nonzero(words[k // WORD_BITS] >> (k % WORD_BITS) & 1) / self.m) ** HASHES for k in range(len(langs))])

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row; the score is the corrected share of the row's trigrams that the language has."""
        grams, row, has = trigrams(data, offsets)
        rows = len(offsets) - 1
        if not self.langs:
            return ["und"] * rows, np.zeros(rows)
        at, total = slots(grams, self.m), np.bincount(row, minlength=rows).astype(float)
        hits = np.zeros((len(self.langs), rows))
        for w, table in enumerate(self.words):
            mask = table[at[0]]
            for other in at[1:]:
                mask = mask & table[other]
            for k in range(w * WORD_BITS, min(len(self.langs), (w + 1) * WORD_BITS)):
                hits[k] = np.bincount(row, mask >> (k % WORD_BITS) & 1, rows)
        share = (hits / np.maximum(total, 1) - self.false[:, None]) / (1 - self.false[:, None] + 1e-12)
        share = np.clip(share, 0, 1)
        best = share.argmax(0)
        names = np.array(self.langs, object)[best]
        return [n if h else "und" for n, h in zip(names, has, strict=True)], np.where(has, share.max(0), 0.0)


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(frame: DataFrame, column: str = "text", lang: str = "lang") -> Filters:
    """Filters learned from all rows with text and language. Only the table of slots comes to the driver."""
    counts = frame.filter(F.col(lang).isNotNull() & F.col(column).isNotNull()).select(F.col(column).alias("text"), F.col(lang).cast("string").alias("lang")).mapInArrow(_count, "lang string, gram long, n long, texts long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    counts = blocks.stored(frame.sparkSession, counts)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted(r[0] for r in totals.select("lang").collect())
    if not langs:
        return Filters([], [])
    number = frame.sparkSession.createDataFrame([(x, k) for k, x in enumerate(langs)], "lang string, k int")
    share = counts.join(F.broadcast(totals.join(number, "lang")), "lang").withColumn("share", F.col("n") / F.col("total"))
    top = share.groupBy("gram").agg(F.max("share").alias("top"))
    kept = blocks.stored(frame.sparkSession, share.join(top, "gram").filter((F.col("share") >= RATIO * F.col("top")) & (F.col("texts") >= LEAST_ROWS)).select("gram", "k"))
    m = min(max(1 << (SPARSE * kept.count()).bit_length(), LEAST_SLOTS), MOST_SLOTS)
    table = kept.mapInArrow(_place(m), "slot int, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    blocks.drop(counts, kept)
    slot, word, mask = (table.column(i).to_numpy() for i in range(3))
    words = [np.zeros(m, np.int64) for _ in range(-(-len(langs) // WORD_BITS))]
    for w, bits in enumerate(words):
        bits[slot[word == w]] = mask[word == w]
    return Filters(langs, words)


def _predict(filters, at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = filters.value
        for batch in batches:
            langs, scores = [], []
            for _, _, data, offsets in blocks.slices(*blocks.flat(batch.column(at))):
                lang, score = own.predict(data, offsets)
                langs += lang
                scores.append(score)
            kept = batch.columns[: len(names) - 2]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], names)

    return run


def predict(frame: DataFrame, filters: Filters, column: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` (all by default) with the predicted language and the score under `names`."""
    kept = frame.columns if keep is None else keep
    rows = frame.select(*kept) if column in kept else frame.select(*kept, column)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept), f"`{names[0]}` string, `{names[1]}` double"])
    run = _predict(frame.sparkSession.sparkContext.broadcast(filters), rows.columns.index(column), [*kept, *names])
    return rows.mapInArrow(run, schema)


def accepted(frame: DataFrame, filters: Filters, column: str = "text", least: float = LEAST) -> DataFrame:
    """The rows in a known language: those with a letter and a score of at least `least`; all that have a letter if nothing was learned."""
    names = blocks.unused(frame.columns, "lang_pred"), blocks.unused(frame.columns, "score")
    judged = predict(frame, filters, column, names=names)
    return judged.filter((F.col(names[0]) != "und") & (F.col(names[1]) >= least)).drop(*names) if filters.langs else frame.filter(F.col(column).rlike(r"\p{L}"))
