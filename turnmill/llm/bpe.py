"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word exactly one token can stand last in the word's BPE
encoding. An automaton (a trie of all tokens with suffix links) lists the tokens
that end at a place, longest first; the one that is compatible with the last
token of the prefix before it is stored. Following those back from the end gives
the ids that merging in rank order gives.

Two neighbouring tokens are compatible if merging never joins symbols across
their border: going back through the merges that made both, the two symbols at
the border must at no time have a merge that comes before the next merge of
either.

All words of a batch advance together in numpy. White-space-separated chunks are
looked up by a 64-bit hash in a table of bounded size per worker, so each chunk
is split and encoded once until the table is full and starts anew; chunks of up
to 7 bytes cannot collide, and among the table's longer ones the chance is some
10^-7. Normalising and splitting chunks is the tokenizers library's, by the file's own rules.

Cases: a null or empty text has no ids; special tokens' strings in a text give
their ids, as in the library; unknown bytes do not occur, all 256 are symbols.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

TABLE_CHUNKS = 1_500_000
TABLE_WORDS = 100_000
SLICE = 1 << 20
#: Longer words are encoded one by one, so that few long words do not make many steps of few words.
LONG_WORD = 256
#: Chunks are also cut between ASCII letters and these marks, where the file's pattern always splits; bytes are lower-cased first.
KINDS = np.zeros(256, np.uint8)
KINDS[97:123] = 1
KINDS[[33, 44, 46, 58, 59, 63]] = 2
NEVER = np.int32(2**31 - 1)


class Merges:
    """The vocabulary's tokens, their merges, and the compatibility of neighbours."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        self.n, self.end = max(vocab.values()) + 1, end
        self.rank = np.full(self.n, -1, np.int32)
        self.left = np.zeros(self.n, np.int32)
        self.right = np.zeros(self.n, np.int32)
        keys = np.empty(len(merges), np.int64)
        self.made = np.empty(len(merges), np.int32)
        for k, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            keys[k], self.made[k] = x * self.n + y, z
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = k, x, y
        order = np.argsort(keys, kind="stable")
        self.keys, self.order = keys[order], order.astype(np.int32)
        self.seen = np.full(1 << 21, -1, np.int64)
        self.ranks: dict[int, int] = {}

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NEVER)

    def _apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray) -> np.ndarray:
        """Whether tokens a and b come to stand side by side, with no merge across their border before rank `until`."""
        a, b, good = a.copy(), b.copy(), np.ones(len(a), bool)
        next_a, next_b = until.copy(), until.copy()
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self._merge(x, y)
            bad = (across < next_a[live]) & (across <= next_b[live]) & (across < until[live])
            good[live[bad]] = False
            go = ~bad & ((self.rank[x] >= 0) | (self.rank[y] >= 0))
            live, x, y = live[go], x[go], y[go]
            undo = self.rank[x] > self.rank[y]
            i, j = live[undo], live[~undo]
            next_a[i], a[i] = self.rank[x[undo]], self.right[x[undo]]
            next_b[j], b[j] = self.rank[y[~undo]], self.left[y[~undo]]
        return good

    def reachable(self) -> np.ndarray:
        """Tokens that merging their own symbols gives."""
        good = np.ones(self.n, bool)
        made = np.flatnonzero(self.rank >= 0)
        good[made] = self._apart(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])]:
            good[t] &= good[self.left[t]] and good[self.right[t]]
        return good

    def follows(self, a: int, b: int) -> bool:
        """Whether b can follow a, for one pair."""
        if not self.ranks:
            self.ranks = dict(zip(self.keys.tolist(), self.order.tolist(), strict=True))
            self.parts = self.rank.tolist(), self.left.tolist(), self.right.tolist()
        rank, left, right = self.parts
        next_a = next_b = never = int(NEVER)
        while True:
            across = self.ranks.get(a * self.n + b, never)
            if across < next_a and across <= next_b:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                next_a, a = rank[a], right[a]
            else:
                next_b, b = rank[b], left[b]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether b can follow a; answers are kept in a direct-mapped table of (pair, answer)."""
        key = a.astype(np.int64) * self.n + b
        slot = (blocks.mix(key.astype(np.uint64)) >> np.uint64(43)).astype(np.int64)
        kept = self.seen[slot]
        out = (kept & 1).astype(bool)
        miss = np.flatnonzero(kept >> 1 != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            good = self._apart((new // self.n).astype(np.int32), (new % self.n).astype(np.int32), np.full(len(new), NEVER))
            out[miss] = good[back]
            self.seen[slot[miss]] = key[miss] << 1 | out[miss]
        return out


class Automaton:
    """A trie of tokens over symbols with suffix links. `token` is the longest token that ends in a state, `shorter` the next shorter
    token that ends where a token does. Transitions are a sorted array of (state, symbol); the root has one for every symbol."""

    def __init__(self, spelled: dict[int, list[int]], n_symbols: int, n_tokens: int):
        children: list[dict[int, int]] = [{}]
        final: dict[int, int] = {}
        for token, symbols in spelled.items():
            state = 0
            for s in symbols:
                nxt = children[state].get(s)
                if nxt is None:
                    nxt = children[state][s] = len(children)
                    children.append({})
                state = nxt
            final[state] = token
        n = len(children)
        self.width = n_symbols
        self.token = np.full(n, -1, np.int32)
        self.suffix = np.zeros(n, np.int32)
        self.shorter = np.full(n_tokens, -1, np.int32)
        edges: list[tuple[int, int]] = []
        queue = [0]
        for state in queue:
            if state:
                self.token[state] = self.token[self.suffix[state]]
                if state in final:
                    self.shorter[final[state]] = self.token[state]
                    self.token[state] = final[state]
            for s, child in children[state].items():
                edges.append((state * n_symbols + s, child))
                link = int(self.suffix[state])
                while state and link and s not in children[link]:
                    link = int(self.suffix[link])
                self.suffix[child] = children[link].get(s, 0) if state else 0
                queue.append(child)
        edges.sort()
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.next = np.array([c for _, c in edges], np.int32)

    def advance(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states after one more symbol each: along suffix links until there is a transition."""
        out = np.zeros(len(state), np.int32)
        state, todo = state.copy(), np.arange(len(state))
        while len(todo):
            key = state[todo].astype(np.int64) * self.width + symbol[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[todo[hit]] = self.next[at[hit]]
            todo = todo[~hit & (state[todo] > 0)]
            state[todo] = self.suffix[state[todo]]
        return out


class Encoder:
    """Encodes words (strings of byte symbols) and chunks with the file at `path`."""

    def __init__(self, path: str, by_library: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library, self.by_library = Tokenizer.from_file(path), by_library
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.n_ids = max([*vocab.values(), *self.special.values()]) + 1
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.clear()
        self.at_end = np.zeros(self.n_ids, bool)
        self.at_end[[i for t, i in vocab.items() if end and t.endswith(end)]] = True
        self.edges: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        if by_library:
            return
        self.merges = Merges(vocab, model["merges"], end)
        # Symbols: each character inside a word, and each as a word's last.
        chars = sorted({t for t in vocab if len(t) == 1})
        self.symbol = {c: k for k, c in enumerate(chars)}
        self.n_chars = len(chars)
        good = self.merges.reachable()
        spelled: dict[int, list[int]] = {}
        self.size = np.ones(self.merges.n, np.int32)
        for t, i in vocab.items():
            last = bool(end) and t.endswith(end)
            plain = t[: len(t) - len(end)] if last else t
            if good[i] and plain and all(c in self.symbol for c in plain):
                symbols = [self.symbol[c] for c in plain]
                if last:
                    symbols[-1] += self.n_chars
                spelled[i] = symbols
                self.size[i] = len(symbols)
        self.ends = bool(end)
        self.automaton = Automaton(spelled, 2 * self.n_chars, self.merges.n)
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

    def clear(self) -> None:
        """An empty table of chunks and words."""
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.bounds = np.zeros(0, np.uint16 if self.n_ids <= 1 << 16 else np.uint32), np.zeros(1, np.int64)
        self.word_ids: dict[str, tuple[int, ...]] = {}

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The ids of each word. The last token of every prefix stands in one flat array, so memory follows the words' total length."""
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        out: list = [None] * len(words)
        while order and len(words[order[0]]) > LONG_WORD:
            k = order.pop(0)
            out[k] = self.encode_long(words[k])
        sizes = np.array([len(words[k]) for k in order], np.int64)
        symbols = np.array([self.symbol[c] for k in order for c in words[k]], np.int64)
        first = np.cumsum(sizes) - sizes
        if self.ends:
            symbols[first + sizes - 1] += self.n_chars
        n, longest = len(order), int(sizes[0]) if order else 0
        last = np.zeros(len(symbols), np.int32)
        state = np.zeros(n, np.int32)
        auto = self.automaton
        for i in range(1, longest + 1):
            live = int(np.searchsorted(-sizes, -i, "right"))
            state = auto.advance(state[:live], symbols[first[:live] + i - 1])
            token = auto.token[state]
            todo = np.arange(live)
            while len(todo):
                t = token[todo]
                start = i - self.size[t]
                ok = start == 0
                rest = np.flatnonzero(~ok)
                ok[rest] = self.merges.compatible(last[first[todo[rest]] + start[rest] - 1], t[rest])
                last[first[todo[ok]] + i - 1] = t[ok]
                todo = todo[~ok]
                token[todo] = auto.shorter[token[todo]]
        sizes_of = self.size
        for at, size, k in zip(first.tolist(), sizes.tolist(), order, strict=True):
            own, ids = last[at : at + size], []
            while size:
                t = int(own[size - 1])
                ids.append(t)
                size -= int(sizes_of[t])
            out[k] = tuple(reversed(ids))
        return out

    def encode_long(self, word: str) -> tuple[int, ...]:
        """The ids of one long word, place by place."""
        auto, known = self.automaton, self.pairs
        suffix, token, shorter, size = (x.tolist() for x in (auto.suffix, auto.token, auto.shorter, self.size))
        if not self.edges:
            self.edges = dict(zip(auto.keys.tolist(), auto.next.tolist(), strict=True))
        if len(known) > TABLE_CHUNKS:
            known.clear()
        last, state, end = array("i", bytes(4 * len(word))), 0, len(word)
        for i, c in enumerate(word, 1):
            symbol = self.symbol[c] + (self.n_chars if self.ends and i == end else 0)
            while (to := self.edges.get(state * auto.width + symbol)) is None and state:
                state = suffix[state]
            state = to or 0
            t = token[state]
            while (start := i - size[t]) > 0:
                pair = last[start - 1] * self.merges.n + t
                if pair not in known:
                    known[pair] = self.merges.follows(last[start - 1], t)
                if known[pair]:
                    break
                t = shorter[t]
            last[i - 1] = t
        ids = []
        while end:
            ids.append(last[end - 1])
            end -= size[last[end - 1]]
        return tuple(reversed(ids))

    def _split(self, chunk: str) -> list:
        """The words of a chunk, as strings of byte symbols; special tokens as ids."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk.isprintable() and "<|" not in chunk:
                return self.plain.findall(chunk.lower())
        parts = self.at_special.split(chunk) if self.at_special else [chunk]
        out: list = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        return out

    def chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks and each one's number of ids: by this module, or by the library itself."""
        if self.by_library:
            return self._library_ids(chunks)
        split = [self._split(c) for c in chunks]
        new = list({w for ws in split for w in ws if isinstance(w, str) and w not in self.word_ids})
        for lo in range(0, len(new), 1 << 16):
            part = new[lo : lo + (1 << 16)]
            self.word_ids.update(zip(part, self.encode_words(part), strict=True))
        known = self.word_ids
        ids = [[i for w in ws for i in ((w,) if isinstance(w, int) else known[w])] for ws in split]
        return np.fromiter((i for x in ids for i in x), self.flat.dtype), np.array([len(x) for x in ids], np.int64)

    def _library_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks of letters are words, whose ids end at their only end-of-word token: many go into one text. If a text has another
        number of such tokens, and for other chunks, each chunk is a text."""
        flat, lengths = [], np.zeros(len(chunks), np.int64)
        letters = np.fromiter((c.isalpha() for c in chunks), bool, len(chunks)) if self.at_end.any() else np.zeros(len(chunks), bool)
        words, others = np.flatnonzero(letters), np.flatnonzero(~letters).tolist()
        groups = [words[lo : lo + 256] for lo in range(0, len(words), 256)]
        order = []
        for lo in range(0, len(groups), 64):
            part = groups[lo : lo + 64]
            for group, found in zip(part, self.library.encode_batch_fast([" ".join([chunks[k] for k in g]) for g in part], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, self.flat.dtype)
                ends = np.flatnonzero(self.at_end[ids])
                if len(ends) != len(group):
                    others += group.tolist()
                    continue
                flat.append(ids)
                order.append(group)
                lengths[group] = np.diff(ends, prepend=-1)
        for lo in range(0, len(others), 8192):
            part = others[lo : lo + 8192]
            for k, found in zip(part, self.library.encode_batch_fast([chunks[k] for k in part], add_special_tokens=False), strict=True):
                flat.append(np.array(found.ids, self.flat.dtype))
                lengths[k] = len(flat[-1])
        order = np.concatenate([*order, np.array(others, np.int64)]) if chunks else np.zeros(0, np.int64)
        start = np.zeros(len(chunks), np.int64)
        start[order] = np.cumsum(lengths[order]) - lengths[order]
        return (np.concatenate(flat) if flat else self.flat[:0])[blocks.spread(start, lengths)], lengths

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, and the rows' offsets in them."""
        return self.encode_terms(data, offsets)[:2]

    def encode_terms(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All rows' ids and the rows' offsets in them; each chunk's hash, and the rows' offsets in those."""
        data, starts, ends, bounds = _chunks(data, offsets)
        wanted, where, back = np.unique(blocks.hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, wanted)
        new = np.flatnonzero((at == len(self.keys)) | (self.keys[np.minimum(at, len(self.keys) - 1)] != wanted)) if len(self.keys) else np.arange(len(wanted))
        if len(new):
            if len(self.keys) + len(new) > TABLE_CHUNKS and len(self.keys):
                self.clear()
                new = np.arange(len(wanted))
            ids, lengths = self.chunk_ids([data[starts[k] : ends[k]].tobytes().decode("utf-8") for k in where[new]])
            places = len(self.bounds) - 1 + np.arange(len(new))
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lengths)])
            self.flat = np.concatenate([self.flat, ids])
            at = np.searchsorted(self.keys, wanted[new])
            self.keys, self.places = np.insert(self.keys, at, wanted[new]), np.insert(self.places, at, places)
            if len(self.word_ids) > TABLE_WORDS:
                self.word_ids = {}
        place = self.places[np.searchsorted(self.keys, wanted)][back] if len(wanted) else np.zeros(0, np.int64)
        lengths = self.bounds[place + 1] - self.bounds[place]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[blocks.spread(self.bounds[place], lengths)], total[bounds], wanted[back], bounds


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The bytes, lower-cased unless special tokens may be in them (those are matched before), with the chunks' starts, ends and bounds."""
    if data.tobytes().find(b"<|") < 0:
        data = blocks.LOWER[data]
    return data, *blocks.words(data, offsets, kinds=KINDS)


def chunk_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's hash, and the rows' offsets in those."""
    data, starts, ends, bounds = _chunks(data, offsets)
    return blocks.hashes(data, starts, ends), bounds


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_library: bool = False) -> Encoder:
    """This process's encoder for the file."""
    if (path, by_library) not in _encoders:
        _encoders[path, by_library] = Encoder(path, by_library)
    return _encoders[path, by_library]


_names: dict[str, list[str]] = {}


def names(path: str) -> list[str]:
    """The file's tokens by id."""
    if path not in _names:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        by_id = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        _names[path] = [by_id.get(i, "") for i in range(max(by_id) + 1)]
    return _names[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for lo, hi, data, offsets in blocks.slices(*blocks.flat(batch.column(1)), SLICE):
                ids, bounds = own.encode(data, offsets)
                values = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], values], ["id", "ids"])

    return run


def encode(frame: DataFrame, path: str, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, ids): the token ids of each whole text."""
    return frame.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("string").alias("text")).mapInArrow(_encode(path), "id long, ids array<int>")


def _decode(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [n.encode() for n in names(path)]
        decimal = [str(i).encode() for i in range(len(raw))]
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                lists = part.column(1)
                bounds = lists.offsets.to_numpy()
                values = lists.values.to_numpy()
                rows = [values[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                texts = (b" ".join([raw[i] for i in row]) for row in rows)
                if digest:
                    columns = [
                        pa.array([len(row) for row in rows], pa.int64()),
                        pa.array([hashlib.sha256(b" ".join([decimal[i] for i in row])).hexdigest() for row in rows], pa.string()),
                        pa.array([hashlib.sha256(text).hexdigest() for text in texts], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(texts), pa.binary()).cast(pa.string())], ["id", "text"])

    return run


def decode(ids: DataFrame, path: str) -> DataFrame:
    """(id, text): the ids' tokens joined by spaces, as the library decodes a file without a decoder."""
    return ids.select("id", "ids").mapInArrow(_decode(path, False), "id long, text string")


def digests(ids: DataFrame, path: str) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoded rows."""
    return ids.select("id", "ids").mapInArrow(_decode(path, True), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
