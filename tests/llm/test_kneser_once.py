"""op1's model holds every pair of words, those seen once too, in one round or several."""

import collections
import math
import zlib

import numpy as np
import pytest

from tests.llm.test_operators import documents, sample, slow_tokens
from turnmill.llm import kneser


def slow_modified(texts):
    """log probability of (word before, word) in an interpolated modified Kneser-Ney model of pairs, each count with its own discount."""
    pairs, letters = collections.Counter(), collections.Counter(range(257))
    for t in texts:
        words = slow_tokens(t)
        letters.update(b for w in words[:-1] for b in w.encode())
        letters[256] += len(words)
        pairs.update(zip(["<s>", *words], words))
    follows = collections.Counter(b for _, b in pairs)
    discounts = [kneser.discounts([sum(c == k for c in grams.values()) for k in range(1, 5)]) for grams in (follows, pairs)]
    own = collections.defaultdict(list)
    for (a, _), c in pairs.items():
        own[a].append(c)

    def mixed(c, counts, d, below):
        if not counts:
            return below
        less = lambda x: d[min(x, 3) - 1]
        return ((c - less(c) if c else 0) + sum(map(less, counts)) * below) / sum(counts)

    every = letters.total()

    def p(a, b):
        spelt = math.prod([letters[x] / every for x in (b.encode() if b != "</s>" else b"")] + [letters[256] / every])
        return math.log(mixed(pairs[a, b], own.get(a), discounts[1], mixed(follows[b], list(follows.values()), discounts[0], spelt)))

    return p, pairs


@pytest.mark.parametrize("round_keys", [1 << 20, 16])
def test_pairs_seen_once_are_modelled(spark, monkeypatch, round_keys):
    monkeypatch.setattr(kneser, "ROUND_KEYS", round_keys)
    rows = [(i, t[:200], lang, s) for i, t, lang, s in sample(5, 40)] + [(41 + i, t, "en", "s") for i, t in enumerate((" \n", "a", "A a a a", "a", "once seen", "unseen 123"))]
    rows += [rows[2], rows[2], (60, None, "en", "s"), (61, "", None, "s"), (None, "a", "en", "s")]
    good = [i for i in range(40) if i % 2] + [43, 45]
    trusted = spark.createDataFrame([(i,) for i in good], "_trusted long")
    p, pairs = slow_modified([t for i, t, *_ in rows[:46] if i in good and zlib.crc32(str(i).encode()) % kneser.HOLD_OUT])
    assert sum(c == 1 for c in pairs.values()) > 20
    want = []
    for i, t, *_ in rows:
        words = slow_tokens(t)
        want.append((str(i), len(t or ""), math.exp(-sum(p(a, b) for a, b in zip(["<s>", *words], words)) / len(t)) if t else None))
    got = sorted(((str(r["doc_id"]), r["n_chars"], r["perplexity"]) for r in kneser.judge(documents(spark, rows), trusted).collect()), key=lambda r: r[:2])
    for mine, theirs in zip(got, sorted(want, key=lambda r: r[:2]), strict=True):
        assert mine[:2] == theirs[:2] and mine[2] == (theirs[2] and pytest.approx(theirs[2], rel=1e-4))


@pytest.mark.parametrize("most", [1, 1 << 31, 1 << 40])
@pytest.mark.parametrize("size", [1, 500])
def test_pairs_come_back(size, most):
    rng = np.random.default_rng(size)
    one, two = np.sort(rng.integers(0, 1 << kneser.BITS, size, np.uint64)), rng.integers(0, 40, size, np.uint64) << np.uint64(42)
    n = rng.integers(1, most + 1, size)
    back = kneser._unpack_pairs(kneser._pack_pairs(one, two, n))
    assert [x.tolist() for x in back] == [one.tolist(), two.tolist(), n.tolist()]
