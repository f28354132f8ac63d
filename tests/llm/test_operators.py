"""Each operator on small tables, against brute force, exact round trips or held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("turnmill.llm")
from turnmill.llm import bpe, components, jaccard, kneser, langid, licenses, lines, media, packing, preference, slots, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and is that it with for was on are this be at by".split(), "de": "der die und das ist von mit sich den auf für nicht als ein".split()}


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], DOCS)


def sample(seed=0, n=120):
    rng = random.Random(seed)
    syllables = {"en": ["th", "er", "ing", "ou", "wh", "sh", "tion"], "de": ["sch", "ei", "ung", "ü", "pf", "tz", "ä"]}
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        words = [rng.choice(WORDS[lang]) if rng.random() < 0.4 else "".join(rng.choice(syllables[lang]) for _ in range(rng.randint(2, 4))) for _ in range(rng.randint(5, 160))]
        rows.append((i, " ".join(words), lang, f"s{i % 4}"))
    return rows


ODD = [(None, "x y z", None, None), (9001, None, "en", "s0"), (9002, "", "en", "s0"), (9003, " \n\t", None, "s0"), (9004, "1 2 3", "en", None), (9005, "A", "en", "s0"), (9006, "wort " * 30000, "de", "s0"), (9005, "A", "en", "s0"), (9007, "日本語 😀 \x00 z", "ja", "s1")]


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


# Media.


def test_tables():
    assert media.MULAW[0xFF] == 0 and media.MULAW[0x00] == -32124 and media.MULAW[0x80] == 32124
    assert media.ALAW[0xD5] == 8 and media.ALAW[0x55] == -8 and media.ALAW[0xAA] == 32256
    assert sorted(set(np.abs(media.MULAW.astype(int))))[1] == 8


def ima_slow(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), block[2]
    out = [value]
    for b in block[4:]:
        for code in (b & 15, b >> 4):
            step = int(media.STEPS[index])
            delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value + (-delta if code & 8 else delta)))
            index = max(0, min(88, index + int(media.CHANGES[code & 7])))
            out.append(value)
    return out


def test_ima_equals_the_loop():
    blocks = np.random.default_rng(0).integers(0, 256, (20, 68), dtype=np.uint8)
    blocks[:, 2] %= 89
    assert media.decode_ima(blocks).tolist() == [ima_slow(b.tobytes()) for b in blocks]


@pytest.mark.parametrize("codec", media.CODECS)
def test_wav_round_trip(codec):
    payload = bytes(range(256)) * 3
    assert media.payload_of(media.to_wav(payload, codec)) == payload


def test_media_table(spark):
    frame = documents(spark, sample(n=30) + ODD)
    files = media.store(frame)
    got = media.read(files)
    by_id = collections.defaultdict(set)
    for r in got.collect():
        by_id[r["id"]].add((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], bool(r["pcm"][:4] == b"RIFF")))
    for i, text, *_ in sample(n=30) + ODD:
        raw = (text or "").encode()
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), True) in by_id[i]
    assert media.read(media.store(frame.limit(0))).count() == 0


def slow_feature(payload):
    """The feature, sample by sample."""
    codec = media.CODECS[zlib.crc32(payload) % 3]
    if codec == "ima":
        pcm = [v for lo in range(0, len(payload), 64) for v in ima_slow(bytes(4) + payload[lo : lo + 64])]
    else:
        pcm = [int({"mulaw": media.MULAW, "alaw": media.ALAW}[codec][b]) for b in payload]
    at = lambda k: pcm[min(max(k, 0), len(pcm) - 1)]
    out = [v for k in range(len(pcm)) for v in (pcm[k], max(-32768, min(32767, (9 * (at(k) + at(k + 1)) - at(k - 1) - at(k + 2) + 8) >> 4)))]
    rms = math.sqrt(sum(v * v for v in out) / len(out))
    crossings = sum((a < 0) != (b < 0) for a, b in zip(out, out[1:], strict=False))
    return codec, len(out), rms, max(map(abs, out)), crossings, zlib.crc32(np.array(out, "<i2").tobytes())


def test_query_stores_media_and_pcm(spark, tmp_path, monkeypatch):
    from turnmill.llm import blocks, queries

    rows = [r for r in sample(n=30) + ODD if r[0] != 9006]
    documents(spark, rows).withColumn("media", F.lit("clash")).withColumn("pcm", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    kept, stored = [], blocks.stored
    monkeypatch.setattr(blocks, "stored", lambda *a: kept.append(stored(*a)) or kept[-1])
    monkeypatch.setattr(media, "GROUP_BYTES", 700)
    got = queries.op3_telephony_audio(spark, str(tmp_path)).collect()
    assert kept[0].count() == len(got) == len(rows)
    by_payload = {r["payload_sha256"]: r for r in got}
    for _, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        row = by_payload[hashlib.sha256(payload).hexdigest()]
        codec, samples, rms, peak, crossings, crc = slow_feature(payload)
        found = dict(x.split("=") for x in row["feature"].split(";")[1:])
        assert row["feature"].split(";")[0] == codec and abs(int(found.pop("rms")) - rms) <= 1
        assert found == {"samples": str(samples), "peak": str(peak), "crossings": str(crossings), "pcm": f"{crc:08x}"}
        assert row["pcm"][:4] == b"RIFF" and zlib.crc32(media.from_wav(bytes(row["pcm"]))[3]) == crc
    assert {bytes(r["media"][:4]) for r in kept[0].collect()} == {b"RIFF"}


# URLs.


def judged(entries, url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [e for e in entries if (host == e[: e.index("/")] or host.endswith("." + e[: e.index("/")])) and path.startswith(e[e.index("/") :])]
    return host, path, max(fits, key=len, default=None)


URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/1", "https://example.org/en/12?x#y", "http://example.orgx/es/", "http://org/", "http://x.com/de/a", "http://com", "a://b://c.org/", "http://x.com/fr/\nz", "http://ExämpleÀ.com/de/", "http://..org/es/"]
ENTRIES = ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"]


def test_urls_both_ways(spark):
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 2)], "page_id long, url string, entry string")
    parts = urls.with_parts(frame)
    want = [judged(ENTRIES, u) for u in URLS * 2]
    for limit in (urls.MAX_LIST_BYTES, 1):
        got = [tuple(r) for r in urls.judge(parts, ENTRIES, limit).orderBy("page_id").select("host", "path", "entry").collect()]
        assert got == want
    assert urls.judge(parts.limit(0), ENTRIES).count() == 0


def test_digest_collisions_are_confirmed():
    array = urls.DigestArray(np.frombuffer(urls.DigestArray.build(["a/", "b/"]), np.uint8))
    forged = array.digests.copy()
    forged[:] = forged[0]
    array.digests = forged
    assert array.contains(["a/", "b/"]).sum() >= 1 and not array.contains(["c/"])[0]


# Preference pairs.


def test_preference(spark):
    u, a, b = ("user", "q"), ("assistant", "yes"), ("assistant", "no")
    data = [(1, [u, a], [u, b]), (2, [u, a], [u, a]), (3, None, [u]), (4, [u], []), (5, [(None, None), a], [(None, None), b, u])]
    frame = spark.createDataFrame(data, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    got = {r["pair_id"]: r for r in preference.format_pairs(frame).collect()}
    assert (got[1]["prompt"], got[1]["chosen"], got[1]["chosen_mask"]) == ("<|user|>\nq\n", "<|assistant|>\nyes\n", "-14,+3,-1")
    assert (got[2]["n_prompt_turns"], got[2]["chosen"], got[2]["rejected"]) == (2, "", "")
    assert got[3]["prompt"] == "" and got[3]["rejected"] == "<|user|>\nq\n"
    assert got[5]["prompt"] == "<|unknown|>\n\n" and got[5]["rejected_mask"].count("+") == 1
    for r in got.values():
        for side in ("chosen", "rejected"):
            assert sum(int(x[1:]) for x in r[f"{side}_mask"].split(",") if x) == len(r[side])


def test_reply_pairs(spark):
    data = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (1, 0, "assistant", "c"), (1, 1, "user", "d"), (2, 0, "user", "e"), (3, 0, "assistant", None), (None, 0, "assistant", "x"), (0, 1, "assistant", "b")]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in preference.reply_pairs(frame).collect()}
    assert sorted(got) == [0, 1, 3]
    assert [t["text"] for t in got[0]["chosen"]] == ["a", "b", "b"] and [t["text"] for t in got[0]["rejected"]] == ["a", "b", "c"]
    assert [t["text"] for t in got[3]["rejected"]] == []


# Licenses.


def phrase_places(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    return len(words), len(found), min((k for k, _ in found), default=None), max((k for k, _ in found), default=None), ",".join(sorted({x for _, x in found}))


TEXTS = ["Apache License, Version 2.0 and the MIT-License", "cc-by cc by-sa 4.0 CC BY", "GNU General\nPublic   LICENSE version 3 or later", "permission is hereby granted, free of charge, to any person obtaining a copy", "accby ccé by", "\u212aapache license", "all rights reserved, mit license mit license", "éapache license", "GPL v2 only"]


def test_licenses(spark):
    data = [*enumerate(TEXTS), (50, None), (51, ""), (52, "..."), (53, "mit license " * 5000)]
    got = {r["i"]: r for r in licenses.scan(spark.createDataFrame(data, "i int, text string")).collect()}
    for i, t in data:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == phrase_places(t), t
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[0]["labels"] == "apache,apache-2.0,mit"
    assert "cc-by-sa-4.0" in got[1]["labels"] and "cc-by-sa," not in got[1]["labels"] + ","
    assert got[3]["labels"] == "mit" and got[8]["labels"] == "gpl-2-only"


def test_suppression_leaves_no_covered_detection(spark):
    got = licenses.scan(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    for r in got.collect():
        found = r["detections"]
        assert not any(a != b and a["start"] <= b["start"] and a["end"] >= b["end"] and a["priority"] > b["priority"] for a in found for b in found)


def test_every_rule_passes_the_gate():
    assert len(licenses.rules()) > 200
    for keyword, regex, *_ in licenses.rules():
        assert keyword in regex and (regex.startswith("cc by") or any(s in regex for s in licenses.STEMS))


# Lines.


def base_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    own = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(own) - len(set(own)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_rules(spark):
    rng = random.Random(1)
    data = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 90))) + rng.choice(["", "\nx y\nx y", "#|é"])) for i in range(60)] + [(r[0], r[1]) for r in ODD] + [(7000, "a b c " * 7000)]
    got = lines.with_base(spark.createDataFrame(data, "doc_id long, text string"))
    have = rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert have == sorted(((i, *base_rules(t)) for i, t in data), key=str)


def test_frequent_lines_deplete(spark):
    body = " ".join(f"w{k}" for k in range(60))
    data = [(i, f"{body} {i}\nShared Menu  line", "en", "h") for i in range(30)] + [(100 + i, "\n".join(["shared menu line"] * 30) + f"\nown {' '.join(f'u{i}x{k}' for k in range(20))}", "en", "h") for i in range(3)] + [(200, body + " other host\nshared menu line", "en", "g")]
    got = {r["doc_id"]: r["kept"] for r in lines.judge(documents(spark, data)).collect()}
    assert all(got[i] for i in range(30)) and got[200] and not any(got[100 + i] for i in range(3))
    cleaned = {r["doc_id"]: r["text"] for r in lines.clean(documents(spark, data)).collect()}
    assert "menu" not in cleaned[3].lower() and "menu" in cleaned[200] and lines.judge(documents(spark, []), "text").count() == 0


def test_copies_count_once(spark):
    text = "\n".join(" ".join(f"w{j}x{k}" for k in range(30)) for j in range(4))
    got = lines.judge(documents(spark, [(i, text, "en", "h") for i in range(40)]))
    assert {r["kept"] for r in got.collect()} == {True}


# BPE.


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_bpe_equals_the_library(spark, path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    data = [(i, t) for i, t, *_ in sample(n=40) + ODD] + [(500, "It's <|endoftext|> DON'T <|ENDOFTEXT|> a<|startoftext|>b,c.d;e 12,5 é, ẛ̣ İ ǅ z"), (501, "a" * 3000 + " !!!! ,,,, a,b'll")]
    ids = bpe.encode(spark.createDataFrame(data, "doc_id long, text string"), path)
    got = bpe.digests(ids, path)
    want = []
    for i, t in data:
        e = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert rows_of(got, "id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    assert bpe.decode(ids, path).filter("id = 500").first()["text"] == library.decode(library.encode(data[-2][1], add_special_tokens=False).ids, skip_special_tokens=False)


def test_bpe_on_random_words(path):
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(path), bpe.Encoder(path), random.Random(2)
    words = list({"".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 30))) for _ in range(3000)})
    assert [list(x) for x in own.encode_words(words)] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_tables_start_anew(path, monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_CHUNKS", 50)
    import pyarrow as pa

    own, column = bpe.Encoder(path), pa.array([t for _, t, *_ in sample(n=40)])
    from turnmill.llm import blocks

    whole = bpe.Encoder(path).encode(*blocks.flat(column))
    parts = [own.encode(d, o)[0] for _, _, d, o in blocks.slices(*blocks.flat(column), 200)]
    assert np.concatenate(parts).tolist() == whole[0].tolist()


# Language.


def test_languages(spark):
    frame = documents(spark, sample(n=240) + ODD)
    filters = langid.fit(frame.withColumn("held", langid.held_out()).filter("not held"))
    got = langid.predict(frame.withColumn("score", F.lit("clash")), filters, names=("lang_pred", "score_"))
    rows = got.collect()
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 9000 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 30 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    odd = {(r["doc_id"], r["text"]): r["lang_pred"] for r in rows}
    assert odd[9001, None] == odd[9002, ""] == odd[9003, " \n\t"] == odd[9004, "1 2 3"] == "und"
    assert odd[9006, "wort " * 30000] == "de" and odd[9007, "日本語 😀 \x00 z"] in filters.langs
    assert all(0 <= r["score_"] <= 1 and r["score"] == "clash" for r in rows)
    none = langid.fit(frame.limit(0))
    assert none.langs == [] and {r["lang_pred"] for r in langid.predict(frame, none).collect()} == {"und"}
    assert "score" in langid.accepted(frame.withColumn("score", F.lit(1)), filters).columns


def slow_trigrams(text):
    low = []
    for c in text:
        small = c.lower()
        low.append(" " if not c.isalpha() else small if len(small) == 1 else c)
    padded = [" ", *low, " "]
    return ["".join(padded[k : k + 3]) for k, c in enumerate(text) if c.isalpha()]


def slow_mix(x):
    most = (1 << 64) - 1
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & most
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & most
    return x ^ x >> 31


@pytest.mark.parametrize("most", [1 << 8, 1 << 23])
def test_languages_equal_brute_force(spark, monkeypatch, most):
    """Languages and scores, with filters that are nearly full and with sparse ones."""
    monkeypatch.setattr(langid, "LEAST_SLOTS", 1 << 6)
    monkeypatch.setattr(langid, "MOST_SLOTS", most)
    rows = sample(3, 60) + [r for r in ODD if r[0] != 9006] + [(500, "le éœ ÀB İx", "fr", "s"), (501, "le éœ", "fr", "s")]
    frame = documents(spark, rows)
    counts, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang, _ in rows:
        if text is not None and lang is not None:
            counts[lang].update(slow_trigrams(text))
            texts.update((lang, g) for g in set(slow_trigrams(text)))
    learned = sorted(x for x in counts if counts[x])
    share = {(x, g): n / sum(counts[x].values()) for x in learned for g, n in counts[x].items()}
    kept = [(x, g) for (x, g), s in share.items() if texts[x, g] >= 2 and s >= langid.RATIO * max(share.get((y, g), 0) for y in learned)]
    m = min(max(1 << (16 * len(kept)).bit_length(), 1 << 6), most)

    def places(g):
        value = slow_mix(ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]))
        return (value & 0xFFFFFFFF) % m, (value >> 32) % m

    bits = {x: {p for y, g in kept if y == x for p in places(g)} for x in learned}
    filters = langid.fit(frame)
    assert filters.langs == learned and filters.m == m
    got = langid.predict(frame, filters).collect()
    for r in got:
        grams = slow_trigrams(r["text"] or "")
        if not grams:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        scores = {}
        for x in learned:
            false = (len(bits[x]) / m) ** 2
            scores[x] = (sum(all(p in bits[x] for p in places(g)) for g in grams) / len(grams) - false) / (1 - false + 1e-12)
        scores = {x: min(max(s, 0), 1) for x, s in scores.items()}
        top = max(scores.values())
        assert scores[r["lang_pred"]] > top - 1e-9 and abs(r["score"] - top) < 1e-9


def test_bits_beyond_one_word(spark):
    rows = [(i, f"{chr(0x4E00 + i % 70)}{chr(0x5E00 + i % 70)}{chr(0x6E00 + i % 70)}" * 3, f"l{i % 70:02d}", "s") for i in range(140)]
    frame = documents(spark, rows)
    filters = langid.fit(frame)
    assert len(filters.langs) == 70 and len(filters.words) == 2
    assert all(r["lang"] == r["lang_pred"] for r in langid.predict(frame, filters).collect())


# Kneser-Ney.


def slow_tokens(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^ \t-\r]+", text or "")]
    return [*words, "</s>"] if text else []


def slow_model(texts):
    pairs = collections.Counter()
    letters = collections.Counter({k: 1 for k in range(257)})
    for t in texts:
        words = slow_tokens(t)
        letters.update(b for w in words[:-1] for b in w.encode())
        letters[256] += len(words)
        pairs.update(zip(["<s>", *words], words))
    grams = [None, collections.Counter(g[1:] for g in pairs), pairs]
    d = [None] + [kneser.discounts([sum(1 for c in grams[n].values() if c == k) for k in range(1, 5)]) for n in (1, 2)]
    d[2][0] = 1.0

    def p(g, spelt):
        n = len(g)
        if n == 0:
            return spelt
        own = {h: c for h, c in grams[n].items() if h[:-1] == g[:-1]}
        if not own:
            return p(g[1:], spelt)
        total = sum(own.values())
        less = lambda c: d[n][min(c, 3) - 1]
        return max(own.get(g, 0) - less(own.get(g, 1)), 0) / total + sum(map(less, own.values())) / total * p(g[1:], spelt)

    every = sum(letters.values())
    spell = lambda w: math.prod([letters[b] / every for b in (w.encode() if w != "</s>" else b"")] + [letters[256] / every])
    return lambda g: p(g, spell(g[-1]))


def test_perplexity_equals_brute_force(spark):
    rows = [(i, t[:200], lang, s) for i, t, lang, s in sample(5, 40)] + [(41 + i, t, "en", "s") for i, t in enumerate((" \n", "a", "A a a a", "unseen words 123"))] + [r for r in ODD if r[0] != 9006]
    frame = documents(spark, rows)
    good = [i for i in range(40) if i % 2] + [42, 43]
    trusted = spark.createDataFrame([(i,) for i in good], "_trusted long")
    held = {i for i in good if zlib.crc32(str(i).encode()) % kneser.HOLD_OUT == 0}
    p = slow_model([t for i, t, *_ in rows if i in good and i not in held])
    got = kneser.perplexities(frame, trusted).collect()
    assert len(got) == len(rows) and {r["doc_id"] for r in got if r["held"]} == held
    cache = {}
    want = []
    for i, t, *_ in rows:
        padded = ["<s>", *slow_tokens(t)]
        total = 0.0
        for g in zip(padded, padded[1:]):
            cache[g] = cache.get(g) or math.log(p(g))
            total += cache[g]
        want.append((i, len(t or ""), total))
    key = lambda r: (str(r[0]), r[2])
    for mine, theirs in zip(sorted(((r["doc_id"], r["n"], r["logp"]) for r in got), key=key), sorted(want, key=key), strict=True):
        assert mine[:2] == theirs[:2] and mine[2] == pytest.approx(theirs[2], rel=1e-5, abs=1e-4)


def test_order_of_words_counts(spark):
    rng = random.Random(3)
    text = "the quick brown fox jumps over the lazy dog while a small bird sings in the old tree near the river"
    words = text.split()
    rows = [(i, " ".join(words[k:] + words[:k]), "en", "s") for i, k in enumerate(rng.randrange(len(words)) for _ in range(60))]
    shuffled = [(100 + i, " ".join(rng.sample(words, len(words))), "en", "s") for i in range(20)]
    scored = {r["doc_id"]: r["logp"] / r["n"] for r in kneser.perplexities(documents(spark, rows + shuffled), spark.range(40).select(F.col("id").alias("_trusted"))).collect()}
    assert min(scored[i] for i in range(40, 60)) > max(scored[100 + i] for i in range(20))


def test_keys_are_those_of_sql(spark):
    rng = np.random.default_rng(1)
    words = rng.integers(-(2**63), 2**63, (3, 50), np.int64)
    words[:, :2] = [[0, 1]] * 3
    frame = spark.createDataFrame(list(zip(*words.tolist(), strict=True)), "a long, b long, c long")
    for n in (1, 2, 3):
        got = [r[0] for r in frame.select(F.xxhash64(*"abc"[:n])).collect()]
        assert kneser.keys(*words[:n].view(np.uint64)).tolist() == [x % 2**64 >> 64 - kneser.BITS for x in got]


def test_quality(spark):
    rng = random.Random(9)
    junk = [(1000 + i, "".join(rng.choice("#$%&*|XQZ!") + rng.choice("aB") for _ in range(80)), "en", "s") for i in range(10)]
    frame = documents(spark, sample(4, 500) + junk + ODD)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(450)] + [(3, 0, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    trusted = kneser.trusted_ids(labels)
    assert trusted.filter("_trusted in (3, 4)").count() == 0
    got = {(r["doc_id"], r["n_chars"]): r["kept"] for r in kneser.judge(frame, trusted).collect()}
    assert sum(got[i, len(t)] for i, t, *_ in sample(4, 500)) >= 495 and not any(got[i, len(t)] for i, t, *_ in junk)
    assert not got[9001, 0] and not got[9002, 0]
    kept = kneser.accepted(frame, trusted)
    assert kept.columns == frame.columns and kept.filter("doc_id between 1000 and 1009").count() == 0
    assert all(r["kept"] == (r["n_chars"] > 0) for r in kneser.judge(frame, trusted.limit(0)).collect())
    assert kneser.judge(frame.limit(0), trusted).count() == 0


@pytest.mark.parametrize("size", [1, 2, 500])
def test_lists_come_back(size):
    rng = np.random.default_rng(size)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (size, 2))})
    for shift in (0, 1 << 45):
        key, row = (np.array([p[k] + (shift if k == 0 else 0) for p in pairs], np.uint64) for k in (0, 1))
        back = kneser._lists(kneser._listed(key, row.astype(np.uint32), np.arange(len(key), dtype=np.uint32)))
        assert [x.tolist() for x in back] == [key.tolist(), row.tolist(), list(range(len(key)))]


def test_tokens_stay_in_their_rows():
    import pyarrow as pa

    from turnmill.llm import blocks

    texts = ["A b", None, " ", "", "\U0010ffff" * 300 + " a", "x" * 300_000]
    word, row, spelt = kneser.tokens(*blocks.flat(pa.array(texts)), np.full(257, -1.0))
    assert row.tolist() == [0] * 4 + [2] * 2 + [4] * 4 + [5] * 3
    assert word[[0, 4, 6, 10]].tolist() == [kneser.BEFORE] * 4 and word[[3, 5, 9, 12]].tolist() == [kneser.AFTER] * 4 and word[1] == word[8]
    assert spelt.tolist() == [0, -2, -2, -1, 0, -1, 0, -1201, -2, -1, 0, -300_001, -1]
    assert kneser.before(word, row, 1)[[1, 4, 5, 7, 11]].tolist() == [0] * 5


# Jaccard.


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def slow_components(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)].append(i)
    return [(i, len(sets[k]), (min(least[find(k)], default=None) if sets[k] else i)) for k, (i, *_) in enumerate(rows)]


def copies(seed):
    rng = random.Random(seed)
    rows = []
    passage = " ".join(f"p{k}" for k in range(55))
    for g in range(14):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 6, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 30))):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9999)}"
            text = " ".join(own) + (" " + passage if rng.random() < 0.4 else "")
            rows.append((len(rows), text.upper() if rng.random() < 0.1 else text, "en", "s"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG", 4)
    rows = copies(seed) + ODD
    got = jaccard.component_ids(documents(spark, rows).repartition(5))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(slow_components(rows), key=str)


def test_derived_overlaps_equal_whole_ones():
    rng = np.random.default_rng(5)
    for _ in range(200):
        p, x, y = (np.unique(rng.integers(0, 60, rng.integers(0, 50))).astype(np.uint64) for _ in range(3))
        got = jaccard.derived_overlap(len(np.intersect1d(p, y)), y, np.setdiff1d(x, p), np.setdiff1d(p, x))
        assert got == len(np.intersect1d(x, y))


def test_derived_pairs_equal_brute_force(spark, monkeypatch):
    rows = copies(3)
    join = jaccard.Join(documents(spark, rows).repartition(3))
    names = [(jaccard.digest(s), s) for s in jaccard.shingle_sets(pa.array([t for _, t, *_ in rows])) if len(s)]
    sets = dict(names)
    keys = sorted(sets)
    first = spark.createDataFrame([(a, b) for a, b in zip(keys[1:], keys)] + [(keys[0], keys[-1])], "a long, b long")
    answers = join.verify(first, differences=True)
    linked = [(a, b) for a in keys for b in keys if a != b and len(np.intersect1d(sets[a], sets[b])) * 175 >= 75 * (len(sets[a]) + len(sets[b]))]
    near = join.verify(spark.createDataFrame([(a, min(b for x, b in linked if x == a)) for a in sorted({a for a, _ in linked})], "a long, b long"), differences=True)
    pairs = [(a, b) for k, a in enumerate(keys) for b in keys[k + 1 : k + 9]]
    for known in (answers, near):
        got = join.derive(spark.createDataFrame(pairs, "a long, b long"), known).collect()
        assert {frozenset((r["a"], r["b"])) for r in got} == {frozenset(p) for p in pairs} and len(got) == len(pairs)
        assert all((r["na"], r["nb"], r["overlap"]) == (len(sets[r["a"]]), len(sets[r["b"]]), len(np.intersect1d(sets[r["a"]], sets[r["b"]]))) for r in got)


def test_hash_of_words_that_a_polynomial_confuses(spark, path):
    """The Thue-Morse word and its complement have equal polynomial hashes modulo 2^64."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"one two three four {word}", "en", "s"), (2, f"one two three four {other}", "en", "s"), (3, f"{word} {other} {word[:1024]} {other[:1024]}", "en", "s")]
    got = jaccard.component_ids(documents(spark, rows))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == [(1, 1, 1), (2, 1, 2), (3, 1, 3)]
    library = bpe.encoder(path).library
    ids = bpe.encode(documents(spark, rows), path).collect()
    assert {r["id"]: r["ids"] for r in ids} == {k: library.encode(t, add_special_tokens=False).ids for k, t, *_ in rows}


def test_slot_counts():
    rng = np.random.default_rng(8)
    values = np.sort(rng.integers(0, 1 << 20, 5000).astype(np.uint32))
    assert (slots.unpack_sorted(slots.pack_sorted(values)) == values).all() and not len(slots.unpack_sorted(slots.pack_sorted(values[:0])))


def supersets(seed):
    """Pairs of J 0.75 to 0.82 of which one set holds the other; the extra words stand in both orders before and behind the common ones."""
    rng = random.Random(seed)
    rows = []
    for g in range(60):
        base = [f"s{seed}g{g}w{k}" for k in range(rng.choice([24, 94, 154]))]
        n = len(base) - 4
        extra = [f"s{seed}g{g}x{k}" for k in range(round(n * (1 / rng.uniform(0.752, 0.82) - 1)))]
        rows += [(len(rows), " ".join(base), "en", "s"), (len(rows) + 1, " ".join(base + extra if g % 2 else extra + base), "en", "s")]
    return rows


@pytest.mark.parametrize("long", [2, 64])
def test_supersets_equal_brute_force(spark, long, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG", long)
    rows = supersets(7) + copies(7)[:40]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    got = jaccard.component_ids(documents(spark, rows).repartition(5))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(slow_components(rows), key=str)


def test_one_of_each(spark):
    rows = copies(3) + [(900, "same words in this text here", "en", "a"), (900, "same words in this text here", "en", "a"), (901, "", "en", "a"), (902, None, "en", "a")]
    frame = documents(spark, rows)
    got = jaccard.one_of_each(frame)
    want = {c for i, n, c in slow_components(rows) if n} | {901, 902}
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want) and got.columns == frame.columns
    assert jaccard.component_ids(frame.limit(0)).count() == 0


def test_chain_of_links(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 40)] + [(100, 101), (7, 7), (101, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_packed_rows():
    rng = np.random.default_rng(3)
    shingle = np.sort(rng.integers(-(2**63), 2**63 - 1, 500))
    name = rng.integers(0, 9, 500)
    row = (shingle, name, (name + 5).astype(np.int32), rng.integers(0, 90, 500).astype(np.int32), rng.random(500) < 0.5)
    assert all((x == y).all() for x, y in zip(row, jaccard.unpack_rows(jaccard.pack_rows(*row)), strict=True))


# Packing.


def slow_bm25(rows, weight, mean):
    """Scores of all rows for each row as seed, for terms that at least two rows have."""
    df = collections.Counter(t for r in rows for t in set(r))
    tfs = [collections.Counter(r) for r in rows]
    score = lambda q, d: sum(weight[t] * tfs[d][t] * (packing.K1 + 1) / (tfs[d][t] + packing.K1 * (1 - packing.B + packing.B * len(rows[d]) / mean)) for t in set(rows[q]) & set(rows[d]) if df[t] > 1)
    return [[score(q, d) for d in range(len(rows))] for q in range(len(rows))]


def test_index_equals_the_formula():
    rng = random.Random(4)
    rows = [[rng.choice([rng.randint(0, 5), rng.randint(0, 200)]) for _ in range(rng.randint(0, 40))] for _ in range(90)] + [[]]
    weight = {t: 1 + t % 7 for t in range(201)}
    want = slow_bm25(rows, weight, 20.0)
    high = np.uint64(32)  # a place's low bits give way to its row
    terms = np.array([t for r in rows for t in r], np.uint64) << high
    index = packing.Index(terms, np.repeat(np.arange(91), [len(r) for r in rows]), 91, lambda t: 1 + (t >> high).astype(np.int64) % 7, 20.0)
    assert len(index.dense) and len(index.row)
    for q in range(91):
        assert np.allclose(index.scores(q), want[q], atol=1e-2)


def test_windows_equal_brute_force(spark, path, monkeypatch):
    """Whole windows, from statistics over all documents and exact scores of all documents of the shard, in any batches."""
    monkeypatch.setattr(packing, "WINDOW", 256)
    rows = [(i, t, lang, s) for i, t, lang, s in sample(9, 70)] + [(100 + i, t, lang, s) for i, t, lang, s in sample(9, 8)]
    shingled = []
    for i, t, *_ in rows:
        data, offsets = packing.blocks.flat(pa.array([t]))
        shingled.append((int(packing._least_hash(pa.array([t]))[0].as_py()), i, bpe.chunk_hashes(data, offsets)[0].tolist()))
    shingled.sort()
    words = [w for *_, w in shingled]
    df = collections.Counter(w >> 42 for ws in words for w in set(ws))
    weight = {w: math.log1p((len(words) - df[w >> 42] + 0.5) / (df[w >> 42] + 0.5)) for ws in words for w in ws}
    scores = slow_bm25(words, weight, sum(map(len, words)) / len(words))
    library = bpe.encoder(path, by_library=True).library
    text = {i: t for i, t, *_ in rows}
    sizes = [len(library.encode(text[i], add_special_tokens=False).ids) + 1 for _, i, _ in shingled]
    want = [shingled[p[0]][1] for p in packing.Packer(0, 256).pack(np.array(sizes), lambda q: np.array(scores[q]))]
    for batch in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = packing.pack(documents(spark, rows).repartition(3), path).collect()
        order = [p["doc_id"] for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"]))]
        assert list(dict.fromkeys(order)) == list(dict.fromkeys(want))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def check_pieces(pieces, want):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    rest = collections.Counter(i for i, _ in want)
    for i, ids in want:
        own = sorted((p for p in by_doc[i] if p["doc_tokens"] == len(ids)), key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == len(ids) * rest[i] or rest[i] > 1
        for p in own:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4")
            assert rest[i] > 1 or (zlib.crc32(part.tobytes()) == p["ids_crc32"] and (p["ids"] is None or p["ids"] == part.tolist()))
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.WINDOW and at & (at - 1) == 0


def test_packing(spark, path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    rows = sample(6, 200) + ODD
    frame = documents(spark, rows)
    got = packing.pack(frame, path).collect()
    want = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, *_ in rows]
    check_pieces(got, want)
    assert sum(p["length"] for p in got) == sum(len(x) for _, x in want)
    assert packing.pack(frame.limit(0), path).count() == 0


def test_neighbours_come_first():
    """Of equal neighbours the first in shard order comes first."""
    scores = np.zeros((4, 4), np.float32)
    scores[0, 2] = 1
    pieces = packing.Packer(0, 16).pack(np.array([4, 4, 4, 4]), lambda seed: scores[seed])
    assert [p[0] for p in pieces] == [0, 2, 1, 3]
    scores[0] = 1
    assert [p[0] for p in packing.Packer(0, 64).pack(np.array([4, 4, 4, 4]), lambda seed: scores[seed])] == [0, 1, 2, 3]
    assert packing.tail_cuts(13) == [8, 4, 1]


# Columns with clashing names, and empty tables.


def test_helper_columns_do_not_clash(spark):
    rows = sample(n=12) + ODD[:5]
    plain = documents(spark, rows).select("doc_id", "text", "source")
    names = ["_norm", "_bag", "_base", "_all", "_text", "_words", "_low", "_keys", "_near", "_exact", "_sure", "document", "_host", "_document", "_hash", "_gone", "_own_key", "_first_id", "_first_key", "_first_copies"]
    frame = plain.withColumns({c: F.lit(c) for c in names})
    for run, added in ((licenses.scan, ["n_words", "labels", "score"]), (lines.with_base, ["n_words", "n_repeat_words"]), (lines.judge, ["kept"]), (lines.clean, []), (jaccard.one_of_each, [])):
        got = run(frame)
        extra = [c for c in names if c in got.columns]
        assert extra == names, run
        assert rows_of(got, "doc_id", *added) == rows_of(run(plain), "doc_id", *added)
        assert all(r[c] == c for r in got.select(*names).collect() for c in names)


def test_empty_tables(spark, path):
    none = documents(spark, ODD).limit(0)
    assert licenses.scan(none).count() == lines.judge(none).count() == bpe.digests(bpe.encode(none, path), path).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference.format_pairs(preference.reply_pairs(turns)).count() == 0
