"""Stages on small conversations: behaviour, invariants, and plain-Python versions on random threads."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from turnmill.functions import jsonops, text
from turnmill.functions.tokens import Counter
from turnmill.operators import budget, filler, recency, repetition, resolution, structure, tools
from turnmill.plans import model_tier, registry
from turnmill.plans.engine import Compressor, summary
from turnmill.sources import messages, sinks

LONG = "the deployment of the new payment service failed because the database migration was not applied in time"


def rows(frame, *columns):
    columns = columns or ("conv_id", "pos", "role", "content")
    return [tuple(r) for r in frame.select(*columns).orderBy("conv_id", "pos").collect()]


def turns(spark, *conversations):
    return messages.from_python(spark, [list(c) for c in conversations])


@pytest.mark.parametrize(("value", "out"), [
    ('{\n "b": 1.0,\n "a": [1, 2]}', '{"b":1.0,"a":[1,2]}'),
    ('not json {', "not json {"),
    ('```json\n{ "a": 1 }\n```', '```json\n{"a":1}\n```'),
    ('```python\n{ "a": 1 }\n```', '```python\n{ "a": 1 }\n```'),
    ("a\na\nb\n\n\n\nb", "a\nb\n\nb"),
    ('{"a": 1, "a": 2}', '{"a":2}'),
    ("", ""), ("  ", "  "), ('["\\ud800"]', '["\\ud800"]'),
])
def test_compacted(value, out):
    assert jsonops.compacted(value, 0.5) == out


def test_compacted_strengths():
    assert jsonops.compacted(" a   b ", 0.5) == " a   b "
    assert jsonops.compacted(" a   b ", 0.75) == "a b"


def test_line_helper_equals_splitlines(spark):
    values = ["a\nb\n", "a", "a\n", "x\r\nx\r\ny", "p\x0bp q", "", "\n\n", "a\n\n\na\na", "one\x85one"]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = [r[0] for r in frame.select("i", text.squeezed_lines(F.col("v")).alias("o")).orderBy("i").select("o").collect()]
    want = [jsonops.plain_compacted(v, 0.5) if not re.search("\n{3,}", v) else v for v in values]
    for v, g, w in zip(values, got, want, strict=True):
        if not re.search("\n{3,}", v):
            assert g == w, v


@pytest.mark.parametrize(("value", "out"), [
    ("Basically, we should really go.", "We should go."),
    ("I was just in time, just so", "I was just in time"),
    ("Actually, no that is wrong", "Actually, no that is wrong"),
    ("plain words", "plain words"),
    ("you know", ""),
    ("très basically bien", "Très bien"),
])
def test_fillers(spark, value, out):
    frame = spark.createDataFrame([(value,)], "v string")
    assert frame.select(text.without_fillers(F.col("v"))).first()[0] == out


def test_filler_stage(spark):
    got = rows(filler.filler(turns(spark, [("system", "well"), ("user", "okay"), ("assistant", "Sounds good!"), ("assistant", "you know"), ("tool", "basically"), ("assistant", "It is very fine.")])))
    assert [r[2:] for r in got] == [("system", "well"), ("user", "okay"), ("tool", "basically"), ("assistant", "It is fine.")]
    got = rows(filler.filler(turns(spark, [("user", "okay"), ("assistant", "So it is.")]), "rag_doc"))
    assert [r[3] for r in got] == ["It is."]


def test_repetition_keeps_the_later(spark):
    other = "a completely different sentence about cooking rice with many herbs and some olive oil"
    got = rows(repetition.repetition(turns(spark, [("user", LONG), ("assistant", LONG), ("user", other), ("user", LONG + " again"), ("user", "short one")])))
    assert [r[1] for r in got] == [1, 2, 3, 4]
    got = rows(repetition.repetition(turns(spark, [("user", LONG), ("assistant", LONG)]), "rag_doc", 0.8, False))
    assert [r[1] for r in got] == [1]


def test_repetition_leaves_conversations_apart(spark):
    assert len(rows(repetition.repetition(turns(spark, [("user", LONG)], [("user", LONG)])))) == 2


def test_resolution(spark):
    thread = [("system", "sys"), ("user", "Which database should we use for the orders?"), ("assistant", "Use postgres for the orders database"), ("user", "Ok let's go with postgres. Thanks."), ("assistant", "Sounds good"), ("user", "next topic")]
    got = rows(resolution.resolution(turns(spark, thread)))
    assert [r[2:] for r in got][0] == ("system", "sys") and got[-1][3] == "next topic"
    made = [r for r in got if r[3].startswith("RESOLVED: Topic — postgres")]
    assert len(made) == 1 and made[0][2] == "system"
    assert len(rows(resolution.resolution(turns(spark, [("user", "What is confirmed?"), ("assistant", "hm")])))) == 2
    assert len(rows(resolution.resolution(turns(spark, thread), "rag_doc"))) == len(thread)
    one_sided = [("user", "hello there"), ("user", "approved: the plan")]
    assert len(rows(resolution.resolution(turns(spark, one_sided)))) == 2
    assert len(rows(resolution.resolution(turns(spark, one_sided), "agent"))) == 1


def test_description(spark):
    frame = spark.createDataFrame([("Confirmed. X",), ("we'll use: redis — now. Bye",), ("approved",)], "v string")
    assert [r[0] for r in frame.select(resolution.description(F.col("v"))).collect()] == ["decision recorded", "redis — now", "approved"]


def test_recency(spark):
    old = "One is here. Two is here. Three is here. Four is here. Five is here."
    conv = [("user", old), ("assistant", old), ("user", "a"), ("assistant", "b"), ("user", old)]
    got = rows(recency.recency(turns(spark, conv), "chat", 0.5, "tail"))
    assert [r[3] for r in got] == ["Four is here. Five is here."] * 2 + ["a", "b", old]
    got = rows(recency.recency(turns(spark, conv), "chat", 0.5, "lsa"))
    assert len(got[0][3]) < len(old) and got[4][3] == old


def greedy(conv, limit):
    """Oldest group first while above the limit, the last two turns that are no system's protected."""
    count = lambda t: -(-len(f"{t['role']}\n{t['content']}" + (("\n" if t["content"] else "") + t["calls"] if t["calls"] else "")) // 4)
    groups, head = {}, None
    for t in conv:
        ids = [c["id"] for c in json.loads(t["calls"])] if t["calls"] else []
        if t["role"] in ("tool", "function") and head is not None and (t["id"] is None or t["id"] in head[1]):
            groups[t["pos"]] = head[0]
        else:
            groups[t["pos"]] = t["pos"]
            head = (t["pos"], ids) if t["role"] == "assistant" and ids else None
    keep = list(conv)
    while sum(map(count, keep)) > limit:
        last = {t["pos"] for t in [t for t in keep if t["role"] != "system"][-2:]}
        for t in keep:
            members = {p for p, g in groups.items() if g == groups[t["pos"]]}
            if t["role"] != "system" and not members & last:
                keep = [k for k in keep if k["pos"] not in members]
                break
        else:
            break
    return [t["pos"] for t in keep]


def test_budget_equals_the_loop(spark):
    rng = random.Random(7)
    data, convs = [], []
    for c in range(300):
        conv = []
        for pos in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "assistant", "tool", "tool", "function", "system"])
            calls = json.dumps([{"id": f"c{k}"} for k in range(rng.randint(1, 2))]) if role == "assistant" and rng.random() < 0.7 else None
            own = rng.choice([None, "c0", "c1", "zz"]) if role in ("tool", "function") else None
            conv.append({"pos": pos, "role": role, "content": "x" * rng.randint(0, 40), "calls": calls, "id": own})
        convs.append(conv)
        data += [(c, t["pos"], t["role"], t["content"], t["calls"], t["id"]) for t in conv]
    from turnmill.schema import canonical

    frame = canonical(spark.createDataFrame(data, "conv_id long, pos long, role string, content string, tool_calls_json string, tool_call_id string"))
    got: dict[int, list[int]] = {}
    for r in budget.evictions(budget.counted(frame), 30).filter("not evicted").select("conv_id", "pos").collect():
        got.setdefault(r[0], []).append(r[1])
    for c, conv in enumerate(convs):
        assert sorted(got.get(c, [])) == greedy(conv, 30), conv


def test_budget_cuts_system_last(spark):
    conv = [("system", "s" * 400), ("user", "old " * 50), ("user", "u"), ("assistant", "a")]
    out = budget.budget(turns(spark, conv), 40)
    got = rows(out, "role", "content", "compressed", "pos")
    assert [r[0] for r in got] == ["system", "user", "assistant"] and len(got[0][1]) < 400 and got[0][2]


def test_tool_groups(spark):
    conv = [{"role": "assistant", "content": None, "tool_calls": [{"id": "a", "function": {"name": "f", "arguments": '{ "x": 1 }'}}]}, {"role": "tool", "tool_call_id": "a", "content": "ok"}, {"role": "tool", "tool_call_id": "q", "content": "ok"}, {"role": "user", "content": "x"}]
    got = rows(tools.with_groups(turns(spark, conv)), "pos", "tool_group", "conv_id")
    assert [g[:2] for g in got] == [(0, 0), (1, 0), (2, 2), (3, 3)]
    assert '"{\\"x\\":1}"' in rows(structure.structure(turns(spark, conv), 0.5), "tool_calls_json", "pos", "conv_id")[0][0]


def test_round_trips(spark):
    strings = ["a", "b", "c"]
    pairs = [("user", "x"), ("assistant", "y")]
    dicts = [{"role": "user", "content": "hi", "extra": [1, {"k": None}]}, {"role": "assistant", "content": None, "tool_calls": [{"id": "1"}]}, {"role": "user", "content": [{"type": "text", "text": "see"}, {"type": "image_url", "image_url": {"url": "u"}}]}]
    like = [strings, pairs, dicts]
    assert sinks.to_python(messages.from_python(spark, like), like) == like
    with pytest.raises(TypeError):
        messages.rows_of(None)
    with pytest.raises(TypeError):
        messages.rows_of([3])
    with pytest.warns(UserWarning):
        assert len(messages.rows_of([{"role": "user", "content": "a"}, 5])) == 1


def test_objects(spark):
    class M:
        def __init__(self, kind, content):
            self.type, self.content = kind, content

    like = [[M("human", "a"), M("ai", "b")]]
    frame = messages.from_python(spark, like)
    assert [r[2] for r in rows(frame)] == ["user", "assistant"]
    assert [m.content for m in sinks.to_python(frame, like)[0]] == ["a", "b"]


def test_json_reader(spark):
    frame = spark.createDataFrame([(1, json.dumps([{"role": "USER", "content": "a", "timestamp": "2024-01-02T03:04:05Z"}, 7, {"role": "tool", "tool_call_id": None, "content": [{"type": "text", "text": "p"}, {"type": "text", "text": "q"}]}]))], "conv_id long, messages string")
    got = messages.from_json(frame).select("role", text.of_turn().alias("t"), "has_tool_key", F.year("ts").alias("y"), "pos", "conv_id")
    assert [tuple(r)[:4] for r in got.orderBy("pos").collect()] == [("user", "a", False, 2024), ("tool", "p q", True, None)]


def test_engine_invariants(spark):
    rng = random.Random(3)
    convs = [[("system", "You help.")] * (c % 2) + [(rng.choice(["user", "assistant"]), " ".join(rng.choice(LONG.split()) for _ in range(rng.randint(1, 30))) + ".") for _ in range(rng.randint(1, 8))] for c in range(12)]
    frame = turns(spark, *convs)
    engine = Compressor(compression="high", summarizer="tail")
    result = engine.compress(frame, 60)
    stats = {r["conv_id"]: r for r in result.stats.collect()}
    out = rows(result.turns)
    for c, conv in enumerate(convs):
        mine = [r for r in out if r[0] == c]
        assert stats[c]["tokens_after"] <= stats[c]["tokens_before"] or any("RESOLVED" in r[3] for r in mine)
        system = [r[3] for r in mine if r[2] == "system" and not r[3].startswith("RESOLVED")]
        assert system == [t for r, t in conv if r == "system"] or stats[c]["tokens_after"] > 60 - len("You help.")
        assert stats[c]["turns_before"] == len(conv) and stats[c]["turns_after"] == len(mine)
    preview = {r["conv_id"]: r for r in engine.preview(frame, 60).stats.collect()}
    assert all(preview[c]["tokens_after"] == stats[c]["tokens_after"] for c in preview)
    alone = rows(engine.compress(frame.filter("conv_id = 5"), 60).turns)
    assert alone == [r for r in out if r[0] == 5]
    assert rows(engine.compress(frame.repartition(7), 60).turns) == out
    text_ = result.stats.select(summary()).first()[0]
    assert text_.startswith("turnmill (chat, high): ") and "stages: structure, filler" in text_


def test_presets_and_costs(spark):
    frame = turns(spark, [("user", LONG), ("assistant", "Noted."), ("user", LONG)])
    engine = Compressor(cost_provider="openai", model="gpt-4o", cost_output_tokens=10)
    r = engine.compress(frame).stats.first()
    assert r["turn_delta_by_stage"] == {"filler": 1, "repetition": 1} and r["turns_removed"] == 2 and r["cost_saved_usd"] > 0
    assert engine.recommend_preset(frame, 10_000).first()["preset"] == "low"
    assert engine.fits_budget(frame, 10_000).first()["fits"]


def test_custom_stage_by_conversation(spark):
    registry.clear()
    registry.register_stage("last", registry.by_conversation(lambda pdf: pdf.tail(1)), before="filler")
    got = rows(Compressor().compress(turns(spark, ["a", "b"], ["c"]), stages=["last"]).turns)
    assert [r[3] for r in got] == ["b", "c"]
    registry.clear()


class Failing:
    def deduplicate(self, turns):
        raise RuntimeError

    def summarize(self, content, max_tokens):
        raise RuntimeError


def test_model_tier(spark):
    frame = turns(spark, [("system", "s"), ("user", "same"), ("user", "same"), ("assistant", "z" * 50)])
    got = rows(model_tier.model_tier(frame, model_tier.Mock(), "dedupe_only"))
    assert [r[3] for r in got] == ["s", "same", "z" * 50]
    got = rows(model_tier.model_tier(frame, model_tier.Mock(), "replace_all", 0))
    assert [r[2] for r in got] == ["system", "assistant"] and got[1][3].startswith("Summary: user: same")
    got = rows(model_tier.model_tier(frame, model_tier.Mock(), "summarize_only", 0))
    assert len(got) == 5
    assert len(rows(model_tier.model_tier(frame, model_tier.Mock(), "replace_all", 10_000))) == 4
    result = Compressor(backend=Failing(), least_chars=0).compress(frame)
    assert result.turns.count() == 4 and result.stats.first()["warnings_emitted"]


def test_empty_and_null(spark):
    empty = turns(spark)
    result = Compressor(compression="high").compress(empty, 10)
    assert result.turns.count() == 0 and result.stats.count() == 0
    frame = spark.createDataFrame([(1, 0, None, None), (1, 1, "user", None), (None, 0, "user", "x")], "conv_id long, pos long, role string, content string")
    assert Compressor(compression="high").compress(frame, 5).turns.count() >= 1


def test_bpe_counter(spark):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers

    counter = Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = rows(budget.counted(turns(spark, [("user", "hello world")]), counter), "tokens", "conv_id", "pos")
    assert got[0][0] == 4
