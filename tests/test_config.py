import pytest

from turnmill.operators import costs, recency, repetition
from turnmill.plans import config, registry
from turnmill.plans.engine import Compressor
from turnmill.plans.model_tier import keep_indices


def enabled(**kwargs):
    p = config.select(config.profile(kwargs.pop("kind", "chat")), **kwargs)
    return {n for n, s in p.stages.items() if s.enabled}


def test_presets_meet_profiles():
    assert enabled(compression="low") == {"structure", "filler", "repetition"}
    assert enabled(compression="max") == {"structure", "filler", "repetition", "resolution", "recency"}
    assert "resolution" not in enabled(compression="high", kind="rag_doc")
    assert "resolution" in enabled(stages=["resolution"], kind="rag_doc")


def test_budget_rule():
    assert "budget" not in enabled(compression="high")
    assert "budget" in enabled(compression="low", token_budget=5)
    assert "budget" not in enabled(compression="low", token_budget=5, disable=["budget"])
    assert "budget" in enabled(stages=["budget"], token_budget=5, disable=["budget"])
    assert enabled(stages=["budget"]) == set()


def test_bad_names():
    for kwargs in ({"stages": []}, {"stages": ["nope"]}, {"disable": ["role_aware"]}, {"compression": "huge"}):
        with pytest.raises(ValueError):
            enabled(**kwargs)
    with pytest.raises(ValueError):
        Compressor("poem")
    with pytest.raises(ValueError):
        Compressor(mode="x")
    with pytest.raises(ValueError):
        Compressor().configure(nope={})
    with pytest.warns(UserWarning):
        Compressor().configure(filler={"odd": 1})


@pytest.mark.parametrize(("budget", "error"), [(True, TypeError), (1.5, TypeError), (0, ValueError)])
def test_budget_values(budget, error):
    with pytest.raises(error):
        config.checked_budget(budget)


def test_thresholds():
    assert repetition.threshold(0.6) == 0.95 - 0.6 * 0.25
    assert recency.threshold(0.5) == 0.4


def test_registry():
    registry.clear()
    registry.register_stage("a", lambda t, **_: t, before="filler")
    assert registry.order()[:3] == ["structure", "a", "filler"]
    for name in ("a", "filler", ""):
        with pytest.raises(ValueError):
            registry.register_stage(name, lambda t, **_: t)
    registry.register_stage("b", lambda t, **_: t, before="nowhere")
    with pytest.raises(RuntimeError):
        registry.order()
    registry.clear()


def test_costs():
    one = costs.estimate(1_000_000, "oai", "gpt-4o-mini", 100_000)
    assert (one["input_cost_usd"], one["output_cost_usd"], one["total_cost_usd"]) == (0.15, 0.06, 0.21)
    assert costs.rates("claude", "x-claude-3-5-haiku-1")[1:] == ("claude-3-5-haiku", 0.8, 4.0)
    assert costs.rates("google", "odd")[1:3] == ("odd", 0.10)
    assert costs.rates("ollama", None)[2:] == (0.0, 0.0)
    with pytest.raises(ValueError):
        costs.provider("nobody")
    with pytest.raises(ValueError):
        costs.estimate(-1)


def test_keep_indices():
    assert keep_indices("[0, 2, 9]", 4) == [0, 2]
    assert keep_indices("I keep 0,2 of 5", 6) == [0, 2, 5]
    assert keep_indices("-1", 3) == [1]
    assert keep_indices("none", 3) == [0, 1, 2]
    assert keep_indices("", 2) == [0, 1]
    assert keep_indices("[9]", 3) == [0, 1, 2]
    assert keep_indices("x", 1) == [0]
    assert keep_indices("0", 0) == []
