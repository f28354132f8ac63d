"""Prices and costs in USD for a million tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# List prices (input, output) by provider and model, in order of lookup.
PRICES = {
    "openai": {"gpt-4o-mini": (0.15, 0.60), "gpt-4o": (2.50, 10.0), "gpt-4.1-mini": (0.40, 1.60), "gpt-4.1": (2.0, 8.0), "o4-mini": (1.10, 4.40), "default": (0.15, 0.60)},
    "anthropic": {"claude-haiku-4-5": (1.0, 5.0), "claude-sonnet-4-5": (3.0, 15.0), "claude-3-5-haiku": (0.80, 4.0), "claude-3-5-sonnet": (3.0, 15.0), "default": (1.0, 5.0)},
    "google": {"gemini-2.0-flash": (0.10, 0.40), "gemini-1.5-flash": (0.075, 0.30), "gemini-1.5-pro": (1.25, 5.0), "default": (0.10, 0.40)},
    "local": {"default": (0.0, 0.0)},
}
ALIASES = {"oai": "openai", "claude": "anthropic", "gemini": "google", "ollama": "local"}


def provider(name: str) -> str:
    """The provider that a name or alias means; ValueError for others."""
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in PRICES:
        raise ValueError(f"unknown provider {name!r}; one of {sorted(PRICES)}")
    return key


def rates(name: str, model: str | None = None) -> tuple[str, str, float, float]:
    """(provider, model, input rate, output rate): the exact model, else the first whose name the model's contains, else the default."""
    table = PRICES[own := provider(name)]
    key = (model or "default").strip()
    exact = key if key in table else next((n for n in table if n != "default" and n in key.lower()), None)
    return (own, exact or key or "default", *table[exact or "default"])


def estimate(input_tokens: int, provider_name: str = "openai", model: str | None = "gpt-4o-mini", output_tokens: int = 0) -> dict:
    """One estimate, as columns of `with_costs` have it for a table."""
    if input_tokens < 0 or output_tokens < 0:
        raise ValueError("token counts must not be negative")
    own, name, inp, out = rates(provider_name, model)
    a, b = input_tokens / 1_000_000.0 * inp, output_tokens / 1_000_000.0 * out
    return {"provider": own, "model": name, "input_tokens": input_tokens, "output_tokens": output_tokens, "input_cost_usd": round(a, 8), "output_cost_usd": round(b, 8), "total_cost_usd": round(a + b, 8), "input_rate": inp, "output_rate": out}


def cost(tokens: Column, rate: float) -> Column:
    return F.round(tokens / F.lit(1_000_000.0) * F.lit(float(rate)), 8)


def with_rates(frame: DataFrame, provider_column: str = "provider", model_column: str = "model") -> DataFrame:
    """Adds rate_provider, rate_model, input_rate and output_rate to rows with provider and model names, by the rules of `rates`.
    The price list is a map in the plan, so nothing is joined. Unknown providers give nulls."""
    key = F.lower(F.trim(F.col(provider_column)))
    own = F.coalesce(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[key], key)
    model = F.trim(F.coalesce(F.when(F.col(model_column) != "", F.col(model_column)), F.lit("default")))
    choice = F.lit(None).cast("string")
    for name, table in reversed(PRICES.items()):
        inner = F.when(model.isin(*table), model)
        for m in (m for m in table if m != "default"):
            inner = inner.when(F.lower(model).contains(m), m)
        choice = F.when(own == name, inner.otherwise("default")).otherwise(choice)
    flat = {f"{p}/{m}": r for p, t in PRICES.items() for m, r in t.items()}
    prices = lambda k: F.create_map(*[F.lit(x) for name, r in flat.items() for x in (name, r[k])])[F.concat_ws("/", own, choice)]
    known = own.isin(*PRICES)
    return frame.withColumns({"rate_provider": F.when(known, own), "rate_model": F.when(known, F.when((choice == "default") & (model != "default"), model).otherwise(choice)), "input_rate": F.when(known, prices(0)), "output_rate": F.when(known, prices(1))})
