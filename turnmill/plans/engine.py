"""The engine: plans built from profiles, run over all conversations of a DataFrame at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lineage, tokens
from ..operators import budget, costs, filler, recency, repetition, resolution, structure
from ..schema import canonical
from . import config, model_tier, registry


#: Stages that read their input more than once; what goes into them is stored, so that chains of them stay plans of one stage each.
JOINING = ("repetition", "resolution", "recency", "budget")


@dataclass
class Result:
    """Compressed turns, and one row of statistics for each conversation."""

    turns: DataFrame
    stats: DataFrame


@dataclass
class Compressor:
    """Compresses conversations of one context type. `counter` is a rank file for BPE counts; without it, characters are counted."""

    conv_type: str = "chat"
    compression: str = "medium"
    counter: str | None = None
    model: str | None = None
    summarizer: str = "lsa"
    subject: Callable[[Column], Column] | None = None
    backend: model_tier.Backend | None = None
    mode: str = "replace_all"
    least_chars: int = model_tier.LEAST_CHARS
    max_summary_tokens: int = 2048
    cost_provider: str | None = None
    cost_output_tokens: int = 0
    profile: config.Profile = field(init=False)

    def __post_init__(self) -> None:
        self.profile = config.profile(self.conv_type)
        self.compression = config.level(self.compression)
        if self.mode not in model_tier.MODES:
            raise ValueError(f"unknown mode {self.mode!r}; one of {model_tier.MODES}")

    def configure(self, **settings: dict) -> Compressor:
        """Settings of stages, as filler={"enabled": False}."""
        self.profile = config.configured(self.profile, settings)
        return self

    def set_compression(self, name: str) -> Compressor:
        self.compression = config.level(name)
        return self

    def plan(self, compression: str | None = None, stages: list[str] | None = None, disable: list[str] | None = None, token_budget: int | None = None) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
        """The stages that run, in order, as functions of turns."""
        config.checked_budget(token_budget)
        chosen = config.select(self.profile, compression or self.compression, stages, disable, token_budget, registry.names())
        kind, aware = chosen.conv_type, chosen.role_aware
        strength = {n: s.aggressiveness for n, s in chosen.stages.items()}
        counter = tokens.resolve(self.counter)
        built = {
            "structure": lambda t: structure.structure(t, strength["structure"]),
            "filler": lambda t: filler.filler(t, kind),
            "repetition": lambda t: repetition.repetition(t, kind, strength["repetition"], aware),
            "resolution": lambda t: resolution.resolution(t, kind, self.subject),
            "recency": lambda t: recency.recency(t, kind, strength["recency"], self.summarizer),
            "budget": lambda t: budget.budget(t, token_budget, counter),
        }
        for name in registry.names():
            built[name] = lambda t, name=name: registry.get(name).run(t, aggressiveness=strength[name], conv_type=kind, role_aware=aware)
        return [(name, built[name]) for name in registry.order() if chosen.stages[name].enabled]

    def _counts(self, turns: DataFrame, name: str) -> DataFrame:
        rows = budget.counted(turns, tokens.resolve(self.counter))
        return rows.groupBy("conv_id").agg(F.count("*").alias(f"turns_{name}"), F.sum("tokens").cast("bigint").alias(f"tokens_{name}"))

    def compress(self, turns: DataFrame, token_budget: int | None = None, *, compression: str | None = None, stages: list[str] | None = None, disable: list[str] | None = None, dry_run: bool = False, shared: dict | None = None) -> Result:
        """All conversations compressed, each on its own. With dry_run the turns come back unchanged, and no backend is asked.
        `shared` holds the stored results of stages by the names of all stages so far, for plans that start alike."""
        start = canonical(turns)
        plan = self.plan(compression, stages, disable, token_budget)
        out, sizes = start, []
        shared = {} if shared is None else shared
        for k, (name, stage) in enumerate(plan):
            key = tuple(n for n, _ in plan[: k + 1])
            if key not in shared:
                out = stage(out)
                shared[key] = lineage.stored(out) if name in JOINING or any(n in JOINING for n, _ in plan[k + 1 : k + 2]) else out
            out = shared[key]
            if name != "structure":  # which drops no turn
                sizes.append((name, out))
        tier = None
        if self.backend is not None and not dry_run:
            tiered = model_tier.model_tier(out, self.backend, self.mode, self.least_chars, self.max_summary_tokens)
            tier = tiered.groupBy("conv_id").agg(F.max("tier_applied").alias("tier_applied"), F.max("tier_before").alias("tier_before"), F.max("tier_after").alias("tier_after"), F.max("tier_warning").alias("tier_warning"))
            out = tiered.select(*start.columns)
        stats = self._stats(start, sizes, out, tier, [n for n, _ in plan], compression or self.compression, token_budget, dry_run)
        return Result(start if dry_run else out, stats)

    def _stats(self, start: DataFrame, sizes: list, out: DataFrame, tier: DataFrame | None, names: list[str], level: str, token_budget: int | None, dry_run: bool) -> DataFrame:
        stats = self._counts(start, "before").join(self._counts(out, "after"), "conv_id", "left").na.fill(0, ["turns_after", "tokens_after"])
        last, entries = F.col("turns_before"), []
        for name, turns in sizes:
            count = turns.groupBy("conv_id").agg(F.count("*").alias(f"_{name}"))
            stats = stats.join(count, "conv_id", "left").na.fill(0, [f"_{name}"])
            entries.append(F.when(F.col(f"_{name}") != last, F.struct(F.lit(name).alias("key"), (last - F.col(f"_{name}")).cast("bigint").alias("value"))))
            last = F.col(f"_{name}")
        delta = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull())) if entries else F.create_map().cast("map<string,bigint>")
        warned = F.array(budget.warnings(last if len(sizes) < 2 else F.col(f"_{sizes[-2][0]}"), F.col("_budget"), token_budget)) if "budget" in names and sizes and sizes[-1][0] == "budget" else F.array().cast("array<string>")
        if tier is not None:
            stats = stats.join(tier, "conv_id", "left")
            warned = F.concat(warned, F.array("tier_warning"))
        get = lambda c, empty: F.coalesce(c, F.lit(empty)) if tier is not None else F.lit(empty)
        stats = stats.withColumns({
            "turn_delta_by_stage": delta,
            "stages_run": F.array(*[F.lit(n) for n in names]).cast("array<string>"),
            "warnings_emitted": F.filter(warned, lambda w: w.isNotNull()),
            "compression_level": F.lit(level),
            "context_type": F.lit(self.conv_type),
            "token_budget": F.lit(token_budget).cast("bigint"),
            "dry_run": F.lit(dry_run),
            "tier_applied": get("tier_applied", False),
            "tier_before": get("tier_before", 0).cast("bigint"),
            "tier_after": get("tier_after", 0).cast("bigint"),
        }).drop(*(f"_{n}" for n, _ in sizes), "tier_warning")
        stats = with_savings(stats)
        return attach_cost(stats, self.cost_provider, self.model, self.cost_output_tokens) if self.cost_provider else stats

    def preview(self, turns: DataFrame, token_budget: int | None = None, **kwargs) -> Result:
        return self.compress(turns, token_budget, dry_run=True, **kwargs)

    def fits_budget(self, turns: DataFrame, token_budget: int, **kwargs) -> DataFrame:
        """(conv_id, tokens_after, fits)."""
        return self.preview(turns, token_budget, **kwargs).stats.select("conv_id", "tokens_after", (F.col("tokens_after") <= token_budget).alias("fits"))

    def compare_presets(self, turns: DataFrame, token_budget: int | None = None, presets: tuple[str, ...] = config.LEVELS) -> DataFrame:
        """The statistics under each preset, with `preset` and its place `ord`."""
        shared: dict = {}
        each = [self.preview(turns, token_budget, compression=p, shared=shared).stats.withColumns({"preset": F.lit(p), "ord": F.lit(i)}) for i, p in enumerate(presets)]
        return reduce(DataFrame.unionByName, each)

    def recommend_preset(self, turns: DataFrame, token_budget: int, presets: tuple[str, ...] = config.LEVELS) -> DataFrame:
        """(conv_id, preset): the first that fits, else the one with the fewest tokens."""
        fits = F.col("tokens_after") <= token_budget
        rank = F.struct((~fits).alias("no"), F.when(fits, F.col("ord")).otherwise(F.col("tokens_after")).cast("bigint").alias("by"), "ord")
        return self.compare_presets(turns, token_budget, presets).groupBy("conv_id").agg(F.min_by("preset", rank).alias("preset"))

    def estimate_tokens(self, turns: DataFrame) -> DataFrame:
        """(conv_id, tokens)."""
        return self._counts(canonical(turns), "before").select("conv_id", F.col("tokens_before").alias("tokens"))

    def estimate_cost(self, turns: DataFrame, provider: str = "openai", model: str | None = None, output_tokens: int = 0) -> DataFrame:
        """(conv_id, tokens, input_cost_usd, output_cost_usd, total_cost_usd)."""
        name = model or self.model or "gpt-4o-mini"
        one = costs.estimate(0, provider, name, output_tokens)
        inp = F.col("tokens") / F.lit(1_000_000.0) * F.lit(one["input_rate"])
        out = float(output_tokens) / 1_000_000.0 * one["output_rate"]
        return self.estimate_tokens(turns).select("conv_id", "tokens", F.round(inp, 8).alias("input_cost_usd"), F.lit(round(out, 8)).alias("output_cost_usd"), F.round(inp + F.lit(out), 8).alias("total_cost_usd"))


def with_savings(stats: DataFrame) -> DataFrame:
    """Adds turns_removed, tokens_saved and token_savings_pct (two digits, 0 for no tokens)."""
    saved = F.greatest(F.lit(0).cast("bigint"), F.col("tokens_before") - F.col("tokens_after"))
    pct = F.when(F.col("tokens_before") > 0, F.round(100.0 * saved / F.col("tokens_before"), 2)).otherwise(0.0)
    return stats.withColumns({"turns_removed": F.greatest(F.lit(0).cast("bigint"), F.col("turns_before") - F.col("turns_after")), "tokens_saved": saved, "token_savings_pct": pct})


def attach_cost(stats: DataFrame, provider: str = "openai", model: str | None = None, output_tokens: int = 0) -> DataFrame:
    """Adds the estimated cost before and after; with output tokens also theirs, which compression does not change."""
    one = costs.estimate(0, provider, model or "gpt-4o-mini", output_tokens)
    cost = lambda c: F.col(c) / F.lit(1_000_000.0) * F.lit(one["input_rate"])
    before, after = F.round(cost("tokens_before"), 8), F.round(cost("tokens_after"), 8)
    out = output_tokens / 1_000_000.0 * one["output_rate"]
    extra = lambda c: F.round(c + F.lit(float(out)), 8) if output_tokens > 0 else F.lit(None).cast("double")
    return stats.withColumns({
        "cost_provider": F.lit(one["provider"]),
        "cost_model": F.lit(one["model"]),
        "input_cost_before_usd": before,
        "input_cost_after_usd": after,
        "cost_saved_usd": F.round(F.greatest(F.lit(0.0), before - after), 8),
        "output_tokens": F.lit(output_tokens if output_tokens > 0 else None).cast("bigint"),
        "output_cost_usd": F.lit(round(out, 8) if output_tokens > 0 else None).cast("double"),
        "total_cost_before_usd": extra(cost("tokens_before")),
        "total_cost_after_usd": extra(cost("tokens_after")),
    })


def summary(name: str = "turnmill") -> Column:
    """One report text for a row of statistics."""
    dry = F.when(F.col("dry_run"), " [dry-run]").otherwise("")
    head = F.concat(F.lit(f"{name} ("), "context_type", F.lit(", "), F.coalesce("compression_level", F.lit("default")), F.lit(")"), dry, F.lit(": "), F.format_string("%d -> %d turns, %d -> %d tokens (%s%% saved)", "turns_before", "turns_after", "tokens_before", "tokens_after", F.col("token_savings_pct").cast("string")))
    return F.concat(head, F.when(F.size("stages_run") > 0, F.concat(F.lit("\nstages: "), F.array_join("stages_run", ", "))).otherwise(""))


def exported() -> Column:
    """A row of statistics as JSON."""
    return F.to_json(F.struct("*"))
