"""Profiles, presets and the choice of stages: the logical plan of a compression."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

STAGES = ("structure", "filler", "repetition", "resolution", "recency", "budget")
LEVELS = ("low", "medium", "high")
LEVEL_ALIASES = {"light": "low", "med": "medium", "mid": "medium", "max": "high"}
PRESETS = {
    "low": frozenset({"structure", "filler", "repetition"}),
    "medium": frozenset({"structure", "filler", "repetition", "resolution"}),
    "high": frozenset({"structure", "filler", "repetition", "resolution", "recency"}),
}

# The strength of each stage by context type (None: the stage is off).
STRENGTHS = {
    "chat": {"structure": 0.45, "filler": 0.7, "repetition": 0.6, "resolution": 0.8, "recency": 0.5, "budget": 0.5},
    "rag_doc": {"structure": 0.5, "filler": 0.5, "repetition": 0.8, "resolution": None, "recency": 0.3, "budget": 0.5},
    "agent": {"structure": 0.75, "filler": 0.4, "repetition": 0.7, "resolution": 0.9, "recency": 0.6, "budget": 0.5},
}
ROLE_AWARE = {"chat": True, "rag_doc": False, "agent": True}


@dataclass(frozen=True)
class StageConfig:
    enabled: bool = True
    aggressiveness: float = 0.5


@dataclass(frozen=True)
class Profile:
    """The configuration of every stage for one context type."""

    conv_type: str
    role_aware: bool
    stages: dict[str, StageConfig] = field(default_factory=dict)

    def with_stage(self, name: str, **changes) -> Profile:
        return replace(self, stages={**self.stages, name: replace(self.stages.get(name, StageConfig()), **changes)})


def profile(conv_type: str) -> Profile:
    if conv_type not in STRENGTHS:
        raise ValueError(f"unknown context type {conv_type!r}; one of {sorted(STRENGTHS)}")
    stages = {name: StageConfig(value is not None, 0.5 if value is None else value) for name, value in STRENGTHS[conv_type].items()}
    return Profile(conv_type, ROLE_AWARE[conv_type], stages)


def level(name: str) -> str:
    key = name.strip().lower()
    key = LEVEL_ALIASES.get(key, key)
    if key not in LEVELS:
        raise ValueError(f"unknown compression level {name!r}; one of {LEVELS} or {sorted(LEVEL_ALIASES)}")
    return key


def checked_budget(token_budget: int | None) -> int | None:
    if token_budget is None:
        return None
    if isinstance(token_budget, bool) or not isinstance(token_budget, int):
        raise TypeError("token_budget must be an int or None")
    if token_budget < 1:
        raise ValueError("token_budget must be at least 1")
    return token_budget


def configured(base: Profile, settings: dict[str, dict]) -> Profile:
    """The profile with settings of stages; unknown stages raise, unknown keys warn."""
    for name, values in settings.items():
        if name not in base.stages:
            raise ValueError(f"unknown stage {name!r}; one of {sorted(base.stages)}")
        known = {k: v for k, v in values.items() if k in StageConfig.__dataclass_fields__}
        for k in values.keys() - known.keys():
            warnings.warn(f"unknown setting {k!r} of stage {name!r}", stacklevel=3)
        base = base.with_stage(name, **known)
    return base


def select(base: Profile, compression: str = "medium", stages: list[str] | None = None, disable: list[str] | None = None, token_budget: int | None = None, custom: tuple[str, ...] = ()) -> Profile:
    """The profile with each stage on or off: by name if `stages` is given, else where the preset and the profile agree (a custom stage
    only runs by name); then without those in `disable`. Budget runs only with a token budget, and if `stages` is given only by name."""
    known = {*STAGES, *custom}
    for names in (stages, disable):
        if unknown := [n for n in names or () if n not in known]:
            raise ValueError(f"unknown stages {unknown}; one of {sorted(known)}")
    if stages is not None and not stages:
        raise ValueError("stages must name at least one stage")
    preset = PRESETS[level(compression)] if stages is None else frozenset(stages)
    off = set(disable or ())
    out = base
    for name in known - {"budget"}:
        on = name in preset and (stages is not None or base.stages.get(name, StageConfig()).enabled)
        out = out.with_stage(name, enabled=on and name not in off)
    if stages is not None:
        on = "budget" in preset
    else:
        on = base.stages["budget"].enabled and "budget" not in off
    return out.with_stage("budget", enabled=on and token_budget is not None)
