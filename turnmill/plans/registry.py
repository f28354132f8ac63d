"""Custom stages: functions from turns to turns, put before a stage of the plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from .config import STAGES


@dataclass(frozen=True)
class CustomStage:
    name: str
    run: Callable[..., DataFrame]
    before: str = "budget"


_custom: list[CustomStage] = []


def register_stage(name: str, run: Callable[..., DataFrame], *, before: str = "budget") -> None:
    """run(turns, aggressiveness=, conv_type=, role_aware=) -> turns. It runs where `stages` names it."""
    if not name or name in STAGES:
        raise ValueError(f"stage name {name!r} is empty or reserved")
    if name in names():
        raise ValueError(f"stage {name!r} is registered already")
    _custom.append(CustomStage(name, run, before))


def unregister_stage(name: str) -> None:
    """Forgets the stage; unknown names are ignored."""
    _custom[:] = [s for s in _custom if s.name != name]


def by_conversation(f: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[..., DataFrame]:
    """A stage of a Python function of one conversation's turns, ordered by pos. Its memory is that of one conversation."""

    def run(turns: DataFrame, **_) -> DataFrame:
        return turns.groupBy("conv_id").applyInPandas(lambda pdf: f(pdf.sort_values("pos")), turns.schema)

    return run


def names() -> tuple[str, ...]:
    return tuple(s.name for s in _custom)


def get(name: str) -> CustomStage:
    return next(s for s in _custom if s.name == name)


def clear() -> None:
    _custom.clear()


def order() -> list[str]:
    """All stages in the order they run; RuntimeError if a custom stage's place is not there."""
    out = list(STAGES)
    for s in _custom:
        if s.before not in out:
            raise RuntimeError(f"stage {s.name!r} is to run before {s.before!r}, which is no stage")
        out.insert(out.index(s.before), s.name)
    return out
