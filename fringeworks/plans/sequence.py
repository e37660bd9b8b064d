"""The fixed sequence: flag, average channels, average rows, prune; then reports; then write."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..operators.averaging import frequency_average, time_average
from ..operators.flagging import flag_frequencies, flag_uv_above, flag_values
from ..operators.pruning import optimize
from ..sources.model import VisibilitySet


@dataclass(frozen=True)
class Steps:
    uv_above: float | None = None
    nan: bool = False
    clip: tuple[float, float] | None = None
    rules: list[dict] = field(default_factory=list)
    frequency_factor: int = 1
    time_factor: int = 1
    optimize: bool = False


def run(vs: VisibilitySet, steps: Steps) -> VisibilitySet:
    """Averaging channels before rows is part of the meaning: with flags the two do not commute."""
    if steps.uv_above is not None:
        vs = flag_uv_above(vs, steps.uv_above)
    vs = flag_values(vs, steps.nan, steps.clip)
    if steps.rules:
        vs = flag_frequencies(vs, steps.rules)
    vs = time_average(frequency_average(vs, steps.frequency_factor), steps.time_factor)
    return optimize(vs) if steps.optimize else vs
