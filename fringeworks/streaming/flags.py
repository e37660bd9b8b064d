"""The row-wise operators on a stream of main rows.

Flagging looks at one row at a time and averaging channels too, so both run on an
unbounded DataFrame as they are. Averaging rows and pruning are over all rows and
stay batch operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.averaging import frequency_average
from ..operators.flagging import flag_frequencies, flag_uv_above, flag_values
from ..plans.sequence import Steps
from ..sources.model import VisibilitySet


def flagged(main: DataFrame, like: VisibilitySet, steps: Steps) -> DataFrame:
    """``main`` (streaming or not) with the flags and the channel averages of ``steps``; ``like`` gives shape and channels."""
    if steps.time_factor > 1 or steps.optimize:
        raise ValueError("rows can't be averaged or dropped in a stream")
    vs = like.having(main)
    if steps.uv_above is not None:
        vs = flag_uv_above(vs, steps.uv_above)
    vs = flag_values(vs, steps.nan, steps.clip)
    if steps.rules:
        vs = flag_frequencies(vs, steps.rules)
    return frequency_average(vs, steps.frequency_factor).main
