"""Flagging by distance, by value and by frequency. Flags are only ever added.

Every operator is a projection of one row: no shuffle, and chains of them are one
stage. Counts are separate queries, each one aggregation.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import above, amplitude, at_least, squared_uv
from ..sources.model import VisibilitySet


def flag_uv_above(vs: VisibilitySet, limit: float) -> VisibilitySet:
    """Flags rows whose UV distance is over ``limit``; the plane's flags stay."""
    far = above(squared_uv(), float(limit) ** 2)
    return vs.having(vs.main.withColumn("flag_row", F.col("flag_row") | far), "flag_row")


def uv_above_counts(vs: VisibilitySet, limit: float) -> DataFrame:
    """max_uv, rows_above, newly_flagged, rows_flagged (afterwards)."""
    far = above(squared_uv(), float(limit) ** 2)
    return vs.main.agg(
        F.sqrt(F.max(squared_uv())).alias("max_uv"),
        F.count_if(far).alias("rows_above"),
        F.count_if(far & ~F.col("flag_row")).alias("newly_flagged"),
        F.count_if(far | F.col("flag_row")).alias("rows_flagged"),
    )


def _clipped(a: Column, lo: float, hi: float) -> Column:
    return (a <= F.lit(float(lo))) | at_least(a, float(hi))


def flag_values(vs: VisibilitySet, nan: bool = False, clip: tuple[float, float] | None = None) -> VisibilitySet:
    """Flags cells without amplitude, and cells at or below the first or at or over the second of ``clip``."""
    if not nan and clip is None:
        return vs

    def hit(re_: Column, im: Column) -> Column:
        a = amplitude(re_, im)
        return reduce(or_, ([F.isnan(a)] if nan else []) + ([_clipped(a, *clip)] if clip is not None else []))

    hits = F.zip_with("data_re", "data_im", hit)
    return vs.having(vs.main.withColumn("flag", F.zip_with("flag", hits, lambda f, h: f | h)), "flag")


def value_counts(vs: VisibilitySet, clip: tuple[float, float]) -> DataFrame:
    """n_nan, n_clip (flagged before or not), total."""
    amplitudes = F.zip_with("data_re", "data_im", amplitude)
    rows = vs.main.select(
        F.size(F.filter(amplitudes, F.isnan)).alias("nan"),
        F.size(F.filter(amplitudes, lambda a: _clipped(a, *clip))).alias("clip"),
        F.size("flag").alias("n"),
    )
    return rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("nan", "n_nan"), ("clip", "n_clip"), ("n", "total"))))


def channel_masks(vs: VisibilitySet, rules: list[dict]) -> list[list[bool]]:
    """For each rule the channels in its ranges, ends included. The channel table is read once, on the driver."""
    freqs = [r["chan_freq_hz"] for r in vs.channels().orderBy("chan").collect()]
    if not freqs:
        raise RuntimeError("channel frequencies are needed for flag rules")
    return [[any(lo * 1e6 <= f <= hi * 1e6 for lo, hi in rule.get("spw") or []) for f in freqs] for rule in rules]


def _gate(rule: dict) -> Column:
    uv = F.sqrt(squared_uv())
    gates = [uv < F.lit(float(rule["uv_below"]))] if rule.get("uv_below") is not None else []
    gates += [above(uv, float(rule["uv_above"]))] if rule.get("uv_above") is not None else []
    return reduce(and_, gates, F.lit(True))


def flag_frequencies(vs: VisibilitySet, rules: list[dict]) -> VisibilitySet:
    """Flags the channels of each rule on the rows whose UV distance is between its bounds (both outside)."""
    masks = [(rule, mask) for rule, mask in zip(rules, channel_masks(vs, rules)) if any(mask)]
    if not masks:
        return vs.having(vs.main, "flag")
    on = [F.when(_gate(rule), F.lit([bool(m) for m in mask for _ in range(vs.ncorr)])).otherwise(F.lit([False] * vs.nchan * vs.ncorr)) for rule, mask in masks]
    flag = reduce(lambda f, m: F.zip_with(f, m, lambda a, b: a | b), on, F.col("flag"))
    return vs.having(vs.main.withColumn("flag", flag), "flag")


def frequency_counts(vs: VisibilitySet, rules: list[dict]) -> DataFrame:
    """entry, n_chan, n_ranges, n_vis for each rule; rules may count the same cells."""
    masks = channel_masks(vs, rules)
    gated = vs.main.agg(*(F.count_if(_gate(rule)).alias(f"g{k}") for k, rule in enumerate(rules)))
    rows = [F.struct(F.lit(k).alias("entry"), F.lit(sum(m)).alias("n_chan"), F.lit(len(rule.get("spw") or [])).alias("n_ranges"), (F.col(f"g{k}") * sum(m) * vs.ncorr).alias("n_vis")) for k, (rule, m) in enumerate(zip(rules, masks))]
    return gated.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
