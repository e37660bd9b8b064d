"""Exact percentiles without holding the values in one place."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins in a doubling of the value, at the first pass.
PER_OCTAVE = 256
#: Parts into which each later pass cuts a bin that holds a wanted rank.
PARTS = 4096
#: Values left in open bins that are counted one by one.
FEW = 100_000
#: Values that Spark's own percentile may hold in one buffer, some 100 bytes each.
MOST_HELD = 2_000_000
_ZERO, _INFINITE, _NAN = -(1 << 40), 1 << 40, 1 << 41


def exact_quantiles(values: DataFrame, at: list[float], about: int | None = None) -> tuple[int, float | None, list[float]]:
    """Number, mean and quantiles (0 to 1) of a column of numbers from 0 up, between neighbours in proportion.

    The first pass counts values by bins of their logarithm, which keep their order; each
    later one cuts only the bins that hold a wanted rank, at most two for each quantile.
    The driver gets counts by bin, never values but the ends of bins and the last few.
    Nulls do not count; NaN is above infinity. Without a value there are no quantiles.
    Where there are ``about`` MOST_HELD values or fewer, one aggregation holds them all instead.
    """
    values = values.toDF("v").select(F.col("v").cast("double").alias("v")).filter("v is not null")
    v = F.col("v")
    if about is not None and about <= MOST_HELD:
        n, mean, found = values.agg(F.count("v"), F.avg("v"), F.percentile("v", F.lit(at))).first()
        return n, mean, found or []
    octave = F.when(v == 0, _ZERO).when(v < math.inf, F.floor(F.log2(v) * PER_OCTAVE)).when(F.isnan(v), _NAN).otherwise(_INFINITE)
    found = values.groupBy(octave.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("v").alias("total")).collect()
    if any(r["bin"] is None for r in found):
        raise ValueError("values under 0")
    found.sort(key=lambda r: r["bin"])
    n = sum(r["n"] for r in found)
    if not n:
        return 0, None, []
    places = [q * (n - 1) for q in at]
    wanted = {f(p) for p in places for f in (math.floor, math.ceil)}
    known: dict[int, float] = {}
    todo = _open([(r["lo"], r["hi"], r["n"]) for r in found], 0, wanted, known)
    while todo:
        few = sum(n for _, _, n, _ in todo) <= FEW
        key = None
        for i, (lo, hi, _, _) in enumerate(todo):
            part = v if few else F.floor((v - lo) / (hi - lo) * PARTS).cast("double")
            mine = F.struct(F.lit(i).alias("i"), part.alias("part"))
            key = (F if key is None else key).when((v >= lo) & (v <= hi), mine)
        cut = values.select("v", key.alias("key")).filter("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        todo = [
            left
            for i, (_, _, _, start) in enumerate(todo)
            for left in _open(sorted((r["lo"], r["hi"], r["n"]) for r in cut if r["key"]["i"] == i), start, wanted, known)
        ]

    def between(place: float) -> float:
        low, high = math.floor(place), math.ceil(place)
        a, b = known[low], known[high]
        return a if low == high or a == b else (high - place) * a + (place - low) * b

    return n, math.fsum(r["total"] for r in found) / n, [between(p) for p in places]


def _open(bins: list[tuple[float, float, int]], start: int, wanted: set[int], known: dict[int, float]) -> list[tuple[float, float, int, int]]:
    """Notes the wanted ranks that the bins' ends tell; returns the bins (least, greatest, number, first rank) that hold others."""
    left = []
    for lo, hi, n in bins:
        inside = [r for r in wanted if start <= r < start + n]
        for r in inside:
            if r == start or not lo < hi:
                known[r] = lo
            elif r == start + n - 1:
                known[r] = hi
        if any(r not in known for r in inside):
            left.append((lo, hi, n, start))
        start += n
    return left
