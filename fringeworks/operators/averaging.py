"""Flag-aware averages over blocks of channels and blocks of rows.

In a block, data are the mean of unflagged cells (0 without any), weights their sum,
sigmas the root of the inverse of the summed inverse squares (1 without any), and a
flag is set if any was: a mean without its flagged cells still counts as flagged.

Channels are averaged within the row's arrays, without a shuffle. Rows move once, to
their block, whose at most ``factor`` rows one group holds; their arrays are combined
there in the order of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import inverse_square, or_one
from ..sources.model import VisibilitySet

#: Longer blocks of channels are summed by a loop over the array instead of one expression.
UNROLLED = 16


def frequency_average(vs: VisibilitySet, factor: int) -> VisibilitySet:
    """Averages blocks of ``factor`` channels; what is left over makes a narrower last channel.

    Without effect for factors under 2 or over the number of channels.
    """
    if factor < 2 or factor > vs.nchan:
        return vs
    nchan = -(-vs.nchan // factor)
    places = F.sequence(F.lit(0), F.lit(nchan * vs.ncorr - 1))

    def first(p: Column) -> Column:
        return F.floor(p / vs.ncorr).cast("int") * (factor * vs.ncorr) + p % vs.ncorr

    def over(f, op, start) -> Column:
        """For each new cell ``op`` over ``f(position)`` of its old cells; positions past the end give null."""
        if factor <= UNROLLED:
            return F.transform(places, lambda p: reduce(op, (F.coalesce(f(first(p) + k * vs.ncorr), start) for k in range(factor))))
        steps = F.sequence(F.lit(0), F.lit((factor - 1) * vs.ncorr), F.lit(vs.ncorr))
        return F.transform(places, lambda p: F.aggregate(steps, start, lambda a, k: op(a, F.coalesce(f(first(p) + k), start))))

    plus = lambda a, b: a + b
    # Old columns are read from a struct: within a lambda, a name could mean the new column of the same projection.
    old = lambda column: F.col(f"_old.`{column}`")
    good = lambda i: ~F.get(old("flag"), i)
    unflagged = lambda column, i: F.when(good(i), F.get(old(column), i))
    total = lambda value: over(value, plus, F.lit(0.0))
    count = total(lambda i: F.when(good(i), 1.0))
    new = {"flag": over(lambda i: F.get(old("flag"), i), lambda a, b: a | b, F.lit(False))}
    for c in ("data_re", "data_im"):
        new[c] = F.zip_with(total(lambda i, c=c: unflagged(c, i)), count, lambda s, n: s / or_one(n))
    if vs.has("weight_spectrum"):
        new["weight_spectrum"] = total(lambda i: unflagged("weight_spectrum", i))
    if vs.has("sigma_spectrum"):
        new["sigma_spectrum"] = F.transform(total(lambda i: F.when(good(i), inverse_square(F.get(old("sigma_spectrum"), i)))), lambda s: F.sqrt(F.lit(1.0) / or_one(s)))
    for c in set(vs.planes()) - set(new):
        new[c] = F.when(F.size(old(c)) == vs.nchan * vs.ncorr, _gathered(old(c), places, first)).otherwise(old(c))
    main = vs.main.withColumn("_old", F.struct(*(F.col(f"`{c}`") for c in vs.planes())))
    main = main.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in vs.main.columns))
    block = F.expr(f"int(chan div {factor})")
    mine = vs.channels().groupBy("spw_id", block.alias("chan")).agg(F.avg("chan_freq_hz").alias("chan_freq_hz"))
    return vs.having(main, *new, "chan_freq_hz", channel=mine, nchan=nchan, reshaped=True)


def _gathered(column: Column, places: Column, at) -> Column:
    return F.transform(places, lambda p: F.get(column, at(p)))


def time_average(vs: VisibilitySet, factor: int, rows: int | None = None) -> VisibilitySet:
    """Averages blocks of ``factor`` consecutive rows; rows left over at the end are dropped.

    ``rows`` is the number of rows where it is known; else they are counted.
    """
    if factor < 2:
        return vs
    rows = vs.main.count() if rows is None else rows
    block = F.expr(f"row_id div {factor}")
    kept = vs.main.filter(F.col("row_id") < rows // factor * factor).withColumn("_block", block)
    names = [c for c in ("data_re", "data_im", "flag", "weight_spectrum", "sigma_spectrum") if vs.has(c)]
    # In the order of rows, so that sums come out alike in every run.
    old = F.array_sort(F.collect_list(F.struct("row_id", *names))).alias("_old")
    main = row_averages(kept, old)
    size = F.array_max(F.transform("_old", lambda r: F.size(r["flag"])))
    places = F.array_repeat(F.lit(0), F.greatest(size, F.lit(0)))

    def over(f, op, start) -> Column:
        """For each cell ``op`` over ``f(row, position)`` of the block's rows; nulls count as ``start``."""
        if factor <= UNROLLED:
            return F.transform(places, lambda _, p: reduce(op, (F.coalesce(f(F.get("_old", F.lit(k)), p), start) for k in range(factor))))
        return F.transform(places, lambda _, p: F.aggregate("_old", start, lambda a, r: op(a, F.coalesce(f(r, p), start))))

    plus = lambda a, b: a + b
    unflagged = lambda value: over(lambda r, p: F.when(~F.get(r["flag"], p), value(r, p)), plus, F.lit(0.0))
    count = unflagged(lambda r, p: F.lit(1.0))
    new = {"flag": over(lambda r, p: F.get(r["flag"], p), lambda a, b: a | b, F.lit(False))}
    for c in ("data_re", "data_im"):
        new[c] = F.zip_with(unflagged(lambda r, p, c=c: F.get(r[c], p)), count, lambda s, n: s / or_one(n))
    if vs.has("weight_spectrum"):
        new["weight_spectrum"] = unflagged(lambda r, p: F.get(r["weight_spectrum"], p))
    if vs.has("sigma_spectrum"):
        new["sigma_spectrum"] = F.transform(unflagged(lambda r, p: inverse_square(F.get(r["sigma_spectrum"], p))), lambda s: F.sqrt(F.lit(1.0) / or_one(s)))
    new["row_id"] = F.col("_block")
    return vs.having(main.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in vs.main.columns)), *vs.main.columns, reshaped=True)


def row_averages(kept: DataFrame, *also: Column) -> DataFrame:
    """Per _block ``also`` and the columns of rows: means and sums over rows that are not wholly flagged, firsts of the rest."""
    good = F.when(F.col("flag_row") | F.forall("flag", lambda x: x), 0.0).otherwise(1.0)
    first = lambda c: F.min_by(F.col(f"`{c}`"), "row_id")
    # A product, not a condition: a NaN in a flagged row stays one.
    found = {c: F.sum(F.col(c) * F.col("_good")) / or_one(F.sum("_good")) for c in ("u", "v", "w", "time")}
    found |= {c: F.sum(F.col(c) * F.col("_good")) for c in ("interval", "exposure")}
    found["flag_row"] = F.bool_or("flag_row")
    plane = {"row_id", "_block", "data_re", "data_im", "flag", "weight_spectrum", "sigma_spectrum"}
    names = [c for c in kept.columns if c not in plane]
    return kept.withColumn("_good", good).groupBy("_block").agg(*((found[c] if c in found else first(c)).alias(c) for c in names), *also)
