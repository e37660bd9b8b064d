"""Dropping wholly flagged rows and channels, and keeping one field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.model import VisibilitySet


def all_flagged() -> Column:
    return F.forall("flag", lambda x: x)


def dead_rows() -> Column:
    return F.col("flag_row") | all_flagged()


def channel_states(vs: VisibilitySet, *also: Column) -> DataFrame:
    """chan and dead: flagged in every cell of every row, also of rows that will be dropped; ``also`` of ``_dead``, whether a row will be."""
    long = vs.main.select(dead_rows().alias("_dead"), F.posexplode("flag").alias("pos", "flag"))
    return long.groupBy(F.expr(f"int(pos div {vs.ncorr})").alias("chan")).agg(F.bool_and("flag").alias("dead"), *also)


def prune_counts(vs: VisibilitySet) -> DataFrame:
    """One row: rows in all, flagged, without data, dropped, left, dropped for data alone; channels dead and in all."""
    rows = vs.main.select("flag_row", all_flagged().alias("empty"))
    rows = rows.agg(
        F.count("*").alias("n_total"),
        F.count_if("flag_row").alias("n_flag_row"),
        F.count_if("empty").alias("n_all_data"),
        F.count_if(F.col("flag_row") | F.col("empty")).alias("n_combined"),
        F.count_if(~(F.col("flag_row") | F.col("empty"))).alias("n_remaining"),
        F.count_if(F.col("empty") & ~F.col("flag_row")).alias("n_extra"),
    )
    return rows.crossJoin(channel_states(vs).agg(F.count_if("dead").alias("n_chan_flagged"), F.lit(vs.nchan).alias("n_chan_total")))  # two single rows


def drop_dead_rows(vs: VisibilitySet) -> VisibilitySet:
    return vs.having(vs.main.filter(~dead_rows()), *vs.main.columns, reshaped=True)


def _gathered(column: str, places: Column) -> Column:
    return F.transform(places, lambda i: F.get(column, i))


def drop_dead_channels(vs: VisibilitySet) -> VisibilitySet:
    """One pass finds the dead channels; the arrays then keep the others, and the channel table with them."""
    return _without_channels(vs, {r["chan"] for r in channel_states(vs).filter("dead").collect()})


def _without_channels(vs: VisibilitySet, dead: set[int]) -> VisibilitySet:
    kept = [c for c in range(vs.nchan) if c not in dead]
    if len(kept) == vs.nchan:
        return vs
    places = F.lit([c * vs.ncorr + p for c in kept for p in range(vs.ncorr)])
    planes = {c: F.when(F.size(c) == vs.nchan * vs.ncorr, _gathered(c, places)).otherwise(F.col(c)) for c in vs.planes()}
    main = vs.main.select(*(planes[c].alias(c) if c in planes else F.col(f"`{c}`") for c in vs.main.columns))
    channel = vs.channels().join(vs.main.sparkSession.createDataFrame([(c, k) for k, c in enumerate(kept)], "chan int, _new int"), "chan")
    channel = channel.select("spw_id", F.col("_new").alias("chan"), "chan_freq_hz")
    return vs.having(main, *planes, "chan_freq_hz", channel=channel, nchan=len(kept), reshaped=True)


def optimize(vs: VisibilitySet) -> VisibilitySet:
    """Drops dead rows and dead channels; a set of which nothing remains is a RuntimeError."""
    # One pass for both; channels are judged on all rows, before any are dropped.
    states = channel_states(vs, F.bool_or(~F.col("_dead")).alias("alive")).collect()
    if not any(r["alive"] for r in states):
        raise RuntimeError("every row is flagged: nothing would remain")
    return drop_dead_rows(_without_channels(vs, {r["chan"] for r in states if r["dead"]}))


def field_id(vs: VisibilitySet, field: str | int) -> int:
    """The id of a field given by number, which wins, or by its exact name."""
    try:
        return int(field)
    except ValueError:
        pass
    names = {r["name"].strip(): r["field_id"] for r in vs.field.orderBy(F.desc("field_id")).collect()}
    if field not in names:
        raise RuntimeError(f"no field {field!r}; there are {', '.join(f'{i}: {n}' for n, i in sorted(names.items(), key=lambda x: x[1]))}")
    return names[field]


def only_field(vs: VisibilitySet, field: str | int) -> VisibilitySet:
    """Rows of one field; a field without rows is a RuntimeError."""
    number = field_id(vs, field)
    main = vs.main.filter(F.col("field_id") == number)
    if main.isEmpty():
        raise RuntimeError(f"no rows of field {field!r}")
    return vs.having(main, *vs.main.columns, reshaped=True)
