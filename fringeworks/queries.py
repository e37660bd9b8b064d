"""Registered queries of the visibility operators and their SQL, over the set derived from ``events``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.numbers import angle
from .operators.averaging import frequency_average, time_average
from .operators.flagging import flag_frequencies, flag_uv_above, flag_values, frequency_counts, uv_above_counts, value_counts
from .operators.pruning import channel_states, drop_dead_channels, drop_dead_rows, only_field, optimize, prune_counts
from .plans import reports
from .plans.sequence import Steps, run
from .sources.derived import from_events
from .sources.model import VisibilitySet, cells
from .sources.storage import open_set, rules_from, update, write_new

UV, CLIP, FACTOR, FOV = 1000.0, (0.0, 2000.0), 3, "1.0 deg"
RULES = [{"spw": [[1240, 1260]]}, {"spw": [[1000, 1050]], "uv_below": 600}, {"spw": [[1100, 1100]], "uv_below": 1000, "uv_above": 500}]
STEPS = Steps(UV, True, CLIP, RULES, FACTOR, FACTOR, True)


def _r(c: str):
    """Rounded, and without a sign on zero."""
    return (F.round(c, 6) + F.lit(0.0)).alias(c.rpartition(".")[2])


def _flags(vs: VisibilitySet) -> DataFrame:
    return cells(vs).select("row_id", "chan", "corr", "flag")


def _data(vs: VisibilitySet) -> DataFrame:
    return cells(vs).select("row_id", "chan", "corr", _r("data_re"), _r("data_im"))


def _one(vs: VisibilitySet, column: str) -> DataFrame:
    return cells(vs).select("row_id", "chan", "corr", _r(column))


def _whole(vs: VisibilitySet) -> DataFrame:
    return cells(vs).select("row_id", "chan", "corr", "flag", _r("data_re"), _r("data_im"), _r("weight_spectrum"), _r("sigma_spectrum"))


def _nan(vs: VisibilitySet) -> VisibilitySet:
    return flag_values(vs, nan=True)


def _rows(vs: VisibilitySet, *names: str) -> DataFrame:
    return vs.main.select("row_id", *names)


def _averaged(vs: VisibilitySet) -> VisibilitySet:
    return time_average(_nan(vs), FACTOR)


def _stored(vs: VisibilitySet, **how) -> tuple[str, VisibilitySet]:
    """A folder that driver and executors share, with the set written to it; the set as read back."""
    spark = vs.main.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="fringeworks-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/sets/{uuid.uuid4().hex}"
    write_new(vs, path, **how)
    return path, open_set(spark, path)


def _updated(vs: VisibilitySet) -> VisibilitySet:
    path, old = _stored(vs)
    update(_nan(old), path, clobber=True)
    return open_set(vs.main.sparkSession, path)


def _bare(vs: VisibilitySet) -> VisibilitySet:
    """Without the columns a set need not have."""
    return replace(vs, main=vs.main.drop("weight_spectrum", "sigma_spectrum", "interval", "exposure"))


def _numbered(vs: VisibilitySet) -> VisibilitySet:
    """With a further column of the plane's shape: the number of the cell, and one of another shape."""
    number = F.transform("flag", lambda _, i: (F.col("row_id") * 16 + i).cast("double"))
    return replace(vs, main=vs.main.withColumn("number", number).withColumn("pair", F.array(F.col("u"), F.col("v"))))


def _numbers(vs: VisibilitySet) -> DataFrame:
    cell = vs.main.select("row_id", F.get("pair", F.lit(1)).alias("second"), F.posexplode("number").alias("pos", "number"))
    return cell.select("row_id", F.expr(f"int(pos div {vs.ncorr})").alias("chan"), (F.col("pos") % vs.ncorr).alias("corr"), "number", "second")


def _refused(vs: VisibilitySet) -> DataFrame:
    """What pruning says of a set without a good row."""
    try:
        optimize(replace(vs, main=vs.main.withColumn("flag_row", F.lit(True))))
        said = "pruned"
    except RuntimeError:
        said = "refused"
    return vs.main.sparkSession.sql(f"SELECT '{said}' AS verdict")


YAML_RULES = """
- spw: [[1240, 1260]]
- spw: [[1000, 1050]]
  uv_below: 600
- spw: [[1100, 1100]]
  uv_below: 1000
  uv_above: 500
"""

_META = ("time", "u", "v", "w", "interval", "exposure")
_PLANS: dict[str, Callable[[VisibilitySet], DataFrame]] = {
    "flag_uv_above": lambda v: _rows(flag_uv_above(v, UV), "flag_row"),
    "flag_uv_above_stats": lambda v: uv_above_counts(v, UV).withColumn("max_uv", F.round("max_uv", 6)),
    "flag_nan": lambda v: _flags(_nan(v)),
    "flag_clip": lambda v: _flags(flag_values(v, clip=CLIP)),
    "flag_clip_zero_bound": lambda v: _flags(flag_values(v, clip=(0.0, 1e300))),
    "flag_data_counts": lambda v: value_counts(v, CLIP),
    "flag_spw": lambda v: _flags(flag_frequencies(v, RULES[:1])),
    "flag_spw_uv_below": lambda v: _flags(flag_frequencies(v, RULES[1:2])),
    "flag_spw_uv_band": lambda v: _flags(flag_frequencies(v, RULES[2:])),
    "flag_spw_stats": lambda v: frequency_counts(v, RULES),
    "freq_avg_data": lambda v: _data(frequency_average(_nan(v), FACTOR)),
    "freq_avg_weight": lambda v: _one(frequency_average(_nan(v), FACTOR), "weight_spectrum"),
    "freq_avg_sigma": lambda v: _one(frequency_average(_nan(v), FACTOR), "sigma_spectrum"),
    "freq_avg_flag": lambda v: _flags(frequency_average(_nan(v), FACTOR)),
    "freq_avg_tail": lambda v: _whole(frequency_average(_nan(v), FACTOR)).filter("chan = 2"),
    "freq_avg_factor_gt_nchan": lambda v: _data(frequency_average(v, 9)),
    "chan_freq_avg": lambda v: frequency_average(v, FACTOR).channel,
    "time_avg_data": lambda v: _data(_averaged(v)),
    "time_avg_weight": lambda v: _one(_averaged(v), "weight_spectrum"),
    "time_avg_sigma": lambda v: _one(_averaged(v), "sigma_spectrum"),
    "time_avg_flag": lambda v: _flags(_averaged(v)),
    "time_avg_meta": lambda v: _rows(_averaged(v), *map(_r, _META), "flag_row"),
    "time_avg_first_cols": lambda v: _rows(_averaged(v), "antenna1", "antenna2", "field_id", "data_desc_id"),
    "freq_then_time_avg": lambda v: _whole(time_average(frequency_average(_nan(v), FACTOR), FACTOR)),
    "time_then_freq_avg": lambda v: _whole(frequency_average(_averaged(v), FACTOR)),
    "optimize_rows": lambda v: _rows(drop_dead_rows(v), "flag_row"),
    "optimize_channels": lambda v: channel_states(flag_frequencies(v, RULES[:1])),
    "optimize_cells": lambda v: _flags(drop_dead_channels(flag_frequencies(v, RULES[:1]))),
    "optimize_stats": lambda v: prune_counts(flag_frequencies(v, RULES[:1])),
    "split_by_name": lambda v: _rows(only_field(v, "purchase"), "field_id"),
    "split_by_id": lambda v: _rows(only_field(v, 3), "field_id"),
    "split_after_time_avg": lambda v: _rows(only_field(_averaged(v), "click"), "field_id", _r("time")),
    "summary_flags": reports.flag_totals,
    "summary_histogram": reports.unflagged_histogram,
    "summary_row_minmax": reports.row_extremes,
    "summary_row_size": reports.row_sizes,
    "summary_uv_percentiles": lambda v: reports.uv_percentiles(v).withColumn("uv", F.round("uv", 6)),
    "summary_spectral": reports.spectral,
    "summary_dt_max": lambda v: reports.longest_integrations(v).withColumn("dt_max", F.round("dt_max", 6)),
    "summary_interval": reports.current_integration,
    "summary_fields": reports.fields,
    "barber_max": lambda v: _barber(_nan(v)),
    "barber_max_pol": lambda v: _barber(_nan(v), 1),
    "barber_stats": lambda v: _rounded(reports.amplitude_statistics(_nan(v))),
    "analyze_image_size": lambda v: _rounded(reports.image_report(v, angle(FOV))),
    "full_pipeline": lambda v: _whole(run(v, STEPS)),
    "flag_no_rule": lambda v: _flags(flag_values(v)),
    "flag_yaml_rules": lambda v: _flags(flag_frequencies(v, rules_from(YAML_RULES))),
    "freq_avg_without_optional": lambda v: _data(frequency_average(_nan(_bare(v)), FACTOR)),
    "time_avg_without_optional": lambda v: _data(_averaged(_bare(v))),
    "freq_avg_other_columns": lambda v: _numbers(frequency_average(_numbered(v), FACTOR)),
    "optimize_refused": _refused,
    "store_open": lambda v: _whole(_stored(_nan(v))[1]),
    "store_channels": lambda v: _stored(frequency_average(v, FACTOR))[1].channel.select("spw_id", "chan", "chan_freq_hz"),
    "store_split": lambda v: _rows(_stored(v, split="purchase")[1], "field_id", "antenna1", "time"),
    "store_update": lambda v: _flags(_updated(v)),
}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(n, 6).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def _barber(vs: VisibilitySet, corr: int | None = None) -> DataFrame:
    return _rounded(reports.strongest(vs, corr).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, plan=plan: plan(from_events(spark, sf_dir))) for name, plan in _PLANS.items()}


# SQL. r0 and c0 are the derived set's rows and cells; each step reads the last and names its own.
_BASE = """
r0 AS (
  SELECT event_id AS row_id,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END::INT AS field_id,
    0::INT AS data_desc_id, 5e9 + 8 * event_id AS time,
    (user_id % 16)::INT AS antenna1, ((user_id * 7 + 3) % 16)::INT AS antenna2,
    ((37 * event_id) % 2001 - 1000)::DOUBLE AS u, ((53 * event_id) % 1501 - 750)::DOUBLE AS v, (event_id % 11)::DOUBLE AS w,
    8e0 AS interval_, 8e0 - 5e-1 * (event_id % 2) AS exposure, event_id % 23 = 0 AS flag_row,
    event_id % 29 = 0 OR (event_id // 3) % 100 = 0 AS dead, user_id, value
  FROM events),
c0 AS (
  SELECT row_id, c::INT AS chan, p::INT AS corr,
    CASE WHEN (row_id + c) % 89 = 0 THEN 0e0 WHEN (row_id + 3 * c + p) % 97 = 0 THEN 'NaN'::DOUBLE ELSE round(100 * value) * (1 + c) / 128e0 END AS re,
    CASE WHEN (row_id + c) % 89 = 0 THEN 0e0 ELSE (user_id - 75) * (1 + p) / 64e0 END AS im,
    dead OR (31 * row_id + 17 * c + 7 * p) % 11 = 0 AS flag,
    1 + ((row_id + c + p) % 4) / 4e0 AS wt,
    CASE WHEN (row_id + c) % 1009 = 0 THEN 0e0 ELSE 5e-1 * (1 + (row_id + 2 * c + p) % 4) END AS sg
  FROM r0, range(8) AS x(c), range(2) AS y(p))"""
_AMP = "sqrt(re * re + im * im)"
_ISNAN = f"isnan({_AMP})"
_CLIPPED = f"({_AMP} <= 0 OR ({_AMP} >= 2000 AND NOT {_ISNAN}))"
_UVD = "sqrt(u * u + v * v)"
_GATES = [
    ("chan = 5", "true"),
    ("chan IN (0, 1)", f"{_UVD} < 600"),
    ("chan = 2", f"{_UVD} < 1000 AND {_UVD} > 500"),
]
_SG = "sum(CASE WHEN flag THEN 0e0 WHEN sg = 0 THEN 'Infinity'::DOUBLE ELSE 1 / (sg * sg) END)"


def _flag(new: str, old: str, what: str, rows: str = "r0") -> str:
    return f"{new} AS (SELECT c.row_id, chan, corr, re, im, flag OR ({what}) AS flag, wt, sg FROM {old} c JOIN {rows} r ON r.row_id = c.row_id)"


def _average(new: str, old: str, keys: str) -> str:
    n = "greatest(sum(CASE WHEN flag THEN 0 ELSE 1 END), 1)"
    return (
        f"{new} AS (SELECT {keys}, sum(CASE WHEN flag THEN 0e0 ELSE re END) / {n} AS re, sum(CASE WHEN flag THEN 0e0 ELSE im END) / {n} AS im, "
        f"bool_or(flag) AS flag, sum(CASE WHEN flag THEN 0e0 ELSE wt END) AS wt, sqrt(1 / CASE WHEN {_SG} = 0 THEN 1e0 ELSE {_SG} END) AS sg FROM {old} GROUP BY ALL)"
    )


def _by_chan(new: str, old: str) -> str:
    return _average(new, old, "row_id, (chan // 3)::INT AS chan, corr")


def _by_time(new: str, old: str) -> str:
    whole = f"(SELECT * FROM {old} WHERE row_id < (SELECT count(*) // 3 * 3 FROM r0))"
    return _average(new, whole, "row_id // 3 AS row_id, chan, corr")


def _rows_by_time(new: str, old: str, rows: str = "r0") -> str:
    mean = lambda c: f"sum({c} * g) / CASE WHEN sum(g) = 0 THEN 1e0 ELSE sum(g) END AS {c}"
    firsts = ", ".join(f"arg_min({c}, pos) AS {c}" for c in ("antenna1", "antenna2", "field_id", "data_desc_id"))
    return (
        f"{new}g AS (SELECT r.* EXCLUDE (row_id), r.row_id AS pos, CASE WHEN flag_row OR every THEN 0e0 ELSE 1e0 END AS g "
        f"FROM {rows} r JOIN (SELECT row_id, bool_and(flag) AS every FROM {old} GROUP BY row_id) a ON a.row_id = r.row_id WHERE r.row_id < (SELECT count(*) // 3 * 3 FROM r0)), "
        f"{new} AS (SELECT pos // 3 AS row_id, {', '.join(map(mean, ('u', 'v', 'w', 'time')))}, sum(interval_ * g) AS interval_, sum(exposure * g) AS exposure, bool_or(flag_row) AS flag_row, {firsts} FROM {new}g GROUP BY pos // 3)"
    )


def _sql(select: str, *steps: str) -> str:
    return f"WITH {', '.join([_BASE.strip(), *steps])} {select}"


_DATA = "round(re, 6) + 0e0 AS data_re, round(im, 6) + 0e0 AS data_im"
_CELL = "row_id, chan, corr"
_ALL = f"{_CELL}, flag, {_DATA}, round(wt, 6) + 0e0 AS weight_spectrum, round(sg, 6) + 0e0 AS sigma_spectrum"
_NAN = _flag("c1", "c0", _ISNAN)
_SPW1 = _flag("c1", "c0", _GATES[0][0])
_MASKED = f"CASE WHEN flag THEN 0e0 ELSE {_AMP} END"


def _barber_sql(where: str = "") -> str:
    return _sql(
        f"SELECT round(a, 6) AS max_amplitude, row_id, chan, corr, flag, wt AS weight, strftime(TIMESTAMP '1858-11-17' + to_seconds(time::BIGINT), '%Y-%m-%d %H:%M:%S') AS timestamp, antenna1, antenna2 "
        f"FROM (SELECT *, {_MASKED} AS a FROM c1 {where}) JOIN r0 USING (row_id) ORDER BY a DESC, row_id, chan, corr LIMIT 1",
        _NAN,
    )


def oracle_sql() -> dict[str, str]:
    avg_c, avg_t = _by_chan("c2", "c1"), _by_time("c2", "c1")
    far = f"(u * u + v * v > {UV * UV})"
    flags = f"SELECT {_CELL}, flag FROM"
    uvs = f"SELECT quantile_cont({_UVD}, {{}}) FROM r0"
    counts = "coalesce(sum(flag::INT), 0)::BIGINT"
    row = "(SELECT row_id, count(*)::BIGINT AS n, sum(flag::INT)::BIGINT AS flagged, sum((NOT flag)::INT)::BIGINT AS unflagged FROM c0 GROUP BY row_id)"
    uv_max = f"(SELECT max({_UVD}) FROM r0)"
    resolution = f"(299792458e0 / (13.5e8 * {uv_max}))"
    dead = "row_id IN (SELECT row_id FROM (SELECT row_id, bool_and(flag) AS every FROM c0 GROUP BY row_id) JOIN r0 USING (row_id) WHERE NOT (flag_row OR every))"
    pipeline = [
        f"r1 AS (SELECT * REPLACE (flag_row OR {far} AS flag_row) FROM r0)",
        _flag("c1", "c0", _ISNAN), _flag("c2", "c1", _CLIPPED),
        _flag("c3", "c2", " OR ".join(f"(({a}) AND ({b}))" for a, b in _GATES)),
        _by_chan("c4", "c3"), _by_time("c5", "c4"), _rows_by_time("r5", "c4", "r1"),
        "dead AS (SELECT chan, bool_and(flag) AS every FROM c5 GROUP BY chan)",
        "kept AS (SELECT chan, (row_number() OVER (ORDER BY chan) - 1)::INT AS k FROM dead WHERE NOT every)",
        "good AS (SELECT row_id FROM (SELECT row_id, bool_and(flag) AS every FROM c5 GROUP BY row_id) JOIN r5 USING (row_id) WHERE NOT (flag_row OR every))",
    ]
    gated = _flag("c1", "c0", " OR ".join(f"(({a}) AND ({b}))" for a, b in _GATES))
    return {
        "flag_no_rule": _sql(f"{flags} c0"),
        "flag_yaml_rules": _sql(f"{flags} c1", gated),
        "freq_avg_without_optional": _sql(f"SELECT {_CELL}, {_DATA} FROM c2", _NAN, avg_c),
        "time_avg_without_optional": _sql(f"SELECT {_CELL}, {_DATA} FROM c2", _NAN, avg_t),
        "freq_avg_other_columns": _sql("SELECT row_id, (chan // 3)::INT AS chan, corr, (row_id * 16 + chan * 2 + corr)::DOUBLE AS number, v AS second FROM c0 JOIN r0 USING (row_id) WHERE chan % 3 = 0"),
        "optimize_refused": "SELECT 'refused' AS verdict",
        "store_open": _sql(f"SELECT {_ALL} FROM c1", _NAN),
        "store_channels": "SELECT 0::INT AS spw_id, (c // 3)::INT AS chan, avg(1e9 + 5e7 * c) AS chan_freq_hz FROM range(8) AS x(c) GROUP BY c // 3",
        "store_split": _sql("SELECT row_id, field_id, antenna1, time FROM r0 WHERE field_id = 2"),
        "store_update": _sql(f"{flags} c1", _NAN),
        "flag_uv_above": _sql(f"SELECT row_id, flag_row OR {far} AS flag_row FROM r0"),
        "flag_uv_above_stats": _sql(f"SELECT round(sqrt(max(u * u + v * v)), 6) AS max_uv, count(*) FILTER ({far}) AS rows_above, count(*) FILTER ({far} AND NOT flag_row) AS newly_flagged, count(*) FILTER ({far} OR flag_row) AS rows_flagged FROM r0"),
        "flag_nan": _sql(f"{flags} c1", _NAN),
        "flag_clip": _sql(f"{flags} c1", _flag("c1", "c0", _CLIPPED)),
        "flag_clip_zero_bound": _sql(f"{flags} c1", _flag("c1", "c0", f"{_AMP} <= 0")),
        "flag_data_counts": _sql(f"SELECT count(*) FILTER ({_ISNAN}) AS n_nan, count(*) FILTER ({_CLIPPED}) AS n_clip, count(*) AS total FROM c0"),
        "flag_spw": _sql(f"{flags} c1", _SPW1),
        "flag_spw_uv_below": _sql(f"{flags} c1", _flag("c1", "c0", f"({_GATES[1][0]}) AND ({_GATES[1][1]})")),
        "flag_spw_uv_band": _sql(f"{flags} c1", _flag("c1", "c0", f"({_GATES[2][0]}) AND ({_GATES[2][1]})")),
        "flag_spw_stats": _sql(" UNION ALL ".join(f"SELECT {k}::INT AS entry, {n}::INT AS n_chan, 1::INT AS n_ranges, count(*) FILTER ({g}) * {n} * 2 AS n_vis FROM r0" for k, (n, (_, g)) in enumerate(zip((1, 2, 1), _GATES)))),
        "freq_avg_data": _sql(f"SELECT {_CELL}, {_DATA} FROM c2", _NAN, avg_c),
        "freq_avg_weight": _sql(f"SELECT {_CELL}, round(wt, 6) + 0e0 AS weight_spectrum FROM c2", _NAN, avg_c),
        "freq_avg_sigma": _sql(f"SELECT {_CELL}, round(sg, 6) + 0e0 AS sigma_spectrum FROM c2", _NAN, avg_c),
        "freq_avg_flag": _sql(f"{flags} c2", _NAN, avg_c),
        "freq_avg_tail": _sql(f"SELECT {_ALL} FROM c2 WHERE chan = 2", _NAN, avg_c),
        "freq_avg_factor_gt_nchan": _sql(f"SELECT {_CELL}, {_DATA} FROM c0"),
        "chan_freq_avg": "SELECT 0::INT AS spw_id, (c // 3)::INT AS chan, avg(1e9 + 5e7 * c) AS chan_freq_hz FROM range(8) AS x(c) GROUP BY c // 3",
        "time_avg_data": _sql(f"SELECT {_CELL}, {_DATA} FROM c2", _NAN, avg_t),
        "time_avg_weight": _sql(f"SELECT {_CELL}, round(wt, 6) + 0e0 AS weight_spectrum FROM c2", _NAN, avg_t),
        "time_avg_sigma": _sql(f"SELECT {_CELL}, round(sg, 6) + 0e0 AS sigma_spectrum FROM c2", _NAN, avg_t),
        "time_avg_flag": _sql(f"{flags} c2", _NAN, avg_t),
        "time_avg_meta": _sql(f"SELECT row_id, {', '.join(f'round({c}, 6) + 0e0 AS {c}' for c in ('time', 'u', 'v', 'w', 'exposure'))}, round(interval_, 6) + 0e0 AS interval, flag_row FROM r2", _NAN, _rows_by_time("r2", "c1")),
        "time_avg_first_cols": _sql("SELECT row_id, antenna1, antenna2, field_id, data_desc_id FROM r2", _NAN, _rows_by_time("r2", "c1")),
        "freq_then_time_avg": _sql(f"SELECT {_ALL} FROM c3", _NAN, avg_c, _by_time("c3", "c2")),
        "time_then_freq_avg": _sql(f"SELECT {_ALL} FROM c3", _NAN, avg_t, _by_chan("c3", "c2")),
        "optimize_rows": _sql(f"SELECT row_id, flag_row FROM r0 WHERE {dead}"),
        "optimize_channels": _sql("SELECT chan, bool_and(flag) AS dead FROM c1 GROUP BY chan", _SPW1),
        "optimize_cells": _sql("SELECT row_id, (chan - (chan > 5)::INT)::INT AS chan, corr, flag FROM c1 WHERE chan <> 5", _SPW1),
        "optimize_stats": _sql(
            "SELECT count(*) AS n_total, count(*) FILTER (flag_row) AS n_flag_row, count(*) FILTER (every) AS n_all_data, count(*) FILTER (flag_row OR every) AS n_combined, "
            "count(*) FILTER (NOT (flag_row OR every)) AS n_remaining, count(*) FILTER (every AND NOT flag_row) AS n_extra, "
            "(SELECT count(*) FROM (SELECT chan FROM c1 GROUP BY chan HAVING bool_and(flag))) AS n_chan_flagged, 8::INT AS n_chan_total "
            "FROM r0 JOIN (SELECT row_id, bool_and(flag) AS every FROM c1 GROUP BY row_id) USING (row_id)",
            _SPW1,
        ),
        "split_by_name": _sql("SELECT row_id, field_id FROM r0 WHERE field_id = 2"),
        "split_by_id": _sql("SELECT row_id, field_id FROM r0 WHERE field_id = 3"),
        "split_after_time_avg": _sql("SELECT row_id, field_id, round(time, 6) + 0e0 AS time FROM r2 WHERE field_id = 0", _NAN, _rows_by_time("r2", "c1")),
        "summary_flags": _sql(
            f"SELECT n_flagged, n_total, rows_flagged, rows_total, 1e2 * n_flagged / n_total AS percent, 1e2 * rows_flagged / rows_total AS rows_percent "
            f"FROM (SELECT {counts} AS n_flagged, count(*) AS n_total FROM c0), (SELECT count(*) FILTER (flag_row) AS rows_flagged, count(*) AS rows_total FROM r0)"
        ),
        "summary_histogram": _sql(
            f"SELECT bin::INT AS bin, count(s) AS rows FROM range(6) AS b(bin) LEFT JOIN (SELECT unflagged * 1e0 / n AS s FROM {row}) ON "
            "bin = CASE WHEN s = 0 THEN 0 WHEN s <= 0.25 THEN 1 WHEN s <= 0.5 THEN 2 WHEN s <= 0.75 THEN 3 WHEN s < 1 THEN 4 ELSE 5 END GROUP BY bin"
        ),
        "summary_row_minmax": _sql(f"SELECT min(unflagged) AS min_unflagged, max(unflagged) AS max_unflagged, min(flagged) AS min_flagged, max(flagged) AS max_flagged FROM {row}"),
        "summary_row_size": _sql(f"SELECT min(n) AS min_size, max(n) AS max_size, min(n) = max(n) AS consistent FROM {row}"),
        "summary_uv_percentiles": _sql(" UNION ALL ".join(f"SELECT {float(p)}::DOUBLE AS percentile, round(({uvs.format(p / 100)}), 6) AS uv" for p in reports.UV_PERCENTILES)),
        "summary_spectral": "SELECT 1::BIGINT AS nspw, 8::BIGINT AS nchan, 1000e0 AS fmin_mhz, 1350e0 AS fmax_mhz, 350e0 AS bandwidth_mhz",
        "summary_dt_max": _sql(" UNION ALL ".join(f"SELECT {x}::DOUBLE AS loss, round(299792458e0 * sqrt(6 * {x}::DOUBLE) / (pi() * 7.2921150e-5 * {uv_max} * 13.5e8 * 0.0174533e0), 6) AS dt_max" for x in reports.LOSSES)),
        "summary_interval": _sql("SELECT interval_ AS dt FROM r0 WHERE row_id = 0"),
        "summary_fields": _sql("SELECT field_id, ['click', 'error', 'purchase', 'signup', 'view'][field_id + 1] AS name, count(*) AS rows FROM r0 GROUP BY field_id"),
        "barber_max": _barber_sql(),
        "barber_max_pol": _barber_sql("WHERE corr = 1"),
        "barber_stats": _sql(
            f"SELECT round(avg({_MASKED}), 6) AS mean_amplitude, " + ", ".join(f"round(quantile_cont({_MASKED}, {p / 100!r}), 6) AS p{str(p).replace('.', '_')}" for p in reports.AMPLITUDE_PERCENTILES) + " FROM c1",
            _NAN,
        ),
        "analyze_image_size": _sql(
            f"SELECT round({uv_max}, 6) AS max_baseline_m, 13.5e8::DOUBLE AS max_frequency_hz, round({resolution} * 180 / pi() * 3600, 6) AS resolution_arcsec, "
            f"((trunc(5 * (pi() / 180) / {resolution})::BIGINT + 1) // 2 * 2)::BIGINT AS image_size"
        ),
        "full_pipeline": _sql(f"SELECT row_id, k AS chan, corr, flag, {_DATA}, round(wt, 6) + 0e0 AS weight_spectrum, round(sg, 6) + 0e0 AS sigma_spectrum FROM c5 JOIN kept USING (chan) WHERE row_id IN (SELECT row_id FROM good)", *pipeline),
    }
