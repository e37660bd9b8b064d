"""Reports as small DataFrames. Each is one aggregation of the rows it needs, percentiles a few; columns it does not use are not read."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import EARTH_TURN, LIGHT, amplitude, squared_uv, timestamp_of, uv_distance
from ..functions.quantiles import exact_quantiles
from ..sources.model import VisibilitySet

UV_PERCENTILES = (25, 33, 50, 75, 95, 100)
AMPLITUDE_PERCENTILES = (50, 95, 99, 99.99, 99.999)
LOSSES = (0.01, 0.03, 0.05)
DEFAULT_OFFSET = 0.0174533  # rad
BINS = ("0%", "1-25%", "26-50%", "51-75%", "76-99%", "100%")


def _per_row(vs: VisibilitySet) -> DataFrame:
    flagged = F.size(F.filter("flag", lambda x: x))
    return vs.main.select("flag_row", F.size("flag").alias("n"), flagged.alias("flagged")).withColumn("unflagged", F.col("n") - F.col("flagged"))


def flag_totals(vs: VisibilitySet) -> DataFrame:
    """n_flagged, n_total, percent; rows_flagged, rows_total, rows_percent. Flagged rows do not count as flagged cells."""
    found = _per_row(vs).agg(
        F.coalesce(F.sum("flagged"), F.lit(0)).cast("long").alias("n_flagged"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_total"),
        F.count_if("flag_row").alias("rows_flagged"),
        F.count("*").alias("rows_total"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.col(a) / F.col(b)).otherwise(0.0)
    return found.withColumn("percent", share("n_flagged", "n_total")).withColumn("rows_percent", share("rows_flagged", "rows_total"))


def unflagged_histogram(vs: VisibilitySet) -> DataFrame:
    """bin (0 to 5) and rows: rows by share of unflagged cells: none, to a quarter, half, three quarters, under all, all."""
    share = F.col("unflagged") / F.greatest(F.col("n"), F.lit(1))
    bin_ = F.when(share == 0, 0).when(share >= 1, 5).otherwise(F.greatest(F.lit(1), F.ceil(share * 4)).cast("int"))
    edges = _per_row(vs).agg(*(F.count_if(bin_ == k).alias(f"b{k}") for k in range(6)))
    return edges.select(F.explode(F.array(*(F.struct(F.lit(k).alias("bin"), F.col(f"b{k}").alias("rows")) for k in range(6)))).alias("x")).select("x.*")


def row_extremes(vs: VisibilitySet) -> DataFrame:
    """Least and most unflagged, flagged and cells in a row."""
    return _per_row(vs).agg(*(f(c).cast("long").alias(f"{name}_{c}") for c in ("unflagged", "flagged") for name, f in (("min", F.min), ("max", F.max))))


def row_sizes(vs: VisibilitySet) -> DataFrame:
    """min_size, max_size and consistent: all rows have arrays of one size."""
    return _per_row(vs).agg(F.min("n").cast("long").alias("min_size"), F.max("n").cast("long").alias("max_size")).withColumn("consistent", F.col("min_size") == F.col("max_size"))


def uv_percentiles(vs: VisibilitySet, at: tuple[float, ...] = UV_PERCENTILES) -> DataFrame:
    """percentile and uv (m), exact, between neighbours in proportion; no rows for a set without rows."""
    _, _, found = exact_quantiles(vs.main.select(uv_distance().alias("v")), [p / 100 for p in at], vs.main.count())
    return vs.main.sparkSession.createDataFrame([(float(p), v) for p, v in zip(at, found)], "percentile double, uv double")


def spectral(vs: VisibilitySet) -> DataFrame:
    """nspw, nchan, fmin_mhz (first channel), fmax_mhz (last), bandwidth_mhz; negative for falling frequencies."""
    nspw = vs.channel.agg(F.count_distinct("spw_id").alias("nspw"))
    ends = vs.channels().agg(F.count("*").alias("nchan"), (F.min_by("chan_freq_hz", "chan") / 1e6).alias("fmin_mhz"), (F.max_by("chan_freq_hz", "chan") / 1e6).alias("fmax_mhz"))
    return nspw.crossJoin(ends).withColumn("bandwidth_mhz", F.col("fmax_mhz") - F.col("fmin_mhz"))  # two single rows


def longest_integrations(vs: VisibilitySet, offset: float = DEFAULT_OFFSET) -> DataFrame:
    """loss and dt_max (s): how long one may average before turning fringes cost that share of the amplitude."""
    uv = vs.main.agg(F.sqrt(F.max(squared_uv())).alias("uv"))
    nu = vs.channels().agg(F.max_by("chan_freq_hz", "chan").alias("nu"))
    down = F.lit(math.pi * EARTH_TURN) * F.col("uv") * F.col("nu") * F.lit(float(offset))
    of = lambda loss: F.when((F.col("uv") > 0) & (F.col("nu") > 0) & (F.lit(offset) > 0), F.lit(LIGHT * math.sqrt(6 * loss)) / down).otherwise(float("inf"))
    rows = F.array(*(F.struct(F.lit(x).alias("loss"), of(x).alias("dt_max")) for x in LOSSES))
    return uv.crossJoin(nu).select(F.explode(rows).alias("x")).select("x.*")  # two single rows


def current_integration(vs: VisibilitySet) -> DataFrame:
    """dt (s) of the first row: its interval, else its exposure."""
    column = next((c for c in ("interval", "exposure") if vs.has(c)), None)
    return vs.main.agg((F.min_by(column, "row_id") if column else F.lit(None).cast("double")).alias("dt"))


def fields(vs: VisibilitySet) -> DataFrame:
    """field_id, name and rows of the fields that have rows; a field without a name is called by its number."""
    rows = vs.main.groupBy("field_id").agg(F.count("*").alias("rows"))
    named = rows.join(F.broadcast(vs.field.select("field_id", F.trim("name").alias("name"))), "field_id", "left")
    return named.select("field_id", F.coalesce("name", F.concat(F.lit("FIELD_ID="), F.col("field_id").cast("string"))).alias("name"), "rows")


def _masked(vs: VisibilitySet) -> DataFrame:
    if not vs.has("weight_spectrum"):
        raise RuntimeError("the strongest visibility needs weights")
    zipped = F.arrays_zip("data_re", "data_im", "flag")
    return vs.main.withColumn("_a", F.transform(zipped, lambda x: F.when(x["flag"], 0.0).otherwise(amplitude(x["data_re"], x["data_im"]))))


def strongest(vs: VisibilitySet, corr: int | None = None) -> DataFrame:
    """The first cell of largest amplitude, flagged ones as 0, with its place, flag, weight, time and antennas."""
    ranked = F.transform("_a", lambda a, i: F.struct(a.alias("a"), (-i).alias("neg")))
    if corr is not None:
        ranked = F.filter(ranked, lambda x: (-x["neg"]) % vs.ncorr == corr)
    rows = _masked(vs).select("row_id", "time", "antenna1", "antenna2", F.array_max(ranked).alias("top"), "flag", "weight_spectrum").filter("top is not null")
    pos = -F.col("top.neg")
    rows = rows.select(
        F.struct(F.col("top.a").alias("a"), (-F.col("row_id")).alias("neg")).alias("rank"),
        F.struct("row_id", pos.alias("pos"), F.get("flag", pos).alias("flag"), F.get("weight_spectrum", pos).alias("weight"), "time", "antenna1", "antenna2").alias("cell"),
    )
    best = rows.agg(F.max("rank").alias("rank"), F.max_by("cell", "rank").alias("cell"))
    return best.select(
        F.col("rank.a").alias("max_amplitude"),
        F.col("cell.row_id").alias("row_id"),
        F.expr(f"int(cell.pos div {vs.ncorr})").alias("chan"),
        (F.col("cell.pos") % vs.ncorr).alias("corr"),
        F.col("cell.flag").alias("flag"),
        F.col("cell.weight").alias("weight"),
        timestamp_of(F.col("cell.time")).alias("timestamp"),
        F.col("cell.antenna1").alias("antenna1"),
        F.col("cell.antenna2").alias("antenna2"),
    )


def amplitude_statistics(vs: VisibilitySet, at: tuple[float, ...] = AMPLITUDE_PERCENTILES) -> DataFrame:
    """mean_amplitude and percentiles over all cells, flagged ones as 0."""
    _, mean, found = exact_quantiles(_masked(vs).select(F.explode("_a").alias("v")), [p / 100 for p in at], vs.main.count() * vs.nchan * vs.ncorr)
    names = [f"p{str(p).replace('.', '_')}" for p in at]
    return vs.main.sparkSession.createDataFrame([(mean, *(found or [None] * len(at)))], ", ".join(f"{c} double" for c in ("mean_amplitude", *names)))


def image_report(vs: VisibilitySet, fov: float, oversampling: float = 5.0) -> DataFrame:
    """max_baseline_m, max_frequency_hz, resolution_arcsec, image_size; nulls where there is no resolution. Flags do not matter."""
    uv = vs.main.agg(F.sqrt(F.max(squared_uv())).alias("max_baseline_m"))
    nu = vs.channel.agg(F.max("chan_freq_hz").alias("max_frequency_hz"))
    resolution = F.when((F.col("max_baseline_m") > 0) & (F.col("max_frequency_hz") > 0), F.lit(LIGHT) / (F.col("max_frequency_hz") * F.col("max_baseline_m")))
    pixels = F.expr("(cast(_n as bigint) + 1) div 2 * 2")
    found = uv.crossJoin(nu).withColumn("_r", resolution).withColumn("_n", F.lit(float(oversampling * fov)) / F.col("_r"))  # two single rows
    return found.select("max_baseline_m", "max_frequency_hz", (F.col("_r") * (180 / math.pi * 3600)).alias("resolution_arcsec"), pixels.alias("image_size"))
