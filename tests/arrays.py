"""Small visibility sets and the array reference that results are held against."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fringeworks.sources.model import VisibilitySet

MAIN = (
    "row_id long, field_id int, time double, antenna1 int, antenna2 int, u double, v double, w double, interval double, exposure double, "
    "flag_row boolean, data_re array<double>, data_im array<double>, flag array<boolean>, weight_spectrum array<double>, sigma_spectrum array<double>, model array<double>"
)


def random_set(rows: int, nchan: int, ncorr: int, seed: int = 0) -> dict:
    r = np.random.default_rng(seed)
    shape = (rows, nchan, ncorr)
    return {
        "data": r.normal(size=shape) + 1j * r.normal(size=shape),
        "flag": r.random(shape) > 0.7,
        "weight": r.random(shape) + 0.1,
        "sigma": (r.random(shape) + 0.1) * 2,
        "uvw": r.normal(size=(rows, 3)) * 100,
        "time": np.arange(rows, dtype=float),
        "interval": np.full(rows, 2.0),
        "exposure": np.full(rows, 2.0),
        "flag_row": np.zeros(rows, bool),
        "antenna1": np.arange(rows) % 4,
        "antenna2": np.arange(rows) % 3,
        "field": np.arange(rows) % 2,
    }


def to_set(spark, a: dict, freqs=None, partitions: int = 3) -> VisibilitySet:
    rows, nchan, ncorr = a["data"].shape
    flat = lambda x, kind: x.reshape(rows, -1).astype(kind).tolist()
    table = list(zip(
        range(rows), a["field"].tolist(), a["time"].tolist(), a["antenna1"].tolist(), a["antenna2"].tolist(),
        *a["uvw"].T.tolist(), a["interval"].tolist(), a["exposure"].tolist(), a["flag_row"].tolist(),
        flat(a["data"].real, float), flat(a["data"].imag, float), flat(a["flag"], bool), flat(a["weight"], float), flat(a["sigma"], float), flat(a["data"].real, float),
    ))
    freqs = [1e9 + 5e7 * c for c in range(nchan)] if freqs is None else freqs
    main = spark.createDataFrame(table, MAIN).orderBy(F.rand(1)).repartition(partitions)
    channel = spark.createDataFrame([(0, c, float(f)) for c, f in enumerate(freqs)], "spw_id int, chan int, chan_freq_hz double")
    field = spark.createDataFrame([(0, "alpha "), (1, "beta")], "field_id int, name string")
    return VisibilitySet(main, channel, field, nchan, ncorr)


def to_arrays(vs: VisibilitySet) -> dict:
    rows = vs.main.orderBy("row_id").collect()
    shape = (len(rows), vs.nchan, vs.ncorr)
    plane = lambda c: np.array([r[c] for r in rows]).reshape(shape)
    return {
        "data": plane("data_re") + 1j * plane("data_im"),
        "flag": plane("flag"),
        "weight": plane("weight_spectrum"),
        "sigma": plane("sigma_spectrum"),
        "model": plane("model"),
        "uvw": np.array([[r.u, r.v, r.w] for r in rows]).reshape(-1, 3),
        **{c: np.array([r[c] for r in rows]) for c in ("time", "interval", "exposure", "flag_row", "antenna1", "antenna2", "row_id")},
    }


def block_average(a: dict, blocks: list[tuple[int, int]], axis: int) -> dict:
    """Loops over blocks (lo, hi) of an axis of the plane."""
    out = {k: [] for k in ("data", "flag", "weight", "sigma", "model")}
    for lo, hi in blocks:
        cut = [slice(None)] * 3
        cut[axis] = slice(lo, hi)
        cut = tuple(cut)
        good = ~a["flag"][cut]
        n = good.sum(axis)
        out["data"].append(np.where(good, a["data"][cut], 0).sum(axis) / np.maximum(n, 1))
        out["flag"].append(a["flag"][cut].any(axis))
        out["weight"].append(np.where(good, a["weight"][cut], 0).sum(axis))
        with np.errstate(divide="ignore"):
            s = np.where(good, 1 / a["sigma"][cut] ** 2, 0).sum(axis)
        out["sigma"].append(np.sqrt(1 / np.where(s == 0, 1, s)))
        out["model"].append(np.take(a["model"], lo, axis))
    return {k: np.stack(v, axis) for k, v in out.items()}


def by_channel(a: dict, factor: int) -> dict:
    n = a["data"].shape[1]
    return a | block_average(a, [(lo, min(n, lo + factor)) for lo in range(0, n, factor)], 1)


def by_time(a: dict, factor: int) -> dict:
    n = len(a["time"]) // factor
    out = a | block_average(a, [(k * factor, (k + 1) * factor) for k in range(n)], 0)
    good = ~(a["flag_row"] | a["flag"].all((1, 2)))
    split = lambda x: x[: n * factor].reshape(n, factor, *x.shape[1:])
    g = split(good).astype(float)
    count = np.maximum(g.sum(1), 1)
    out["uvw"] = (split(a["uvw"]) * g[..., None]).sum(1) / count[:, None]
    out["time"] = (split(a["time"]) * g).sum(1) / count
    for c in ("interval", "exposure"):
        out[c] = (split(a[c]) * g).sum(1)
    out["flag_row"] = split(a["flag_row"]).any(1)
    for c in ("antenna1", "antenna2"):
        out[c] = a[c][: n * factor : factor]
    return out


def same(found: dict, wanted: dict, names=("data", "flag", "weight", "sigma", "model", "uvw", "time", "interval", "exposure", "flag_row", "antenna1", "antenna2")) -> None:
    for c in names:
        assert found[c].shape == wanted[c].shape, c
        np.testing.assert_allclose(found[c], wanted[c], rtol=1e-9, atol=1e-12, err_msg=c)
