import math

import numpy as np
import pytest

from fringeworks.functions import quantiles
from fringeworks.functions.quantiles import exact_quantiles

AT = [0.0, 0.25, 0.33, 0.5, 0.95, 0.9999, 1.0]


def both(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "a double")
    return exact_quantiles(df, AT), exact_quantiles(df, AT, about=len(values))


@pytest.mark.parametrize("few", [0, 100_000])
@pytest.mark.parametrize("kind", ["uniform", "wide", "ties", "one", "tiny"])
def test_bins_give_what_one_buffer_gives(spark, monkeypatch, few, kind):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(7)
    values = {
        "uniform": rng.random(3000) * 100,
        "wide": np.exp(rng.normal(0, 30, 3000)),
        "ties": rng.integers(0, 4, 3000).astype(float),
        "one": np.array([2.5]),
        "tiny": np.array([0.0, 5e-324, 1e-310, 1.0, 1.0 + 2**-52, 1.7e308]),
    }[kind].tolist()
    (n, mean, got), (m, same, wanted) = both(spark, values)
    assert n == m == len(values) and got == wanted
    assert math.isclose(mean, same, rel_tol=1e-12)
    np.testing.assert_allclose(got, np.quantile(values, AT), rtol=1e-9)


def test_nulls_nan_infinity_and_nothing(spark):
    (n, _, got), (m, _, wanted) = both(spark, [None, 1.0, math.inf, math.nan, math.nan, 0.0, None])
    assert n == m == 5
    np.testing.assert_array_equal(got, wanted)
    assert both(spark, [None]) == ((0, None, []), (0, None, []))
    with pytest.raises(ValueError):
        exact_quantiles(spark.createDataFrame([(-1.0,)], "a double"), AT)
