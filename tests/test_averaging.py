import numpy as np
import pytest

from fringeworks.operators.averaging import frequency_average, time_average

from .arrays import by_channel, by_time, random_set, same, to_arrays, to_set


def with_model(a):
    return a | {"model": a["data"].real}


@pytest.mark.parametrize("factor,partitions", [(2, 1), (3, 3), (5, 8), (20, 2)])
def test_frequency_average(spark, factor, partitions):
    a = with_model(random_set(20, 23, 2))
    a["flag"][3] = True
    same(to_arrays(frequency_average(to_set(spark, a, partitions=partitions), factor)), by_channel(a, factor))


@pytest.mark.parametrize("factor,partitions", [(2, 1), (3, 3), (7, 8)])
def test_time_average(spark, factor, partitions):
    a = with_model(random_set(25, 5, 2))
    a["flag"][3] = True
    a["flag_row"][[0, 6, 7, 8]] = True
    found = to_arrays(time_average(to_set(spark, a, partitions=partitions), factor))
    same(found, by_time(a, factor))
    assert found["row_id"].tolist() == list(range(25 // factor))


def test_orders_do_not_commute(spark):
    a = with_model(random_set(12, 8, 2))
    vs = to_set(spark, a)
    one = to_arrays(time_average(frequency_average(vs, 4), 3))
    two = to_arrays(frequency_average(time_average(vs, 3), 4))
    same(one, by_time(by_channel(a, 4), 3))
    same(two, by_channel(by_time(a, 3), 4))
    assert not np.allclose(one["data"], two["data"])


def explicit(data, flag, axis):
    a = random_set(*np.moveaxis(np.zeros((len(data), 1, 1)), 0, axis).shape)
    put = lambda x: np.moveaxis(np.array(x).reshape(len(data), 1, 1), 0, axis)
    a |= {"data": put(data) + 0j, "flag": put(flag), "weight": put([2.0, 3, 5, 7]), "sigma": put([2.0, 4, 3, 5])}
    return with_model(a)


@pytest.mark.parametrize("axis", [0, 1])
def test_flagged_cells_do_not_count(spark, axis):
    vs = to_set(spark, explicit([10.0, 20, 30, 40], [False, True, False, False], axis))
    found = to_arrays((frequency_average if axis else time_average)(vs, 2))
    assert found["data"].real.ravel().tolist() == [10, 35]
    assert found["weight"].ravel().tolist() == [2, 12]
    np.testing.assert_allclose(found["sigma"].ravel(), [2, 1 / np.sqrt(1 / 9 + 1 / 25)])
    assert found["flag"].ravel().tolist() == [True, False]


@pytest.mark.parametrize("axis", [0, 1])
def test_wholly_flagged_block(spark, axis):
    vs = to_set(spark, explicit([1.0, 2, 3, 4], [True, True, False, False], axis))
    found = to_arrays((frequency_average if axis else time_average)(vs, 2))
    assert (found["data"].ravel()[0], found["weight"].ravel()[0], found["sigma"].ravel()[0]) == (0, 0, 1)
    if axis == 0:
        assert (found["time"][0], found["interval"][0], found["uvw"][0].tolist()) == (0, 0, [0, 0, 0])


def test_zero_sigma_weighs_everything(spark):
    a = explicit([1.0, 2, 3, 4], [False] * 4, 1)
    a["sigma"][0, 0, 0] = 0
    assert to_arrays(frequency_average(to_set(spark, a), 2))["sigma"].ravel()[0] == 0


def test_metadata_of_good_rows_only(spark):
    a = with_model(random_set(6, 2, 1))
    a["flag"][:] = False
    a["flag"][4] = True
    a["flag_row"][0] = True
    a["time"] = np.arange(6) * 10.0
    found = to_arrays(time_average(to_set(spark, a), 2))
    assert found["time"].tolist() == [10, 25, 50]
    assert found["interval"].tolist() == [2, 4, 2]
    np.testing.assert_allclose(found["uvw"], [a["uvw"][1], a["uvw"][2:4].mean(0), a["uvw"][5]])


def test_nan_in_a_flagged_row_stays(spark):
    a = with_model(random_set(2, 2, 1))
    a["flag_row"][0], a["time"][0] = True, np.nan
    assert np.isnan(to_arrays(time_average(to_set(spark, a), 2))["time"][0])


def test_factors_without_effect_and_short_sets(spark):
    a = with_model(random_set(3, 4, 1))
    vs = to_set(spark, a)
    assert frequency_average(vs, 1) is vs and frequency_average(vs, 5) is vs and time_average(vs, 1) is vs
    assert time_average(vs, 4).main.count() == 0


def test_channel_frequencies(spark):
    vs = to_set(spark, with_model(random_set(1, 5, 1)), [100.0, 200, 300, 400, 500])
    assert [r.chan_freq_hz for r in frequency_average(vs, 2).channel.orderBy("chan").collect()] == [150, 350, 500]


def test_absent_columns(spark):
    a = with_model(random_set(6, 4, 2))
    vs = to_set(spark, a)
    vs = vs.having(vs.main.drop("weight_spectrum", "sigma_spectrum", "interval", "exposure"))
    found = time_average(frequency_average(vs, 2), 2).main
    assert found.columns == vs.main.columns and found.count() == 3
