import numpy as np
import pytest

from fringeworks.operators.flagging import flag_frequencies, flag_uv_above, flag_values, frequency_counts, uv_above_counts, value_counts

from .arrays import random_set, to_arrays, to_set


def plain(rows, nchan, ncorr):
    a = random_set(rows, nchan, ncorr)
    a["flag"][:] = False
    return a


def test_uv_bound_is_exclusive_and_nan_stays(spark):
    a = plain(4, 2, 1)
    a["uvw"] = np.array([[3.0, 4, 0], [3, 4.01, 0], [np.nan, 1, 0], [100, 0, 0]])
    a["flag_row"][3] = True
    vs = to_set(spark, a)
    found = to_arrays(flag_uv_above(vs, 5.0))
    assert found["flag_row"].tolist() == [False, True, False, True] and not found["flag"].any()
    r = uv_above_counts(to_set(spark, {k: v[[0, 1, 3]] for k, v in a.items()}), 5.0).first()
    assert (r.max_uv, r.rows_above, r.newly_flagged, r.rows_flagged) == (100, 2, 1, 2)


def test_clip_bounds_are_inclusive(spark):
    a = plain(1, 6, 1)
    a["data"][0, :, 0] = [0, 1, 2, 10, 11, np.nan]
    assert to_arrays(flag_values(to_set(spark, a), clip=(1, 10)))["flag"].ravel().tolist() == [True, True, False, True, True, False]
    r = value_counts(to_set(spark, a), (1, 10)).first()
    assert (r.n_nan, r.n_clip, r.total) == (1, 4, 6)


def test_infinite_is_not_nan(spark):
    a = plain(1, 2, 1)
    a["data"][0, :, 0] = [complex(np.inf, np.nan), complex(1, np.nan)]
    assert to_arrays(flag_values(to_set(spark, a), nan=True))["flag"].ravel().tolist() == [False, True]


def test_no_operation_changes_nothing(spark):
    vs = to_set(spark, plain(2, 2, 1))
    assert flag_values(vs) is vs


def test_frequency_rules_keep_earlier_flags(spark):
    a = plain(2, 4, 1)
    a["data"][0, 0, 0] = np.nan
    vs = flag_values(to_set(spark, a, [1e8, 2e8, 3e8, 4e8]), nan=True)
    found = to_arrays(flag_frequencies(vs, [{"spw": [[250, 350]]}]))["flag"]
    assert found[0, 0, 0] and found[:, 2].all() and not found[0, 1, 0] and found.sum() == 3


def test_frequency_rule_bounds(spark):
    a = plain(4, 3, 2)
    a["uvw"] = np.array([[100.0, 0, 0], [200, 0, 0], [300, 0, 0], [np.nan, 0, 0]])
    rules = [{"spw": [[200, 300]], "uv_below": 300, "uv_above": 100}, {"uv_below": 1}, {"spw": [[100, 100]], "uv_above": 200}]
    vs = to_set(spark, a, [1e8, 2e8, 3e8])
    wanted = np.zeros((4, 3, 2), bool)
    wanted[1, 1:], wanted[2, 0] = True, True
    assert (to_arrays(flag_frequencies(vs, rules))["flag"] == wanted).all()
    assert [(r.entry, r.n_chan, r.n_ranges, r.n_vis) for r in frequency_counts(vs, rules).orderBy("entry").collect()] == [(0, 2, 1, 4), (1, 0, 0, 0), (2, 1, 1, 2)]


def test_rules_need_frequencies(spark):
    vs = to_set(spark, plain(1, 2, 1))
    with pytest.raises(RuntimeError):
        flag_frequencies(vs.having(vs.main, channel=vs.channel.limit(0)), [{"spw": [[1, 2]]}])
