import json

import numpy as np
import pytest

from fringeworks import cli
from fringeworks.functions.numbers import angle, image_size, longest_integration
from fringeworks.operators.averaging import frequency_average, time_average
from fringeworks.operators.flagging import flag_uv_above
from fringeworks.operators.pruning import field_id, only_field, optimize, prune_counts
from fringeworks.plans import reports, text
from fringeworks.plans.sequence import Steps, run
from fringeworks.sources.storage import open_set, rules_from, update, write_new
from fringeworks.streaming.flags import flagged

from .arrays import random_set, to_arrays, to_set


def dead():
    a = random_set(5, 4, 2)
    a["flag"][:] = False
    a["flag"][:, 1] = True  # a dead channel
    a["flag"][2] = True  # a dead row
    a["flag"][:, 3] = True
    a["flag"][0, 3, 1] = False  # clean only in a row that goes
    a["flag_row"][0] = True
    return a


def test_optimize(spark):
    vs = optimize(to_set(spark, dead()))
    found = to_arrays(vs)
    assert found["row_id"].tolist() == [1, 3, 4] and vs.nchan == 3
    np.testing.assert_array_equal(found["data"], dead()["data"][[1, 3, 4]][:, [0, 2, 3]])
    assert [(r.chan, r.chan_freq_hz) for r in vs.channel.orderBy("chan").collect()] == [(0, 1e9), (1, 1.1e9), (2, 1.15e9)]
    r = prune_counts(to_set(spark, dead())).first()
    assert (r.n_total, r.n_flag_row, r.n_all_data, r.n_combined, r.n_remaining, r.n_extra, r.n_chan_flagged, r.n_chan_total) == (5, 1, 1, 2, 3, 1, 1, 4)


def test_nothing_left(spark):
    a = dead()
    a["flag_row"][:] = True
    with pytest.raises(RuntimeError):
        optimize(to_set(spark, a))


def test_a_flagged_row_drops_its_block(spark):
    a = random_set(4, 2, 1)
    a["flag"][:] = False
    a["uvw"][:] = 0
    a["uvw"][1, 0] = 9e3
    vs = time_average(flag_uv_above(to_set(spark, a), 1e3), 2)
    found = to_arrays(vs)
    np.testing.assert_allclose(found["data"][0], a["data"][:2].mean(0))
    assert found["flag_row"].tolist() == [True, False]
    assert to_arrays(optimize(vs))["row_id"].tolist() == [1]


def test_fields(spark):
    vs = to_set(spark, random_set(5, 2, 1))
    assert field_id(vs, "alpha") == 0 and field_id(vs, "7") == 7 and field_id(vs, 1) == 1
    assert to_arrays(only_field(vs, "beta"))["row_id"].tolist() == [1, 3]
    for bad in ("gamma", "7"):
        with pytest.raises(RuntimeError):
            only_field(vs, bad)
    assert sorted(map(tuple, reports.fields(vs).collect())) == [(0, "alpha", 3), (1, "beta", 2)]
    unnamed = vs.having(vs.main, field=vs.field.filter("field_id = 0"))
    assert "FIELD_ID=1" in {r.name for r in reports.fields(unnamed).collect()}


def test_summary(spark):
    a = random_set(6, 2, 2)
    a["flag"] = np.zeros((6, 4), bool)
    for row, n in enumerate([0, 1, 2, 3, 4, 4]):
        a["flag"][row, :n] = True
    a["flag"] = a["flag"].reshape(6, 2, 2)
    vs = to_set(spark, a)
    assert [r.rows for r in reports.unflagged_histogram(vs).orderBy("bin").collect()] == [2, 1, 1, 1, 0, 1]
    t = reports.flag_totals(vs).first()
    assert (t.n_flagged, t.n_total, t.rows_flagged, t.rows_total) == (14, 24, 0, 6)
    uv = np.hypot(*a["uvw"][:, :2].T)
    np.testing.assert_allclose([r.uv for r in reports.uv_percentiles(vs).orderBy("percentile").collect()], np.percentile(uv, reports.UV_PERCENTILES))
    assert reports.row_sizes(vs).first().consistent
    odd = vs.having(vs.main.selectExpr("*", "if(row_id = 1, slice(flag, 1, 3), flag) AS f").drop("flag").withColumnRenamed("f", "flag"))
    assert not reports.row_sizes(odd).first().consistent
    assert "alpha" in text.summary(vs, "x") and reports.current_integration(vs).first().dt == 2.0


def test_summary_reads_the_averaged_rows(spark):
    a = random_set(4, 2, 1)
    a["flag"][:] = False
    a["uvw"][:] = 0
    a["uvw"][0, 0] = 100
    assert reports.uv_percentiles(time_average(to_set(spark, a), 2)).agg({"uv": "max"}).first()[0] == 50


def test_strongest(spark):
    a = random_set(4, 3, 2)
    a["data"][:], a["flag"][:] = 0, False
    a["data"][1, 2, 0], a["data"][2, 1, 0], a["data"][3, 0, 1] = 10, 10, 99
    a["flag"][3, 0, 1] = True
    vs = to_set(spark, a)
    r = reports.strongest(vs).first()
    assert (r.max_amplitude, r.row_id, r.chan, r["corr"], r.antenna1) == (10, 1, 2, 0, 1)
    a["data"][0, 1, 1] = 4
    r = reports.strongest(to_set(spark, a), 1).first()
    assert (r.max_amplitude, r.row_id, r.chan, r["corr"]) == (4, 0, 1, 1)
    assert str(r.timestamp) == "1858-11-17 00:00:00"
    assert "Max |v| = 10" in text.strongest(vs)
    with pytest.raises(RuntimeError):
        reports.strongest(vs.having(vs.main.drop("weight_spectrum")))


@pytest.mark.parametrize("uv,nu,offset,loss,wanted", [
    (1e3, 1.4e9, 1, 0.01, 0.229), (1e2, 1.4e9, 1, 0.01, 2.29), (1e4, 1.4e9, 1, 0.01, 0.0229), (1e3, 150e6, 1, 0.01, 2.14),
    (1e3, 5e9, 1, 0.01, 0.0642), (1e3, 1.4e9, 0.0174533, 0.01, 13.1), (1e3, 1.4e9, 1, 0.03, 0.397), (1e3, 1.4e9, 0.1, 0.01, 2.29),
])
def test_longest_integration(uv, nu, offset, loss, wanted):
    assert longest_integration(uv, nu, offset, loss) == pytest.approx(wanted, rel=0.02)
    assert longest_integration(0, nu, offset, loss) == float("inf")


def test_angles_and_image_size():
    assert angle("1.0 deg") == pytest.approx(0.0174533, rel=1e-6)
    assert angle("60 arcmin") == angle("3600arcsec") == pytest.approx(angle("1 degs"))
    assert angle("0.5 rad") == 0.5
    with pytest.raises(ValueError):
        angle("wide")
    assert image_size(0.0, 1e9, 1, 5) is None and image_size(1000.0, 1e9, 0.01, 5)[1] % 2 == 0


def test_a_set_survives_a_replacement_that_fails(spark, tmp_path, monkeypatch):
    from fringeworks.sources import storage

    vs, path = to_set(spark, random_set(6, 5, 2)), f"file://{tmp_path}/x.set"
    write_new(vs, path)
    move, asked = storage._move, []

    def failing(spark, old, new):
        asked.append(new)
        if len(asked) == 2:
            raise RuntimeError("no")
        move(spark, old, new)

    monkeypatch.setattr(storage, "_move", failing)
    with pytest.raises(RuntimeError):
        write_new(vs, path, clobber=True)
    assert open_set(spark, path).main.count() == 6 and len(asked) == 3


def test_write_open_update(spark, tmp_path):
    path = f"file://{tmp_path}/set"
    vs = frequency_average(to_set(spark, random_set(6, 5, 2)), 2)
    write_new(vs, path)
    again = open_set(spark, path)
    assert (again.nchan, again.ncorr) == (3, 2)
    np.testing.assert_array_equal(to_arrays(again)["data"], to_arrays(vs)["data"])
    with pytest.raises(RuntimeError):
        write_new(vs, path)
    write_new(vs, path, clobber=True, split="alpha")
    assert open_set(spark, path).main.count() == 3
    far = flag_uv_above(open_set(spark, path), 0.0)
    with pytest.raises(RuntimeError):
        update(far, path)
    update(far, path, clobber=True)
    assert all(r.flag_row for r in open_set(spark, path).main.collect())
    with pytest.raises(RuntimeError):
        update(time_average(open_set(spark, path), 2), path, clobber=True)
    with pytest.raises(RuntimeError):
        open_set(spark, f"{path}-none")


def test_rules():
    assert rules_from("- spw:\n  - [1, 2]\n  uv_below: 600\n") == [{"spw": [[1, 2]], "uv_below": 600}]
    with pytest.raises(RuntimeError):
        rules_from("spw: 1")


def test_commands(spark, tmp_path, capsys):
    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    a = dead()
    write_new(to_set(spark, a), path)
    rules = tmp_path / "rules.yml"
    rules.write_text("- spw:\n  - [1000, 1000]\n")
    parse = cli.parser().parse_args
    cli.process(spark, parse(["process", "--ms", path, "--msout", out, "--summary", "--barber", "--optimize", "--flag-nan", "--flag-clip", "-1", "100", "--flag-spectral-window", str(rules)]))
    assert "Max |v|" in capsys.readouterr().out and open_set(spark, out).nchan <= 2
    cli.process(spark, parse(["process", "--ms", path, "--apply", "--clobber", "--flag-uv-above", "0"]))
    assert open_set(spark, path).main.filter("not flag_row").isEmpty()
    with pytest.raises(RuntimeError):
        cli.process(spark, parse(["process", "--ms", path, "--optimize", "--apply"]))
    told = cli.analyze(spark, parse(["analyze", "--ms", path, "--image-fov", "1.0 deg", "--output-json", str(tmp_path / "r.json")]))
    assert json.loads((tmp_path / "r.json").read_text()) == told and len(told) == 8
    row = reports.image_report(open_set(spark, path), angle("1.0 deg")).first()
    assert row.image_size == told["recommended_image_size_pixels"]


def test_stream(spark, tmp_path):
    vs = to_set(spark, random_set(6, 4, 2))
    vs.main.write.parquet(f"{tmp_path}/rows")
    steps = Steps(uv_above=50.0, nan=True, clip=(0.0, 2.0), rules=[{"spw": [[1000, 1050]]}], frequency_factor=2)
    stream = flagged(spark.readStream.schema(vs.main.schema).parquet(f"{tmp_path}/rows"), vs, steps)
    query = stream.writeStream.format("memory").queryName("flagged_rows").start()
    query.processAllAvailable()
    query.stop()
    batch = run(vs, steps)
    found = to_arrays(batch.having(spark.table("flagged_rows")))
    np.testing.assert_array_equal(found["flag"], to_arrays(batch)["flag"])
    with pytest.raises(ValueError):
        flagged(vs.main, vs, Steps(time_factor=2))
