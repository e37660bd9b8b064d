"""Commands: ``python -m fringeworks.cli process …`` and ``python -m fringeworks.cli analyze …``."""

from __future__ import annotations

import argparse
import datetime
import json
import logging
from importlib.metadata import PackageNotFoundError, version

from pyspark.sql import SparkSession

from .functions.numbers import angle, image_size
from .plans import reports, text
from .plans.sequence import Steps, run
from .sources.storage import open_set, read_rules, update, write_new


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fringeworks", description=__doc__)
    try:
        told = version("fringeworks")
    except PackageNotFoundError:
        told = "0.1"
    p.add_argument("--version", action="version", version=told)
    commands = p.add_subparsers(dest="command", required=True)
    a = commands.add_parser("process", help="flag, average, prune, report, write")
    a.add_argument("--ms", required=True, help="folder of a visibility set")
    a.add_argument("--msout", help="folder to write")
    a.add_argument("--summary", action="store_true")
    a.add_argument("--optimize", action="store_true", help="drop wholly flagged rows and channels; needs --msout")
    a.add_argument("--time-average-factor", type=int, default=1)
    a.add_argument("--frequency-average-factor", type=int, default=1)
    a.add_argument("--clobber", action="store_true")
    a.add_argument("--barber", action="store_true", help="report the strongest visibility")
    a.add_argument("--barber-pol", type=int)
    a.add_argument("--apply", action="store_true", help="update --ms; without effect beside --msout")
    a.add_argument("--flag-uv-above", type=float)
    a.add_argument("--flag-nan", action="store_true")
    a.add_argument("--flag-clip", type=float, nargs=2, metavar=("MIN", "MAX"))
    a.add_argument("--flag-spectral-window", metavar="RULES")
    a.add_argument("--debug", action="store_true")
    a.add_argument("--field-of-view", default="1.0 deg")
    a.add_argument("--split", help="field, by number or name, to keep when writing --msout")
    b = commands.add_parser("analyze", help="recommend an image size")
    b.add_argument("--ms", required=True)
    b.add_argument("--image-fov", required=True)
    b.add_argument("--oversampling-factor", type=float, default=5.0)
    b.add_argument("--output-json")
    return p


def process(spark: SparkSession, o: argparse.Namespace) -> None:
    if o.optimize and not o.msout:
        raise RuntimeError("--optimize drops rows and channels: give --msout to write what remains")
    if o.debug:
        logging.basicConfig(filename=f"fringeworks.{datetime.datetime.now():%Y%m%d-%H%M%S}.log", level=logging.DEBUG)
    rules = read_rules(o.flag_spectral_window) if o.flag_spectral_window else []
    steps = Steps(o.flag_uv_above, o.flag_nan, tuple(o.flag_clip) if o.flag_clip else None, rules, o.frequency_average_factor, o.time_average_factor, o.optimize)
    vs = run(open_set(spark, o.ms), steps)
    if o.summary:
        print(text.summary(vs, o.ms, angle(o.field_of_view)))
    if o.barber:
        print(text.strongest(vs, o.barber_pol))
    if o.msout:
        write_new(vs, o.msout, o.clobber, o.split)
    elif o.apply:
        update(vs, o.ms, o.clobber)


def analyze(spark: SparkSession, o: argparse.Namespace) -> dict | None:
    vs, fov = open_set(spark, o.ms), angle(o.image_fov)
    row = reports.image_report(vs, fov, o.oversampling_factor).first()
    found = image_size(row.max_baseline_m or 0.0, row.max_frequency_hz or 0.0, fov, o.oversampling_factor)
    if found is None:
        print("No resolution: baselines or frequencies are missing")
        return None
    print(f"{o.ms}: baselines to {row.max_baseline_m:.0f} m, frequencies to {row.max_frequency_hz / 1e6:.3f} MHz")
    print(f"resolution {row.resolution_arcsec:.2f} arcsec; for {o.image_fov}: {found[1]} x {found[1]} pixels")
    told = {
        "ms": o.ms,
        "max_baseline_m": row.max_baseline_m,
        "max_frequency_hz": row.max_frequency_hz,
        "max_frequency_mhz": row.max_frequency_hz / 1e6,
        "resolution_arcsec": row.resolution_arcsec,
        "field_of_view": o.image_fov,
        "oversampling_factor": o.oversampling_factor,
        "recommended_image_size_pixels": found[1],
    }
    if o.output_json:
        with open(o.output_json, "w") as f:
            json.dump(told, f, indent=2)
    return told


def main(argv: list[str] | None = None) -> None:
    o = parser().parse_args(argv)
    spark = SparkSession.builder.appName("fringeworks").getOrCreate()
    (process if o.command == "process" else analyze)(spark, o)


if __name__ == "__main__":
    main()
