"""Visibility sets as folders of Parquet tables, flag-rule files, and reports as JSON.

A set's folder holds ``main``, ``channel`` and ``field``. Paths are Spark paths; all
reads and writes go through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pruning import only_field
from .model import VisibilitySet


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def _move(spark: SparkSession, old: str, new: str) -> None:
    fs, where = _file_system(spark, old)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise RuntimeError(f"can't rename {old} to {new}")


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def open_set(spark: SparkSession, path: str) -> VisibilitySet:
    """Opens a folder; a missing one is a RuntimeError. Its shape is taken from one row and the channel table."""
    if not exists(spark, f"{path}/main"):
        raise RuntimeError(f"no visibility set at {path}")
    main, channel, field = (spark.read.parquet(f"{path}/{t}") for t in ("main", "channel", "field"))
    first = main.select(F.size("flag").alias("n")).head()
    described = channel.filter("spw_id = 0").agg(F.max("chan")).first()[0]
    n = first["n"] if first else 0
    nchan = described + 1 if described is not None else n
    if "ncorr" in channel.columns and (c := channel.agg(F.max("ncorr")).first()[0]):
        nchan = n // c
    ncorr = n // nchan if nchan and n else 1
    return VisibilitySet(main, channel, field, nchan, max(1, ncorr))


def write_new(vs: VisibilitySet, path: str, clobber: bool = False, split: str | int | None = None) -> None:
    """Writes all columns and the dimension tables; ``split`` keeps one field. An existing folder needs ``clobber``."""
    spark = vs.main.sparkSession
    if split is not None:
        vs = only_field(vs, split)
    if exists(spark, path) and not clobber:
        raise RuntimeError(f"{path} exists; ask for it to be replaced")
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    _write(vs, fresh)
    if not exists(spark, path):
        return _move(spark, fresh, path)
    # The old set is there, under one name or the other, until the new one has its place.
    old = f"{fresh}.old"
    _move(spark, path, old)
    try:
        _move(spark, fresh, path)
    except Exception:
        _move(spark, old, path)
        raise
    _delete(spark, old)


def update(vs: VisibilitySet, path: str, clobber: bool = False) -> None:
    """Replaces ``path`` by the set if only columns changed; needs ``clobber``.

    Parquet has no columns that can be written alone, so the tables are written
    beside the old ones and then renamed. Nothing changed: nothing is written.
    """
    if not clobber:
        raise RuntimeError("an update in place must be asked for")
    if vs.reshaped:
        raise RuntimeError("rows or channels were merged or dropped: write a new set")
    if vs.changed:
        write_new(vs, path, clobber=True)


def _write(vs: VisibilitySet, path: str) -> None:
    # Clustered by row_id: blocks of rows stay in few partitions, so averages combine before they shuffle.
    vs.main.repartitionByRange("row_id").sortWithinPartitions("row_id").write.parquet(f"{path}/main")
    vs.channel.drop("ncorr").withColumn("ncorr", F.lit(vs.ncorr)).write.parquet(f"{path}/channel")
    vs.field.write.parquet(f"{path}/field")


def rules_from(text: str) -> list[dict]:
    """Flag rules of a YAML list: ``spw`` (ranges in MHz) with optional ``uv_below`` and ``uv_above`` (m)."""
    found = yaml.safe_load(text)
    if not isinstance(found, list):
        raise RuntimeError("flag rules must be a list")
    return found


def read_rules(path: str) -> list[dict]:
    with open(path) as f:
        return rules_from(f.read())


def write_json(report: DataFrame, path: str) -> dict:
    """The one row of a report as a JSON file."""
    row = report.first().asDict()
    with open(path, "w") as f:
        json.dump(row, f, indent=2)
    return row
