"""A deterministic visibility set made from an ``events`` table, whose ids are dense from 0."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .model import VisibilitySet

NCHAN, NCORR = 8, 2
FIELDS = ("click", "error", "purchase", "signup", "view")


def from_events(spark: SparkSession, sf_dir: str) -> VisibilitySet:
    e = F.col("event_id")
    plane = lambda f: F.transform(F.sequence(F.lit(0), F.lit(NCHAN * NCORR - 1)), lambda i: f(F.floor(i / NCORR), i % NCORR))
    zero = lambda c: (e + c) % 89 == 0
    dead = (e % 29 == 0) | (F.expr("(event_id div 3) % 100 = 0"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    main = events.select(
        e.alias("row_id"),
        (F.array_position(F.array(*map(F.lit, FIELDS)), F.col("event_type")) - 1).cast("int").alias("field_id"),
        F.lit(0).alias("data_desc_id"),
        (F.lit(5.0e9) + 8 * e).alias("time"),
        (F.col("user_id") % 16).cast("int").alias("antenna1"),
        ((F.col("user_id") * 7 + 3) % 16).cast("int").alias("antenna2"),
        ((37 * e) % 2001 - 1000).cast("double").alias("u"),
        ((53 * e) % 1501 - 750).cast("double").alias("v"),
        (e % 11).cast("double").alias("w"),
        F.lit(8.0).alias("interval"),
        (F.lit(8.0) - 0.5 * (e % 2)).alias("exposure"),
        (e % 23 == 0).alias("flag_row"),
        plane(lambda c, p: F.when(zero(c), 0.0).when((e + 3 * c + p) % 97 == 0, float("nan")).otherwise(F.round(100 * F.col("value")) * (1 + c) / 128)).alias("data_re"),
        plane(lambda c, p: F.when(zero(c), 0.0).otherwise((F.col("user_id") - 75) * (1 + p) / F.lit(64.0))).alias("data_im"),
        plane(lambda c, p: dead | ((31 * e + 17 * c + 7 * p) % 11 == 0)).alias("flag"),
        plane(lambda c, p: F.lit(1.0) + ((e + c + p) % 4) / F.lit(4.0)).alias("weight_spectrum"),
        plane(lambda c, p: F.when((e + c) % 1009 == 0, 0.0).otherwise(F.lit(0.5) * (1 + (e + 2 * c + p) % 4))).alias("sigma_spectrum"),
    )
    channel = spark.range(NCHAN).select(F.lit(0).alias("spw_id"), F.col("id").cast("int").alias("chan"), (F.lit(1.0e9) + 5.0e7 * F.col("id")).alias("chan_freq_hz"))
    field = spark.range(len(FIELDS)).select(F.col("id").cast("int").alias("field_id"), F.get(F.array(*map(F.lit, FIELDS)), F.col("id").cast("int")).alias("name"))
    return VisibilitySet(main, channel, field, NCHAN, NCORR)
