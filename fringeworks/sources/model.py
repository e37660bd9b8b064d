"""A visibility set: one row per baseline and time, the (channel, correlation) plane as flat arrays.

Arrays are row-major: position = channel * ncorr + correlation. ``row_id`` is dense
from 0 and is the order of rows; DataFrame order means nothing. The dimension tables
``channel`` (spw_id, chan, chan_freq_hz) and ``field`` (field_id, name) are small.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Columns of the plane that have a rule of their own when averaged.
PLANE = ("data_re", "data_im", "flag", "weight_spectrum", "sigma_spectrum")


@dataclass(frozen=True)
class VisibilitySet:
    main: DataFrame
    channel: DataFrame
    field: DataFrame
    nchan: int
    ncorr: int
    #: Columns that differ from what was read; what an update has to write.
    changed: frozenset[str] = field(default_factory=frozenset)
    #: Rows were dropped or merged, or channels changed, so an update in place is not possible.
    reshaped: bool = False

    def having(self, main: DataFrame, *changed: str, **other) -> "VisibilitySet":
        return replace(self, main=main, changed=self.changed | set(changed), **other)

    def has(self, column: str) -> bool:
        return column in self.main.columns

    def planes(self) -> list[str]:
        """Array columns; those whose arrays have nchan * ncorr elements follow the channels."""
        return [f.name for f in self.main.schema.fields if isinstance(f.dataType, ArrayType)]

    def channels(self) -> DataFrame:
        """Channels of the first spectral window that the data have."""
        return self.channel.filter((F.col("spw_id") == 0) & (F.col("chan") < self.nchan))


def cells(vs: VisibilitySet, *also: str) -> DataFrame:
    """Long form: row_id, chan, corr and the plane's columns, with ``also`` of the row."""
    names = [c for c in PLANE if vs.has(c)]
    long = vs.main.select("row_id", *also, F.posexplode(F.arrays_zip(*names)).alias("pos", "cell"))
    return long.select(
        "row_id",
        *also,
        F.expr(f"int(pos div {vs.ncorr})").alias("chan"),
        (F.col("pos") % vs.ncorr).alias("corr"),
        *(F.col(f"cell.{c}").alias(c) for c in names),
    )
