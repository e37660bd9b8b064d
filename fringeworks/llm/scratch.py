"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """URI of spark.checkpoint.dir; where the session has none, a temporary folder if the master is this machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fringeworks-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/") if "://" in folder else "file://" + folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/fringeworks/{name}-{uuid.uuid4().hex}"


#: Spark's own setting: the shuffle files of a query go when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffle_files_removed(spark: SparkSession):
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, was) if was is not None else spark.conf.unset(CLEANUP)


#: What ``written`` has written and nothing has removed.
_paths: list[str] = []


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    _paths.append(path)
    with shuffle_files_removed(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``written`` wrote. Only for tables on which nothing that is still to run depends."""
    for table in tables:
        remove(table.sparkSession, table._written_to)


def remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(conf).delete(found, True)
    if path in _paths:
        _paths.remove(path)


def step(make, name: str) -> DataFrame:
    """``make()`` written; all that it wrote on the way goes."""
    before = set(_paths)
    out = written(make(), name)
    for path in [p for p in _paths if p not in before and p != out._written_to]:
        remove(out.sparkSession, path)
    return out


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def in_row(df: DataFrame, **columns: Column) -> DataFrame:
    """``row``, a struct of all columns of ``df``, and ``columns``: so no name of a user's column meets an operator's own."""
    return df.select(F.struct(*map(quoted, df.columns)).alias("row"), *(c.alias(n) for n, c in columns.items()))


def out_of_row(df: DataFrame, names: list[str], **instead: Column) -> DataFrame:
    """The columns ``names`` of ``row`` in their order, those in ``instead`` replaced."""
    return df.select(*(instead[n].alias(n) if n in instead else F.col("row").getField(n).alias(n) for n in names))


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the session's Python workers, once, however the driver came to import them."""
    context, package = spark.sparkContext, Path(__file__).parents[1]
    if getattr(context, "_fringeworks_shipped", False) or not package.is_dir():
        return
    path = os.path.join(tempfile.mkdtemp(), "fringeworks.zip")  # Spark's file server takes it from the driver
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(path)
    context._fringeworks_shipped = True


#: Bytes of an Arrow batch, in the worker and in the executor beside its heap. The C library's allocator
#: keeps a multiple of the largest buffers for each of the executor's threads, so small ones cost it less.
BATCH_BYTES = 2 << 20


def give_back() -> None:
    """Returns the worker's free memory to the system: idle workers live on beside others' tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's, where it has it
    if trim is not None:
        trim(0)


#: What workers keep from task to task of one function, as long as no other runs in them.
kept_by_workers: list[dict] = []
_ran_last: list[tuple] = []


def turn_to(f) -> None:
    """Drops what this worker keeps for another function than ``f``."""
    name = (f.__module__, f.__qualname__)
    if _ran_last != [name]:
        for kept in kept_by_workers:
            kept.clear()
        _ran_last[:] = [name]


def in_slices(batch):
    """The rows of a record batch in slices of about ``BATCH_BYTES``, one row at least."""
    n = max(1, min(batch.num_rows, -(-batch.nbytes // BATCH_BYTES)))
    rows = -(-batch.num_rows // n)
    for at in range(0, max(1, batch.num_rows), max(1, rows)):
        yield batch.slice(at, rows) if n > 1 else batch


def in_arrow(df: DataFrame, f, schema) -> DataFrame:
    """``df.mapInArrow(f, schema)`` in small batches both ways, with workers that know this package."""

    def run(batches):
        turn_to(f)
        for batch in f(batches):
            yield from in_slices(batch)
        give_back()

    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of ids or hashes that may be broadcast, about 50 MB on each executor.
MOST_BROADCAST = 400_000


def broadcast_if_small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, narrow and written before, marked for broadcast if it has ``most`` rows or fewer; else joins shuffle."""
    return F.broadcast(df) if df.count() <= most else df
