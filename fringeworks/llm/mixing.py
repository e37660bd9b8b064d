"""Mixing sources to target weights by capped water-filling.

Targets share the total size by weight; a source stops at ``epochs`` times its
size and what it cannot take goes to the others in proportion to their weights
until none is above its cap. The level where that ends is found by one sort of
the sources by cap per weight. Within a source every document is taken as many
whole times as the target asks of the source, and a seeded order of the
documents decides which are taken once more; the document at the border is taken
in part, so a source's words meet its target to the word.

Only aggregates per (source, bucket of the seeded order) and the rows of one
bucket per source are ever sorted together; a bucket is 1/4096 of a source.

Defined results: null text has size 0 and takes 0; null source is a source of
its own, last in order; rows with equal ids are separate documents, equal rows
alike up to their order, which is by id and size where hashes tie; very long texts
are counted whole; an empty table gives no rows. ``mix`` reads no other columns than
it is given; ``repeated`` gives all columns back, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import in_row, out_of_row, written

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size). One row per source: the only windows over all of them."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int"))
    cap = F.col("source_size").cast("double") * epochs
    every = Window.partitionBy(F.lit(0))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = sizes.select("source", "source_size", weight.alias("weight"), cap.alias("cap")).withColumn("ratio", F.col("cap") / F.col("weight"))
    found = found.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("level", level)
    # The first source in ratio order that its level does not fill to the cap sets the level of the rest.
    found = found.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))).over(every)["level"])
    return found.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, size: Column, weights=WEIGHTS, epochs: int = EPOCHS, seed: int = 17, key: Column | None = None) -> DataFrame:
    """doc_id, source, key, size, source_size, target, taken for each row of (doc_id, source, …).

    ``size`` and ``key`` are expressions over ``docs``. ``taken`` is at most ``epochs * size``.
    """
    key = F.lit(None).cast("long") if key is None else key
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    rows = docs.select("doc_id", "source", size.alias("size"), key.alias("key")).withColumn("_order", order)
    rows = written(rows.withColumn("_bucket", F.substring("_order", 1, 3)), "mix_sizes")
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("in_bucket"))
    buckets = written(buckets, "mix_buckets")
    targets = water_fill(buckets.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), weights, epochs)
    # Words that are still to be taken once more, after the whole repetitions of every document.
    targets = targets.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("_more", F.floor("target") - F.col("_whole") * F.col("source_size"))
    up_to = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = buckets.select("source", "_bucket", F.coalesce(F.sum("in_bucket").over(up_to), F.lit(0)).alias("_ahead"), "in_bucket")
    b, t = ahead.alias("b"), targets.alias("t")
    plan = b.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "_bucket", "_ahead", "in_bucket", "source_size", "target", "_whole", "_more")
    plan = plan.withColumn("_border", (F.col("_ahead") < F.col("_more")) & (F.col("_ahead") + F.col("in_bucket") > F.col("_more")))
    p, r = plan.alias("p"), rows.alias("r")
    joined = r.join(p, F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r._bucket") == F.col("p._bucket")))
    joined = joined.select("r.doc_id", "r.source", "key", "size", "source_size", "target", "_whole", "_more", "_border", "_ahead", "r._bucket", "_order")
    inner = Window.partitionBy("source", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    border = joined.filter("_border").withColumn("_at", F.col("_ahead") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    part = F.least("size", F.greatest(F.lit(0), F.col("_more") - F.col("_at")))
    rest = joined.filter("not _border").withColumn("_at", F.col("_ahead"))
    columns = ["doc_id", "source", "key", "size", "source_size", "target"]
    taken = lambda more: (F.col("_whole") * F.col("size") + more).cast("long").alias("taken")
    whole = F.when(F.col("_at") < F.col("_more"), F.col("size")).otherwise(F.lit(0))
    return rest.select(*columns, taken(whole)).unionByName(border.select(*columns, taken(part)))



def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    sizes = F.zip_with(F.slice(F.split(text, WORD, -1), F.lit(1), n), F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), n), lambda r, w: F.length(r) + F.length(w))
    return F.substring(text, F.lit(1), F.aggregate(sizes, F.lit(0), lambda a, x: a + x))


def repeated(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: int = 17) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, the last time cut where it is taken in part.

    Rows without a word take no part. Equal rows share alike, rounded down.
    """
    size, th = n_words(F.col("text")), F.xxhash64("text")
    taken = mix(docs, size, weights, epochs, seed, th).filter("taken > 0")
    share = taken.groupBy("doc_id", "source", "key", "size").agg(F.expr("sum(taken) div count(*)").alias("share"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & F.col("src").eqNullSafe(F.col("source")) & (F.col("th") == F.col("key"))
    rows = in_row(docs, id=F.col("doc_id"), src=F.col("source"), th=th).join(share.filter("share > 0"), same)
    copies = F.ceil(F.col("share") / F.col("size")).cast("int")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    left = (F.col("share") - (F.col("copy") - 1) * F.col("size")).cast("int")
    text = F.col("row.text")
    return out_of_row(rows, docs.columns, text=F.when(left < F.col("size"), first_words(text, left)).otherwise(text))
