"""Quality rules: base statistics and robust multivariate outliers.

Every document gets five base statistics. Within each language and source the
minimum-covariance-determinant estimate of location and scatter is found for the
transformed statistics by concentration steps: from a start at medians and
median deviations, the nearest share ``H`` of the group's rows gives the next
estimate, until the determinant stops falling. Rows far from it by Mahalanobis
distance are rejected.

All passes over rows are aggregations of a narrow written table with map-side
combination: moments per group, and counts per group and distance bin, from which
the share's radius is read. No group is brought together in one task.

Defined results: a null text has no words and fails the base rule; null languages
and sources are values of their own; groups under ``LEAST`` rows use their
language's estimate, and that the estimate of all rows; equal rows are judged
alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Standard deviations that the transformed statistics have at least. The last is wide, so that
#: no length alone comes near ``CUTOFF``: a million times the group's mean adds 3 to the distance.
FLOORS = (0.08, 0.25, 1.0, 0.15, 8.0)
P = len(FLOORS)
H = 0.75
LEAST = 50
MOST_STEPS = 12
CONFIDENCE = 0.9999


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), f)[0]


def covered_words(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more."""
    windows = F.when(
        F.size(words) >= 4,
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def count(hashes: Column) -> Column:
        def repeated(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))
            at = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
            return F.aggregate(
                at,
                F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
                lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
            )["n"]

        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(rows, repeated))

    return let(windows, count)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("_text")).select(
        "doc_id",
        "lang",
        "source",
        F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words"),
        F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(F.filter(F.split("_text", "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        covered_words(F.col("_words")).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def transformed() -> list[Column]:
    """Word length, symbols per word, repeated lines, repeated words per word, words; of rows with words."""
    n = F.col("n_words")
    return [
        F.log(F.col("word_chars") / n),
        F.log1p(10 * F.col("n_symbols") / n),
        F.log1p("n_dup_lines"),
        F.col("n_repeat_words") / n,
        F.log(n.cast("double")),
    ]


def chi2_cdf(x: float, k: int) -> float:
    """By the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    term = total = 1 / (k / 2)
    n = 1
    while term > 1e-17 * total:
        term *= x / 2 / (k / 2 + n)
        total += term
        n += 1
    return total * math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return lo


#: Makes the scatter of the nearest share consistent at the normal distribution.
CONSISTENCY = H / chi2_cdf(chi2_quantile(H, P), P + 2)
CUTOFF = chi2_quantile(CONFIDENCE, P)


def key(level: int, *columns: str) -> Column:
    return F.to_json(F.struct(F.lit(level).alias("level"), *columns))


def groups(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, judged_by (a group's key) and feeds (keys of the groups that its rows help to estimate)."""
    n = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    in_lang = F.sum("n").over(Window.partitionBy("lang"))
    level = F.when(F.col("n") >= least, 0).when(in_lang >= least, 1).otherwise(2)
    n = n.withColumn("level", level)
    own, lang, every = key(0, "lang", "source"), key(1, "lang"), key(2)
    n = n.withColumn("lang_used", F.max(F.col("level") == 1).over(Window.partitionBy("lang")))
    n = n.withColumn("all_used", F.max(F.col("level") == 2).over(Window.partitionBy(F.lit(0))))
    feeds = F.array(F.when(F.col("level") == 0, own), F.when(F.col("lang_used"), lang), F.when(F.col("all_used"), every))
    return n.select("lang", "source", F.when(F.col("level") == 0, own).when(F.col("level") == 1, lang).otherwise(every).alias("judged_by"), F.array_compact(feeds).alias("feeds"))


def started(fed: DataFrame) -> DataFrame:
    """Per group the medians and the diagonal scatter of the quartile ranges, from counts per bin of an eighth of a floor."""
    bins = F.array(*(F.struct(F.lit(j).alias("j"), F.floor(F.col(f"x{j}") / (FLOORS[j] / 8)).alias("b")) for j in range(P)))
    counts = fed.select("g", F.explode(bins).alias("s")).groupBy("g", "s.j", "s.b").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("g", "j")
    up_to = F.sum("n").over(whole.orderBy("b")) / F.sum("n").over(whole)
    counts = counts.withColumn("share", up_to)
    at = lambda q: F.min(F.when(F.col("share") >= q, F.col("b")))
    quartiles = counts.groupBy("g", "j").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    pick = lambda j, c: F.max(F.when(F.col("j") == j, F.col(c)))
    width = [f / 8 for f in FLOORS]
    moments = [((pick(j, "q2") + 0.5) * width[j]).alias(f"m{j}") for j in range(P)]
    scatter = [F.pow((pick(j, "q3") - pick(j, "q1")) * width[j] / 1.349, F.lit(2)).alias(f"c{j}{j}") for j in range(P)]
    found = quartiles.groupBy("g").agg(*moments, *scatter)
    return inverted(found.withColumns({f"c{i}{j}": F.lit(0.0) for i in range(P) for j in range(i)}))


def moments(fed: DataFrame) -> DataFrame:
    """Per group the mean and the consistent scatter of the rows with ``near``."""
    x = [F.col(f"x{j}") for j in range(P)]
    sums = [F.avg(x[j]).alias(f"m{j}") for j in range(P)]
    products = [F.covar_pop(x[i], x[j]).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    found = fed.filter("near").groupBy("g").agg(*sums, *products)
    return inverted(found.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * CONSISTENCY for i in range(P) for j in range(i + 1)}))


def inverted(found: DataFrame) -> DataFrame:
    """g, m (mean), w (rows of the inverse Cholesky factor of the scatter) and logdet."""
    c = {(i, j): F.col(f"c{i}{j}") for i in range(P) for j in range(i + 1)}
    for i in range(P):
        found = found.withColumn(f"c{i}{i}", F.greatest(c[i, i], F.lit(FLOORS[i] ** 2)))
    for j in range(P):  # Cholesky by columns; rounding must not make a root negative
        inner = [F.pow(F.col(f"l{j}{k}"), F.lit(2)) for k in range(j)]
        found = found.withColumn(f"l{j}{j}", F.sqrt(F.greatest(c[j, j] - reduce(add, inner, F.lit(0.0)), F.lit(FLOORS[j] ** 2 / 100))))
        for i in range(j + 1, P):
            inner = [F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)]
            found = found.withColumn(f"l{i}{j}", (c[i, j] - reduce(add, inner, F.lit(0.0))) / F.col(f"l{j}{j}"))
    for j in range(P):
        found = found.withColumn(f"w{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, P):
            inner = [F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)]
            found = found.withColumn(f"w{i}{j}", -reduce(add, inner) / F.col(f"l{i}{i}"))
    det = reduce(add, [2 * F.log(F.col(f"l{j}{j}")) for j in range(P)])
    return found.select("g", F.array(*(F.col(f"m{j}") for j in range(P))).alias("m"), F.array(*(F.col(f"w{i}{j}") for i in range(P) for j in range(i + 1))).alias("w"), det.alias("logdet"))


SALTS = 16


def distances(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by ``g``; a hot group's rows meet copies of its estimate."""
    salted = estimate.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    both = rows.withColumn("_salt", F.pmod(F.xxhash64(*(F.col(f"x{j}") for j in range(P)), F.col("doc_id")), F.lit(SALTS)).cast("int")).join(salted, ["g", "_salt"])
    at = 0
    total = []
    for i in range(P):
        terms = [F.col("w")[at + j] * (F.col(f"x{j}") - F.col("m")[j]) for j in range(i + 1)]
        total.append(F.pow(reduce(add, terms), F.lit(2)))
        at += i + 1
    return both.withColumn("d2", reduce(add, total)).drop("m", "w", "logdet", "_salt")


def nearest(rows: DataFrame, share: float = H) -> DataFrame:
    """Adds ``near``: the group's rows up to the distance bin that completes ``share`` of them."""
    rows = rows.withColumn("_bin", F.floor(64 * F.log1p("d2")))
    counts = rows.groupBy("g", "_bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("g")
    up_to = F.sum("n").over(whole.orderBy("_bin")) / F.sum("n").over(whole)
    edge = counts.withColumn("share", up_to).groupBy("g").agg(F.min(F.when(F.col("share") >= share, F.col("_bin"))).alias("_edge"))
    edge = edge.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "d2"), F.lit(SALTS)).cast("int"))
    return rows.join(edge, ["g", "_salt"]).withColumn("near", F.col("_bin") <= F.col("_edge")).drop("_bin", "_edge", "_salt")


def estimate(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates of the groups in ``of`` from rows with x0, x1, …"""
    r, o = rows.alias("r"), of.alias("o")
    same = F.col("r.lang").eqNullSafe(F.col("o.lang")) & F.col("r.source").eqNullSafe(F.col("o.source"))
    fed = written(r.join(o, same).select("doc_id", F.explode("feeds").alias("g"), *(f"x{j}" for j in range(P))), "mcd_rows")
    now = written(started(fed), "mcd_start")
    for step in range(MOST_STEPS):
        after = written(moments(nearest(distances(fed, now))), "mcd_step")
        moved = after.join(now.select("g", F.col("logdet").alias("was")), "g").agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        now = after
        if step and (moved is None or moved < 1e-3):
            break
    return now


def judge(stats: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds base_failed, d2 (null where the base rule fails) and kept to the result of ``statistics``."""
    stats = written(stats.withColumn("base_failed", base_failed()), "rules")
    passed = stats.filter(~F.col("base_failed")).select("doc_id", "lang", "source", *(x.alias(f"x{j}") for j, x in enumerate(transformed())))
    of = written(groups(passed, least), "rule_groups")
    found = estimate(passed, of)
    kept = [F.when(F.col("n_words") > 0, x).alias(f"x{j}") for j, x in enumerate(transformed())]
    s, o = stats.alias("s"), of.alias("o")
    same = F.col("s.lang").eqNullSafe(F.col("o.lang")) & F.col("s.source").eqNullSafe(F.col("o.source"))
    good = s.filter(~F.col("base_failed")).join(o, same).select("s.*", F.col("judged_by").alias("g"), *kept)
    good = distances(good, found).select(*stats.columns, "d2", (F.col("d2") <= CUTOFF).alias("kept"))
    failed = stats.filter("base_failed").withColumn("d2", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    return good.unionByName(failed)
