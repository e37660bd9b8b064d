"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizer_path())


def _crc_mod(column: str, n: int) -> Column:
    """crc32 of a column as text, modulo n; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compression import fit, score

    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _crc_mod("doc_id", 5) != 0)
    found = score(docs, model)
    return found.select("doc_id", (_crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import removed

    found = removed(documents(spark, sf_dir))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared_words")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .findings import scan

    found = scan(documents(spark, sf_dir))
    return found.select("doc_id", "finding", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, n_words

    found = mix(documents(spark, sf_dir), n_words(F.col("text")))
    return found.select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight,
    3e0 * source_size AS cap, (sum(source_size) OVER ())::DOUBLE AS total
  FROM named),
leveled AS (
  SELECT *, cap / weight AS ratio,
    (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM leveled WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1)) AS target
  FROM leveled),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END::BIGINT AS whole,
    coalesce(sum(s.size) OVER (PARTITION BY s.source
      ORDER BY md5('17|' || coalesce(s.doc_id::VARCHAR, '') || '|' || s.size), s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (whole * size + least(size, greatest(0, floor(target) - whole * source_size - ahead)))::BIGINT AS taken
FROM placed
"""


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import judge, statistics

    found = judge(statistics(documents(spark, sf_dir)))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .direct_codes import read_documents, write

    return read_documents(spark, write(documents(spark, sf_dir), tokenizer_path(), end_id=2))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, prototypes

    docs = documents(spark, sf_dir)
    held_out = _crc_mod("doc_id", 4) == 2
    found = identify(docs.select("doc_id", "text"), *prototypes(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import Join, linked

    return linked(documents(spark, sf_dir), Join(words=3, num=90, den=100)).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM worded),
sized AS (SELECT doc_id, s, len(s)::BIGINT AS n FROM shingled),
tokens AS (SELECT doc_id, n, unnest(s) AS t FROM sized),
linked AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached(x, y) AS (
  SELECT doc_id, doc_id FROM sized
  UNION
  SELECT r.x, l.y FROM reached r JOIN linked l ON r.y = l.x)
SELECT s.doc_id, s.n AS n_shingles, r.component_id
FROM sized s JOIN (SELECT x, min(y) AS component_id FROM reached GROUP BY x) r ON r.x = s.doc_id
"""


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scratch import written
    from .telephony import decode_column, described, store_texts

    # The resampled PCM is a column of the result: stored once, by whoever writes that.
    return described(decode_column(written(store_texts(documents(spark, sf_dir)), "telephony")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pack": op1_pack,
        "op2_quality": op2_quality,
        "op3_repeats": op3_repeats,
        "op4_secrets": op4_secrets,
        "op5_mix": op5_mix,
        "op6_rules": op6_rules,
        "op7_token_files": op7_token_files,
        "op8_language": op8_language,
        "op9_jaccard": op9_jaccard,
        "op10_telephony": op10_telephony,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mix": OP5_SQL, "op9_jaccard": OP9_SQL}
