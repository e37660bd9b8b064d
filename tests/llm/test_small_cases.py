"""Every operator on null, empty, long, tied and repeated rows, on empty tables, and with clashing extra columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeworks.llm import queries as q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were".split()


#: Names that the pipeline's operators use, or once used, for columns of their own.
OWN_NAMES = ("_id", "_th", "_first", "_n", "_values", "_taken", "_size", "_key", "_source", "_copy", "row", "id", "th", "hash", "src", "share", "copy", "key", "places", "is_first", "times", "part", "sig", "c", "b", "one", "finding", "start", "end", "lang_pred_", "length2", "a.b")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "a", "er", "ing"]) for _ in range(n))


def edge_rows() -> list[tuple]:
    long_ = prose(1, 9000) + " " + "x" * 5000
    rows = [
        (0, None, "en", "a", 0), (1, "", "en", "a", 0), (2, " \n\t\x0b\x0c\r ", "en", None, 7), (3, "one", None, "b", 3), (4, "one two", "fr", "b", 7),
        (5, long_, "en", "a", 1), (6, prose(2, 300), "en", None, 1), (7, prose(2, 300), "en", "a", 1), (8, prose(2, 299) + " other", "en", "c", 1),
        (8, prose(3, 80), "fr", "c", 1), (8, prose(3, 80), "fr", "c", 1), (None, prose(4, 60), None, None, None), (None, None, None, None, None),
        (11, "é😀 ß İ Σας ``` " + prose(5, 60), "de", "b", 1), (12, "a a a a a a a a " * 40, "en", "b", 1), (13, "!!! ### $$$ 12345", "en", "b", 1),
        (14, 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" and so on', "en", "tests/x.py", 1), (-5, "\x00\x01 a\x1cb", "en", "b", 1),
    ]
    return rows


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    """A folder of tables with odd rows and extra columns whose names the operators use themselves."""
    folder = str(tmp_path_factory.mktemp("edges"))
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    for c in ("score", "lang_pred", "size", "k", "comp", "g", "piece", "length", "media", "value", "_order", "taken", *OWN_NAMES):
        docs = docs.withColumn(c, F.lit("extra"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(6, 1, 0), (12, 0, 0), (12, 0, 0), (None, 1, 0), (5, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_empty_table(spark, empty, name):
    assert q.queries()[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(set(q.queries()) - {"op1_pack", "op4_secrets"}))
def test_a_row_for_each_row(spark, edges, name):
    rows = q.queries()[name](spark, edges).collect()
    key = lambda i: (i is None, i or 0)
    assert sorted((r.doc_id for r in rows), key=key) == sorted((r[0] for r in edge_rows()), key=key)


def ids_of(text):
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(q.tokenizer_path())
    return ids_of.t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, edges):
    rows = q.op1_pack(spark, edges).collect()
    wanted = []
    for i, text, *_ in edge_rows():
        ids = ids_of(text) + [1]
        wanted += [(i, k, lo, len(ids[lo : lo + 4096]), crc(ids[lo : lo + 4096])) for k, lo in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)[:5]) for r in rows)
    by_sequence: dict = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by_sequence) == -(-sum(w[3] for w in wanted) // 4096)


def test_op5(spark, edges):
    rows = q.op5_mix(spark, edges).collect()
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, q.op5_mix(spark, edges).collect()), key=repr)
    targets = {(r.source_size, r.target) for r in rows}
    assert sum(t for _, t in targets) == pytest.approx(sum(r["size"] for r in rows))


def test_op7(spark, edges):
    rows = q.op7_token_files(spark, edges).collect()
    wanted = sorted((crc(ids_of(r[1]) + [2]), len(ids_of(r[1])) + 1) for r in edge_rows())
    assert sorted((r.ids_crc32, r.n_tokens) for r in rows) == wanted
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    ids = [r.doc_id for r in rows]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])


def test_op3(spark, edges):
    rows = q.op3_repeats(spark, edges).collect()
    texts = [(r[0], (r[1] or "").encode()) for r in edge_rows()]
    seen: dict = {}
    for _, t in texts:
        for k in range(len(t) - 399):
            seen[t[k : k + 400]] = seen.get(t[k : k + 400], 0) + 1
    wanted = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if seen[t[k : k + 400]] > 1:
                gone[k : k + 400] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        wanted.append((i, len(t), int(gone.sum()), int((np.diff(np.r_[0, gone]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in rows)


def test_op6_statistics(spark, edges):
    from fringeworks.llm.rules import statistics

    found = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in statistics(spark.read.parquet(f"{edges}/documents.parquet")).collect()}
    assert (0, 0, 0, 0, 0, 0) in found and (12, 320, 320, 0, 0, 320) in found and (13, 4, 14, 6, 0, 0) in found


def test_op8(spark, edges):
    rows = {r.doc_id: r for r in q.op8_language(spark, edges).collect()}
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert [rows[i].lang_pred for i in (0, 1, 2, 13)] == ["und"] * 4


def test_op10(spark, edges):
    rows = q.op10_telephony(spark, edges).collect()
    for r in rows:
        assert r.payload_bytes % 64 == 0 and r.payload_bytes - max(r.n_bytes, 1) < 64
    texts = {(r[1] or "").encode() for r in edge_rows()}
    padded = {hashlib.sha256(t + b"\0" * ((-len(t)) % 64 or (0 if t else 64))).hexdigest() for t in texts}
    assert {r.payload_sha256 for r in rows} == padded and len({(r.payload_sha256, r.feature) for r in rows}) == len(padded)


def test_op9(spark, edges):
    rows = q.op9_jaccard(spark, edges).collect()
    found = {(r.doc_id, r.n_shingles): r.component_id for r in rows}
    assert found[(0, 0)] == 0 and found[(2, 0)] == 2 and found[(3, 1)] == 3 and found[(4, 1)] == 4
    assert {r.component_id for r in rows if r.doc_id in (6, 7)} == {6}
    assert sorted(r.component_id for r in rows if r.doc_id == 8) == [6, 8, 8]


def test_pipeline(spark, edges, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    kept = pipeline.language(spark, docs, edges)
    assert {None, 3, 5, 8} <= {r.doc_id for r in kept.collect()} and not {0, 1, 2, 13} & {r.doc_id for r in kept.collect()}
    one = pipeline.near_duplicates(spark, docs, edges)
    assert one.columns == docs.columns
    ids = sorted((r.doc_id for r in one.collect()), key=lambda i: (i is None, i or 0))
    assert ids == [-5, 0, 1, 2, 3, 4, 5, 6, 8, 11, 12, 13, 14, None, None]
    assert kept.columns == docs.columns and {(r.score, r.lang_pred, r._id) for r in kept.select("score", "lang_pred", "_id").collect()} == {("extra",) * 3}
    masked = pipeline.secrets(spark, docs, edges)
    assert masked.columns == docs.columns and pipeline.mixture(spark, docs, edges).columns == docs.columns
    assert pipeline.mixture(spark, docs, edges).filter("_th != 'extra' or `a.b` != 'extra'").count() == 0
    assert masked.count() == len(edge_rows()) and masked.filter("doc_id = 14").first().text == 'token = "[SECRET]" and so on'
    assert pipeline.run(spark, edges).count() > 0 and pipeline.run(spark, empty).count() == 0
