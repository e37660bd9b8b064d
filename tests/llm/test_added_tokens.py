"""Strings of the tokenizer's added tokens in texts, against the tokenizer as its file makes it."""

import json

import numpy as np
from tokenizers import Tokenizer

from fringeworks.llm import queries as q
from fringeworks.llm.wordids import WordIds

from .test_small_cases import SCHEMA, crc

TEXTS = [
    "plain words", "end of one <|endoftext|> start of next<|startoftext|>x", "<|endoftext|>", "<|endoftext|><|endoftext|>", "a<|ENDOFTEXT|>b <|endo ftext|>",
    "x<|endoftext|>'s don<|startoftext|>'t", "e<|endoftext|>́ \t\n<|startoftext|>\x0b Σ<|endoftext|>Σας", None, "after it",
]


def plain_ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_word_ids_of_added_tokens():
    path = q.tokenizer_path()
    wanted = [plain_ids(path, t) for t in TEXTS]
    assert 49407 in wanted[1] and 49406 in wanted[1]
    assert [np.frombuffer(e, "<u4").tolist() for e in WordIds(path).encode(TEXTS)] == wanted


def test_added_tokens_that_stand_in_normalised_text(tmp_path):
    told = json.load(open(q.tokenizer_path()))
    told["added_tokens"][1]["normalized"] = True
    (path := tmp_path / "t.json").write_text(json.dumps(told))
    assert [np.frombuffer(e, "<u4").tolist() for e in WordIds(str(path)).encode(TEXTS)] == [plain_ids(str(path), t) for t in TEXTS]


def test_op1_and_op7_with_added_tokens(spark, tmp_path):
    spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(TEXTS)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    ids = [plain_ids(q.tokenizer_path(), t) for t in TEXTS]
    rows = q.op1_pack(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in rows) == [(i, len(x) + 1, crc([*x, 1])) for i, x in enumerate(ids)]
    rows = q.op7_token_files(spark, str(tmp_path)).orderBy("start").collect()
    starts = np.cumsum([0, *(len(x) + 1 for x in ids)])[:-1].tolist()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == [(i, at, len(x) + 1, crc([*x, 2])) for i, (at, x) in enumerate(zip(starts, ids))]
