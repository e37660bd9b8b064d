"""op3 hashes whole batches, sorts only what is still alike and spreads only runs that whole fragments leave open."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fringeworks.llm import repeats as r
from fringeworks.llm.suffixes import leading_equal, permuted_prefixes, suffix_array, words_ahead

from .test_short_passages import told


@pytest.mark.parametrize("block", [16, 1 << 15])
def test_fragments_of_a_batch_are_those_of_its_texts(monkeypatch, block):
    monkeypatch.setattr(r, "BLOCK", block)
    pick = random.Random(1)
    texts = ["".join(pick.choice("ab é\n") for _ in range(pick.choice([0, 1, 39, 40, 41, 300]))) for _ in range(60)] + ["a" * 200, "ab" * 100]
    data, bounds = r.joined_texts(pa.array(["not this", *texts]).slice(1))
    doc, mark, lo, hi = r.landmarks(data, bounds, 40, 12)
    for k, text in enumerate(texts):
        t = text.encode()
        assert data[bounds[k] : bounds[k + 1]].tobytes() == t
        mine = doc == k
        if len(t) < 40:
            assert not mine.any()
            continue
        assert lo[mine][0] == 0 and hi[mine][-1] == len(t) - 39 and (lo[mine][1:] == hi[mine][:-1]).all()
        assert [x.tolist() for x in (mark[mine], lo[mine], hi[mine])] == [x.tolist() for x in r.fragments(t, 40, 12)]
    strings: dict = {}  # equal strings, equal landmarks
    for k, m, a, b in zip(doc.tolist(), mark.tolist(), lo.tolist(), hi.tolist()):
        for at in range(a, b):
            assert strings.setdefault(data[bounds[k] + at : bounds[k] + at + 40].tobytes(), m) == m


def test_words_of_a_batch():
    texts = ["", " a bb\ta\n", "a", "bb" + "x" * 3000 + " é é", "x" * 3000 + "\x0b\x0ca\r", "\x1c a\x00"]
    values, bounds = r.word_values(*r.joined_texts(pa.array(texts)))
    words = [t.encode().split() for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    flat = [w for x in words for w in x]
    assert [[a == b for b in flat] for a in flat] == (values[:, None] == values).tolist()


def test_characters_at_a_time():
    pick = np.random.default_rng(2)
    for top in (4, 258, 512):
        s = np.r_[np.where(pick.random(3000) < 0.1, 1, pick.choice([2, 3, top - 2, top - 1], 3000)), 0].astype(np.int16)
        s[1000:1700] = s[200:900]
        a, b = pick.integers(0, 2990, (2, 500))
        plain = [next((k for k in range(7) if s[x + k] != s[y + k]), 7) for x, y in zip(a, b)]
        ahead = words_ahead(s)
        assert leading_equal(ahead[a] ^ ahead[b]).tolist() == plain
        order = suffix_array(s, top)
        key = [tuple(s[i:].tolist()) for i in order]
        assert key == sorted(key)
        before, size = permuted_prefixes(s, order, 1)
        for x, y in zip(order[1:], order):
            m = 0
            while s[x + m] == s[y + m] > 1:
                m += 1
            assert (before[x], size[x]) == (y, m)


def test_only_runs_of_lone_fragments_are_spread(spark, monkeypatch):
    pick = random.Random(4)

    def words(n):
        return [f"{pick.randrange(10**6):x}" for _ in range(n)]

    passage = words(400)
    texts = [" ".join(words(30) + passage + words(30)) for _ in range(40)] + [" ".join(words(20) + passage[k : k + 75] + words(20)) for k in (0, 90, 211)]
    texts += [" ".join(passage[:300] + ["other"] + passage[300:])] * 30  # copies count once
    rows, write = {}, r.written

    def counted(df, name):
        out = write(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(r, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x.doc_id: x.n_shared_words for x in r.removed(docs).collect()}
    assert [found[k] for k in range(len(texts))] == told(texts, 50)
    assert rows["passage_runs"] < 44 * 60  # 40 times 351 of the passage alone, were every run spread
