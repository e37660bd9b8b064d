"""Passages too short to be removed are told by op3's column n_shared_words."""

import random

from fringeworks.llm import queries as q
from fringeworks.llm.repeats import removed

from .test_small_cases import SCHEMA


def told(texts, words):
    """For each text the words in runs of ``words`` words that another text has, by brute force."""
    split = [(t or "").encode().split() for t in texts]
    grams = [[tuple(w[k : k + words]) for k in range(len(w) - words + 1)] for w in split]
    out = []
    for i, mine in enumerate(grams):
        others = {g for j, x in enumerate(grams) if j != i for g in x}
        out.append(len({k + d for k, g in enumerate(mine) if g in others for d in range(words)}))
    return out


def test_short_passages_by_brute_force(spark, tmp_path):
    pick = random.Random(5)

    def words(n):
        return [f"{pick.randrange(10**6):x}" for _ in range(n)]

    passage, other, short, twice = words(53), words(61), words(49), words(52)
    texts = [
        " ".join(words(80) + passage + words(70)),
        "\n".join(words(30) + passage + words(10) + other + words(20)),
        " ".join(other + words(200)),
        " ".join(words(40) + short + words(40)),
        " ".join(short + words(60)),
        " ".join(twice + words(60) + twice),
        " ".join(passage[:50]),
        " ".join(words(300)), None, "", "a b", "é " * 60, " ".join(["same"] * 70), " ".join(["same"] * 55),
    ]
    texts += [texts[2], texts[9], texts[10], texts[11]]
    spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in q.op3_repeats(spark, str(tmp_path)).collect()}
    assert [rows[i].n_shared_words for i in range(len(texts))] == told(texts, 50)
    assert rows[0].n_shared_words == 53 and rows[0].n_removed == 0


def test_equal_rows_and_null_ids_share(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "w1 w2")], "doc_id long, text string")
    assert sorted(r.n_shared_words for r in removed(docs).collect()) == [0, 60, 60, 60]
