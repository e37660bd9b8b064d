"""What the similarity join moves follows the documents, not their square, and only what a pair needs."""

import pytest

from fringeworks.llm.jaccard import Join, allocate, bitmap_bits, linking

from .test_small_cases import prose


@pytest.mark.parametrize("lo, hi", [(72, 112), (177, 276), (433, 676)])
def test_signatures_of_a_set_do_not_grow_with_the_number_of_sets(lo, hi):
    apart = Join(words=5, num=80, den=100).most_apart(2 * hi)
    made = [(how.segments + int(how.two * hi / how.segments)) for how in (allocate(lo, hi, apart, n) for n in (20_000, 100_000, 6_000_000))]
    assert made[2] <= 1.2 * made[0] and made[1] <= 1.2 * made[0]


def test_bitmaps_have_one_or_two_bits_a_shingle():
    assert all(max(64, n) <= bitmap_bits(n) <= max(64, 2 * n) for n in range(1, 5000))


def test_only_texts_of_pairs_meet(spark):
    import zstandard

    texts = [prose(seed, 60) for seed in range(40)]
    texts[7] = texts[3]
    rows = [(c, zstandard.ZstdCompressor().compress(t.encode())) for c, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "c long, data binary")
    pairs = spark.createDataFrame([(3, 7), (3, 9)], "a long, b long")
    found = linking(pairs, table, Join())
    assert [(x.a, x.b) for x in found.collect()] == [(3, 7)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2
