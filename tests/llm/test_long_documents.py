"""Rules on documents far longer than their group."""

import pytest

from fringeworks.llm.rules import judge, statistics

from .test_small_cases import prose


@pytest.mark.parametrize("n", [60_000, 400_000])
def test_a_clean_document_is_not_rejected_for_its_length(spark, n):
    texts = [prose(k, 60 + k % 90) for k in range(200)] + [prose(999, n), prose(998, n).replace(" ", " ### ")]
    rows = {r.doc_id: r for r in judge(statistics(spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string"))).collect()}
    assert rows[200].n_words == n and not rows[200].base_failed
    assert [rows[i].kept for i in range(202)] == [True] * 201 + [False]
