"""Compression classifier: which of two zstandard dictionaries shortens a text more.

One dictionary is trained on good and one on bad labelled texts. A whole text is
compressed with each; the difference of the two sizes, divided by the text's size
and by their sum, with the compression ratio, goes through a logistic curve
fitted on labelled texts that the dictionaries have not seen.

The fit is bounded: per label the ``SAMPLE`` documents of smallest seeded hash
for the dictionaries and as many others for the curve, none longer than
``LONGEST`` characters. Every document is scored whole.

Defined results: null and empty texts get the score that the curve gives to size
0; a document with several labels counts with each of them; without both labels
the score is the share of label 1, or 0.5 without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import in_arrow

SAMPLE = 2000
LONGEST = 65_536
DICT_BYTES = 112_640
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        if model.good:
            self.good, self.bad = compressor(model.good), compressor(model.bad)

    def features(self, texts: list[bytes]) -> np.ndarray:
        n = np.array([len(t) for t in texts], float) + 1
        good = np.array([len(self.good.compress(t)) for t in texts], float)
        bad = np.array([len(self.bad.compress(t)) for t in texts], float)
        by_text, by_sum = (bad - good) / n, (bad - good) / (bad + good)
        ratio, size = np.log(np.minimum(good, bad) / n + 0.01), np.log(n)
        return np.stack([by_text, by_sum, ratio, size, ratio**2, by_text**2, by_text * ratio, by_sum * ratio, by_text * size, ratio * size], 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        m = self.model
        if not m.good:
            return np.full(len(texts), m.prior)
        x = (self.features(texts) - m.mean) / m.scale
        return 1 / (1 + np.exp(-np.clip(m.weights[0] + x @ m.weights[1:], -50, 50)))


def compressor(content: bytes):
    import zstandard

    found = zstandard.ZstdCompressionDict(content)
    found.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=found, write_checksum=False, write_content_size=False, write_dict_id=False)


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; the texts themselves where there are too few to train on."""
    import zstandard

    texts = [t for t in texts if len(t) >= 8]
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, texts)) // 4)), texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICT_BYTES:] or b"\n\n\n\n\n\n\n\n"


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 60) -> np.ndarray:
    """Newton steps on the ridge-penalised log loss; the first weight is the constant."""
    x = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(x.shape[1]), ridge * len(y) * np.r_[0, np.ones(x.shape[1] - 1)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty + 1e-9), x.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> Model:
    """Learns from ``labels`` (doc_id, quality) of documents for which ``learn`` (over doc_id) holds."""
    order = F.xxhash64(F.lit(29), F.col("doc_id"))
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    short = docs.select("doc_id", "text").filter(F.length("text").between(1, LONGEST))
    texts: dict[int, list[bytes]] = {}
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    for quality in (0, 1):
        chosen = known.filter(F.col("quality") == quality).select("doc_id").distinct().orderBy(order, "doc_id").limit(2 * sample)
        rows = short.join(F.broadcast(chosen), "doc_id").select(order.alias("o"), "doc_id", "text").collect()  # 2 * sample rows at most
        texts[quality] = [r["text"].encode() for r in sorted(rows, key=lambda r: (r["o"], r["doc_id"], r["text"]))]
    total = sum(counts.values())
    empty = Model(b"", b"", np.zeros(0), np.zeros(0), np.zeros(0), counts.get(1, 0) / total if total else 0.5)
    if not texts[0] or not texts[1]:
        return empty
    model = Model(dictionary(texts[1][::2]), dictionary(texts[0][::2]), np.zeros(10), np.ones(10), np.zeros(11), empty.prior)
    held = {q: t[1::2] or t for q, t in texts.items()}
    x = Scorer(model).features(held[1] + held[0])
    y = np.r_[np.ones(len(held[1])), np.zeros(len(held[0]))]
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = fit_logistic((x - model.mean) / model.scale, y)
    # The two labels were drawn in equal number; the constant carries their real odds.
    model.weights[0] += np.log(counts[1] / len(held[1])) - np.log(counts[0] / len(held[0]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [b"" if t is None else t.encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.score(texts))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(in_arrow, scored, "doc_id long, score double")
