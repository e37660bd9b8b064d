"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1, made from its code point. An
n-gram's vector is the product of its letters' vectors, each rolled by its place
from the end; a document's vector is the sum over its n-grams, a language's
prototype the sum over its documents. The answer is the prototype with the
largest cosine.

Texts are lower-cased; a run of other characters than letters counts as one
blank. All sums are of integers, so results do not depend on the order of rows.

Defined results: null texts and texts without a letter are ``und`` with score 0;
without any prototype every document is ``und``. Ties go to the first language in
code-point order. Very long texts are bundled whole, their n-grams counted at once;
equal rows have equal answers; a null language teaches nothing; an empty table gives
no rows. All columns of ``docs`` stay; a clash with the names of the two new ones is
an error, and both names are parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .scratch import in_arrow, in_row

DIMENSIONS = 1024
N = 3
SEED = 7
#: n-gram vectors kept by a worker (1 KB each); beyond, the memory is filled anew.
KEPT = 20_000
CHUNK = 200_000
BLANK = 32


class Profiles:
    def __init__(self, dimensions: int = DIMENSIONS, n: int = N, seed: int = SEED):
        self.dimensions, self.n, self.seed = dimensions, n, seed
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.letters: dict[int, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.codes = np.zeros(0, np.uint64)
        self.vectors = np.zeros((0, self.dimensions), np.int8)

    def _letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            bits = np.random.Generator(np.random.Philox(key=[self.seed, c])).integers(0, 2, self.dimensions, np.int8)
            self.letters[c] = 2 * bits - 1
        return self.letters[c]

    def _bind(self, code: int) -> np.ndarray:
        v = np.ones(self.dimensions, np.int8)
        for k in range(self.n):  # the last letter is not rolled
            v = v * np.roll(self._letter(code >> 21 * k & 0x1FFFFF), k)
        return v

    def _of(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of distinct, ascending n-gram codes."""
        if len(self.codes) > KEPT:
            self.forget()
        new = np.setdiff1d(codes, self.codes, assume_unique=True)
        if len(new):
            every = np.concatenate([self.codes, new])
            order = np.argsort(every)
            self.vectors = np.concatenate([self.vectors, [self._bind(int(c)) for c in new]])[order]
            self.codes = every[order]
        return self.vectors[np.searchsorted(self.codes, codes)]

    def grams(self, text: str) -> np.ndarray:
        """Codes of the text's n-grams, 21 bits a letter; empty without a letter."""
        c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = self.letter[c]
        if not is_letter.any():
            return np.zeros(0, np.uint64)
        c = np.where(is_letter, c, BLANK)
        keep = np.r_[True, is_letter[1:] | is_letter[:-1]]
        c = np.r_[BLANK, c[keep], BLANK].astype(np.uint64)
        code = np.zeros(max(0, len(c) - self.n + 1), np.uint64)
        for k in range(self.n):
            code = code << np.uint64(21) | c[k : len(c) - self.n + 1 + k]
        return code

    def bundles(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(first text's index, a row of integers for each of the next texts), a bounded number of n-grams at a time."""
        at, held, size = 0, [], 0
        for i, text in enumerate(texts):
            held.append(self.grams(text or ""))
            size += len(held[-1])
            if size >= CHUNK or len(held) >= 256 or i == len(texts) - 1:
                yield at, self._bundle(held)
                at, held, size = i + 1, [], 0

    def _bundle(self, held: list[np.ndarray]) -> np.ndarray:
        found, where = np.unique(np.concatenate(held), return_inverse=True)
        if not len(found):
            return np.zeros((len(held), self.dimensions))
        row = np.repeat(np.arange(len(held)), [len(h) for h in held])
        out = np.zeros((len(held), self.dimensions))
        for lo in range(0, len(found), 2048):
            hi = min(len(found), lo + 2048)
            inside = (where >= lo) & (where < hi)
            counts = np.bincount(row[inside] * (hi - lo) + where[inside] - lo, minlength=len(held) * (hi - lo))
            # Sums stay below 2**24, exact as 32-bit floats, for counts of a chunk; longer texts use 64 bits.
            kind = np.float32 if len(where) < 1 << 24 else np.float64
            out += counts.reshape(len(held), hi - lo).astype(kind) @ self._of(found[lo:hi]).astype(kind)
        return out


_profiles: dict[tuple, Profiles] = {}


def profiles(*key: int) -> Profiles:
    if key not in _profiles:
        _profiles[key] = Profiles(*key)
    return _profiles[key]


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS, n: int = N, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and their bundled vectors, from all rows of (text, lang)."""

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, sums = profiles(dimensions, n, seed), {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at, rows in make.bundles(batch.column(0).to_pylist()):
                for lang in sorted(set(langs[at : at + len(rows)])):
                    mine = [k for k in range(len(rows)) if langs[at + k] == lang]
                    sums[lang] = sums.get(lang, 0) + rows[mine].sum(0).astype(np.int64)
        make.forget()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    known = docs.select("text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    parts = known.transform(in_arrow, bundled, "lang string, v array<long>").select("lang", F.posexplode("v").alias("d", "x"))
    rows = parts.groupBy("lang", "d").agg(F.sum("x").alias("x")).collect()  # languages times dimensions
    langs = sorted({r["lang"] for r in rows})
    out = np.zeros((len(langs), dimensions))
    for r in rows:
        out[langs.index(r["lang"]), r["d"]] = r["x"]
    return langs, out


def identify(docs: DataFrame, langs: list[str], vectors: np.ndarray, n: int = N, seed: int = SEED, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds ``pred`` and ``score`` (cosine, from 0 to 1) of every whole text to ``docs``, which has no columns of these names."""
    if taken := {pred.lower(), score.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns of these names: {sorted(taken)}")
    rows = in_row(docs, text=F.col("text").cast("string"))  # a row's columns pass as one, whatever their names
    dimensions = vectors.shape[1] if len(langs) else DIMENSIONS
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    shared = docs.sparkSession.sparkContext.broadcast((langs, unit))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, unit = shared.value
        make = profiles(dimensions, n, seed)
        for batch in batches:
            preds, scores = [], []
            for _, rows in make.bundles(batch.column(1).to_pylist()):
                size = np.linalg.norm(rows, axis=1)
                if not langs:
                    size[:] = 0
                cosine = rows @ unit.T / np.maximum(size, 1e-12)[:, None] if langs else np.zeros((len(rows), 1))
                best = cosine.argmax(1)
                preds += [langs[b] if s else "und" for b, s in zip(best, size)]
                scores.append(np.clip(np.where(size > 0, cosine.max(1), 0), 0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["row", "pred", "score"])
        make.forget()

    schema = StructType([rows.schema["row"], StructField("pred", StringType()), StructField("score", DoubleType())])
    found = rows.transform(in_arrow, judged, schema)
    return found.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), F.col("pred").alias(pred), F.col("score").alias(score))
