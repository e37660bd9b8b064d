"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Piece lengths are integers from 1 to the capacity, so the corpus is described
for packing by a histogram with at most ``capacity`` rows. The driver packs that
histogram: it fills a bin greedily with the longest lengths that fit, then
replaces the bin's shortest document by the two unpacked lengths that fill the
widened gap best, and repeats the finished bin as often as the histogram allows.
Executors then look up each piece's bin by its length and its rank among the
pieces of that length. Neither histogram nor plan grows with the corpus.

Defined results: a null text is an empty document (its end id only); every row
is a document of its own, also rows with equal or null ids; an empty table gives
no rows; columns other than the two named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .scratch import discard, in_arrow, partitions, written
from .wordids import encoder

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RANK_BITS = 40


@dataclass
class Plan:
    """For each run of ranks of a length: its first bin, slots per bin, and the slots' offsets."""

    keys: np.ndarray  # length << RANK_BITS | first rank, ascending
    base: np.ndarray
    slots: np.ndarray
    first_offset: np.ndarray
    offsets: np.ndarray
    bins: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << RANK_BITS) | rank
        run = np.searchsorted(self.keys, key, side="right") - 1
        n = key - self.keys[run]
        slot = n % self.slots[run]
        return self.base[run] + n // self.slots[run], self.offsets[self.first_offset[run] + slot]


def best_two_fit(counts: np.ndarray) -> Plan:
    """Packs ``counts[length]`` documents of each length into bins of ``len(counts) - 1``."""
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    left[0] = 0
    lengths = np.arange(capacity + 1)
    used = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, list[int]]] = []
    bins = 0
    while left.any():
        free = left.copy()
        below = np.maximum.accumulate(np.where(free > 0, lengths, 0))
        gap, limit, taken = capacity, capacity, []
        while limit > 0 and (size := int(below[limit])):
            k = min(gap // size, int(free[size]))
            taken += [size] * k
            free[size] -= k
            gap -= k * size
            limit = min(gap, size - 1)
        while gap > 0 and taken:
            smallest = min(taken)
            wide = gap + smallest
            below = np.maximum.accumulate(np.where(free[: wide + 1] > 0, lengths[: wide + 1], 0))
            a = np.flatnonzero(free[:wide] > 0)
            if not len(a):
                break
            b = np.minimum(below[wide - a], a)
            same = (b == a) & (free[a] < 2)
            b = np.where(same, below[np.maximum(a - 1, 0)], b)
            b = np.where(b > wide - a, below[wide - a], b)
            total = np.where(b > 0, a + b, 0)
            best = int(total.argmax())
            if total[best] <= smallest:
                break
            taken.remove(smallest)
            taken += [int(a[best]), int(b[best])]
            free[a[best]] -= 1
            free[b[best]] -= 1
            free[smallest] += 1
            gap = wide - int(total[best])
        taken.sort(reverse=True)
        sizes, uses = np.unique(taken, return_counts=True)
        times = int((left[sizes] // uses).min())
        starts = np.cumsum([0, *taken[:-1]])
        taken_at = np.array(taken)
        for size, use in zip(sizes.tolist(), uses.tolist()):
            runs.append((size << RANK_BITS | int(used[size]), bins, use, starts[taken_at == size].tolist()))
        used[sizes] += uses * times
        left[sizes] -= uses * times
        bins += times
    runs.sort()
    flat = [o for r in runs for o in r[3]]
    first = np.cumsum([0, *(len(r[3]) for r in runs)])[:-1]
    col = lambda i: np.array([r[i] for r in runs], np.int64)
    return Plan(col(0), col(1), col(2), first.astype(np.int64), np.array(flat, np.int64), bins)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document of (doc_id, text): only documents over ``capacity`` are cut."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for at in range(0, len(ids), 256):
                for i, data in zip(ids[at : at + 256], encode(batch.column(1)[at : at + 256].to_pylist())):
                    data += end
                    for piece, lo in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[lo : lo + 4 * capacity]
                        rows.append((i, piece, lo // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(in_arrow, cut, PIECES)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a column ``length`` from 1 to ``capacity``."""
    spark = found.sparkSession
    names = found.columns
    order = ["length", *(c for c in names if c != "length")]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            size = batch.column(names.index("length")).to_numpy()
            edge = np.flatnonzero(np.r_[True, size[1:] != size[:-1]]) if len(size) else np.zeros(0, np.int64)
            run = np.diff(np.r_[edge, len(size)])
            rank = np.arange(len(size)) - np.repeat(edge, run) + np.repeat(seen[size[edge]], run)
            np.add.at(seen, size[edge], run)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), part), pa.int32()), pa.array(rank, pa.int64())], names=[*names, "_part", "_rank"])

    schema = StructType([*found.schema.fields, StructField("_part", IntegerType()), StructField("_rank", LongType())])
    sorted_ = found.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    table = written(sorted_.transform(in_arrow, ranked, schema), "pieces")
    # At most capacity + partitions rows: partitions are ranges of lengths.
    groups = sorted((r["_part"], r["length"], r["n"]) for r in table.groupBy("_part", "length").agg(F.count("*").alias("n")).collect())
    counts = np.zeros(capacity + 1, np.int64)
    ahead = []
    for _, size, n in groups:
        ahead.append(int(counts[size]))
        counts[size] += n
    plan = best_two_fit(counts)
    keys = np.array([p * (capacity + 1) + size for p, size, _ in groups], np.int64)
    shared = spark.sparkContext.broadcast((plan, keys, np.array(ahead, np.int64)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, keys, ahead = shared.value
        for batch in batches:
            size, part, rank = (batch.column(i).to_numpy().astype(np.int64) for i in (names.index("length"), len(names), len(names) + 1))
            if not len(size):
                continue
            bin_, offset = plan.place(size, rank + ahead[np.searchsorted(keys, part * (capacity + 1) + size)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(bin_), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields[: len(names)])
    return table.transform(in_arrow, placed, out + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    # Written first: sampling for the ranges would encode every text a second time.
    found = written(pieces(docs, tokenizer, capacity, end_id), "tokenised")
    out = pack(found, capacity)
    discard(found)
    return out
