"""Exact Jaccard join of word-shingle sets by universe partition and pigeonhole.

Sizes fall into bands, so narrow that two sets that are similar enough lie in the
same or in neighbouring bands. In a band the shingle universe is hashed into
segments, and every segment gets one or two units: with one, both sets must have
the same shingles there; with two, they may differ by one, which the one-deletion
neighbourhood of the segment finds. Similar sets differ in at most ``H`` shingles,
so with ``H + 1 + s`` units at least ``s + 1`` units' worth of segments agree. How
many segments get two units is chosen by cost: signatures written against
candidates expected from the number of sets in the band, of which a pivot leaves
each class few, so that signatures do not grow faster than the documents. A set whose empty
segments hold at most ``s`` units does not write those, as another segment must
agree too.

Equal sets are one class. Signatures travel to their buckets as sorted, packed
blocks: a block sends one entry a signature, so a bucket gets as many as there are
blocks at most; further classes that a block has with one signature are rows of
their own, as that signature is known to be shared. In each bucket the classes are
compared with a pivot. What is not yet in one component then is compared pair by
pair in buckets of up to ``SMALL`` classes. A larger bucket is split: each class x has its difference R from the
bucket's pivot, and |x ^ y| = |R(x) ^ R(y)|, so two similar classes, not both
similar to the pivot, share one of the first ``H + 1`` elements of R in an order
that puts what the pivot lacks first; those elements are the next buckets. What
many texts share with the pivot is not in R, so such a passage holds no bucket
together any more. After ``LEVELS`` splits buckets are compared whole.

A parity bitmap of each set bounds the difference from below and throws most false
candidates out; what is left is compared shingle by shingle.

Shingles are 64-bit hashes, signatures 48-bit hashes (equal ones only make
candidates), classes 128-bit hashes of all of a set's shingles.

Defined results: null texts and texts without a word have an empty set and link
with nothing; equal ids and equal rows are documents of their own; a null id is
never a component's smallest id unless all are null; an empty table gives no rows;
very long texts are sets like others, in bands of their own; columns but doc_id and
text play no part, whatever their names, and ``one_of_each`` gives them back as
they were.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import broadcast_if_small, discard, in_arrow, in_row, kept_by_workers, out_of_row, partitions, written

#: Words whose hashes a worker keeps.
WORDS = 100_000
PIVOT_ROUNDS, SMALL, LEVELS = 1, 256, 4
#: Signatures, and sets, of one block, and signatures expected in one part of the hash's range.
BLOCK, BLOCK_SETS, PART = 1_000_000, 60_000, 2_000_000
SIGNATURE_BITS = 48
#: A candidate costs as much as so many signatures; of a segment's shingles, the share that only its own document has;
#: share of pairs of documents that have the same text elsewhere, so that a segment without own shingles may agree.
CANDIDATE, OWN, COMMON = 4.0, 0.8, 0.001
#: Candidates of one signature at most, however many sets there are: a class meets its bucket's pivot, and most of its buckets have the same few.
MET = 0.2


@dataclass(frozen=True)
class Join:
    """Shingles of ``words`` words; sets link if intersection / union >= num / den."""

    words: int = 3
    num: int = 90
    den: int = 100

    def most_apart(self, sizes: int) -> int:
        """Largest symmetric difference of linked sets whose sizes add up to ``sizes``."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def bands(self, largest: int) -> list[tuple[int, int]]:
        """Sizes that meet; a set reaches into the next band only from the top of its own."""
        out, lo = [], 1
        while lo <= largest:
            hi = lo * self.den * 5 // (self.num * 4)
            out.append((lo, hi))
            lo = hi + 1
        return out


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


_words = Words()
kept_by_workers.append(_words)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; the whole sequence if there are fewer."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and white space as in [\x20\x09-\x0D]
    if not found:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    n = min(words, len(ids))
    out = np.full(len(ids) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k])
    return np.unique(out)


def bitmap(found: np.ndarray) -> bytes:
    """Parities of the shingles in a power of two of buckets, one or two for each shingle."""
    size = bitmap_bits(len(found))
    return np.packbits(np.bincount((found >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1).tobytes()


def bitmap_bits(n: int) -> int:
    return 64 << (n // 64).bit_length()


def apart_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference from two bitmaps."""
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8)) for v in (a, b))
    if len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x.reshape(-1, len(y)).sum(0) & 1  # bucket numbers end in the same bits
    return int((x != y).sum())


@dataclass(frozen=True)
class Allocation:
    """A band's segments: the first ``two`` have two units; ``slack`` is s."""

    segments: int
    two: int
    slack: int


def allocate(lo: int, hi: int, apart: int, sets: int) -> Allocation:
    """Segments for a band's ``sets`` sets of ``lo`` to ``hi`` shingles, by expected cost a set."""
    best, size = None, (lo + hi) / 2
    for part in (0, 0.125, 0.25, 0.5, 0.75, 1):
        slack = 0
        for _ in range(4):
            units = apart + 1 + slack
            two = int(units * part / 2) if part < 1 else units // 2
            m = two + units - 2 * two
            mean = lo / m
            hollow = 2 * two * math.exp(-mean) * (1 + mean) + (m - two) * math.exp(-mean)
            slack = math.ceil(hollow + 4 * math.sqrt(hollow)) if hollow > 0.01 and m > 8 else 0
        mean = size / m
        agree = COMMON * math.exp(-2 * OWN * mean)
        written_ = (m - two) + two * (1 + mean)
        cost = written_ + CANDIDATE * min(sets * agree, MET) * ((m - two) + two * (1 + 2 * mean))
        if best is None or cost < best[0]:
            best = (cost, Allocation(m, two, max(0, 2 * two + (m - two) - apart - 1)))
    return best[1]


def signatures(found: np.ndarray, band: int, how: Allocation) -> np.ndarray:
    salt = np.uint64((band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    token = mixed(found ^ salt)
    segment = ((token >> np.uint64(32)) % np.uint64(how.segments)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    token, segment = mixed(token[order]), segment[order]
    size = np.bincount(segment, minlength=how.segments)
    ends = np.cumsum(size)
    total = np.r_[np.uint64(0), np.cumsum(token, dtype=np.uint64)]
    sums = total[ends] - total[ends - size]
    units = np.where(np.arange(how.segments) < how.two, 2, 1)
    hollow = int(units[size < units].sum())
    places, values = np.arange(how.segments), sums
    if how.two:
        inner = segment < how.two
        rest = sums[segment[inner]] - token[inner]
        places, values = np.r_[places, segment[inner]], np.r_[values, rest]
    if hollow <= how.slack:
        full = values != 0
        places, values = places[full], values[full]
    return mixed(values + mixed(places.astype(np.uint64) + salt))


def allocations(docs: DataFrame, join: Join) -> tuple[list[tuple[int, int]], list[Allocation | None], int]:
    """The bands, their allocations and about how many signatures they make, from the numbers of blanks in all texts."""
    text = F.col("text").cast("string")
    n = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    log = F.floor(100 * F.log(F.col("n").cast("double"))).cast("int")
    spread = docs.select(n.alias("n"), F.length(text).alias("size")).filter("size > 0").groupBy(log.alias("log")).agg(F.count("*").alias("sets"), F.max("size").alias("most")).collect()  # a row per hundredth of the logarithm
    bands = join.bands(max(((r["most"] + 1) // 2 for r in spread), default=0))  # no text has more words
    starts = [b[0] for b in bands]
    in_band = np.zeros(len(bands) + 1, np.int64)
    for r in spread:
        in_band[max(0, int(np.searchsorted(starts, math.exp((r["log"] + 0.5) / 100), side="right")) - 1)] += r["sets"]
    hows, made = [], 0
    for k, (lo, hi) in enumerate(bands):
        apart = join.most_apart(2 * hi)
        how = allocate(lo, hi, apart, int(in_band[k] + in_band[max(0, k - 1)])) if apart else None
        hows.append(how)
        made += int(in_band[k]) * 2 * (how.segments + int(how.two * hi / how.segments)) if how else 0
    return bands, hows, made


def keys_of(sets: list[np.ndarray]) -> pa.Array:
    import xxhash

    keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
    return pa.StructArray.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["k1", "k2"])


KINDS = {
    "part": pa.int32(), "doc_id": pa.int64(), "th": pa.int64(), "n_shingles": pa.int64(), "k": pa.struct([("k1", pa.int64()), ("k2", pa.int64())]),
    "bits": pa.binary(), "sig": pa.int64(), "k1": pa.int64(), "packed": pa.binary(),
}
#: Rows of documents have k, rows of buckets have sig and k1.
OUT = "doc_id long, th long, n_shingles long, k struct<k1: long, k2: long>, bits binary, sig long, k1 long"
PACKED = f"part int, {OUT}, packed binary"


def rows_of(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kind)) for name, kind in KINDS.items()], names=list(KINDS))


def planes(x: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then their next ones, and so on."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def unplaned(data: bytes, kind: str, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8).reshape(width, n).T.copy().view(kind).reshape(n)


def pack(sig: np.ndarray, shared: np.ndarray, at: np.ndarray, keys: np.ndarray) -> bytes:
    """Ascending signatures, whether each is known to be shared, and the keys[at] that have them."""
    import zstandard

    who, at = np.unique(at, return_inverse=True)
    data = struct.pack("<II", len(sig), len(who)) + keys[who].tobytes() + planes(np.diff(sig, prepend=np.uint64(0))) + planes(at.astype("<u2")) + np.packbits(shared).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, flags and keys."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    n, m = struct.unpack_from("<II", data)
    at = 8 + 8 * m
    keys = np.frombuffer(data[8:at], "<i8")
    sig = np.cumsum(unplaned(data[at : at + 8 * n], "<u8", n), dtype=np.uint64)
    who = unplaned(data[at + 8 * n : at + 10 * n], "<u2", n)
    return sig, np.unpackbits(np.frombuffer(data[at + 10 * n :], np.uint8), count=n).astype(bool), keys[who]


class Block:
    """Signatures of a run of sets, each set's once."""

    def __init__(self, parts: int):
        self.parts, self.width = parts, -(-(1 << SIGNATURE_BITS) // parts)
        self.clear()

    def clear(self) -> None:
        self.known: set[tuple[int, int]] = set()
        self.keys: list[int] = []
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, key: tuple[int, int], sigs: np.ndarray) -> None:
        """``sigs`` keep their upper 48 bits; the lower 16 say whose they are."""
        self.known.add(key)
        self.held.append(sigs & np.uint64(0xFFFF_FFFF_FFFF_0000) | np.uint64(len(self.keys)))
        self.keys.append(key[0])
        self.size += len(sigs)

    def full(self) -> bool:
        return self.size >= BLOCK or len(self.known) >= BLOCK_SETS

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            x, keys = np.sort(np.concatenate(self.held)), np.array(self.keys, "<i8")
            x = x[np.r_[True, x[1:] != x[:-1]]]
            sig, at = x >> np.uint64(16), (x & np.uint64(0xFFFF)).astype(np.int64)
            fresh = np.r_[True, sig[1:] != sig[:-1]]
            if not fresh.all():
                k1 = keys[at[~fresh]]
                yield rows_of(len(k1), part=pa.array((k1 % self.parts).astype(np.int32)), sig=pa.array(sig[~fresh].view(np.int64)), k1=pa.array(k1))
            first = np.flatnonzero(fresh)
            shared, sig, at = np.diff(np.r_[first, len(sig)]) > 1, sig[first], at[first]
            edges = np.searchsorted(sig, np.arange(self.parts + 1, dtype=np.uint64) * np.uint64(self.width))
            for p in np.flatnonzero(np.diff(edges)).tolist():
                here = slice(edges[p], edges[p + 1])
                yield rows_of(1, part=pa.array([p], pa.int32()), packed=pa.array([pack(sig[here], shared[here], at[here], keys)]))
        self.clear()


def shared_of(entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(sig, k1) of the signatures in ``entries`` that several classes have or that are known to be shared."""
    sig, known, k1 = (np.concatenate(x) for x in zip(*entries))
    order = np.argsort(sig, kind="stable")
    same = sig[order[1:]] == sig[order[:-1]]
    some = order[np.r_[False, same] | np.r_[same, False] | known[order]]
    sig, known, k1 = sig[some], known[some], k1[some]
    order = np.lexsort((k1, sig))
    sig, known, k1 = sig[order], known[order], k1[order]
    edge = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
    fresh = np.r_[True, (sig[1:] != sig[:-1]) | (k1[1:] != k1[:-1])] if len(sig) else np.zeros(0, bool)
    if len(sig):
        many = (np.add.reduceat(fresh.astype(np.int64), edge) > 1) | np.logical_or.reduceat(known, edge)
        fresh &= np.repeat(many, np.diff(np.r_[edge, len(sig)]))
    sig, k1 = sig[fresh].view(np.int64), k1[fresh]
    return rows_of(len(sig), sig=pa.array(sig), k1=pa.array(k1))


def met(rows: DataFrame, parts: int) -> DataFrame:
    """The rows of ``Block`` after their parts met: (sig, k1) of shared signatures only; other rows as they are."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, part = list(KINDS)[1:-1], [], None
        for batch in batches:
            is_packed = batch.column("packed").is_valid()
            rest = batch.filter(pc.invert(is_packed)).select(out)
            if rest.num_rows:
                yield rest
            packed = batch.filter(is_packed)
            for p, data in zip(packed.column("part").to_pylist(), packed.column("packed").to_pylist()):
                if held and p != part:
                    yield shared_of(held).select(out)
                    held = []
                part = p
                held.append(unpack(data))
        if held:
            yield shared_of(held).select(out)

    return rows.repartition(parts, "part").sortWithinPartitions("part").transform(in_arrow, shared, OUT)


def sets_and_buckets(docs: DataFrame, join: Join) -> DataFrame:
    """Rows of documents (doc_id, th, n_shingles, k, bits) and of buckets (sig, k1): the classes of each signature that several have.

    A set has signatures in its own band and, as the smaller of a pair, in the next.
    """
    bands, hows, expected = allocations(docs, join)
    starts = np.array([b[0] for b in bands], np.int64)
    parts = max(partitions(docs.sparkSession), -(-expected // PART))

    def sign(found: np.ndarray) -> np.ndarray:
        band = int(np.searchsorted(starts, len(found), side="right")) - 1
        # Sets that can be in a pair of the next band have at least num / den times its least size.
        own = [b for b in (band, band + 1) if b < len(bands) and hows[b] and (b == band or len(found) * join.den >= bands[b][0] * join.num)]
        return np.concatenate([signatures(found, b, hows[b]) for b in own]) if len(found) and own else np.zeros(0, np.uint64)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(parts)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sets = [shingles(t, join.words) for t in some.column(1).to_pylist()]
                keys = keys_of(sets)
                for s, k in zip(sets, keys.to_pylist()):
                    k = (k["k1"], k["k2"])
                    if len(s) and k not in block.known:
                        block.add(k, sign(s))
                        if block.full():
                            yield from block.rows()
                part = (keys.field("k1").to_numpy() % parts).astype(np.int32)
                yield rows_of(len(sets), part=pa.array(part), doc_id=some.column(0), th=some.column(2), n_shingles=pa.array([len(s) for s in sets], pa.int64()), k=keys, bits=pa.array([bitmap(s) for s in sets], pa.binary()))
        yield from block.rows()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).transform(in_arrow, made, PACKED).transform(met, parts)


def class_texts(docs: DataFrame, one: DataFrame) -> DataFrame:
    """c and data (the packed text) of the classes in ``one`` (c, doc_id, th, times)."""

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([compress(t.encode()) for t in part.column(1).to_pylist()], pa.binary())], names=["c", "data"])

    wanted = broadcast_if_small(one.select("c", F.col("doc_id").alias("id"), F.col("th").alias("hash"), "times"))
    found = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash")))
    if one.filter("times > 1").limit(1).count():  # equal rows: one of them
        found = found.filter("times = 1").unionByName(found.filter("times > 1").dropDuplicates(["c"]))
    return found.select("c", "text").transform(in_arrow, press, "c long, data binary")


def with_both(pairs: DataFrame, texts: DataFrame, join: Join, f: Callable, schema: str) -> DataFrame:
    """``f`` of an iterator of (a, b, shingles of a, shingles of b) for all pairs (a, b); ``f`` yields record batches."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def read() -> Iterator[tuple]:
            sets = lambda data: shingles(zstandard.ZstdDecompressor().decompress(data).decode(), join.words)
            last, sb = None, None
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                        if b != last:
                            last, sb = b, sets(tb)
                        yield a, b, sets(ta), sb

        yield from f(read())

    rows = pairs
    for c, t in (("a", "ta"), ("b", "tb")):  # only texts that are in a pair move
        wanted = broadcast_if_small(pairs.select(F.col(c).alias("c")).distinct())
        rows = rows.join(texts.join(wanted, "c", "left_semi").select(F.col("c").alias(c), F.col("data").alias(t)), c)
    return rows.select("a", "b", "ta", "tb").transform(in_arrow, each, schema)


def similar(pairs: DataFrame, one: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps allow a link."""
    narrow = one.select("c", "n", "bits")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            apart = map(apart_at_least, batch.column("ba").to_pylist(), batch.column("bb").to_pylist())
            keep = [low <= join.most_apart(int(s)) for low, s in zip(apart, n)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(narrow.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a")
    rows = rows.join(narrow.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b")
    near = F.least("na", "nb") * join.den >= F.greatest("na", "nb") * join.num
    return rows.filter(near).select("a", "b", "na", "nb", "ba", "bb").transform(in_arrow, bounded, "a long, b long")


def link(x: np.ndarray, y: np.ndarray, join: Join) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return join.den * both >= join.num * (len(x) + len(y) - both)


def linking(pairs: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def found(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        ends = [(a, b) for a, b, sa, sb in rows if link(sa, sb, join)]  # as many as the task has pairs
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return with_both(pairs, texts, join, found, "a long, b long")


def elements(x: np.ndarray, pivot: np.ndarray, pivot_key: int, join: Join) -> np.ndarray:
    """Buckets of ``x`` below a pivot: the first of their difference's elements, those that the pivot lacks first."""
    larger = len(x) * join.den // join.num
    most = join.most_apart(len(x) + larger) + 1
    out, inside = np.setdiff1d(x, pivot, assume_unique=True), np.setdiff1d(pivot, x, assume_unique=True)
    first = np.r_[np.sort(out), np.sort(inside)][:most]
    return mixed(first ^ mixed(np.array([pivot_key], np.uint64)))


def split(pairs: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """For classes a and their pivots b: rows of links, with k (a, b), and of the next buckets (sig, k1: a class)."""
    parts = partitions(pairs.sparkSession)

    def found(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        block = Block(parts)
        for a, b, sa, sb in rows:
            if link(sa, sb, join):
                yield rows_of(1, part=pa.array([a % parts], pa.int32()), k=pa.array([{"k1": a, "k2": b}], KINDS["k"]))
            block.add((a, b), elements(sa, sb, b, join))
            if block.full():
                yield from block.rows()
        yield from block.rows()

    return with_both(pairs, texts, join, found, PACKED).transform(met, parts)


def near_pairs(open_: DataFrame, one: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) of a bucket's classes (sig, c, comp) in different components whose bitmaps may link.

    Bitmaps of a bucket are compared within the task, so only what passes leaves it.
    """

    def of_bucket(c: list[int], comp: list[int], n: list[int], bits: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        least = min(map(len, bits))
        x = np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, least), 0) for b in bits]).view(np.uint64)
        c, comp, n = np.array(c), np.array(comp), np.array(n)
        for i in range(len(c) - 1):
            apart = np.bitwise_count(x[i] ^ x[i + 1 :]).sum(1)
            most = (n[i] + n[i + 1 :]) * (join.den - join.num) // (join.den + join.num)
            j = np.flatnonzero((apart <= most) & (comp[i] != comp[i + 1 :])) + i + 1
            if len(j):
                yield np.minimum(c[i], c[j]), np.maximum(c[i], c[j])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def told() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][0] != row[0]:
                    for pair in of_bucket(*list(zip(*held))[1:]):
                        out.append(pair)
                        if len(out) >= 10_000:
                            yield told()
                            out.clear()
                    held = []
                held.append(row)
        if held:
            out += of_bucket(*list(zip(*held))[1:])
        yield told()

    rows = open_.select("sig", "c", "comp").join(one.select("c", "n", "bits"), "c").select("sig", "c", "comp", "n", "bits")
    rows = rows.repartition(partitions(open_.sparkSession), "sig").sortWithinPartitions("sig")
    return rows.transform(in_arrow, found, "a long, b long")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(c, comp) after joining the components that a link (a, b) connects."""
    known = broadcast_if_small(labels)
    ends = known.select(F.col("c").alias("a"), F.col("comp").alias("ca"))
    edges = links.join(ends, "a").join(known.select(F.col("c").alias("b"), F.col("comp").alias("cb")), "b").filter("ca != cb")
    under = stars(edges.select(F.greatest("ca", "cb").alias("hi"), F.least("ca", "cb").alias("lo")))
    if not under.limit(1).count():
        discard(under)
        return labels
    found = labels.join(broadcast_if_small(under).select(F.col("hi").alias("comp"), "lo"), "comp", "left")
    out = written(found.select("c", F.coalesce("lo", "comp").alias("comp")), "labels")
    discard(labels, under)
    return out


def stars(edges: DataFrame) -> DataFrame:
    """(hi, lo): every vertex of the edges (hi, lo) but the least of its component, with that least.

    Large and small stars in turn: first every vertex ties its larger neighbours to the
    least it knows, then its smaller ones and itself, until nothing changes.
    """
    edges, was = written(edges.distinct(), "stars"), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("sum")).first()
        if now == was or not now["n"]:
            return edges
        was = now
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        small = small.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
        before, edges = edges, written(small.distinct(), "stars")
        discard(before)


def mask(seed: int) -> Column:
    return F.lit(int(mixed(np.array([seed + 1], np.uint64))[0] >> np.uint64(1)))


def with_pivots(large: DataFrame, seed: int) -> DataFrame:
    """(a, b): each class of the buckets (sig, c) with their pivots. Classes of many buckets come first as pivots, so that a class meets few."""
    often = large.groupBy("c").agg(F.count("*").alias("often"))
    rows = large.select("sig", "c").join(broadcast_if_small(written(often, "often")), "c")
    pivots = rows.groupBy("sig").agg(F.min(F.struct((-F.col("often")).alias("o"), F.col("c").bitwiseXOR(mask(seed)).alias("m"), F.col("c").alias("b"))).alias("p"))
    pivots = written(pivots.select("sig", "p.b"), "pivots")
    return rows.join(pivots, "sig").filter("c != b").select(F.col("c").alias("a"), "b").distinct()


def opened(buckets: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """sig, c, comp, b (a pivot of seeded choice) and size of the buckets (sig, c) that have classes of several components."""
    rows = buckets.join(broadcast_if_small(labels), "c")
    several = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.col("c").bitwiseXOR(mask(seed))).alias("p"), F.count("*").alias("size")).filter("lo != hi")
    several = written(several.select("sig", F.col("p").bitwiseXOR(mask(seed)).alias("b"), "size"), "several")
    out = written(rows.join(several, "sig").select("sig", "c", "comp", "b", "size"), "open_buckets")
    discard(several)
    return out


def components(buckets: DataFrame, one: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """(c, comp) of the classes in ``one`` after linking those that share a bucket (sig, c). ``buckets`` goes."""
    labels = written(one.select("c", F.col("c").alias("comp")), "labels")
    ordered = lambda rows: rows.filter("c != b").select(F.least("c", "b").alias("a"), F.greatest("c", "b").alias("b")).distinct()

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        links = written(linking(pairs, texts, join), "links")
        discard(pairs)
        return links

    seed, source = 0, buckets
    for level in range(LEVELS + 1):
        for last in [False] * PIVOT_ROUNDS + [True]:
            open_ = opened(buckets, labels, seed)
            discard(source)
            seed, source = seed + 1, open_
            if not (sizes := open_.agg(F.max("size").alias("most")).first()["most"]):
                discard(open_)
                return labels
            if last:
                break
            links = checked(similar(ordered(open_), one, join))
            labels = merged(labels, links)
            discard(links)
            buckets = open_.filter("c != b and size > 2").select("sig", "c")  # the pivot has met all others
        small = open_ if level == LEVELS else open_.filter(F.col("size") <= SMALL)
        links = checked(near_pairs(small, one, join).distinct())
        if level == LEVELS or sizes <= SMALL:
            labels = merged(labels, links)
            discard(links, open_)
            return labels
        pairs = written(with_pivots(open_.filter(F.col("size") > SMALL), seed), "pairs")
        found = written(split(pairs, texts, join), "split")
        labels = merged(labels, links.unionByName(found.filter("k is not null").select(F.col("k.k1").alias("a"), F.col("k.k2").alias("b"))))
        discard(links, pairs, open_)
        buckets, source = found.filter("sig is not null").select("sig", F.col("k1").alias("c")), found
    return labels


def grouped(docs: DataFrame, join: Join) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n_shingles, comp) of every row of (doc_id, text), and (comp, size, first) of components with several rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = written(sets_and_buckets(docs, join), "sets")
    table, rows = both.filter("k is not null"), both.filter("sig is not null").select("sig", "k1")
    halves = written(rows.select("k1").distinct(), "bucket_classes")
    members = table.filter("n_shingles > 0").withColumn("k1", F.col("k.k1")).join(broadcast_if_small(halves), "k1", "left_semi")
    members = members.groupBy("k", "doc_id", "th").agg(F.count("*").alias("times"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"))
    one = members.groupBy("k").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "times", "n", "bits")).alias("one"))
    one = written(one.select(F.monotonically_increasing_id().alias("c"), "k", "one.*"), "classes")
    buckets = written(rows.join(broadcast_if_small(one.select(F.col("k.k1").alias("k1"), "c")), "k1").select("sig", "c"), "buckets")
    texts = written(class_texts(docs, one), "class_texts")
    labels = components(buckets, one, texts, join)
    moved = labels.filter("c != comp").join(one.select("c", "k"), "c").join(one.select(F.col("c").alias("comp"), F.col("k").alias("into")), "comp")
    moved = written(moved.select("k", "into"), "moved_classes")
    discard(halves, texts, labels, one)
    rows = table.join(broadcast_if_small(moved), "k", "left").select("doc_id", "th", "n_shingles", F.coalesce("into", "k").alias("comp"))
    rows = written(rows, "components")
    discard(both, moved)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    groups = rows.filter("n_shingles > 0").groupBy("comp").agg(F.count("*").alias("size"), first).filter("size > 1")
    return rows, written(groups, "groups")


def linked(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles and component_id of every row of (doc_id, text)."""
    rows, groups = grouped(docs, join)
    rows = rows.join(broadcast_if_small(groups.select("comp", F.col("first.doc_id").alias("least"), "size")), "comp", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("size").isNotNull(), F.col("least")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "th", "n_shingles", own.alias("component_id"))


def one_of_each(docs: DataFrame, join: Join) -> DataFrame:
    """``docs`` with one row of each component, of smallest (doc_id, hash of the text); empty sets all stay."""
    rows, groups = grouped(docs, join)
    marks = rows.filter("n_shingles > 0").join(broadcast_if_small(groups.select("comp", "first")), "comp")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    marks = marks.groupBy("doc_id", "th").agg(F.max(is_first).alias("is_first"), F.count("*").alias("times"))
    marks = written(marks, "marks")
    docs_ = in_row(docs, id=F.col("doc_id").cast("long"), hash=F.xxhash64(F.col("text").cast("string")))
    both = docs_.join(broadcast_if_small(marks), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("th")), "left")
    alone = both.filter("is_first is null or (is_first and times = 1)")
    again = both.filter("is_first and times > 1").dropDuplicates(["id", "hash"])  # the first's id and text stand in several rows
    return out_of_row(alone, docs.columns).unionByName(out_of_row(again, docs.columns))
