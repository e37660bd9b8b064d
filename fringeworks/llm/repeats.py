"""Removal of long byte strings that occur more than once, by suffix arrays of shards.

A string of ``LENGTH`` bytes has a landmark: the first of its ``GRAM``-byte grams
with the least hash. Equal strings have equal landmarks at equal places, so all
starts in a document that share a landmark make one fragment, and a repeated start
can only be repeated in fragments with the same landmark. Equal fragments are
counted, not compared. Different fragments with one landmark meet in a shard, whose
suffix array is built by induced sorting; a start repeats if its string shares
``LENGTH`` bytes with a neighbour in suffix order, which the permuted common
prefixes tell. Every start belongs to one fragment, so nothing matches itself.

A landmark whose different fragments are more than ``MOST`` does not go into one
shard: its starts are grouped by the 128-bit hashes of their strings, in a shuffle
that combines before it sends. Nothing is dropped.

Shorter passages stay in the text but are told: ``n_shared_words`` counts the words
of a document in runs of ``PASSAGE`` words that another document has as well.
Landmarks of words find texts that may share a run, in shuffles of hashes; only
the runs around shared landmarks are compared, by 64-bit hashes.

Defined results: a null text is empty; texts shorter than ``LENGTH`` lose nothing;
equal rows are documents of their own and so repeat each other; null ids are kept;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jaccard import mixed
from .scratch import broadcast_if_small, in_arrow, partitions, written
from .suffixes import permuted_prefixes, suffix_array

LENGTH = 400
GRAM = 128
MOST = 20_000
#: Bytes of fragments in one suffix array, unless a landmark alone has more.
SHARD = 4_000_000
#: Words of a passage that counts as shared, and of its landmark.
PASSAGE, PASSAGE_GRAM = 50, 25
#: Texts whose shared landmarks may be broadcast, some 200 bytes each; beyond, the texts shuffle.
MOST_MARKED = 100_000
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Starts whose landmarks are found at once; the arrays of so many fit a core's cache.
BLOCK = 1 << 15
#: Bytes up to which a word's hash is the polynomial's, which some made strings of over 1000 bytes share.
LONG_WORD = 512
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


class Powers:
    """Powers of the hash's base and of its inverse, as long as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.byte = mixed(np.arange(1, 257, dtype=np.uint64))

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(INVERSE, m, 1 << 64))])


_powers: list[Powers] = []


def powers() -> Powers:
    if not _powers:
        _powers.append(Powers())
    return _powers[0]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of the polynomial of ``values`` up to each place; grows the powers to fit."""
    p = powers()
    p.grow(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p.up[: len(values)], out=total[1:])
    return total


def rolled(values: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every ``gram`` values in a row, by prefix sums of a polynomial."""
    total = prefix_sums(values)
    n = len(values) - gram + 1
    return mixed((total[gram:] - total[:n]) * powers().down[:n])


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window, from windows of half the width."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[span:], values[:-span])
        span *= 2
    return np.minimum(values[width - span :], values[: len(values) - (width - span)])


def landmarks(values: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of the strings of ``length`` values of documents that lie one after the other, ``bounds`` their borders.

    Document, landmark hash, first start and end of starts of each, in order. The first
    gram with the least upper bits of its hash is the landmark; the lower bits hold its
    place, so blocks of many documents need no sorting.
    """
    width = length - gram + 1
    low = np.uint64((1 << (BLOCK + width).bit_length()) - 1)
    place = np.arange(BLOCK + width, dtype=np.uint64)
    where, starts, hashes = [], [], []
    for at in range(0, len(values) - length + 1, BLOCK):
        part = values[at : at + BLOCK + length - 1]
        found = rolled(powers().byte[part] if part.dtype == np.uint8 else part, gram)
        mark = window_minimum((found & ~low | place[: len(found)]).view(np.int64), width) & np.int64(low)
        edge = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1]])
        where.append(mark[edge] + at)
        starts.append(edge + at)
        hashes.append(found[mark[edge]])
    begin, end = bounds[:-1], bounds[1:] - (length - 1)
    long_ = end > begin
    if not long_.any():
        return (np.zeros(0, np.int64),) * 4
    where, starts, hashes = map(np.concatenate, (where, starts, hashes))
    new = np.r_[True, where[1:] != where[:-1]]  # one fragment, though a block ends in it
    starts, hashes = starts[new], hashes[new]
    cuts = np.unique(np.concatenate([starts, begin[long_], end[long_]]))
    doc = np.flatnonzero(long_)[np.searchsorted(begin[long_], cuts, "right") - 1]
    inside = np.flatnonzero((cuts >= begin[doc]) & (cuts < end[doc]))  # the others run over a border
    lo, hi, doc = cuts[inside], cuts[inside + 1], doc[inside]
    return doc, hashes[np.searchsorted(starts, lo, "right") - 1].view(np.int64), lo - begin[doc], hi - begin[doc]


def fragments(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Landmark hash, first start and end of starts of each fragment of a text of ``length`` bytes at least."""
    return landmarks(np.frombuffer(data, np.uint8), np.array([0, len(data)]), length, gram)[1:]


def joined_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and their borders."""
    held = texts.cast(pa.large_binary())
    bounds = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = held.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals, which may overlap or touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, starts[1:] > reach[:-1]]
    return starts[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]


def found_fragments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """mark, frag (hash), id, th, lo, hi (starts) and n: how often a document has the fragment.

    Rows with n = 0 are the further places in the document; they need no partner.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kinds = [pa.int64()] * 4 + [pa.int32()] * 3
        for batch in batches:
            data, bounds = joined_texts(batch.column(2))
            doc, mark, lo, hi = landmarks(data, bounds, length, gram)
            at, view = bounds[doc], memoryview(data)
            frag = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip((at + lo).tolist(), (at + hi + length - 1).tolist())), np.uint64, len(doc)).view(np.int64)
            order = np.lexsort((lo, frag, mark, doc))
            doc, mark, frag, lo, hi = doc[order], mark[order], frag[order], lo[order], hi[order]
            first = np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]) | (frag[1:] != frag[:-1])][: len(doc)]
            n = np.zeros(len(doc), np.int64)
            n[first] = np.diff(np.r_[np.flatnonzero(first), len(doc)])
            i, th = (batch.column(k).to_numpy()[doc] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((mark, frag, i, th, lo, hi, n), kinds)], names=["mark", "frag", "id", "th", "lo", "hi", "n"])

    return docs.transform(in_arrow, found, "mark long, frag long, id long, th long, lo int, hi int, n int")


def cut_out(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """mark, frag, data: the bytes of one place of each wanted fragment (mark, frag, id, th, lo, hi)."""
    places = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("mark", "frag", "lo", "hi")).alias("places"))  # as many as a document has
    both = packed(docs).join(places, ["id", "th"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for data, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = unpack(data)
                seen = {(p["mark"], p["frag"]): p for p in places}.values()  # equal rows of one id ask twice
                yield pa.RecordBatch.from_pylist([{"mark": p["mark"], "frag": p["frag"], "data": data[p["lo"] : p["hi"] + length - 1]} for p in seen], schema=pa.schema([("mark", pa.int64()), ("frag", pa.int64()), ("data", pa.binary())]))

    return both.select("data", "places").transform(in_arrow, cut, "mark long, frag long, data binary")


def packed(docs: DataFrame) -> DataFrame:
    """id, th and data: texts in less room for shuffles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([press(t.encode()) for t in part.column(2).to_pylist()], pa.binary())], names=["id", "th", "data"])

    return docs.transform(in_arrow, pack, "id long, th long, data binary")


def repeated_in(texts: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the runs of starts whose string of ``length`` bytes starts anywhere else in ``texts``."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    s = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int16) + np.int16(2)
    s[ends - 1] = 1
    s = np.r_[s, np.int16(0)]
    before, prefix = permuted_prefixes(s, suffix_array(s, 258), 1)
    hit = np.zeros(len(s), bool)
    long_ = np.flatnonzero(prefix >= length)
    hit[long_] = hit[before[long_]] = True
    out = []
    for lo, hi in zip(np.r_[0, ends[:-1]], ends):
        edge = np.flatnonzero(np.diff(np.r_[False, hit[lo:hi], False]))
        out.append((edge[::2], edge[1::2]))
    return out


def sharded(cuts: DataFrame, length: int) -> DataFrame:
    """mark, frag, from, to: runs of repeated starts within fragments, by suffix arrays of shards."""
    n = partitions(cuts.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def told() -> pa.RecordBatch:
            rows = [(m, f, int(a), int(b)) for (m, f, _), (x, y) in zip(held, repeated_in([h[2] for h in held], length)) for a, b in zip(x, y)]
            columns = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])], names=["mark", "frag", "from", "to"])

        for batch in batches:
            for m, f, data in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD and m != held[-1][0]:
                    yield told()
                    held, size = [], 0
                held.append((m, f, data))
                size += len(data)
        if held:
            yield told()

    return cuts.repartition(n, "mark").sortWithinPartitions("mark", "frag").transform(in_arrow, search, "mark long, frag long, `from` int, `to` int")


def by_string(cuts: DataFrame, length: int) -> DataFrame:
    """As ``sharded``, for landmarks with very many fragments: starts grouped by their strings' hashes."""

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for m, f, data in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(data) - length + 1
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[k : k + length]) for k in range(n)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, m)), pa.array(np.full(n, f)), pa.array(np.arange(n), pa.int32()), pa.array(keys[:, 0]), pa.array(keys[:, 1])], names=["mark", "frag", "at", "s1", "s2"])

    rows = cuts.transform(in_arrow, starts, "mark long, frag long, at int, s1 long, s2 long")
    often = rows.groupBy("s1", "s2").agg(F.count("*").alias("n")).filter("n > 1").select("s1", "s2")
    return rows.join(often, ["s1", "s2"]).select("mark", "frag", F.col("at").alias("from"), (F.col("at") + 1).cast("int").alias("to"))


def word_values(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of texts that lie one after the other, and the borders of the texts' words."""
    inner = np.zeros(len(data) + 2, bool)
    inner[1:-1] = ~SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[bounds] = True
    starts = np.flatnonzero(inner[1:] & (~inner[:-1] | border))
    ends = np.flatnonzero(inner[:-1] & (~inner[1:] | border))
    values, p = np.empty(len(starts), np.uint64), powers()
    for at in range(0, len(starts), BLOCK // 8):
        a, b = starts[at : at + BLOCK // 8], ends[at : at + BLOCK // 8]
        total = prefix_sums(p.byte[data[a[0] : b[-1]]])
        values[at : at + len(a)] = mixed((total[b - a[0]] - total[a - a[0]]) * p.down[a - a[0]])
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        import xxhash

        values[k] = xxhash.xxh3_64_intdigest(memoryview(data)[starts[k] : ends[k]])
    return values, np.searchsorted(starts, bounds)


def shared_words(docs: DataFrame, words: int = PASSAGE, gram: int = PASSAGE_GRAM, most: int = MOST_MARKED) -> DataFrame:
    """id, th, n_shared_words of the documents (id, th, text) that share a run of ``words`` words with another one."""

    def marks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds = word_values(*joined_texts(batch.column(2)))
            doc, mark, _, _ = landmarks(values, bounds, words, gram)
            order = np.lexsort((mark, doc))
            doc, mark = doc[order], mark[order]
            first = np.r_[True, (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])][: len(doc)]
            doc, mark = doc[first], mark[first]
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes >= words)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[np.searchsorted(doc, some), len(doc)], pa.int32()), pa.array(mark))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[some]), pa.array(batch.column(1).to_numpy()[some]), pa.array(sizes[some], pa.int64()), lists], names=["id", "th", "size", "marks"])

    def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, bounds = word_values(*joined_texts(batch.column(1)))
            doc, mark, lo, hi = landmarks(values, bounds, words, gram)
            wanted = batch.column(2)
            of = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy())
            pairs = np.unique(mixed(wanted.flatten().to_numpy().view(np.uint64)) + of.astype(np.uint64))  # a bijection for each document
            here = np.isin(mixed(mark.view(np.uint64)) + doc.astype(np.uint64), pairs)
            doc, mark, lo, hi = (c[here] for c in (doc, mark, lo, hi))
            if not len(doc):
                continue
            begin, held = bounds[doc] + lo, hi - lo
            sums = prefix_sums(values)
            edge = np.cumsum(held)
            at = np.arange(edge[-1]) + np.repeat(begin - (edge - held), held)  # every start of every fragment
            down = powers().down
            runs = mixed((sums[at + words] - sums[at]) * down[at]).view(np.int64)
            frag = mixed((sums[begin + held + words - 1] - sums[begin]) * down[begin]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, edge], pa.int32()), pa.array(runs))
            yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(frag), pa.array(batch.column(0).to_numpy()[doc]), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), lists], names=["mark", "frag", "th", "lo", "hi", "runs"])

    texts = written(docs.transform(in_arrow, marks_of, "id long, th long, size long, marks array<long>"), "passage_marks")
    once = texts.groupBy("th").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("size").alias("size"))
    held = texts.select("th", F.explode("marks").alias("mark"))
    several = held.groupBy("mark").agg(F.min("th").alias("a"), F.max("th").alias("b")).filter("a != b").select("mark")
    marks = held.join(several, "mark").groupBy("th").agg(F.collect_set("mark").alias("marks"))  # as many as a text has
    marks = written(marks.join(once.select("id", "th"), "th"), "shared_marks")
    rows = docs.join(broadcast_if_small(marks, most), ["id", "th"]).select("th", "text", "marks")  # one of the copies of a text
    found = written(rows.transform(in_arrow, runs_of, "mark long, frag long, th long, lo int, hi int, runs array<long>"), "passage_fragments")
    kinds = written(found.groupBy("mark", "frag").agg(F.min("th").alias("a"), F.max("th").alias("b")), "passage_kinds")
    # A fragment that another text has is shared as a whole; of one that only one text has, runs may be in other fragments of its landmark.
    covered = found.join(kinds.filter("a != b").select("mark", "frag"), ["mark", "frag"]).select("th", "lo", "hi")
    mixed_ = kinds.groupBy("mark").agg(F.count("*").alias("n"), F.max(F.expr("a = b")).alias("alone")).filter("n > 1 and alone").select("mark")
    one = found.join(kinds.join(mixed_, "mark"), ["mark", "frag"]).filter("th = a").select("th", "b", "lo", F.posexplode("runs").alias("k", "run"))
    one = written(one.select("run", "th", "b", (F.col("lo") + F.col("k")).alias("lo")), "passage_runs")
    both = one.groupBy("run").agg(F.min("th").alias("least"), F.max("b").alias("most")).filter("least != most").select("run")
    covered = covered.unionByName(one.filter("th = b").join(both, "run").select("th", "lo", (F.col("lo") + 1).alias("hi")))
    ahead = F.lead("lo").over(Window.partitionBy("th").orderBy("lo"))
    reach = F.col("hi") + (words - 1) - F.col("lo")
    covered = covered.select("th", F.least(reach, F.coalesce(ahead - F.col("lo"), reach)).alias("n")).groupBy("th").agg(F.sum("n").cast("long").alias("n"))  # equal rows add 0
    told = once.join(covered, "th", "left").select("th", F.when(F.col("copies") > 1, F.col("size")).otherwise(F.col("n")).alias("n_shared_words"))
    return texts.select("id", "th").distinct().join(told.filter("n_shared_words is not null"), "th")


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, spans (array of begin, end of the removed bytes), kept (the other bytes) and n_shared_words of (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    docs = docs.select(F.coalesce(id_, F.lit(-(1 << 63))).alias("id"), F.xxhash64(text, id_.isNull()).alias("th"), text.alias("text"))
    every = written(found_fragments(docs, length, gram), "fragments")
    firsts = every.filter("n > 0")
    kinds = firsts.groupBy("mark", "frag").agg(F.sum("n").alias("n"), F.min(F.struct("id", "th", "lo", "hi")).alias("one"))
    marks = firsts.groupBy("mark").agg(F.sum("n").alias("total"), F.min("frag").alias("a"), F.max("frag").alias("b")).filter("total > 1")
    kinds = written(kinds.join(marks.select("mark", (F.col("a") != F.col("b")).alias("several")), "mark"), "fragment_kinds")
    whole = kinds.filter("n > 1").select("mark", "frag", F.lit(0).alias("from"), (F.col("one.hi") - F.col("one.lo")).alias("to"))
    several = kinds.filter("several")
    hot = several.groupBy("mark").agg(F.count("*").alias("d")).filter(F.col("d") > most).select("mark", F.lit(True).alias("hot"))
    several = several.join(hot, "mark", "left").select("mark", "frag", F.coalesce("hot", F.lit(False)).alias("hot"), "one.*")
    cuts = written(cut_out(docs, several.select("mark", "frag", "id", "th", "lo", "hi"), length), "fragment_texts")
    cuts = cuts.join(hot, "mark", "left")
    parts = sharded(cuts.filter("hot is null").drop("hot"), length)
    parts = parts.unionByName(by_string(cuts.filter("hot").drop("hot"), length))
    hits = written(whole.unionByName(parts), "repeats")
    spans = firsts.join(hits, ["mark", "frag"]).select("id", "th", (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to")).alias("hi"))
    spans = spans.unionByName(every.filter("n = 0").select("id", "th", "lo", "hi"))
    spans = spans.groupBy("id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))  # as many as a document has
    both = packed(docs).join(spans, ["id", "th"], "left").join(written(shared_words(docs), "shared_words"), ["id", "th"], "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, gone, kept = [], [], []
                for data, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    data = unpack(data)
                    lo, hi = runs(np.array([s["lo"] for s in spans or []], np.int64), np.array([s["hi"] + length - 1 for s in spans or []], np.int64))
                    sizes.append(len(data))
                    gone.append([{"begin": int(a), "end": int(b)} for a, b in zip(lo, hi)])
                    kept.append(b"".join(data[a:b] for a, b in zip(np.r_[0, hi].tolist(), np.r_[lo, len(data)].tolist())))
                ids = pa.array([None if i == -(1 << 63) else i for i in part.column(0).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(gone, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary()), part.column(3)], names=["doc_id", "n_bytes", "spans", "kept", "n_shared_words"])

    return both.select("id", "data", "spans", F.coalesce("n_shared_words", F.lit(0).cast("long"))).transform(in_arrow, strip, "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary, n_shared_words long")
