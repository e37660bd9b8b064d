"""Token ids in files of directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level k holds the k-th chunk of
every id that has one, a bitmap that says for each whether a higher chunk
follows, and a directory with the number of set bits before every 512th. A
token's next chunk stands at the rank of its bit, so any token, or any run of
tokens, is read from a few byte ranges without decoding what stands before it.

File: magic; segments of at most ``SEGMENT`` ids, each with the codes, bitmap and
directory of its levels; doc ids, a null mask and the documents' starts; a JSON
index; the index's size; magic. Files are written under names of their own by each
attempt of a task, and only those named in the returned manifest count.

Defined results: null text is empty (its end id only); rows with equal ids follow
each other in the order of their texts; a null doc_id comes first; an empty table
gives no file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import fresh_path, in_arrow, partitions
from .wordids import encoder

MAGIC = b"FWDAC001"
CHUNK_BITS = 8
SEGMENT = 1 << 21
STEP = 512


def place(uri: str):
    """(file system, path) of a URI."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def levels(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes, bitmap and rank directory of each level."""
    rest = ids.astype(np.uint32)
    while len(rest):
        more = rest >> CHUNK_BITS > 0
        padded = np.zeros(-(-len(rest) // STEP) * STEP, bool)
        padded[: len(rest)] = more
        before = np.cumsum(padded.reshape(-1, STEP).sum(1)) - padded.reshape(-1, STEP).sum(1)
        yield (rest & 0xFF).astype(np.uint8), np.packbits(more, bitorder="little"), before.astype("<u4")
        rest = rest[more] >> CHUNK_BITS


class Writer:
    def __init__(self, sink):
        self.sink, self.at, self.held, self.n_held, self.total = sink, 0, [], 0, 0
        self.segments: list[dict] = []
        self.docs: list[int | None] = []
        self.starts: list[int] = []
        self._put(MAGIC)

    def _put(self, data) -> list[int]:
        self.sink.write(data)
        self.at += len(data)
        return [self.at - len(data), len(data)]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit."""
        self.docs.append(doc_id)
        self.starts.append(self.total)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        self.total += len(ids) // 4
        if self.n_held >= SEGMENT:
            self._flush()

    def _flush(self) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        for lo in range(0, len(ids), SEGMENT):
            part = ids[lo : lo + SEGMENT]
            parts = [[self._put(x.tobytes()) for x in level] for level in levels(part)]
            self.segments.append({"first": self.total - len(ids) + lo, "n": len(part), "levels": parts})
        self.held, self.n_held = [], 0

    def close(self) -> None:
        self._flush()
        index = {"n_docs": len(self.docs), "n_tokens": self.total, "segments": self.segments}
        index["doc_ids"] = self._put(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        index["nulls"] = self._put(np.packbits([d is None for d in self.docs], bitorder="little").tobytes())
        index["starts"] = self._put(np.array([*self.starts, self.total], "<u8").tobytes())
        data = json.dumps(index).encode()
        self._put(data)
        self._put(struct.pack("<Q", len(data)) + MAGIC)


class Reader:
    """Random access to a file; ``source`` has read_at(n, offset) and size()."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, magic = struct.unpack("<Q8s", source.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.index = json.loads(source.read_at(n, size - 16 - n))
        self.firsts = np.array([s["first"] for s in self.index["segments"]], np.int64)

    def _array(self, where: list[int], kind: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        width = np.dtype(kind).itemsize
        hi = where[1] // width if hi is None else hi
        return np.frombuffer(self.source.read_at((hi - lo) * width, where[0] + lo * width), kind)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents and their starts, with the number of tokens at the end."""
        ids = self._array(self.index["doc_ids"], "<i8").tolist()
        nulls = np.unpackbits(self._array(self.index["nulls"], "u1"), bitorder="little", count=len(ids))
        return [None if x else i for i, x in zip(ids, nulls)], self._array(self.index["starts"], "<u8").astype(np.int64)

    def _rank(self, level: list, at: int) -> int:
        """Set bits before position ``at``."""
        if not at:
            return 0
        block = min(at // STEP, level[2][1] // 4 - 1)
        bits = np.unpackbits(self._array(level[1], "u1", block * STEP // 8, -(-at // 8)), bitorder="little")
        return int(self._array(level[2], "<u4", block, block + 1)[0]) + int(bits[: at - block * STEP].sum())

    def token(self, at: int) -> int:
        return int(self.tokens(at, at + 1)[0])

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """Ids from ``lo`` to before ``hi``; reads only their own chunks."""
        out = []
        for s in range(int(np.searchsorted(self.firsts, lo, side="right")) - 1, len(self.firsts)):
            first = int(self.firsts[s])
            if first >= hi:
                break
            out.append(self._run(self.index["segments"][s], max(lo - first, 0), min(hi - first, self.index["segments"][s]["n"])))
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def _run(self, segment: dict, lo: int, hi: int) -> np.ndarray:
        out = np.zeros(hi - lo, "<u4")
        which = np.arange(hi - lo)
        for k, level in enumerate(segment["levels"]):
            if lo >= hi:
                break
            out[which] |= self._array(level[0], "u1", lo, hi).astype("<u4") << np.uint32(CHUNK_BITS * k)
            byte = lo // 8
            bits = np.unpackbits(self._array(level[1], "u1", byte, -(-hi // 8)), bitorder="little")[lo - 8 * byte : hi - 8 * byte]
            which = which[bits > 0]
            lo = self._rank(level, lo)
            hi = lo + len(which)
        return out


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> list[dict]:
    """Writes the ids of (doc_id, text) in ascending doc_id order; returns the manifest, one entry per file in that order."""
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token_ids")
    end = np.array([end_id], "<u4").tobytes()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(folder)
        writer = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if writer is None:
                    name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.dac"
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(f"{base}/{name}")
                    writer, encode = Writer(sink), encoder(tokenizer).encode
                for i, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    writer.add(i, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.total], pa.int64())], names=["part", "uri", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    found = rows.transform(in_arrow, put, "part int, uri string, n_docs long, n_tokens long").collect()  # one row per file
    manifest, start = [], 0
    for r in sorted(found, key=lambda r: r["part"]):
        manifest.append({"uri": r["uri"], "start": start, "n_docs": r["n_docs"], "n_tokens": r["n_tokens"]})
        start += r["n_tokens"]
    return manifest


def read_documents(spark, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def got(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = place(uri)
                with fs.open_input_file(path) as source:
                    reader = Reader(source)
                    ids, starts = reader.documents()
                    for lo in range(0, len(ids), 1024):
                        hi = min(len(ids), lo + 1024)
                        crcs, d = [], lo
                        while d < hi:  # as many whole documents at once as fill a segment
                            e = max(d + 1, min(hi, int(np.searchsorted(starts, starts[d] + SEGMENT, side="right")) - 1))
                            data = reader.tokens(int(starts[d]), int(starts[e])).tobytes()
                            crcs += [zlib.crc32(data[4 * (starts[k] - starts[d]) : 4 * (starts[k + 1] - starts[d])]) for k in range(d, e)]
                            d = e
                        yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array(starts[lo:hi] + first), pa.array(np.diff(starts[lo : hi + 1])), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = pa.schema([("uri", pa.string()), ("start", pa.int64())])
    files = spark.createDataFrame(pa.Table.from_pylist([{k: m[k] for k in ("uri", "start")} for m in manifest], schema))
    return files.repartition(max(1, len(manifest))).transform(in_arrow, got, "doc_id long, start long, n_tokens long, ids_crc32 long")
