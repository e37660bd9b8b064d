"""Telephony audio columns: G.711 and IMA ADPCM in WAV containers, to resampled PCM.

mu-law and A-law bytes are expanded by 256-entry tables; ADPCM blocks, which start
afresh with a header each, are decoded together, one numpy step for the k-th
sample of all blocks. PCM is resampled by a windowed-sinc filter with integer
taps, so equal bytes give equal samples on every machine.

Defined results: a null container stays null; a container that is cut short or of
another kind gives null PCM; a container without samples gives empty PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import in_arrow

RATE, RESAMPLED = 8000, 16000
BLOCK = 64
PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 0x11

# Fixed values of the IMA ADPCM format.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
STEP_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


@cache
def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


@cache
def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    step, high = code & 15, code >> 4 & 7
    size = np.where(high > 0, (step << 4) + 264 << np.maximum(high - 1, 0), (step << 4) + 8)
    return np.where(code & 128, size, -size).astype(np.int16)


def adpcm_decode(data: np.ndarray, align: int) -> np.ndarray:
    """Samples of whole blocks of ``align`` bytes (mono), a row for each block."""
    blocks = data.reshape(-1, align)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out = np.empty((2 * (align - 4) + 1, len(blocks)), np.int16)
    out[0] = value
    for k in range(2 * (align - 4)):
        code = blocks[:, 4 + k // 2] >> 4 * (k % 2) & 15
        step = STEPS[index]
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + STEP_CHANGES[code & 7], 0, len(STEPS) - 1)
        out[k + 1] = value
    return out.T


@cache
def taps(up: int, down: int, lobes: int = 4) -> np.ndarray:
    """Q15 taps, a row for each of the ``up`` phases."""
    width = lobes * max(1, -(-down // up))
    at = np.arange(-width + 1, width + 1)[None, :] - np.arange(up)[:, None] / up
    cut = min(1.0, up / down)
    h = cut * np.sinc(cut * at) * np.cos(np.pi * at / (2 * width)) ** 2
    return np.rint(32768 * h / h.sum(1, keepdims=True)).astype(np.int64)


def resample(samples: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples at another rate; integer arithmetic only."""
    if rate == to or not len(samples):
        return samples.astype(np.int16)
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    h = taps(up, down)
    half = h.shape[1] // 2
    x = np.pad(samples.astype(np.float64), (half - 1, half + 1))  # products and sums of integers under 2**53 are exact
    n = -(-len(samples) * up // down)
    out = np.empty(n, np.int16)
    for p in range(up):
        mine = np.arange(n)[np.arange(n) * down % up == p] if down > 1 else slice(p, n, up)
        filtered = np.correlate(x, h[p].astype(np.float64))
        where = np.arange(n)[mine] * down // up
        out[mine] = np.clip(np.floor((filtered[where] + 16384) / 32768), -32768, 32767)
    return out


def wav(data: bytes, tag: int, rate: int = RATE, bits: int = 8, align: int = 1) -> bytes:
    """A mono RIFF container around ``data``."""
    extra = struct.pack("<HH", 2, 2 * (align - 4) + 1) if tag == ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    per_s = rate * align if tag != ADPCM else rate * align // (2 * (align - 4) + 1)
    head = struct.pack("<HHIIHH", tag, 1, rate, per_s, align, bits) + extra
    chunks = b"fmt " + struct.pack("<I", len(head)) + head
    if tag != PCM:
        chunks += b"fact" + struct.pack("<II", 4, len(data) // align * (2 * (align - 4) + 1 if tag == ADPCM else 1))
    chunks += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def parse(media: bytes) -> tuple[int, int, int, bytes] | None:
    """(format tag, rate, block align, data) of a mono container; None if it is not one."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, found = 12, None
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if at + 8 + size > len(media):
            return None
        if name == b"fmt " and size >= 16:
            found = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            return (found[0], found[2], found[4], media[at + 8 : at + 8 + size]) if found and found[1] == 1 else None
        at += 8 + size + size % 2
    return None


def expand(tag: int, align: int, data: bytes) -> np.ndarray | None:
    codes = np.frombuffer(data, np.uint8)
    if tag == MULAW:
        return mulaw_table()[codes]
    if tag == ALAW:
        return alaw_table()[codes]
    if tag == ADPCM and align > 4:
        return adpcm_decode(codes[: len(codes) // align * align], align).reshape(-1)
    if tag == PCM and align == 2:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2")
    return None


def decode(media: bytes | None, rate: int = RESAMPLED) -> bytes | None:
    """A PCM container at ``rate``."""
    if media is None or (found := parse(media)) is None:
        return None
    samples = expand(found[0], found[2], found[3])
    return None if samples is None else wav(resample(samples, found[1], rate).astype("<i2").tobytes(), PCM, rate, 16, 2)


def decode_column(df: DataFrame, media: str = "media", out: str = "pcm", rate: int = RESAMPLED) -> DataFrame:
    """Adds ``out``: the column ``media`` as resampled 16-bit PCM containers."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                pcm = [decode(m, rate) for m in part.column(part.schema.get_field_index(media)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pcm, pa.binary())], names=[*part.schema.names, out])

    return df.drop(out).transform(in_arrow, decoded, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop(out).schema) + f", `{out}` binary")


def payload(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b"\0" * ((BLOCK - len(data) % BLOCK) % BLOCK or (0 if data else BLOCK))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes as mu-law samples of a WAV container."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                sizes = [len((t or "").encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array([wav(payload(t), MULAW) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(in_arrow, stored, "doc_id long, n_bytes long, media binary")


def described(stored: DataFrame) -> DataFrame:
    """Reads the samples of (doc_id, n_bytes, media, pcm) back and describes bytes and sound.

    ``feature``: peak and root mean square of the mu-law, A-law and ADPCM readings
    of the payload, zero crossings of the first, and the crc32 of the samples in ``pcm``,
    which stays as the last column.
    """

    def level(x: np.ndarray) -> str:
        x = x.astype(np.int64)
        return f"{int(np.abs(x).max(initial=0))}/{int(np.sqrt((x * x).sum() // max(1, len(x))))}"

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                media = part.column(2).to_pylist()
                tags, _, _, data = zip(*map(parse, media))
                sounds = map(parse, part.column(3).to_pylist())
                blocks = [len(d) // BLOCK for d in data]
                edges = np.cumsum([0, *blocks])
                adpcm = []
                for lo in range(0, len(data), 16):  # whole texts; a bounded number of blocks unless one text has more
                    some = np.frombuffer(b"".join(data[lo : lo + 16]), np.uint8)
                    samples = adpcm_decode(some, BLOCK)
                    adpcm += [level(samples[edges[k] - edges[lo] : edges[k + 1] - edges[lo]].reshape(-1)) for k in range(lo, min(len(data), lo + 16))]
                rows = []
                for m, tag, d, a, (_, r, _, pcm) in zip(media, tags, data, adpcm, sounds):
                    sound = expand(tag, 1, d)
                    crossings = int(np.count_nonzero(np.diff(np.signbit(sound))))
                    feature = f"mulaw {level(sound)} zc {crossings}; alaw {level(expand(ALAW, 1, d))}; adpcm {a}; pcm{r} {zlib.crc32(pcm):08x}"
                    rows.append((len(d), hashlib.sha256(d).hexdigest(), zlib.crc32(d[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), part.column(3)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm"])

    return stored.select("doc_id", "n_bytes", "media", "pcm").transform(in_arrow, told, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary")
