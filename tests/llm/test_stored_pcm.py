"""The PCM column of op10's result."""

import hashlib
import zlib

import numpy as np

from fringeworks.llm import queries as q
from fringeworks.llm.telephony import mulaw_table, parse, payload, resample

from .test_small_cases import SCHEMA, prose


def test_op10_stores_resampled_pcm(spark, tmp_path):
    texts = [None, "", "é😀", prose(1, 50), prose(2, 3000)]
    spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    q.op10_telephony(spark, str(tmp_path)).write.parquet(f"{tmp_path}/result.parquet")
    rows = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/result.parquet").collect()}
    assert set(rows) == set(range(len(texts)))
    for i, t in enumerate(texts):
        wanted = resample(mulaw_table()[np.frombuffer(payload(t), np.uint8)], 8000, 16000).astype("<i2").tobytes()
        assert parse(bytes(rows[i].pcm)) == (1, 16000, 2, wanted)
        assert rows[i].feature.endswith(f"pcm16000 {zlib.crc32(wanted):08x}")
        assert rows[i].payload_sha256 == hashlib.sha256(payload(t)).hexdigest()
