"""run() on a small table against its five stages by brute force."""

import hashlib
from collections import Counter

import corpus_pipeline
from fringeworks.llm import queries as q
from fringeworks.llm.jaccard import Join

from .test_added_tokens import plain_ids
from .test_methods import brute
from .test_small_cases import SCHEMA, crc, prose

SECRET = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def table():
    texts = [prose(k, 20 + 7 * k % 160) for k in range(40)] + [None, "", "123 !!", prose(900, 5000)]
    texts += [prose(3, 41) + " changed", prose(20, 140) + " and on", prose(7, 20 + 49), prose(901, 30) + " <|endoftext|> " + prose(902, 30)]
    texts += [prose(903 + k, 40) + f' token = "{SECRET[k:] + SECRET[:k]}" ' + prose(950 + k, 20) for k in range(3)]
    return [(i, t, "en", f"s{i * i % 7 % 4}", len(t or "")) for i, t in enumerate(texts)]


def mixed(rows):
    """(doc_id, text) as often as taken, of (doc_id, text, source)."""
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    target, left, free = {}, float(sum(size.values())), set(size)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in over} if over else share
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    out = []
    for s in size:
        more = int(target[s]) % size[s]
        for i, t in sorted(((i, t) for i, t, x in rows if x == s), key=lambda r: hashlib.md5(f"17|{r[0]}|{len(r[1].split())}".encode()).hexdigest()):
            words = t.split()
            part = min(len(words), more)
            more -= part
            out += [(i, t)] * (int(target[s]) // size[s] + (part == len(words))) + [(i, " ".join(words[:part]))] * (0 < part < len(words))
    return out


def test_run_against_brute_force(spark, tmp_path):
    docs = table()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    known = [r for r in docs if r[1] and any(c.isalpha() for c in r[1])]
    roots, _ = brute([r[1] for r in known], Join(words=5, num=80, den=100))
    one = [r for k, r in enumerate(known) if roots[k] == k]
    assert len(docs) - len(known) == 3 and len(known) - len(one) == 3
    masked = []
    for i, t, _, source, _ in one:
        for k in range(3):
            t = t.replace(SECRET[k:] + SECRET[:k], "[SECRET]")
        masked.append((i, t, source))
    assert sum("[SECRET]" in t for _, t, _ in masked) == 3
    wanted = []
    for i, t in mixed(masked):
        ids = [*plain_ids(q.tokenizer_path(), t), 1]
        wanted += [(i, k, lo, len(ids[lo : lo + 4096]), crc(ids[lo : lo + 4096])) for k, lo in enumerate(range(0, len(ids), 4096))]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(wanted)
    ends: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    total = sum(w[3] for w in wanted)
    assert max(ends.values()) <= 4096 and -(-total // 4096) <= len(ends) <= -(-total // 4096) + 1
