import hashlib
import random

import pytest

from tidemark.llm import extendible as X


def brute(rows, limit):
    """Leaf depth and total of each hash, splitting one bit at a time."""
    items = [(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:13], 16), len((t or "").encode())) for i, t in rows]
    out = {}

    def split(depth, prefix, part):
        total = sum(b for _, b in part)
        if total <= limit or depth == X.HASH_BITS:
            for h, _ in part:
                out[h] = (depth, prefix, total)
            return
        for bit in (0, 1):
            split(depth + 1, prefix * 2 + bit, [x for x in part if (x[0] >> (X.HASH_BITS - depth - 1)) & 1 == bit])

    split(0, 0, items)
    return items, out


@pytest.mark.parametrize(("limit", "chain"), [(40, 8), (40, 0), (2000, 8), (10**9, 8)])
def test_matches_splitting_bit_by_bit(spark, limit, chain, monkeypatch):
    monkeypatch.setattr(X, "CHAIN_DEPTHS", chain)
    monkeypatch.setattr(X, "ROUND_BITS", 3)
    rng = random.Random(limit)
    rows = [(i, "é" * rng.randrange(0, 18)) for i in range(300)] + [(None, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, shard string")
    got = X.assign_shards(docs, limit).collect()
    items, leaf = brute(rows, limit)
    want = sorted((str(i), b, *(lambda d, p, t: (d, format(p, f"0{d}b") if d else "", t))(*leaf[h])) for (i, _), (h, b) in zip(rows, items))
    assert sorted((str(r.doc_id), r.n_bytes, r.depth, r.shard, r.shard_bytes) for r in got) == want
    assert all(r.shard_bytes <= limit for r in got)


def test_repeated_ids_and_long_rows_overflow(spark):
    rows = [(7, "x" * 10)] * 60 + [(7, "y" * 500)] + [(i, "z" * 10) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = X.assign_shards(docs, 100).collect()
    assert len(got) == len(rows)
    totals = {}
    for r in got:
        totals.setdefault(r.shard, []).append(r.n_bytes)
    assert all(sum(v) <= 100 or len(v) == 1 for v in totals.values())
    assert all(sum(totals[r.shard]) == r.shard_bytes for r in got)
    assert len(totals) < 30
    assert X.assign_shards(docs.limit(0), 100).count() == 0
