import random

import numpy as np
import pytest

from tidemark.llm import ngram_join as N
from tidemark.llm.common import word_bytes
from tidemark.llm.components import connected_components


def sets_of(text):
    words = word_bytes(text)
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(rows, threshold=0.8):
    sets = [sets_of(t) for _, t in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both >= threshold * len(sets[i] | sets[j]) - 1e-9:
                    links[i] += 1
                    links[j] += 1
                    parent[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, least.get(root(i)) if links[i] else d, links[i]) for i, (d, _) in enumerate(rows)]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(50):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 8, 60, 200]))
        rows.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy)
    out = [(i, " ".join(r) if i % 3 else ", ".join(r).upper()) for i, r in enumerate(rows)]
    return out + [(9000, None), (9001, ""), (9002, "..."), (9003, "..."), (9004, "é è"), (9005, "É é"), (9006, "É é")]


@pytest.mark.parametrize("tile", [1000, 5])
def test_matches_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(N, "TILE", tile)
    rows = corpus(tile)
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, copies int")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in N.near_duplicates(docs).collect())
    want = sorted(brute(rows))
    assert got == want and sum(n for *_, n in want) > 100
    kept = N.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in want})


def test_large_group_of_near_copies(spark):
    rng = random.Random(8)
    base = [f"v{rng.randrange(500)}" for _ in range(150)]
    rows = [(i, " ".join([*base[: 20 + i % 100], f"x{i}", *base[20 + i % 100 :]])) for i in range(300)]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted(brute(rows))


def test_repeated_ids_nulls_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "q r s"), (None, None), (None, "lonely words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, N.near_duplicates(docs).collect()))
    assert len(got) == 6 and sum("n_links=2" in r and "class_id=1" in r for r in got) == 3
    assert N.keep_one_of_each(docs).count() == 4
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_posterior_bound_is_rarely_wrong():
    rng = np.random.default_rng(3)
    least = N.least_agreements(0.8)
    alive = np.ones(20000, bool)
    agreed = np.zeros(20000, int)
    for k, m in least.items():
        agreed += rng.binomial(N.STEP, 0.8, 20000)
        alive &= agreed >= m
    assert alive.mean() > 0.9995
    agreed = np.cumsum(rng.binomial(N.STEP, 0.3, (20000, N.HASHES // N.STEP)), axis=1)
    assert (agreed >= np.array(list(least.values()))).all(axis=1).mean() < 1e-3


def test_signatures_estimate_similarity():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    a = rng.choices(words, k=2000)
    b = a[:1700] + rng.choices(words, k=300)
    x, y = N.shingle_hashes(" ".join(a)), N.shingle_hashes(" ".join(b))
    exact = len(sets_of(" ".join(a)) & sets_of(" ".join(b))) / len(sets_of(" ".join(a)) | sets_of(" ".join(b)))
    assert len(np.intersect1d(x, y)) / len(np.union1d(x, y)) == pytest.approx(exact)
    assert np.mean(N.signature(x) == N.signature(y)) == pytest.approx(exact, abs=0.15)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
