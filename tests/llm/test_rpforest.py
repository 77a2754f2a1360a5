import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import rpforest as R


def brute(rows, threshold=0.93):
    n = len(rows)
    x = [None if label is None or v is None or not v or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.array(v, np.float64) for _, v, label in rows]
    parent, links = list(range(n)), [0] * n

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    groups = {}
    for i, v in enumerate(x):
        if v is not None:
            groups.setdefault((rows[i][2], len(v)), []).append(i)
    for own in groups.values():
        u = np.array([x[i] / np.sqrt(x[i] @ x[i]) for i in own])
        for a, b in zip(*np.nonzero(np.triu(u @ u.T >= threshold, 1))):
            i, j = own[a], own[b]
            links[i] += 1
            links[j] += 1
            parent[root(j)] = root(i)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return sorted((str(r[0]), links[i], str(least.get(root(i)) if links[i] else r[0])) for i, r in enumerate(rows))


def planted(seed, n=700, dim=32):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.standard_normal(dim)
        if rows and i % 3 == 0:
            v = np.array(rows[rng.integers(0, len(rows))][1]) + rng.standard_normal(dim) * rng.choice([0.02, 0.2, 0.36])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.choice([0, 0, 0, 1]))))
    base = rng.standard_normal(dim)
    rows += [(1000 + i, (base + rng.standard_normal(dim) * 0.1).astype(np.float32).tolist(), 0) for i in range(250)]
    return rows


@pytest.mark.parametrize("tile", [1500, 60])
def test_matches_brute_force(spark, tile, monkeypatch):
    for name, value in (("LEAF", 60), ("LARGE", 120), ("TILE", tile)):
        monkeypatch.setattr(R, name, value)
    rows = planted(tile)
    rows += [(2000, None, 0), (2001, [0.0] * 32, 0), (2002, [float("nan")] * 32, 0), (2003, rows[0][1], None), (2004, rows[0][1], rows[0][2]), (2004, rows[0][1], rows[0][2]), (None, rows[5][1], rows[5][2]), (2005, rows[0][1][:8], 0), (2006, [None] * 32, 1), (2007, [], 1)]
    frame = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = R.near_vectors(frame).collect()
    ours, want = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got), brute(rows)
    pairs = sum(w[1] for w in want)
    # No false link, and at least 99.9 % of the links are found.
    assert len(ours) == len(want) and pairs > 10_000
    assert all(a[1] <= b[1] for a, b in zip(ours, want)) and sum(a[1] for a in ours) >= 0.999 * pairs
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert R.near_vectors(frame.limit(0)).count() == 0


def test_recall_on_the_supplied_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in R.near_vectors(frame).collect())
    assert got == brute(rows)


def test_every_label_gets_all_trees(spark, monkeypatch):
    """More labels than one round fits: those of later rounds get as many trees."""
    for name, value in (("LEAF", 20), ("LARGE", 60), ("SAMPLE", 640)):
        monkeypatch.setattr(R, name, value)
    rng = np.random.default_rng(3)
    labels = [f"{i}/0.{i}" for i in range(25)]
    rows = [(b"%d %d" % (i, k), f"{g}|16", 1, rng.standard_normal(16).astype("<f4").tobytes()) for i, g in enumerate(labels) for k in range(120)]
    leaves = R.leaves_of(spark.createDataFrame(rows, R.LEAVES), "<f4").select("key", "grp").collect()
    trees = {}
    for r in leaves:
        label, tree = r.grp.split("|16/")
        trees.setdefault((bytes(r.key), label), set()).add(tree.split(".")[0])
    assert len(trees) == len(rows) and len(labels) > R.SAMPLE // 64
    assert {len(t) for t in trees.values()} == {R.TREES}


def test_no_link_is_lost_in_a_mass_of_near_copies(spark):
    """Thousands of near copies around the threshold, inside a larger table."""
    rng, n, dim = np.random.default_rng(1), 3000, 64
    x = rng.standard_normal((20_000 + n, dim))
    x[:n] = x[n] / np.sqrt(x[n] @ x[n]) + rng.standard_normal((n, dim)) * np.sqrt((1 / 0.945 - 1) / dim)
    frame = spark.createDataFrame([(b"%d" % i, "g|64", 1, v.tobytes()) for i, v in enumerate(x)], R.LEAVES)
    leaves = {}
    for r in R.leaves_of(frame, "<f8").select(F.col("key").cast("string").cast("int").alias("i"), "grp").where(f"i < {n}").collect():
        leaves.setdefault(r.grp, []).append(r.i)
    u, together = R.unit_rows(x[:n]), np.zeros((n, n), dtype=bool)
    for own in leaves.values():
        together[np.ix_(own, own)] = True
    links = u @ u.T >= R.THRESHOLD
    assert links.sum() > 4_000_000 and not (links & ~together).any()
