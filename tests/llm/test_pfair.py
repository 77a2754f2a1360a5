import hashlib
import math
import random
from fractions import Fraction

import pytest

from tidemark.llm import pfair as P


def brute(rows, weights=None, block=P.BLOCK_DOCS, most=P.MOST_BLOCKS):
    """(id, source) rows -> ids in mixed order: windows from the fluid ideal in
    exact fractions, then earliest deadline first, slot by slot."""
    by = {}
    for i, s in rows:
        by.setdefault("-" if s is None else f"={s}", []).append(i)
    for s in by:
        by[s].sort(key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
    if weights is None:
        w = {s: Fraction(int((len(by[s]) ** 0.5) * 1000)) for s in by}
    else:
        exact = {"-" if k is None else f"={k}": Fraction(str(v)) for k, v in weights.items()}
        w = {s: exact.get(s, min(exact.values())) for s in by}
    block = max(block, -(-len(rows) // most))
    n = {s: -(-len(by[s]) // block) for s in by}
    ideal = lambda s, j: sum(min(Fraction(n[u]), w[u] * j / w[s]) for u in by)
    todo = [(math.ceil(ideal(s, j + 1)), s, j, math.floor(ideal(s, j))) for s in by for j in range(n[s])]
    out = []
    for t in range(len(todo)):
        due, s, j, _ = one = min(x for x in todo if x[3] <= t)
        todo.remove(one)
        assert t < due  # no deadline is missed
        out += by[s][j * block : (j + 1) * block]
    return out


@pytest.mark.parametrize(("weights", "block", "run", "most", "seed"), [
    (None, 4, 256, 10**6, 1), ({"a": 3.0, "b": 1.0, None: 2.0}, 1, 7, 10**6, 2), ({"a": 0.5, "zz": 1.0}, 5, 3, 10**6, 3), (None, 1, 16, 50, 4), ({"a": 1000, "b": 1, "c": 333.3}, 1, 8, 10**6, 5),
])
def test_matches_simulation(spark, weights, block, run, most, seed, monkeypatch):
    monkeypatch.setattr(P, "RUN", run)
    monkeypatch.setattr(P.sources_of, "__defaults__", (most,))
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "c", "", None])) for i in range(400)]
    docs = spark.createDataFrame([(i, s, None, "x") for i, s in rows], "doc_id long, source string, text string, slot string")
    got = P.schedule(docs, weights, block_docs=block).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows)))
    assert [r.doc_id for r in got] == brute(rows, weights, block, most)


def test_less_than_a_block_from_the_target(spark):
    """Weights 1000, 1 and 333.3 over thousands of slots, while all sources last."""
    weights = {"a": 1000, "b": 1, "c": 333.3}
    rows = [(i, "a" if i % 4 else "c") for i in range(12000)] + [(20000 + i, "b") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = P.schedule(docs, weights, block_docs=1).orderBy("slot").collect()
    total, run = sum(Fraction(str(v)) for v in weights.values()), dict.fromkeys(weights, 0)
    ends = min(Fraction(sum(s == k for _, s in rows)) / Fraction(str(v)) for k, v in weights.items()) * total
    assert ends > 9000
    for t, r in enumerate(got[: int(ends)], 1):
        run[r.source] += 1
        assert all(abs(run[k] - Fraction(str(v)) / total * t) < 1 for k, v in weights.items())


def test_many_sources(spark):
    """2,000 sources, some of few rows: all rows once, and as far as the ideal."""
    rows = [(i, f"s{i % 2000 if i < 3000 else i % 7}") for i in range(6000)]
    got = P.schedule(spark.createDataFrame(rows, "doc_id long, source string"), block_docs=1).orderBy("position").collect()
    assert [r.position for r in got] == list(range(6000)) and sorted(r.doc_id for r in got) == list(range(6000))
    assert len({r.source for r in got[:1500]}) > 700


def test_keeps_every_row_and_column(spark):
    rows = [(1, "a", "t")] * 30 + [(None, None, None), (2, "b", "x" * 100000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = P.mixed(docs, block_docs=3)
    assert out.columns == docs.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert P.mixed(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.mixed(docs, {"a": 0.0})


def test_main_path_is_native(spark, capsys):
    docs = spark.createDataFrame([(1, "a", "t"), (2, "b", "u")], "doc_id long, source string, text string")
    P.mixed(docs).explain()
    plan = capsys.readouterr().out
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
