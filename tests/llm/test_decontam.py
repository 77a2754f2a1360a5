import random
from collections import Counter

import numpy as np

from tidemark.llm import decontam as D
from tidemark.llm.common import word_bytes


def index(items):
    tokens = [word_bytes(t) for _, t in items]
    df = Counter(t for words in tokens for t in set(words))
    n = len(items)
    return D.BlockMaxIndex(items, df, n, sum(map(len, tokens)) / max(1, n))


def brute_search(ix, items, words):
    scores = Counter()
    for t in set(words):
        for i, w in zip(*ix.postings.get(t, ((), ()))):
            scores[i] += w
    return sorted(i for i, s in scores.items() if s >= 1 - 1e-9)


def random_items(rng, n=60, vocabulary=120):
    words = [f"w{i}" for i in range(vocabulary)]
    weights = 1 / np.arange(1, vocabulary + 1)
    return [(i, " ".join(rng.choices(words, weights, k=rng.randrange(3, 90)))) for i in range(n)], words, weights


def test_wand_finds_what_full_scoring_finds():
    rng = random.Random(1)
    items, words, weights = random_items(rng)
    ix = index(items)
    hits = 0
    for _ in range(400):
        query = [w.encode() for w in rng.choices(words, weights, k=rng.randrange(1, 120))]
        want = brute_search(ix, items, query)
        assert sorted(ix.search(query)) == want
        hits += len(want)
    assert hits > 100


def test_first_filter_loses_no_passage():
    rng = random.Random(2)
    items, words, weights = random_items(rng)
    ix = index(items)
    ix.always = set()
    for _ in range(60):
        text = [w.encode() for w in rng.choices(words, weights, k=rng.randrange(1, 600))]
        kept = set(ix.candidate_passages(text))
        for p in range(-(-len(text) // D.STRIDE)):
            found = [i for i in brute_search(ix, items, text[p * D.STRIDE : p * D.STRIDE + D.PASSAGE])]
            rare = [i for i in found if not all(t in ix.common for t in word_bytes(items[i][1]))]
            assert not rare or p in kept or all(sum(w for t in ix.common for j, w in zip(*ix.postings.get(t, ((), ()))) if j == i) >= 1 for i in rare)


def brute_leaks(docs, items):
    out = set()
    for d, text in docs:
        words = word_bytes(text)
        for i, t in items:
            question, answer = map(word_bytes, D.question_and_answer(t or ""))
            runs = D.shingles(question) or D.shingles(answer)
            if not runs or not words:
                continue
            n = len(next(iter(runs)))
            have = D.shingles(words, n) if len(words) >= n else set()
            a = sum(w in set(words) for w in set(answer)) / len(set(answer)) if answer else 1
            if sum(r in have for r in runs) / len(runs) >= 0.8 and a >= 0.5:
                out.add((d, i))
    return out


def test_operator_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    rng = random.Random(4)
    planted = []
    for k in range(40):  # items inside other texts, some with a word changed
        words = items[k][1].split()
        if k % 2:
            words[rng.randrange(len(words))] = "zzz"
        planted.append((10_000 + k, " ".join(rng.choices("lorem ipsum dolor sit amet".split(), k=rng.randrange(300))) + " " + " ".join(words) + " the end"))
    planted += [(None, None), (None, items[0][1]), (20_000, ""), (20_001, "the " * 30000 + items[1][1])]
    every = spark.createDataFrame([(i, t, 1) for i, t in rows + planted], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(every, bench).collect()}
    want = brute_leaks(rows + planted, items)
    assert got == want and len(want) >= 30
    clean = D.drop_leaks(every, bench)
    assert clean.columns == every.columns
    assert clean.count() == len(rows) + len(planted) - len({d for d, _ in want})
    assert D.find_leaks(every, bench.limit(0)).count() == 0 and D.find_leaks(every.limit(0), bench).count() == 0


def test_parts_give_the_same_leaks(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(100)
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()}
    monkeypatch.setattr(D, "PART_ITEMS", 9)
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect()} == whole
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in D.drop_leaks(docs, bench).collect()} == {d for d, _ in whole}


def test_number_of_leaks_of_the_supplied_tables_is_exact(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "benchmark"))
    assert D.find_leaks(docs, bench).count() == 245
