import zlib
from collections import Counter

import pytest

from tidemark.llm import langid as L


def brute_profile(text, size):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    counts = Counter()
    for word in low.split():
        padded = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram.strip() and " " not in gram[1:-1]:
                    counts[gram] += 1
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    # Word bounds are shared blanks; every padded bigram and trigram is seen once a word.
    return [g for g, _ in sorted(((code(g), n) for g, n in counts.items()), key=lambda x: (-x[1], x[0]))][:size]


@pytest.mark.parametrize("text", ["The cat, the dog!", "a", "A b c", "Über-ñandú 42 été\nété", "日本 語", "x" * 5000, "... a ..."])
def test_profile_matches_brute_force(text):
    assert L.document_profile(text, 50).tolist() == brute_profile(text, 50)


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "", "en", 2), (2, "123 $$", "en", 3), (3, "the thing", None, 4), (3, "the thing", None, 4), (4, "la cosa " * 20000, "es", 5)], "doc_id long, text string, lang string, score int")
    got = L.identify(odd).collect()
    assert len(got) == 6 and sum(r.lang_pred == "und" for r in got) == 3
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert L.identify(docs.limit(0)).count() == 0
    assert L.keep_identified(odd).columns == odd.columns


def test_prediction_reads_the_text_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(100)
    model = L.train(docs)
    a = {r.doc_id: r.lang_pred for r in L.predict(docs, model).collect()}
    from pyspark.sql import functions as F
    b = {r.doc_id: r.lang_pred for r in L.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), model).collect()}
    assert a == b


def test_counts_are_the_same_in_small_pieces(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "the cat sat"), ("b", "el gato"), ("a", "on the mat"), ("a", None), ("b", "12")] * 20, "lang string, text string").coalesce(1)
    whole = sorted(map(tuple, L.count_grams(rows).collect()))
    monkeypatch.setattr(L, "COUNT_CODES", 7)
    assert sorted(map(tuple, L.count_grams(rows).collect())) == whole


def test_letterless_texts_are_rejected_without_profiles(spark):
    rows = [(1, "the cat"), (2, None), (3, ""), (4, "123 $$ ..."), (5, "日本"), (6, "7 \n é")]
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, lang string")
    out = L.keep_identified(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 5, 6]
