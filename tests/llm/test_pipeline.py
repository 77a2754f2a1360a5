import corpus_pipeline
from tests.llm.test_decontam import brute_leaks
from tests.llm.test_extendible import brute as brute_shards
from tests.llm.test_ngram_join import brute as brute_classes
from tests.llm.test_pfair import brute as brute_mix
from tidemark.llm import langid, pfair

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in docs.collect()}
    # Language: rejected are letterless texts and those far from all profiles.
    model = langid.train(docs.where(~langid.held_out_split(docs.doc_id)))
    kept = [i for i, r in rows.items() if (p := model.predict(r.text))[0] != "und" and p[2] <= langid.REJECT_DISTANCE]
    kept = sorted({c for _, c, _ in brute_classes([(i, rows[i].text) for i in sorted(kept)])})
    leaks = {d for d, _ in brute_leaks([(i, rows[i].text) for i in kept], bench)}
    kept = [i for i in kept if i not in leaks]
    assert leaks and len(kept) < len(rows)
    items, leaf = brute_shards([(i, rows[i].text) for i in kept], corpus_pipeline.SHARD_BYTES)
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:5] == docs.columns
    assert sorted((r.doc_id, r.n_bytes, r.depth, r.shard_bytes) for r in got.collect()) == sorted((i, b, leaf[h][0], leaf[h][2]) for i, (h, b) in zip(kept, items))
    # The mixing order reaches the result, and the shards.
    assert [r.doc_id for r in sorted(got.collect(), key=lambda r: r.position)] == brute_mix([(i, rows[i].source) for i in kept])
    mixed = pfair.mixed(docs)
    assert [r.doc_id for r in mixed.collect()] == brute_mix([(i, r.source) for i, r in rows.items()])


def test_stages_and_registration():
    import __spark_entry__

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert "pipeline" in __spark_entry__.queries()
    assert {n.split("_")[0] for n in __spark_entry__.queries()} >= {f"op{i}" for i in range(1, 11)}
