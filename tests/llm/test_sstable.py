import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import sstable as S
from tidemark.llm.common import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "", None, "Don't STOP, l'été 42 œuvre ÀÉ×÷ß naïve", "a<|endoftext|>b x", "\x1c odd \x1f blanks", "ΑΣ ΟΔΟΣ İstanbul",
    "é combined   nbsp 　 wide", "²³ ¼ ªº µ", "日本語 テキスト 🙂🙂", "it's we'll you're 'sabc ''' --- ###$$$", "word " * 5000, "x" * 30000, "___ a_b _1",
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_runs_give_the_ids_of_the_whole_text(plain):
    encoder, rng = S.WordEncoder(PATH, most=50), random.Random(5)
    letters = [chr(c) for c in range(33, 127)] + [chr(c) for c in range(0xA1, 0x180)] + list("  \n\t ") * 12 + list("aeiourst'") * 8 + ["́", "Σ", " ", "\x85"]
    for text in TEXTS + ["".join(rng.choices(letters, k=300)) for _ in range(300)]:
        want = plain.encode(text or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == want, text


def test_shard_round_trip_lookup_and_damage():
    out, rng = io.BytesIO(), random.Random(1)
    ids = sorted(rng.sample(range(-(10**12), 10**12), 3000)) + [10**13] * 3
    writer = S.ShardWriter(out, block_bytes=2000)
    rows = [(S.encode_key(i), np.array([rng.randrange(60000) for _ in range(rng.randrange(1, 60))], "<u2")) for i in ids]
    for key, value in rows:
        writer.add(key, 2, value.tobytes())
    writer.close()
    data = out.getvalue()
    reader = S.ShardReader(io.BytesIO(data), len(data))
    assert len(reader.blocks) > 20 and reader.docs == len(rows)
    assert [(k, v.tolist()) for k, v in reader] == [(k, v.tolist()) for k, v in rows]
    for key, value in rows[:50]:
        assert [v.tolist() for v in reader.get(key)] == [value.tolist()]
    assert len(reader.get(S.encode_key(10**13))) == 3
    absent = [S.encode_key(i) for i in rng.sample(range(2 * 10**12, 10**14), 2000)]
    assert not any(reader.get(k) for k in absent[:50])
    assert sum(map(reader.may_hold, absent)) < 60
    bad = bytearray(data)
    bad[reader.blocks[0].place + 5] ^= 1
    with pytest.raises(ValueError):
        list(S.ShardReader(io.BytesIO(bytes(bad)), len(bad)))


def test_operator_matches_brute_force(spark, plain):
    rows = [(i * 7 % 100, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (5, "twice"), (5, "twice"), (5, "other")]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, start int, shard string")
    got = S.tokenize_to_shards(docs, PATH).orderBy("start").collect()
    assert len(got) == len(rows)
    total, keys = 0, []
    for r in got:
        assert r.start == total
        total += r.n_tokens
        keys.append(-(10**9) if r.doc_id is None else r.doc_id)
    assert keys == sorted(keys)
    def crc(t):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), *crc(t)) for i, t in rows)
    assert S.tokenize_to_shards(docs.limit(0), PATH).count() == 0


def test_lookup_through_manifest(spark, plain):
    docs = spark.createDataFrame([(f"k{i:04d}", f"text number {i}") for i in range(200)], "doc_id string, text string")
    folder = shared_dir(spark, "lookup")
    manifest = S.write_shards(docs, PATH, folder, partitions=5)
    assert S.lookup(manifest, folder, "k0123") == [plain.encode("text number 123", add_special_tokens=False).ids + [1]]
    assert S.lookup(manifest, folder, "k9") == []
