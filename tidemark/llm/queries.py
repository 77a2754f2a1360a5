"""The queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, extendible, hmm_lm, langid, license_scan, ngram_join, pfair, rpforest, secrets, sstable
from .common import table

SHARD_BYTES = 32 << 20


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, read back from sorted-string-table shards."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return sstable.tokenize_to_shards(docs, public_tokenizers.path("word_bpe_49k.json"))


def op2_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.near_vectors(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE u AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS len FROM u),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.v, b.v) / (a.len * b.len) >= 0.93),
reach AS (SELECT a AS vec_id, b AS other FROM e UNION SELECT r.vec_id, e.b FROM reach r JOIN e ON e.a = r.other),
c AS (SELECT vec_id, min(other) AS least FROM reach GROUP BY 1),
l AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY 1)
SELECT m.vec_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, least(m.vec_id, coalesce(c.least, m.vec_id)) AS component_id,
       least(m.vec_id, coalesce(c.least, m.vec_id)) = m.vec_id AS kept
FROM embeddings m LEFT JOIN l USING (vec_id) LEFT JOIN c USING (vec_id)
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item; clean documents give no row."""
    return decontam.flagged_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return extendible.assign_shards(docs, SHARD_BYTES, keep=["doc_id"])


OP5_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS h
  FROM documents),
levels AS (
  SELECT g.depth, d.h >> (52 - g.depth) AS prefix, CAST(sum(d.n_bytes) AS BIGINT) AS total
  FROM d, (SELECT CAST(range AS INTEGER) AS depth FROM range(0, 53)) g GROUP BY ALL),
leaf AS (
  SELECT d.doc_id, d.h, d.n_bytes, min(l.depth) AS depth
  FROM d JOIN levels l ON l.prefix = d.h >> (52 - l.depth) AND l.total <= {SHARD_BYTES} GROUP BY ALL)
SELECT f.doc_id, CASE WHEN f.depth = 0 THEN '' ELSE right(format('{{:052b}}', f.h >> (52 - f.depth)), f.depth) END AS shard,
       f.depth, f.n_bytes, l.total AS shard_bytes
FROM leaf f JOIN levels l ON l.depth = f.depth AND l.prefix = f.h >> (52 - f.depth)
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_texts(table(spark, sf_dir, "documents"))


def op8_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.schedule(table(spark, sf_dir, "documents").select("doc_id", "source"))


# Windows in whole numbers, then earliest deadline first, slot by slot.
OP8_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS src,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS m FROM documents),
k AS (SELECT doc_id, source, src, row_number() OVER (PARTITION BY src ORDER BY m, doc_id) - 1 AS k FROM d),
z AS (SELECT greatest({pfair.BLOCK_DOCS}, CAST(ceil(count(*) / {pfair.MOST_BLOCKS}) AS BIGINT)) AS size FROM d),
s AS (SELECT src, CAST((count(*) + (SELECT size FROM z) - 1) // (SELECT size FROM z) AS HUGEINT) AS n, CAST(floor(sqrt(CAST(count(*) AS DOUBLE)) * 1000) AS HUGEINT) AS w FROM d GROUP BY src),
p AS (SELECT src, w, n, CAST(unnest(generate_series(0, n::BIGINT)) AS HUGEINT) AS j FROM s),
x AS (SELECT p.src, p.j, p.w, p.n, p.w * coalesce(sum(u.n) FILTER (WHERE u.n * p.w <= p.j * u.w), 0) + p.j * coalesce(sum(u.w) FILTER (WHERE u.n * p.w > p.j * u.w), 0) AS x FROM p, s u GROUP BY p.src, p.j, p.w, p.n),
b AS (SELECT a.src, CAST(a.j AS BIGINT) AS block, CAST(a.x // a.w AS BIGINT) AS r, CAST((e.x + e.w - 1) // e.w AS BIGINT) AS d FROM x a JOIN x e ON e.src = a.src AND e.j = a.j + 1),
st AS (
  SELECT CAST(-1 AS BIGINT) AS slot, NULL::STRUCT(d BIGINT, src VARCHAR, block BIGINT, r BIGINT) AS pick, list({{'d': d, 'src': src, 'block': block, 'r': r}}) AS todo FROM b
  UNION ALL
  SELECT slot + 1, one, list_filter(todo, lambda y: y <> one) FROM (
    SELECT slot, todo, list_sort(list_filter(todo, lambda y: y.r <= slot + 1))[1] AS one FROM st WHERE len(todo) > 0)),
t AS (SELECT slot, pick.src AS src, pick.block AS block FROM st WHERE pick IS NOT NULL)
SELECT k.doc_id, k.source, t.block, t.slot, row_number() OVER (ORDER BY t.slot, k.k) - 1 AS position
FROM k JOIN t ON t.src = k.src AND t.block = k.k // (SELECT size FROM z)
"""


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_shards": op1_token_shards,
        "op2_embedding_forest": op2_embedding_forest,
        "op3_decontamination": op3_decontamination,
        "op4_license_scan": op4_license_scan,
        "op5_extendible_shards": op5_extendible_shards,
        "op6_language_id": op6_language_id,
        "op7_hmm_lm": op7_hmm_lm,
        "op8_pfair_mix": op8_pfair_mix,
        "op9_ngram_join": op9_ngram_join,
        "op10_secret_scan": op10_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_forest": OP2_SQL, "op5_extendible_shards": OP5_SQL, "op8_pfair_mix": OP8_SQL}
