"""N-gram Jaccard self-join with Bayesian candidate pruning.

Two texts link when the sets of their five-word shingles have a Jaccard
similarity of at least the threshold. Texts with the same word sequence are
one class from the start. Classes get MinHash signatures; those that agree
on all rows of some band meet in its bucket. There a pair's values are
compared a few at a time: given m agreements in k values and a uniform
prior, the similarity follows Beta(m+1, k-m+1), and a pair is dropped once
the posterior probability of reaching the threshold is below the tolerance.
What is left is verified exactly from the texts.

Nothing is as long as the number of pairs. A pair counts in the first band
on which its classes agree, so it is seen once; a bucket over ``TILE``
classes is cut into tiles, and each pair of tiles is a group of its own;
groups return, per class, its number of links and its root in the group's
own forest. Components then join the forests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import lru_cache
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _WORD_BYTES, mix64, stored
from .components import connected_components
from .groups import Forest, arrow_schema, clustered, record_batch, runs

SHINGLE, THRESHOLD = 5, 0.8
#: MinHash values; the first BANDS x ROWS make the bands. A pair at the
#: threshold misses every band with probability (1 - 0.8^4)^25, 2e-6.
HASHES, BANDS, ROWS = 128, 25, 4
#: Values compared before each look at the posterior, and its tolerance.
STEP, TOLERANCE = 16, 1e-6
#: Classes of a bucket compared in one group.
TILE = 1000
#: Bytes from which a word is hashed by itself.
LONG_WORD = 4096
_SEED = 20240229


@lru_cache(1)
def _constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None], (rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


@lru_cache(1)
def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate(([1], np.full(LONG_WORD - 1, 0x9E3779B97F4A7C15, dtype=np.uint64))).astype(np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of the blank-separated word bytes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = data != 32
    edges = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    out = np.empty(len(starts), dtype=np.uint64)
    short = lengths < LONG_WORD
    for i in np.flatnonzero(~short).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
        inside[starts[i] : ends[i]] = False
    lengths = lengths[short]
    if len(lengths):
        firsts = np.cumsum(lengths) - lengths
        offset = np.arange(lengths.sum()) - np.repeat(firsts, lengths)
        with np.errstate(over="ignore"):
            terms = data[inside].astype(np.uint64) * _powers()[offset]
            out[short] = mix64(np.add.reduceat(terms, firsts) + lengths.astype(np.uint64))
    return out


def shingle_hashes(text: str | None) -> np.ndarray:
    """Distinct hashes of all five-word runs; of the whole text if it is shorter."""
    if not text:
        return np.zeros(0, dtype=np.uint64)
    words = word_hashes(text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES))
    n = min(SHINGLE, len(words))
    if not n:
        return words
    with np.errstate(over="ignore"):
        total = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - n + 1 + k]
    return np.unique(mix64(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values: the least of each of the hash functions over the set."""
    x, (b, a) = shingles.astype(np.uint32), _constants()
    best = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(best, ((x[at : at + 4096] ^ b) * a).min(axis=1), out=best)
    return best


def class_key(text: str | None) -> bytes:
    """Equal for texts with the same words in the same order."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def least_agreements(threshold: float, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each number k of values compared, the fewest agreements m that
    keep P(similarity >= threshold | m of k), which is P(Bin(k+1, t) <= m),
    at the tolerance or above."""
    out = {}
    for k in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, 0
        while True:
            below += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if below >= tolerance:
                break
            m += 1
        out[k] = m
    return out


def surviving_pairs(signatures: np.ndarray, left: np.ndarray, right: np.ndarray, band: int, least: dict[int, int]) -> np.ndarray:
    """Which of the pairs (left[i], right[i]) have this band as their first
    common one and outlive the incremental comparison; a mask."""
    alive = np.arange(len(left))
    for b in range(band):
        at = slice(b * ROWS, (b + 1) * ROWS)
        alive = alive[(signatures[left[alive], at] != signatures[right[alive], at]).any(axis=1)]
        if not len(alive):
            break
    agreed = np.zeros(len(alive), dtype=np.int32)
    for k, most in least.items():
        at = slice(k - STEP, k)
        agreed += (signatures[left[alive], at] == signatures[right[alive], at]).sum(axis=1, dtype=np.int32)
        keep = agreed >= most
        alive, agreed = alive[keep], agreed[keep]
    mask = np.zeros(len(left), dtype=bool)
    mask[alive] = True
    return mask


def _pair_rows(n: int, first: np.ndarray, same_tile: bool) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group in pieces: all i < j, or those across its two tiles."""
    if same_tile:
        ranges = ((i, np.arange(i + 1, n)) for i in range(n - 1))
    else:
        others = np.flatnonzero(~first)
        ranges = ((i, others) for i in np.flatnonzero(first).tolist())
    left, right, size = [], [], 0
    for i, js in ranges:
        left.append(np.full(len(js), i))
        right.append(js)
        size += len(js)
        if size > 100_000:
            yield np.concatenate(left), np.concatenate(right)
            left, right, size = [], [], 0
    if size:
        yield np.concatenate(left), np.concatenate(right)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n) of all rows, and a row of each class with words:
    key, copies, rep (least id), signature."""
    slim = docs.select("doc_id", "text")
    schema = T.StructType([slim.schema["doc_id"], T.StructField("key", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("sig", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, counts, sigs = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                s = shingle_hashes(text)
                keys.append(class_key(text))
                counts.append(len(s))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), pa.array(sigs, pa.binary())], names=schema.fieldNames())

    signed = stored(slim.mapInArrow(run, schema), "signatures")
    classes = signed.where("n > 0").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    return signed.select("doc_id", "key", "n"), stored(classes, "classes")


def _buckets(classes: DataFrame) -> DataFrame:
    """(band, bucket, ta, tb, tile, key) of each class in each group it is in."""
    size = 4 * ROWS
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(F.substring("sig", b * size + 1, size), F.lit(b)).alias("bucket")) for b in range(BANDS)])
    rows = classes.select("key", F.explode(bands).alias("x")).select("key", "x.band", "x.bucket")
    counts = rows.groupBy("band", "bucket").count().where("count > 1").withColumn("tiles", F.ceil(F.col("count") / TILE).cast("int")).drop("count")
    met = rows.join(counts, ["band", "bucket"]).withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    dealt = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return dealt.select("band", "bucket", F.least("tile", "o").alias("ta"), F.greatest("tile", "o").alias("tb"), "tile", "key")


GROUP = ["band", "bucket", "ta", "tb"]


def _group_pairs(group, band: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a group, by row, that outlive the pruning."""
    n = group.num_rows
    sigs = np.frombuffer(b"".join(group.column("sig").to_pylist()), dtype=np.uint32).reshape(n, HASHES)
    first = group.column("tile").to_numpy() == group.column("ta")[0].as_py()
    kept_l, kept_r = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for left, right in _pair_rows(n, first, group.column("ta")[0] == group.column("tb")[0]):
        mask = surviving_pairs(sigs, left, right, band, least)
        kept_l.append(left[mask])
        kept_r.append(right[mask])
    return np.concatenate(kept_l), np.concatenate(kept_r)


def _candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """Per group, its classes with a pair there that outlives the pruning.

    The pairs themselves are not kept: the few groups that have some find
    them again when they verify them, so nothing stored grows with pairs.
    """
    least = least_agreements(threshold)
    rows = clustered(_buckets(classes).join(classes.select("key", "sig"), "key"), GROUP)
    schema = "band int, bucket long, ta int, tb int, tile int, key binary"
    target = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for group in runs(batches, GROUP):
            if group.num_rows < 2:
                continue
            used = np.union1d(*_group_pairs(group, group.column("band")[0].as_py(), least))
            if len(used):
                yield from group.select(target.names).take(pa.array(used)).cast(target).to_batches()

    return rows.mapInArrow(run, schema)


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the sets' intersections, pair by pair or as a matrix product."""
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left.tolist(), right.tolist())], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle of one set is in no intersection.
    keep = times[column] > 1
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 8192
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (at, at + width))
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        total += part @ part.T
    return total[left, right].astype(np.int64)


def _verified(candidates: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Per group and class: links found there (rows of the partners' classes
    count) and the class's root in the group's forest of links."""
    least = least_agreements(threshold)
    # One text of each class, by its key: ids may be null, or one id may be on very
    # many rows. Copies fall to one in each task before any text moves.
    near = stored(candidates.select(F.col("key").alias("_key")).distinct(), "near")
    # The join is by shuffle at any size: a plan that is measured small holds large.
    texts = _with_key(docs.select("text")).join(near.hint("merge"), "_key").groupBy(F.col("_key").alias("key")).agg(F.first("text").alias("text"))
    rows = candidates.join(texts, "key").join(classes.select("key", "copies", "sig"), "key")
    rows = clustered(rows, GROUP)
    schema = "key binary, links long, root binary"
    target = arrow_schema(schema)

    def run(batches):
        waiting = []
        for group in runs(batches, GROUP):
            keys = group.column("key").to_pylist()
            left, right = _group_pairs(group, group.column("band")[0].as_py(), least)
            sets = [shingle_hashes(text.as_py()) for text in group.column("text")]
            sizes = np.array([len(s) for s in sets])
            shared = common_counts(sets, left, right)
            linked = shared >= threshold * (sizes[left] + sizes[right] - shared) - 1e-9
            left, right = left[linked], right[linked]
            copies = group.column("copies").to_numpy()
            links = np.bincount(left, copies[right], len(keys)) + np.bincount(right, copies[left], len(keys))
            forest = Forest(len(keys))
            for i, j in zip(left.tolist(), right.tolist()):
                forest.link(i, j)
            for i in np.flatnonzero(links).tolist():
                waiting.append((keys[i], int(links[i]), keys[forest.root(i)]))
            if len(waiting) > 20_000:
                yield record_batch(waiting, target)
                waiting = []
        if waiting:
            yield record_batch(waiting, target)

    return rows.mapInArrow(run, schema)


def _special_classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n) of all rows; and of each class with copies or links:
    key, copies, rep, n_links, class_id, and whether it holds the row to keep."""
    rows, classes = _classes(docs)
    candidates = stored(_candidates(classes, threshold), "candidates")
    verified = stored(_verified(candidates, classes, docs, threshold), "verified")
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    joined = connected_components(verified.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = links.join(joined.withColumnRenamed("node", "key"), "key", "left").select("key", "links", F.coalesce("component", "key").alias("component"))
    named = stored(named, "components")
    first = F.min(F.struct(F.col("rep").isNull(), F.col("rep").alias("rep"), F.col("key").alias("key")))
    least = named.join(classes.select("key", "rep"), "key").groupBy("component").agg(first.alias("first"))
    linked = named.join(least, "component").select("key", "links", F.col("first.rep").alias("class_id"), (F.col("first.key") == F.col("key")).alias("keeper"))
    # A class of one row without links needs no look-up.
    special = classes.select("key", "copies", "rep").join(linked, "key", "left").where("copies > 1 OR links IS NOT NULL")
    alone = F.col("links").isNull()
    return rows, special.select("key", "copies", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(alone, F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), (alone | F.col("keeper")).alias("keeper"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, copies.

    ``class_id`` is the least doc_id reachable by links, ``n_links`` the
    number of other rows at or above the threshold, ``copies`` the number of
    rows with the same words. ``docs`` needs doc_id and text; other columns
    are ignored. A text without words (null and empty ones too) links with
    nothing and is its own class. Repeated rows are copies of each other.
    A class whose rows all have a null id has a null class_id.
    """
    rows, special = _special_classes(docs, threshold)
    wordy = rows.withColumn("key", F.when(F.col("n") > 0, F.col("key"))).drop("n")
    out = wordy.join(special, "key", "left")
    return out.select("doc_id", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def _with_key(docs: DataFrame) -> DataFrame:
    """``docs`` with the class key of the text as ``_key``; null without words."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_key", T.BinaryType())])
    place, blank = docs.columns.index("text"), class_key(None)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = [class_key(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if k == blank else k for k in keys], pa.binary())], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without those that have a kept near-duplicate.

    Of each class the row with the least id stays; rows without words all
    stay. Of repeated rows with that id and those words one stays.
    """
    rows, special = _special_classes(docs, threshold)
    special = stored(special.select(F.col("key").alias("_key"), "rep", "keeper").withColumnsRenamed({"rep": "_rep", "keeper": "_keeper"}), "special")
    # By shuffle at any size, so that what is measured small holds large.
    joined = _with_key(docs).join(special.hint("merge"), "_key", "left")
    kept = joined.where(F.col("_keeper").isNull() | (F.col("_keeper") & F.col("doc_id").eqNullSafe(F.col("_rep"))))
    same = rows.select("doc_id", F.col("key").alias("_key")).join(special.where("_keeper"), "_key").where(F.col("doc_id").eqNullSafe(F.col("_rep")))
    twice = stored(same.groupBy("_key").count().where("count > 1").select("_key"), "twice")
    if not twice.isEmpty():
        again = kept.join(twice, "_key", "left_semi").dropDuplicates(["_key"])
        kept = kept.join(twice, "_key", "left_anti").unionByName(again)
    return kept.select(*docs.columns)
