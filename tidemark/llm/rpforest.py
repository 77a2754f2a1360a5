"""Embedding near-duplicates by a forest of random-projection trees.

A tree splits vectors at the median of their projections on a random
direction, again and again, until a leaf is small. Vectors near a split go
to both sides (spill), so a close pair seldom parts, and several trees make
a loss ever rarer. Pairs are compared only within leaves, exactly and in
double precision, and linked pairs are united.

Trees are fitted on a bounded sample and then route every vector. A leaf
that is still too large gets a tree of its own from a sample of that leaf,
round by round; one that no split divides (a mass of near copies) is cut
into tiles and compared tile by tile. Identical vectors of a label are one
from the start. Each pair counts in the least leaf that both vectors are
in, so nothing is as long as the number of pairs: a leaf returns links per
vector and its own forest of unions.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .components import connected_components
from .groups import Forest, arrow_schema, clustered, record_batch, runs

THRESHOLD = 0.93
#: Trees of a group at least; deeper ones need more of them.
TREES = 6
#: Vectors of a leaf to aim at, and from which a leaf is split again.
LEAF, LARGE = 400, 2000
#: Half widths, least first, of the band around a split that goes to both
#: sides. A node takes the first that parts a pair at the threshold with a
#: chance of ``PARTED`` at most, so it widens where the vectors lie dense.
SPILLS, PARTED = (0.02, 0.025, 0.03, 0.035, 0.04, 0.045, 0.05, 0.06, 0.07, 0.08, 0.09, 0.1), 0.03
#: Chance that all trees of a group part such a pair.
MISSED = 1e-5
#: Share of a node on a side from which a split costs more comparisons than
#: it saves: both sides together have 2 * 0.7 ** 2 of the node's pairs.
WIDEST = 0.7
#: Vectors in the sample that fits the trees of a round, over all groups.
SAMPLE = 40_000
ROUNDS = 40
TILE = 1500
_SEED = 77


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe for any finite size."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _spill(away: np.ndarray, dim: int) -> float:
    """Half the band's width for a node whose projections are so far from the cut.

    Unit vectors at the threshold are ``sqrt(2 - 2 * THRESHOLD)`` apart, so
    their projections differ by a normal number of that deviation over
    ``sqrt(dim)``. A pair is parted if one end is beyond the band on one side
    and the difference takes the other beyond it on the other side.
    """
    sd = math.sqrt((2 - 2 * THRESHOLD) / dim)
    for spill in SPILLS:
        far = away[(away > spill) & (away < spill + 6 * sd)]
        if sum(math.erfc((d + spill) / sd / math.sqrt(2)) for d in far.tolist()) <= 2 * PARTED * len(away):
            break
    return spill


def trees_for(n: int) -> int:
    """Trees of a group of n vectors, so that few pairs part in all of them."""
    depth = max(1, math.ceil(1.2 * math.log2(max(2, n / LEAF))))
    return max(TREES, math.ceil(math.log(MISSED) / math.log(1 - (1 - PARTED) ** depth)))


class Tree:
    """One random-projection tree: directions and medians by node."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        self.rng = np.random.default_rng(seed)
        self.nodes: dict[int, tuple[np.ndarray, float, float]] = {}
        self._fit(sample, np.arange(len(sample)), 1, depth)
        del self.rng

    def _fit(self, x: np.ndarray, rows: np.ndarray, node: int, depth: int) -> None:
        if depth == 0 or len(rows) < 8:
            return
        # A direction between two vectors of the node spreads it more than
        # one drawn blindly; identical picks fall back to a blind one.
        a, b = x[self.rng.choice(rows)], x[self.rng.choice(rows)]
        w = a - b
        if not np.abs(w).max() > 1e-9:
            w = self.rng.standard_normal(x.shape[1])
        w = w / np.sqrt(w @ w)
        p = x[rows] @ w
        cut = float(np.median(p))
        spill = _spill(np.abs(p - cut), x.shape[1])
        left, right = rows[p <= cut + spill], rows[p > cut - spill]
        if max(len(left), len(right)) > WIDEST * len(rows):
            return
        self.nodes[node] = w, cut, spill
        self._fit(x, left, 2 * node, depth - 1)
        self._fit(x, right, 2 * node + 1, depth - 1)

    def route(self, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, rows) for all leaves with rows; a row may be in several."""
        out, todo = [], [(1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node not in self.nodes or not len(rows):
                if len(rows):
                    out.append((node, rows))
                continue
            w, cut, spill = self.nodes[node]
            p = x[rows] @ w
            todo += [(2 * node, rows[p <= cut + spill]), (2 * node + 1, rows[p > cut - spill])]
        return out


#: Ends the name of a leaf; that of a group of vectors ends with its length.
_LEAF_NAME = re.compile(r"/\d+\.\d+$", re.ASCII)


def _fit_round(large: DataFrame, rows: DataFrame, width: str, first: int) -> dict[str, list[Tree]]:
    """Trees by name of the largest oversized groups, from a bounded sample.

    The groups share the sample in proportion to their size. A group that
    the sample misses stays as it is until a later round. A group of vectors
    gets all its trees, whatever the round; a leaf has trees beside it, so
    one of its own is enough.
    """
    sizes = {r.grp: r.n for r in large.orderBy(F.desc("n"), "grp").limit(SAMPLE // 64).collect()}
    share = min(1.0, SAMPLE / sum(sizes.values()))
    chosen = F.broadcast(rows.sparkSession.createDataFrame([(g,) for g in sizes], "grp string"))
    near = F.pmod(F.xxhash64("key", "grp"), F.lit(1_000_000)) <= int(share * 1_000_000)
    picked = rows.join(chosen, "grp", "left_semi").where(near).select("grp", "vec").limit(2 * SAMPLE)
    found: dict[str, list[bytes]] = {}
    for r in picked.toLocalIterator():
        found.setdefault(r.grp, []).append(bytes(r.vec))
    trees = {}
    for grp, vecs in found.items():
        sample = unit_rows(np.frombuffer(b"".join(sorted(vecs)), dtype=width).reshape(len(vecs), -1))
        # Spill leaves 56 % of a node on each side, so halving takes 1.2 levels.
        depth = int(max(0, min(np.ceil(1.2 * np.log2(sizes[grp] / LEAF)), np.log2(len(vecs) / 8))))
        trees[grp] = [Tree(sample, depth, _SEED + 1000 * first + t) for t in range(1 if _LEAF_NAME.search(grp) else trees_for(sizes[grp]))]
    return trees


LEAVES = "key binary, grp string, copies long, vec binary"


def _route(rows: DataFrame, trees: dict[str, list[Tree]], width: str) -> DataFrame:
    """Rows of the groups with trees, in all their leaves; ``grp`` names the leaf."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    target = arrow_schema(LEAVES)

    def run(batches: Iterable):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            grps = np.array(batch.column(1).to_pylist(), dtype=object)
            for grp in dict.fromkeys(grps.tolist()):
                own = np.flatnonzero(grps == grp)
                part = batch.take(pa.array(own))
                x = unit_rows(_vectors(part.column(3), width))
                for t, tree in enumerate(shared.value[grp]):
                    for leaf, at in tree.route(x):
                        taken = part.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([taken.column(0), pa.array([f"{grp}/{t}.{leaf}"] * len(at), pa.string()), taken.column(2), taken.column(3)], schema=target)

    return rows.select("key", "grp", "copies", "vec").mapInArrow(run, LEAVES)


def leaves_of(vectors: DataFrame, width: str) -> DataFrame:
    """(key, grp, copies, vec) in leaves: every vector in one leaf of each tree at least."""
    current, stuck, parts = vectors, set(), []
    for r in range(ROUNDS):
        sizes = stored(current.groupBy("grp").agg(F.count("*").alias("n")), "leaf-sizes")
        large = sizes.where((F.col("n") > (LARGE if r else LEAF)) & ~F.col("grp").isin(list(stuck)))
        if large.isEmpty():
            break
        trees = _fit_round(large, current, width, r)
        stuck |= {g for g, ts in trees.items() if not any(t.nodes for t in ts)}
        trees = {g: ts for g, ts in trees.items() if g not in stuck}
        if not trees:
            break
        split = F.broadcast(current.sparkSession.createDataFrame([(g,) for g in trees], "grp string"))
        # What is small enough is done; only the rest is written again.
        names = large.select("grp")
        parts.append(current.join(names, "grp", "left_anti").select(*VECTOR))
        waiting = current.join(names, "grp", "left_semi").join(split, "grp", "left_anti").select(*VECTOR)
        current = stored(_route(current.join(split, "grp", "left_semi"), trees, width).unionByName(waiting), "leaves")
    out = current.select(*VECTOR)
    for part in parts:
        out = out.unionByName(part)
    return out


VECTOR = ("key", "grp", "copies", "vec")


def _vectors(column, width: str) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype=width).reshape(len(data), -1)


def _homes(homes: list[list[int]]) -> tuple[np.ndarray, dict[int, int]]:
    """Which leaves each vector is in, as a matrix; leaves in order of their hash."""
    rank = {x: k for k, x in enumerate(sorted({x for h in homes for x in h}))}
    member = np.zeros((len(homes), len(rank)), dtype=bool)
    for i, h in enumerate(homes):
        member[i, [rank[x] for x in h]] = True
    return member, rank


def _compared(leaves: DataFrame, width: str, threshold: float) -> DataFrame:
    """(key, links, root) from all leaves: each pair in the least common one."""
    named = leaves.withColumn("leaf", F.xxhash64("grp"))
    homes = named.groupBy("key").agg(F.sort_array(F.collect_set("leaf")).alias("homes"))
    sizes = leaves.groupBy("grp").count().where("count > 1").select("grp", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    rows = named.join(sizes, "grp").join(homes, "key").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    dealt = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("grp", "leaf", F.least("tile", "o").alias("ta"), F.greatest("tile", "o").alias("tb"), "tile", "key", "copies", "vec", "homes")
    keys, schema = ["grp", "ta", "tb"], "key binary, links long, root binary"
    target = arrow_schema(schema)

    def run(batches):
        waiting = []
        for group in runs(batches, keys):
            n = group.num_rows
            if n < 2:
                continue
            x, key = unit_rows(_vectors(group.column("vec"), width)), group.column("key").to_pylist()
            copies = group.column("copies").to_numpy()
            ta, tb = group.column("ta")[0].as_py(), group.column("tb")[0].as_py()
            first = group.column("tile").to_numpy() == ta
            member, rank = _homes(group.column("homes").to_pylist())
            own = rank[group.column("leaf")[0].as_py()]
            links, forest = np.zeros(n, dtype=np.int64), Forest(n)
            for at in range(0, n, 256):
                i, j = np.nonzero(x[at : at + 256] @ x.T >= threshold)
                i += at
                keep = (i < j) if ta == tb else (i < j) & (first[i] != first[j])
                i, j = i[keep], j[keep]
                # In an earlier common leaf the pair has been counted there.
                here = np.concatenate([np.zeros(0, bool), *((member[i[k : k + 20_000]] & member[j[k : k + 20_000]]).argmax(axis=1) == own for k in range(0, len(i), 20_000))])
                i, j = i[here], j[here]
                links += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
                for a, b in zip(i.tolist(), j.tolist()):
                    forest.link(a, b)
            waiting += [(key[i], int(links[i]), key[forest.root(i)]) for i in np.flatnonzero(links).tolist()]
            if len(waiting) > 20_000:
                yield record_batch(waiting, target)
                waiting = []
        if waiting:
            yield record_batch(waiting, target)

    return clustered(dealt, keys).mapInArrow(run, schema)


def _read(embeddings: DataFrame) -> tuple[DataFrame, str]:
    """(vec_id, grp, vec, key) of all rows; the last three are null where the
    vector links with nothing. ``grp`` is label and length, ``vec`` raw numbers."""
    kind = embeddings.schema["embedding"].dataType.elementType
    width = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    slim = embeddings.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>" if width == "<f4" else "array<double>"))
    schema = T.StructType([slim.schema["vec_id"], T.StructField("grp", T.StringType()), T.StructField("vec", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            grps, vecs = [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2)):
                x = None
                if label is not None and v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy().astype(width)
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                grps.append(None if x is None else f"{label}|{len(x)}")
                vecs.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grps, pa.string()), pa.array(vecs, pa.binary())], names=schema.fieldNames())

    key = F.when(F.col("vec").isNotNull(), F.unhex(F.md5(F.concat(F.col("grp").cast("binary"), "vec"))))
    return slim.mapInArrow(run, schema).withColumn("key", key), width


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Needs vec_id, label and embedding (array of float or double); other
    columns are ignored. Only vectors of equal, non-null label and equal
    length are compared. Null vectors and those with a null or non-finite
    component, or of zeros only, link with nothing, are their own component
    and are kept. Repeated rows link with each other.
    """
    read, width = _read(embeddings)
    rows = stored(read, "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("grp").alias("grp"), F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("vec_id").alias("rep"))
    classes = stored(classes, "classes")
    leaves = leaves_of(classes.select(*VECTOR), width)
    found = stored(_compared(leaves, width, threshold), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = stored(links.join(joined.withColumnRenamed("node", "key"), "key", "left").select("key", "links", F.coalesce("component", "key").alias("component")), "components")
    least = named.join(classes.select("key", "rep"), "key").groupBy("component").agg(F.min("rep").alias("least"))
    linked = named.join(least, "component").select("key", "links", "least")
    of_class = classes.select("key", "copies", "rep").join(linked, "key", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("least"))
    out = rows.select("vec_id", "key").join(of_class, "key", "left")
    component = F.when(F.col("n_links").isNull() | (F.col("n_links") == 0), F.col("vec_id")).otherwise(F.col("least"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
