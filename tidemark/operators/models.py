"""Anomaly and boosted-tree scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EULER = 0.5772156649


def _path_length(n: np.ndarray | float):
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    n = np.asarray(n, dtype=np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Random axis-parallel trees on small samples; score near 1 is anomalous."""

    def __init__(self, sample: np.ndarray, trees: int = 500, size: int = 256, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.size = min(size, len(sample))
        self.limit = int(np.ceil(np.log2(max(2, self.size))))
        #: Made by the first score, in each process.
        self._tables: list = []
        self.trees = [self._grow(sample[rng.choice(len(sample), self.size, replace=False)], 0, rng) for _ in range(trees)]

    def _grow(self, x: np.ndarray, depth: int, rng):
        low, high = (x.min(axis=0), x.max(axis=0)) if len(x) else (None, None)
        open_ = np.flatnonzero(high > low) if len(x) else []
        if depth >= self.limit or len(x) <= 1 or not len(open_):
            return depth + float(_path_length(len(x)))
        f = int(rng.choice(open_))
        cut = float(rng.uniform(low[f], high[f]))
        left = x[:, f] <= cut
        return f, cut, self._grow(x[left], depth + 1, rng), self._grow(x[~left], depth + 1, rng)

    def _cells(self, node, cuts: list[np.ndarray], at: tuple[slice, ...], out: np.ndarray) -> None:
        """Depths of a tree's boxes, each written over its cells between cuts."""
        if isinstance(node, float):
            out[at] = node
            return
        f, cut, left, right = node
        i = int(np.searchsorted(cuts[f], cut)) + 1
        low, high = at[f].start, at[f].stop
        self._cells(left, cuts, (*at[:f], slice(low, i), *at[f + 1 :]), out)
        self._cells(right, cuts, (*at[:f], slice(i, high), *at[f + 1 :]), out)

    def _depths(self, node, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if isinstance(node, float):
            out[rows] += node
            return
        f, cut, left, right = node
        goes = x[rows, f] <= cut
        self._depths(left, x, rows[goes], out)
        self._depths(right, x, rows[~goes], out)

    def _by_cells(self, x: np.ndarray) -> np.ndarray:
        """Rows by the places between all trees' cuts, found once; a tree maps them to its own cells."""
        if not self._tables:
            cuts = [[[] for _ in range(x.shape[1])] for _ in self.trees]

            def gather(node, own):
                if not isinstance(node, float):
                    own[node[0]].append(node[1])
                    gather(node[2], own)
                    gather(node[3], own)

            for tree, own in zip(self.trees, cuts):
                gather(tree, own)
            cuts = [[np.unique(np.array(c)) for c in own] for own in cuts]
            self._all = [np.unique(np.concatenate(c)) for c in zip(*cuts)]
            for tree, own in zip(self.trees, cuts):
                out = np.empty([len(c) + 1 for c in own])
                self._cells(tree, own, tuple(slice(0, n) for n in out.shape), out)
                # The place after the last cut has no cut of its own.
                places = [np.append(np.searchsorted(c, every), len(c)).astype(np.int16) for c, every in zip(own, self._all)]
                self._tables.append((places, out))
        at = [np.searchsorted(every, x[:, f]) for f, every in enumerate(self._all)]
        total = np.zeros(len(x))
        for places, depths in self._tables:
            cell = places[0][at[0]].astype(np.intp)
            for f in range(1, len(at)):
                cell *= depths.shape[f]
                cell += places[f][at[f]]
            total += depths.ravel()[cell]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        # Cells between cuts are few in one or two columns only.
        if x.shape[1] <= 2:
            total = self._by_cells(x)
        else:
            total = np.zeros(len(x))
            for tree in self.trees:
                self._depths(tree, x, np.arange(len(x)), total)
        return 2.0 ** (-total / len(self.trees) / max(1e-9, float(_path_length(self.size))))


def isolation_forest(fit: DataFrame, apply: DataFrame, columns: list[str], out: str = "isolation_forest", trees: int = 500, sample: int = 20_000, seed: int = 0) -> DataFrame:
    """``apply`` with an anomaly score from a forest fitted on ``fit``; nulls are 0.

    Trees need 256 rows each, so the driver gets a bounded sample of rows.
    """
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    rows = fit.select(*filled).orderBy(F.xxhash64(*columns, F.lit(seed))).limit(sample).collect()
    if not rows:
        return apply.withColumn(out, F.lit(None).cast("double"))
    forest = apply.sparkSession.sparkContext.broadcast(IsolationForest(np.array([list(r) for r in rows]), trees, seed=seed))

    names, fields = apply.columns, apply.schema.fields
    rows, values, _ = _with_features(apply, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(v).to_numpy(zero_copy_only=False) for v in values])
            scores = forest.value.score(np.where(np.isnan(x), 0.0, x))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores)], [*names, out])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))


# ---------------------------------------------------------------- boosted trees

#: Bins of a feature, depth and step of the trees.
TREE_BINS, DEPTH, STEP = 32, 2, 0.05
#: Most distinct rows of bins that the driver fits on; beyond it the executors fit.
MOST_CELLS = 1_000_000


def _with_features(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with each column as a double, 0 for null, and whether it was null."""
    values, nulls = [f"_f_{c}" for c in columns], [f"_m_{c}" for c in columns]
    made = {f: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for f, c in zip(values, columns)}
    return df.withColumns(made | {m: F.col(c).isNull() for m, c in zip(nulls, columns)}), values, nulls


def _features(batch: pa.RecordBatch, values: list[str], nulls: list[str]) -> list[np.ndarray]:
    """Value and null flag of each column in turn."""
    at = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    return [x for v, m in zip(values, nulls) for x in (at(v), at(m).astype(np.float64))]


def _grow(bins: list[np.ndarray], cuts: list[np.ndarray], total, weight, n, rows: np.ndarray, depth: int, out: np.ndarray):
    """A regression tree of least squares: a leaf's mean, or (feature, cut, left, right)."""
    s, w = total[rows].sum(), weight[rows].sum()
    best = (0.0, None, None)
    for f, c in enumerate(cuts if depth else []):
        at, size = bins[f][rows], len(c) + 1
        hs, hw, hn = (np.bincount(at, v[rows], size).cumsum()[:-1] for v in (total, weight, n))
        both = (hn > 0) & (hn < n[rows].sum())
        if both.any():
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(both, hs**2 / hw + (s - hs) ** 2 / (w - hw) - s**2 / w, -np.inf)
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], f, j)
    _, f, j = best
    if f is None:
        out[rows] = s / w
        return float(s / w)
    left = bins[f][rows] <= j
    grown = [_grow(bins, cuts, total, weight, n, part, depth - 1, out) for part in (rows[left], rows[~left])]
    return f, float(cuts[f][j]), *grown


def _boost(bins: list[np.ndarray], cuts: list[np.ndarray], n1: np.ndarray, n0: np.ndarray, iterations: int) -> list:
    """(weight, tree) of each iteration over distinct rows of bins that stand for
    n1 rows of the class and n0 others, both classes of equal weight.

    Spark's gradient boosting: log loss of the doubled margin, the first tree on the classes, leaves are means.
    """
    w1, w0 = (n * (n1.sum() + n0.sum()) / (2.0 * n.sum()) for n in (n1, n0))
    margin, trees, every = np.zeros(len(n1)), [], np.arange(len(n1))
    for i in range(iterations):
        total = w1 * 4 / (1 + np.exp(2 * margin)) - w0 * 4 / (1 + np.exp(-2 * margin)) if i else w1 - w0
        out, step = np.empty(len(n1)), STEP if i else 1.0
        trees.append((step, _grow(bins, cuts, total, w1 + w0, n1 + n0, every, DEPTH, out)))
        margin += step * out
    return trees


def _leaf(node, x: list[np.ndarray]):
    if isinstance(node, float):
        return node
    f, cut, left, right = node
    return np.where(x[f] <= cut, _leaf(left, x), _leaf(right, x))


def _probability(trees: list, x: list[np.ndarray]) -> np.ndarray:
    margin = np.zeros(len(x[0]))
    for step, node in trees:
        margin += step * _leaf(node, x)
    return 1 / (1 + np.exp(-2 * margin))


def _cells(rows: DataFrame, cuts: list[list[np.ndarray]], values: list[str], nulls: list[str]) -> DataFrame:
    """(i, code, n): rows of fold i's complement, or of all, by their bins, null flags and class in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = [[] for _ in cuts]

        def made():
            for i, codes in enumerate(kept):
                if codes:
                    code, n = np.unique(np.concatenate(codes), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), i, np.int32)), pa.array(code), pa.array(n.astype(np.int64))], ["i", "code", "n"])
                    codes.clear()

        held = 0
        for batch in batches:
            x = _features(batch, values, nulls)
            fold, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_fold", "_y"))
            for i, own in enumerate(cuts):
                code = y.astype(np.int64)
                for v, c in zip(x, own):
                    code = code * (len(c) + 1) + np.searchsorted(c, v)
                kept[i].append(code[fold != i])
            held += len(y)
            if held >= 500_000:
                yield from made()
                held = 0
        yield from made()

    return rows.mapInArrow(run, "i int, code long, n long").groupBy("i", "code").agg(F.sum("n").alias("n"))


def _trained(df: DataFrame, columns: list[str], label: str, fold: Column, k: int, iterations: int) -> list[list | None]:
    """Trees fitted on the rows outside fold i, for each i under ``k``; None
    under two positives or without a negative.

    Splits are searched among bins, so distinct rows of bins with their numbers
    are all that the fit needs: two passes over the rows, whatever the number of
    trees and folds, and cells on the driver. Cuts are each fit's own quantiles.
    """
    rows, values, nulls = _with_features(df, columns)
    rows = rows.select(*values, *nulls, F.coalesce(F.col(label), F.lit(False)).alias("_y"), fold.cast("int").alias("_fold"))
    inside, share = [F.col("_fold") != i for i in range(k)], [j / TREE_BINS for j in range(1, TREE_BINS)]
    asked = [F.struct(F.count_if(m & F.col("_y")).alias("n1"), F.count_if(m & ~F.col("_y")).alias("n0"), F.array(*[F.percentile_approx(F.when(m, F.col(v)), share, 10_000) for v in values]).alias("cuts")).alias(f"m{i}") for i, m in enumerate(inside)]
    found = rows.agg(*asked).first()
    cuts = [[c for q in m.cuts for c in (np.unique(np.array(q or [], np.float64)), np.array([0.5]))] for m in found]
    able = [m.n1 >= 2 and m.n0 >= 1 for m in found]
    codes = max(2 * math.prod(len(c) + 1 for c in own) for own in cuts)
    got = _cells(rows, cuts, values, nulls).limit(MOST_CELLS + 1).toPandas() if any(able) and codes < 2**62 else None
    if any(able) and (got is None or len(got) > MOST_CELLS):
        return [_fit_spark(rows.where(m), values, nulls, iterations) if a else None for m, a in zip(inside, able)]
    return [_fit_cells(got[got["i"] == i], own, iterations) if a else None for i, (own, a) in enumerate(zip(cuts, able))]


def _fit_cells(cells: pd.DataFrame, cuts: list[np.ndarray], iterations: int) -> list:
    """Trees from counted codes, the classes of a row of bins side by side."""
    size = math.prod(len(c) + 1 for c in cuts)
    code, n = cells["code"].to_numpy(), cells["n"].to_numpy(np.float64)
    rest, at = np.unique(code % size, return_inverse=True)
    n1, n0 = (np.bincount(at, np.where(code // size == y, n, 0.0), len(rest)) for y in (1, 0))
    bins = []
    for c in reversed(cuts):
        rest, b = np.divmod(rest, len(c) + 1)
        bins.insert(0, b)
    return _boost(bins, cuts, n1, n0, iterations)


def _fit_spark(rows: DataFrame, values: list[str], nulls: list[str], iterations: int) -> list:
    """The same trees by Spark, for rows of too many different bins."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    counts = {r["_y"]: r["count"] for r in rows.groupBy("_y").count().collect()}
    weight = F.when(F.col("_y"), sum(counts.values()) / (2.0 * counts[True])).otherwise(sum(counts.values()) / (2.0 * counts[False]))
    flags = {m: F.col(m).cast("double") for m in nulls}
    train = VectorAssembler(inputCols=[x for both in zip(values, nulls) for x in both], outputCol="_x").transform(rows.withColumns(flags))
    train = train.select("_x", F.col("_y").cast("double").alias("_l"), weight.alias("_w"))
    model = GBTClassifier(featuresCol="_x", labelCol="_l", weightCol="_w", maxDepth=DEPTH, maxBins=TREE_BINS, maxIter=iterations, stepSize=STEP, seed=0).fit(train)

    def node(n):
        if n.getClass().getSimpleName() == "LeafNode":
            return float(n.prediction())
        return n.split().featureIndex(), float(n.split().threshold()), node(n.leftChild()), node(n.rightChild())

    return [(w, node(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees)]


def _scored(df: DataFrame, columns: list[str], models: list[list | None], out: str, fold: str | None = None) -> DataFrame:
    """``df`` with the probability by the model of its row's fold, or by the first."""
    names = [c for c in df.columns if c != fold]
    fields = [df.schema[c] for c in names]
    rows, values, nulls = _with_features(df, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(batch, values, nulls)
            of = batch.column(fold).to_numpy(zero_copy_only=False) if fold else np.zeros(batch.num_rows, int)
            p, known = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for i, trees in enumerate(models):
                own = of == i
                if trees is not None and own.any():
                    p[own], known[own] = _probability(trees, [v[own] for v in x]), True
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p, mask=~known)], [*names, out])

    return rows.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))


def supervised(fit: DataFrame, apply: DataFrame, columns: list[str], label: str, out: str = "supervised", iterations: int = 100) -> DataFrame:
    """``apply`` with the boosted trees' probability; null under two positives or without a negative."""
    kept = fit.select(*dict.fromkeys([*columns, label])).persist()
    try:
        models = _trained(kept, columns, label, F.lit(-1), 1, iterations)
    finally:
        kept.unpersist()
    if models[0] is None:
        return apply.withColumn(out, F.lit(None).cast("double"))
    return _scored(apply, columns, models, out)


def _dealt(df: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """``df`` with ``_fold``: the place by the key's digest within its class, modulo ``k``.

    The digest's first digits part the rows evenly; places count within a part,
    after the sizes of the parts before it.
    """
    df = df.withColumns({"_c": F.coalesce(F.col(label), F.lit(False)), "_h": F.md5(F.col(key).cast("string").cast("binary"))})
    df = df.withColumn("_part", F.coalesce(F.substring("_h", 1, 3), F.lit("")))
    before = Window.partitionBy("_c").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # At most 4,097 parts of each class.
    sizes = df.groupBy("_c", "_part").count().select("_c", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_c", "_part").orderBy("_h"))
    dealt = df.withColumn("_place", place).join(F.broadcast(sizes), ["_c", "_part"])
    return dealt.withColumn("_fold", ((F.col("_place") + F.col("_before")) % k).cast("int")).drop("_c", "_h", "_part", "_place", "_before")


def out_of_fold(df: DataFrame, columns: list[str], label: str, key: str, out: str = "supervised_oof", folds: int = 5, iterations: int = 100) -> DataFrame:
    """Stratified out-of-fold scores; folds = min(5, positives), under two: null."""
    kept = df.select(*dict.fromkeys([*columns, label, key])).persist()
    try:
        k = min(folds, kept.where(F.col(label)).count())
        models = _trained(_dealt(kept, label, key, k), columns, label, F.col("_fold"), k, iterations) if k >= 2 else None
    finally:
        kept.unpersist()
    if models is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    return _scored(_dealt(df, label, key, k), columns, models, out, "_fold").select(*df.columns, out)
