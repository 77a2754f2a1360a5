"""Groups of rows for Python operators, without a call to Spark for each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame


def clustered(df: DataFrame, keys: list[str], then: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a key together in one partition, by key and then other columns."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *then)


def runs(batches: Iterable, keys: list[str]) -> Iterator:
    """Record batches of sorted rows -> one pyarrow table for each key."""
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= np.fromiter((x != y for x, y in zip(c, c[1:])), dtype=bool, count=len(c) - 1)
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        if held and tuple(c[0] for c in columns) != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(starts, starts[1:]):
            if held and a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def arrow_schema(ddl: str):
    """The pyarrow schema of a DDL string; made on the driver, sent to tasks."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def record_batch(rows: list[tuple], target):
    """Row tuples, at least one, as a record batch of the pyarrow schema."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)


class Forest:
    """Union-find over 0..n-1 with the least member as root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
