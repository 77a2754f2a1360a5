"""Tables as Parquet folders: replace, append, upsert, views, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Warehouse:
    """Tables below a root folder, named ``schema.table``.

    A table is replaced by writing a new version and pointing the version
    file at it, so readers and a failed write never see half a table.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table.replace('.', '/')}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self, table: str) -> list[int]:
        fs, p = self._fs(self.path(table))
        if not fs.exists(p):
            return []
        jvm = self.spark._jvm
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/{n}/_SUCCESS"))
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and done(n))

    def exists(self, table: str) -> bool:
        return bool(self.versions(table))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path(table)}/v{self.versions(table)[-1]}")

    def replace(self, table: str, df: DataFrame) -> None:
        """Create or replace; ``df`` may read the table that it replaces."""
        last = self.versions(table)
        df.write.parquet(f"{self.path(table)}/v{(last[-1] if last else 0) + 1}")

    def append(self, table: str, df: DataFrame) -> None:
        """Create if missing and append; a ledger row goes last, in a table of its own."""
        last = self.versions(table)
        df.write.mode("append").parquet(f"{self.path(table)}/v{last[-1] if last else 1}")

    def upsert(self, table: str, df: DataFrame, keys: list[str]) -> None:
        """New rows win over old ones with the same keys."""
        old = self.read(table).join(df.select(*keys), keys, "left_anti") if self.exists(table) else None
        self.replace(table, df if old is None else old.unionByName(df))

    def delete_insert(self, table: str, df: DataFrame, key: str) -> None:
        """All rows of the keys in ``df`` are replaced by those in ``df``."""
        self.upsert(table, df, [key])

    def update(self, table: str, changes: DataFrame, key: str) -> None:
        """Set the columns of ``changes`` where they are not null."""
        columns = [c for c in changes.columns if c != key]
        new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
        j = self.read(table).join(new, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns})
        self.replace(table, j.drop(*[f"_{c}" for c in columns]))

    def view(self, name: str, table: str) -> None:
        self.read(table).createOrReplaceTempView(name)

    def tables(self) -> list[str]:
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        schemas = [s.getPath() for s in fs.listStatus(p) if s.isDirectory()]
        return sorted(f"{s.getName()}.{t.getPath().getName()}" for s in schemas for t in fs.listStatus(s) if self.exists(f"{s.getName()}.{t.getPath().getName()}"))

    def columns(self, table: str) -> list[tuple[str, str]]:
        """(name, type) of the table's columns."""
        return self.read(table).dtypes

    def copy_to(self, other: Warehouse, route=lambda table: table) -> list[str]:
        """Copy tables that the target lacks; ``route`` gives a new name or None to skip."""
        made = []
        for t in self.tables():
            if (name := route(t)) and not other.exists(name):
                other.replace(name, self.read(t))
                made.append(name)
        return made


def newest(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """Versions of a table united by name, the newest row of each key kept."""
    every = None
    for v, t in enumerate(tables):
        t = t.withColumn("version", F.lit(v))
        every = t if every is None else every.unionByName(t, allowMissingColumns=True)
    last = F.max("version").over(Window.partitionBy(*key))
    return every.withColumn("_l", last).where("version = _l").drop("_l")


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON array for people to open; for small, hand-checked frames.

    Written row by row to any file system that the session knows.
    """
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(b"[")
        for i, row in enumerate(df.toJSON().toLocalIterator()):
            out.write((",\n" if i else "").encode() + row.encode())
        out.write(b"]\n")
    finally:
        out.close()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def read_hand_check(spark: SparkSession, path: str) -> DataFrame:
    """Hand-filled CSV: all text, empty cells are empty texts."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c.lstrip("﻿")) for c in df.columns])
