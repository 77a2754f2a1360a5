"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that belong to words: digits, letters a-z and every byte of a
#: non-ASCII character; A-Z become a-z, all others a blank.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    Where the session names no such folder, a local master (as in tests) gets
    a temporary one, for checkpoints as well; a cluster gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidemark-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read again.

    Cuts the lineage: whatever is built on it survives a lost executor
    without repeating what made it.
    """
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more from the shared storage."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def with_file_order(docs: DataFrame, name: str) -> DataFrame:
    """``docs``, read from Parquet, with each row's place in the order of its
    files and their rows as column ``name``; null where they are no file scan.

    Files are as many as the tasks that wrote them: their running sum is small.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return docs.withColumn(name, F.lit(None).cast("long"))
    sizes = placed.groupBy("_file").count()
    before = F.sum("count").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select("_file", F.coalesce(before, F.lit(0)).alias("_start")))
    return placed.join(starts, "_file").withColumn(name, F.col("_start") + F.col("_row")).drop("_file", "_row", "_start")


def arrow_fs(uri: str):
    """The pyarrow file system and path of a folder in the shared storage."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bytes(text: str | None) -> list[bytes]:
    """Words of a text: runs of digits, letters and non-ASCII characters.

    A-Z are lower-cased; other characters stay as they are.
    """
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor, shift, multiply rounds)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def crc_mod(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
