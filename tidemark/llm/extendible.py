"""Sharding by extendible hashing.

A document's place is the leading bits of a hash of its id. The directory
starts with one bucket of depth 0; a bucket over the byte limit splits on
the next bit, and only those do. Splitting is done on sums, not rows:
bytes are totalled at a fine depth once, every coarser total follows from
it, and a row's bucket is the first depth at which its prefix fits. A
round goes some bits deeper only for prefixes that still don't fit.

Rows that share all their hash bits (repeated ids) and a single row over
the limit can't be parted by bits. Such a bucket gets overflow pages as in
the classic scheme: runs of its rows, each within the limit where a row is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

HASH_BITS = 52  # of the md5 that any SQL engine can take as a number
ROUND_BITS = 13
#: Bytes of the stored directory (40 a row) up to which it is sent to every task.
BROADCAST_BYTES = 8 << 20
#: Depths up to which the look-up is a chain of broadcast joins.
CHAIN_DEPTHS = 8
ADDED = ("shard", "depth", "n_bytes", "shard_bytes")


def hash_bits(doc_id: Column) -> Column:
    """52 leading bits of the id's md5; a null id hashes as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def directory(sized: DataFrame, limit: int) -> DataFrame:
    """Leaf buckets of (h, bytes) rows: ``depth, prefix, bucket_bytes``.

    ``prefix`` holds the leading ``depth`` bits of h. Each round looks only
    at rows below a bucket that didn't fit, so the work shrinks as it goes
    deeper; 52 bits take four rounds at most.
    """
    leaves, rest, base = None, sized.groupBy("h").agg(F.sum("bytes").alias("bytes")), 0
    while True:
        top = min(HASH_BITS, base + ROUND_BITS)
        at_top = F.shiftrightunsigned("h", HASH_BITS - top)
        fine = rest.groupBy(at_top.alias("p")).agg(F.sum("bytes").alias("bytes"))
        levels = fine.select("bytes", "p", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
        sums = levels.groupBy("depth", F.expr(f"shiftrightunsigned(p, {top} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bucket_bytes"))
        sums = stored(sums, "directory")
        fits = sums.where((F.col("bucket_bytes") <= limit) | (F.col("depth") == HASH_BITS))
        # A leaf is a prefix that fits while its parent does not.
        over = sums.where((F.col("bucket_bytes") > limit) & (F.col("depth") < HASH_BITS))
        parents = over.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        own = fits.withColumn("parent", F.shiftrightunsigned("prefix", 1))
        new = own.join(parents, ["depth", "parent"], "left_semi").select("depth", "prefix", "bucket_bytes")
        if base == 0:
            new = new.unionByName(fits.where("depth = 0").select("depth", "prefix", "bucket_bytes"))
        leaves = new if leaves is None else leaves.unionByName(new)
        deeper = over.where(F.col("depth") == top).select(F.col("prefix").alias("q"))
        if top == HASH_BITS or deeper.isEmpty():
            return leaves
        rest = rest.withColumn("q", at_top).join(deeper, "q", "left_semi").drop("q")
        base = top


def _leaf_of(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows`` with depth, prefix and bucket_bytes of the leaf that holds h.

    Exactly one depth's prefix of h is a leaf. The depths in use (53 numbers
    at most) are collected. With few leaves at few depths each depth is one
    broadcast look-up, so rows don't move; otherwise only distinct hashes
    meet the directory and rows join them by h.
    """
    counts = {r.depth: r["count"] for r in leaves.groupBy("depth").count().collect()}
    prefix = lambda d: F.shiftrightunsigned("h", HASH_BITS - d)
    if 40 * sum(counts.values()) <= BROADCAST_BYTES and len(counts) <= CHAIN_DEPTHS:
        for d in sorted(counts):
            part = leaves.where(F.col("depth") == d).select(F.col("prefix").alias(f"_p{d}"), F.struct("depth", "prefix", "bucket_bytes").alias(f"_leaf{d}"))
            rows = rows.withColumn(f"_p{d}", prefix(d)).join(F.broadcast(part), f"_p{d}", "left").drop(f"_p{d}")
        found = F.coalesce(*[F.col(f"_leaf{d}") for d in sorted(counts)]) if counts else F.lit(None).cast("struct<depth:int,prefix:bigint,bucket_bytes:bigint>")
        return rows.withColumn("_leaf", found).drop(*[f"_leaf{d}" for d in counts]).select("*", "_leaf.*").drop("_leaf")
    options = F.array(*[F.struct(F.lit(d).alias("depth"), prefix(d).alias("prefix")) for d in sorted(counts)])
    keys = rows.select("h").distinct().withColumn("o", F.explode(options)).select("h", "o.depth", "o.prefix")
    return rows.join(keys.join(leaves, ["depth", "prefix"]), "h")


def assign_shards(docs: DataFrame, limit: int, *, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with its shard: ``shard`` (bits, then page), ``depth``,
    ``n_bytes`` and ``shard_bytes``.

    Needs ``doc_id`` and ``text``. Null text has 0 bytes, a null id hashes
    as the empty text, an empty table gives no rows. Every shard is within
    ``limit`` bytes of UTF-8 text unless it is a single row that is longer.
    ``keep`` names the columns to return (all by default); a column named
    like an added one is replaced.
    """
    keep = [c for c in (keep or docs.columns) if c not in ADDED]
    rows = docs.withColumn("h", hash_bits(F.col("doc_id"))).withColumn("n_bytes", text_bytes(F.col("text")))
    sized = stored(rows.select("h", F.col("n_bytes").alias("bytes")), "sizes")
    leaves = stored(directory(sized, limit), "leaves")
    placed = _leaf_of(rows.select(*keep, "h", "n_bytes"), leaves)
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    columns = [*keep, "shard", F.col("depth").cast("int").alias("depth"), "n_bytes", F.col("shard_bytes").cast("long").alias("shard_bytes")]
    fits = placed.where(F.col("bucket_bytes") <= limit).withColumn("shard", bits).withColumn("shard_bytes", F.col("bucket_bytes"))
    fits = fits.select(*columns)
    if leaves.where(F.col("bucket_bytes") > limit).isEmpty():
        return fits
    # Overflow pages of a hash value over the limit. Its rows are dealt to
    # runs of about 16 limits by content and place, so no task holds them all;
    # each run is cut at every half limit of running bytes. A row over half
    # the limit has a page of its own.
    over = placed.where(F.col("bucket_bytes") > limit)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in keep], F.monotonically_increasing_id()), F.ceil(F.col("bucket_bytes") / (16 * limit)))
    half = max(1, limit // 2)
    long_row = F.col("n_bytes") > half
    over = over.withColumn("spread", spread)
    run = Window.partitionBy("h", "spread").orderBy(long_row, "n_bytes", F.xxhash64(*[F.col(c) for c in keep]))
    before = F.coalesce(F.sum("n_bytes").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    page = F.when(long_row, F.concat(F.lit("r"), F.row_number().over(run).cast("string"))).otherwise(F.concat(F.lit("p"), F.floor(before / half).cast("string")))
    paged = over.withColumn("page", page)
    paged = paged.withColumn("shard_bytes", F.sum("n_bytes").over(Window.partitionBy("h", "spread", "page")))
    paged = paged.withColumn("shard", F.concat(bits, F.lit("-"), F.col("spread").cast("string"), "page"))
    return fits.unionByName(paged.select(*columns))


def write_shards(docs: DataFrame, limit: int, folder: str) -> None:
    """Write ``docs`` as one Parquet folder a shard below ``folder``, rows by
    their ``position`` in the mix where they have one."""
    placed = assign_shards(docs, limit)
    if "position" in placed.columns:
        placed = placed.repartition("shard").sortWithinPartitions("shard", "position")
    placed.write.partitionBy("shard").parquet(folder)
