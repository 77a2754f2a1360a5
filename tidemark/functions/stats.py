"""Robust statistics and ranks as columns and small plan steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scale that makes a median absolute deviation a standard deviation of a normal.
MAD_SCALE = 1.4826
CLIP = 5.0


def robust_z(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    """``out``: (value - median) / (1.4826 MAD) within groups, clipped to 5.

    Null where the MAD is 0. Exact medians hold a group's values in one
    task; use it on bounded groups such as peers, not on whole tables.
    """
    w = Window.partitionBy(*by)
    df = df.withColumn("_med", F.median(value).over(w))
    df = df.withColumn("_mad", F.median(F.abs(F.col(value) - F.col("_med"))).over(w))
    z = (F.col(value) - F.col("_med")) / F.nullif(F.lit(MAD_SCALE) * F.col("_mad"), F.lit(0.0))
    clipped = F.when(z.isNotNull(), F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), z)))
    return df.withColumn(out, clipped).drop("_med", "_mad")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: as a lambda's variable it
    is not written out again wherever it is used."""
    return F.transform(F.array(value), use)[0]


def median_of(values: Column) -> Column:
    """Median of an array without nulls; null if it is empty."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        at = lambda i: F.try_element_at(s, i.cast("int"))
        return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)

    return bound(F.sort_array(values), middle)


def cuts_of(key: str, parts: int = 200) -> Column:
    """Aggregate: approximate quantiles of a column, to part rows by."""
    return F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)


def global_rank(df: DataFrame, key: str, tie: str, rank: str = "rank", total: str = "n", cuts: list[float] | None = None) -> DataFrame:
    """``df`` with the 1-based place of each row by ``key`` (double, ascending,
    null first), then ``tie``, and the number of rows.

    No window over all rows: approximate quantiles of the key, one small
    array (``cuts``), part the rows; places count within a part, after the
    sizes of the parts before it. Only rows of one and the same key share a
    part whatever their number.
    """
    if cuts is None:
        cuts = df.agg(cuts_of(key)).first()[0] or []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    part = F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(bounds, lambda c: c < F.col(key))))
    dealt = df.withColumn("_part", part)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_size"))
    # A row a part: their running sum is in one task.
    everyone = Window.orderBy("_part")
    sizes = sizes.select("_part", (F.sum("_size").over(everyone) - F.col("_size")).alias("_before"), F.sum("_size").over(everyone.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(total))
    within = Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_first(), F.col(tie))
    out = dealt.withColumn(rank, F.row_number().over(within)).join(F.broadcast(sizes), "_part")
    return out.withColumn(rank, F.col(rank) + F.col("_before")).drop("_part", "_before")


def quantile_bin(rank: Column, n: Column, bins: int) -> Column:
    """Bin 1..bins of a rank with equal-width cuts on ranks (not ``ntile``)."""
    return F.greatest(F.lit(1), F.ceil((rank - 1) * F.lit(float(bins)) / F.nullif(n - 1, F.lit(0)))).cast("int")


def row_mean(columns: list[str], least: int = 2) -> Column:
    """Mean of the non-null columns of a row; null under ``least`` of them."""
    present = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.when(present >= least, total / F.nullif(present, F.lit(0)))
