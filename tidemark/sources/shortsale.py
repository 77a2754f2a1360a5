"""Delimited short-sale files: daily volumes and single trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Facilities of the daily files, before and from the switch.
SWITCH = "2018-08-01"
BEFORE, AFTER = ("FNSQ", "FNYX", "FORF"), ("FNQC", "FNRA", "FNSQ", "FNYX")
NEEDED = {"date", "symbol", "shortvolume", "totalvolume"}
SMALL = 100


def facilities_for(day: str) -> tuple[str, ...]:
    return BEFORE if day < SWITCH else AFTER


def read_daily(spark: SparkSession, path: str, facility: str | None = None) -> DataFrame:
    """(date, symbol, short_volume, short_exempt_volume, total_volume, facility).

    The header is matched without case and blanks, an unknown header is an
    error. The trailer (under three separators), rows without a date or a
    total are dropped; a missing exempt column is 0; bad numbers are null.
    """
    raw = spark.read.text(path)
    head = raw.where(F.lower("value").startswith("date|")).limit(1).collect()
    if not head:
        raise ValueError(f"no header in {path}")
    names = [n.strip().lower().replace(" ", "") for n in head[0].value.split("|")]
    if not set(names) >= NEEDED:
        raise ValueError(f"unknown header: {head[0].value}")
    rows = raw.where((F.length("value") - F.length(F.replace("value", F.lit("|"), F.lit(""))) >= 3) & ~F.lower("value").startswith("date|"))
    parts = F.split("value", r"\|")
    at = lambda n: F.get(parts, names.index(n)) if n in names else F.lit("0")
    number = lambda n: F.trim(at(n)).try_cast("double").cast("long")
    out = rows.select(
        F.try_to_date(F.trim(at("date")), "yyyyMMdd").alias("date"), F.upper(F.trim(at("symbol"))).alias("symbol"), number("shortvolume").alias("short_volume"),
        F.coalesce(number("shortexemptvolume"), F.lit(0)).alias("short_exempt_volume"), number("totalvolume").alias("total_volume"), F.lit(facility).alias("facility"))
    return out.where("date IS NOT NULL AND total_volume IS NOT NULL")


def sum_facilities(parts: list[DataFrame]) -> DataFrame:
    """One row per date and symbol over facilities, whose names are joined."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    sums = [F.sum(c).alias(c) for c in ("short_volume", "short_exempt_volume", "total_volume")]
    return every.groupBy("date", "symbol").agg(*sums, F.array_join(F.array_sort(F.collect_set("facility")), "|").alias("facilities"))


def trades_daily(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, date, short_trades, short_shares, small_trades) of trade files.

    One pass, columns by header name without case; Spark adds partial sums
    per task, which is what reading in pieces would do by hand.
    """
    raw = spark.read.option("sep", "|").option("header", True).option("inferSchema", False).option("mode", "DROPMALFORMED").csv(path)
    by = {c.strip().lower(): c for c in raw.columns}
    col = lambda n: F.col(f"`{by[n]}`")
    size = col("size").try_cast("double").cast("long")
    rows = raw.select(F.upper(F.trim(col("symbol"))).alias("symbol"), F.trim(col("date")).alias("d"), size.alias("size")).where(F.col("d").rlike(r"^\d{8}$") & F.col("size").isNotNull())
    return rows.groupBy("symbol", F.try_to_date("d", "yyyyMMdd").alias("date")).agg(F.count("*").alias("short_trades"), F.sum("size").alias("short_shares"), F.count_if(F.col("size") < SMALL).alias("small_trades"))


def part_label(path_column: str = "file"):
    """Facility and month of a part's file name, such as ``FNYX_202401``."""
    return F.regexp_extract(F.col(path_column), r"([A-Za-z]+)sh\w*?(\d{6})", 0)
