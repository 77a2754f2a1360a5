"""Captured API pages: bars, minute bars, ticker pages with resume tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR = "struct<t:string,o:double,h:double,l:double,c:double,v:double,n:double,vw:double>"
PAGE = T.StructType([T.StructField("bars", T.MapType(T.StringType(), T.ArrayType(T.StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": "string" if n == "t" else "double", "nullable": True, "metadata": {}} for n in ("t", "o", "h", "l", "c", "v", "n", "vw")]})))), T.StructField("next_page_token", T.StringType())])


def read_bars(spark: SparkSession, path: str, adjustment: str = "raw") -> DataFrame:
    """Rows of captured bar pages ({"bars": {symbol: [...]}})."""
    pages = spark.read.schema(PAGE).option("multiLine", True).json(path)
    rows = pages.select(F.explode("bars").alias("symbol", "rows")).select("symbol", F.explode("rows").alias("b"))
    return rows.select("symbol", F.to_date(F.substring("b.t", 1, 10)).alias("date"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"), F.col("b.n").cast("long").alias("trades"), F.col("b.vw").alias("vwap"), F.lit(adjustment).alias("adjustment")).dropDuplicates(["symbol", "date", "adjustment"])


def read_minutes(spark: SparkSession, path: str) -> DataFrame:
    """Minute bars with ``ts`` in Eastern wall time (timestamp_ntz)."""
    pages = spark.read.schema(PAGE).option("multiLine", True).json(path)
    rows = pages.select(F.explode("bars").alias("symbol", "rows")).select("symbol", F.explode("rows").alias("b"))
    utc = F.to_timestamp_ntz(F.regexp_replace("b.t", "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return rows.select("symbol", F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), utc).alias("ts"), F.col("b.c").alias("c"), F.col("b.v").alias("v"))


def with_raw_close(bars: DataFrame) -> DataFrame:
    """Adjusted bars (``adjustment`` ``all``) with the raw close of the same
    symbol and date as ``close_raw``, null where there is none."""
    raw = bars.where("adjustment = 'raw'").select("symbol", "date", F.col("close").alias("close_raw"))
    return bars.where("adjustment = 'all'").drop("adjustment").join(raw, ["symbol", "date"], "left")


def todo(wanted: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to load: wanted less done."""
    return wanted.join(ledger.select(*keys), keys, "left_anti")


def clean_symbols(*frames: DataFrame) -> DataFrame:
    """Distinct valid symbols of all frames' ``symbol``: upper case, ``/`` as ``.``."""
    every = frames[0].select("symbol")
    for f in frames[1:]:
        every = every.unionByName(f.select("symbol"))
    return every.select(F.upper(F.trim(F.translate("symbol", "/", "."))).alias("symbol")).where(F.col("symbol").rlike(r"^[A-Z]+(\.[A-Z]+)?$")).distinct()
