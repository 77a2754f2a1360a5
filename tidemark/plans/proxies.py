"""The supplied tables read as the engine's inputs, in Spark and in SQL.

Line items of a supplier's nation are a symbol's bars, orders are
announcements, customers are companies, returned items are short flow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar, features


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grain(grain: str, column: str):
    return F.to_date(column) if grain == "day" else F.to_date(F.date_trunc(grain, column))


def sessions(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    days = load(spark, sf_dir, "lineitem").select(_grain(grain, "l_shipdate").alias("session"))
    return calendar.numbered(days)


def bars(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    """symbol, date, close, close_raw, volume, short and trade counts."""
    items = load(spark, sf_dir, "lineitem").join(F.broadcast(load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
    price, returned = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_returnflag") == "R"
    return items.groupBy(F.col("s_nationkey").alias("symbol"), _grain(grain, "l_shipdate").alias("date")).agg(
        F.avg(price).alias("close"), F.min(price).alias("close_raw"), F.sum("l_quantity").alias("volume"),
        F.sum(F.when(returned, F.col("l_quantity")).otherwise(0.0)).alias("short_volume"), F.sum("l_quantity").alias("total_volume"),
        F.count_if(returned).alias("trades"), F.count_if(returned & (F.col("l_quantity") < 10)).alias("small_trades"))


def market(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    items = load(spark, sf_dir, "lineitem")
    return items.groupBy(_grain(grain, "l_shipdate").alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close")).withColumn("symbol", F.lit(-1))


def facts(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    """Bars with session numbers, returns and the market's return."""
    cal = sessions(spark, sf_dir, grain)
    market_ret = features.session_returns(market(spark, sf_dir, grain), cal).select("idx", F.col("ret").alias("market_ret"))
    return features.session_returns(bars(spark, sf_dir, grain), cal).join(F.broadcast(market_ret), "idx", "left")


def announcements(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    """event_id, cik, symbol, type, day0, i0: every order; day 0 is the first session from its date on."""
    orders = load(spark, sf_dir, "orders").withColumn("filed", F.to_date("o_orderdate"))
    cal = calendar.next_session_map(sessions(spark, sf_dir, grain)).select(F.col("day").alias("filed"), F.col("on_or_after").alias("day0"), F.col("idx").alias("i0"))
    companies = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("symbol"))
    out = orders.join(companies, "o_custkey").join(F.broadcast(cal), "filed", "left")
    return out.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("cik"), "symbol", F.col("o_orderstatus").alias("type"), "filed", "day0", "i0")


def sql_calendar(grain: str = "day") -> str:
    """CTEs s(session, idx), b (bars), m (market), f (facts), ev (announcements)."""
    day = "CAST(l_shipdate AS DATE)" if grain == "day" else f"CAST(date_trunc('{grain}', l_shipdate) AS DATE)"
    return f"""
s AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS idx FROM (SELECT DISTINCT {day} AS session FROM lineitem)),
b0 AS (
  SELECT s_nationkey AS symbol, {day} AS date, avg(l_extendedprice / l_quantity) AS close, min(l_extendedprice / l_quantity) AS close_raw,
         sum(l_quantity) AS volume, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS short_volume, sum(l_quantity) AS total_volume,
         count(*) FILTER (WHERE l_returnflag = 'R') AS trades, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity < 10) AS small_trades
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
m0 AS (SELECT {day} AS date, avg(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1),
m AS (SELECT s.idx, m0.close / lag(m0.close) OVER (ORDER BY s.idx) - 1 AS market_ret FROM m0 JOIN s ON s.session = m0.date),
f AS (
  SELECT x.*, x.close / p.close - 1 AS ret, m.market_ret
  FROM (SELECT b0.*, s.idx FROM b0 JOIN s ON s.session = b0.date) x
  LEFT JOIN (SELECT b0.symbol, b0.close, s.idx FROM b0 JOIN s ON s.session = b0.date) p ON p.symbol = x.symbol AND p.idx = x.idx - 1
  LEFT JOIN m ON m.idx = x.idx),
ev AS (
  SELECT o_orderkey AS event_id, o_custkey AS cik, c_nationkey AS symbol, o_orderstatus AS type, CAST(o_orderdate AS DATE) AS filed,
         (SELECT min(session) FROM s WHERE session >= CAST(o_orderdate AS DATE)) AS day0,
         (SELECT min(idx) FROM s WHERE session >= CAST(o_orderdate AS DATE)) AS i0
  FROM orders JOIN customer ON c_custkey = o_custkey)"""
