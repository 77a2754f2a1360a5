"""Queries of the event study: returns, windows, features, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar, features
from . import proxies as P
from .registry import register

FEATURES = ("price_d30", "dollar_volume", "abn_volume", "last5_share", "car", "scar", "beta", "short_share_abn", "short_share_z", "abn_short_trades", "small_trade_share_abn")


def _rounded(df: DataFrame, columns, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Rounded columns; ``nudge`` moves exact halves the same way in any engine."""
    return df.withColumns({c: F.round(F.col(c) + nudge, digits) for c in columns})


def feature_sql(grain: str) -> str:
    """The feature formulas in SQL over the proxies, event by event."""
    pairs = " UNION ALL ".join(f"SELECT '{k}' AS win, {w[0]} AS w0, {w[1]} AS w1, {b[0]} AS b0, {b[1]} AS b1" for k, (w, b) in features.WINDOWS.items())
    w, b = "FILTER (WHERE rel BETWEEN w0 AND w1", "FILTER (WHERE rel BETWEEN b0 AND b1"
    both = "AND ret IS NOT NULL AND market_ret IS NOT NULL)"
    return f"""
WITH {P.sql_calendar(grain)},
k AS (SELECT DISTINCT symbol, i0 FROM ev WHERE i0 IS NOT NULL),
r AS (SELECT k.symbol, k.i0, k.win, k.w0, k.w1, k.b0, k.b1, f.* EXCLUDE (symbol), f.idx - k.i0 AS rel, short_volume / nullif(total_volume, 0) AS share
      FROM (SELECT k.*, v.* FROM k, ({pairs}) v WHERE symbol IN (SELECT symbol FROM f)) k LEFT JOIN f ON f.symbol = k.symbol AND f.idx BETWEEN k.i0 - 300 AND k.i0 - 1),
a AS (
  SELECT symbol, i0, win, w0, w1, b0, b1, count(volume) {w}) AS n_window, count(volume) {b}) AS n_baseline,
         max(close_raw) FILTER (WHERE rel = -30) AS price_d30, median(close_raw * volume) {b}) AS dollar_volume,
         avg(volume) {w}) AS vw, avg(volume) {b}) AS vb, sum(volume) FILTER (WHERE rel BETWEEN w1 - 4 AND w1) AS last5, sum(volume) {w}) AS sw,
         count(*) {w} {both} AS rw, count(*) {b} {both} AS rb, sum(ret) {w} {both} AS sr, sum(market_ret) {w} {both} AS sm,
         regr_slope(ret, market_ret) {b} {both} AS beta, regr_intercept(ret, market_ret) {b} {both} AS alpha,
         regr_syy(ret, market_ret) {b} {both} AS syy, regr_sxx(ret, market_ret) {b} {both} AS sxx, regr_sxy(ret, market_ret) {b} {both} AS sxy,
         sum(short_volume) {w} AND total_volume > 0) AS shw, sum(total_volume) {w} AND total_volume > 0) AS tw,
         sum(short_volume) {b} AND total_volume > 0) AS shb, sum(total_volume) {b} AND total_volume > 0) AS tb,
         count(share) {w}) AS dw, count(share) {b}) AS db, stddev_samp(share) {b}) AS sd,
         coalesce(sum(trades) {w}), 0) AS qw, coalesce(sum(trades) {b}), 0) AS qb, coalesce(sum(small_trades) {w}), 0) AS zw, coalesce(sum(small_trades) {b}), 0) AS zb
  FROM r GROUP BY ALL),
g AS (SELECT *, n_window >= 10 AND n_baseline >= 60 AND vw > 0 AND vb > 0 AS vok, dw >= 10 AND db >= 60 AS fok FROM a),
h AS (SELECT *, vok AND rb >= 60 AND rw >= 10 AS rok, sqrt(greatest(0, syy - sxy * sxy / sxx) / nullif(rb - 1, 0)) AS resid,
             sr - alpha * rw - beta * sm AS car0, shw / tw - shb / tb AS abn,
             greatest(0, i0 + w1 - greatest(0, i0 + w0) + 1) AS lw, greatest(0, i0 + b1 - greatest(0, i0 + b0) + 1) AS lb FROM g),
out AS (
  SELECT symbol, i0, win, n_window, n_baseline, round(price_d30 + 1e-9, 6) AS price_d30, round(dollar_volume + 1e-9, 6) AS dollar_volume,
         round(CASE WHEN vok THEN ln(vw) - ln(vb) END + 1e-9, 6) AS abn_volume, round(CASE WHEN vok THEN coalesce(last5, 0) / sw END + 1e-9, 6) AS last5_share,
         round(CASE WHEN rok THEN car0 END + 1e-9, 6) AS car, round(CASE WHEN rok AND resid > 0 THEN car0 / (resid * sqrt(rw)) END + 1e-9, 6) AS scar,
         round(CASE WHEN rok THEN beta END + 1e-9, 6) AS beta, round(CASE WHEN fok THEN abn END + 1e-9, 6) AS short_share_abn,
         round(CASE WHEN fok AND sd > 0 THEN abn / (sd / sqrt(dw)) END + 1e-9, 6) AS short_share_z,
         round(CASE WHEN qb > 0 THEN ln(qw / lw + 1) - ln(qb / lb + 1) END + 1e-9, 6) AS abn_short_trades,
         round(CASE WHEN qb > 0 AND qw > 0 THEN zw / qw - zb / qb END + 1e-9, 6) AS small_trade_share_abn
  FROM h)"""


def _features(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    events = P.announcements(spark, sf_dir, grain)
    made = features.event_features(events, P.facts(spark, sf_dir, grain))
    return _rounded(made, FEATURES, nudge=1e-9)


def _feature_select(what: str = "") -> str:
    return f"SELECT ev.event_id, win AS \"window\", n_window, n_baseline, {', '.join(FEATURES)} FROM ev JOIN out USING (symbol, i0) {what}"


@register("j19_event_features", feature_sql("day") + _feature_select())
def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _features(spark, sf_dir, "day")
    return P.announcements(spark, sf_dir).join(made, ["symbol", "i0"]).select("event_id", "window", "n_window", "n_baseline", *FEATURES)


FLAGSHIP = feature_sql("week") + _feature_select("WHERE win = 'pre' AND abn_volume IS NOT NULL")


@register("flagship_weekly_features", FLAGSHIP)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-event features of every announcement with enough history, weekly sessions."""
    made = _features(spark, sf_dir, "week").where("window = 'pre' AND abn_volume IS NOT NULL")
    return P.announcements(spark, sf_dir, "week").join(made, ["symbol", "i0"]).select("event_id", "window", "n_window", "n_baseline", *FEATURES)


@register("j01_sessions", f"WITH {P.sql_calendar()} SELECT session, idx FROM s")
def session_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sessions(spark, sf_dir)


@register("j02_day0", f"""WITH {P.sql_calendar()},
  t AS (SELECT event_id, ts - INTERVAL '9131 days' AS accepted FROM events)
SELECT t.event_id, CASE WHEN date_part('hour', accepted) < 16 THEN (SELECT min(session) FROM s WHERE session >= CAST(accepted AS DATE))
       ELSE (SELECT min(session) FROM s WHERE session > CAST(accepted AS DATE)) END AS day0 FROM t""")
def event_day0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events moved back into the years that have sessions, then day 0."""
    moved = P.load(spark, sf_dir, "events").select("event_id", F.expr("ts - INTERVAL '9131' DAY").alias("accepted"))
    return calendar.day0(moved, P.sessions(spark, sf_dir)).select("event_id", "day0")


@register("f07_session_returns", f"WITH {P.sql_calendar()} SELECT symbol, idx, round(ret, 6) AS ret, round(market_ret, 6) AS market_ret FROM f")
def session_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.facts(spark, sf_dir).select("symbol", "idx", "ret", "market_ret"), ("ret", "market_ret"))


@register("f08_row_returns", f"WITH {P.sql_calendar()} SELECT symbol, date, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1, 6) AS ret FROM b0")
def row_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(features.row_returns(P.bars(spark, sf_dir)).select("symbol", "date", "ret"), ("ret",))


@register("j20_day0_ar", f"WITH {P.sql_calendar()} SELECT ev.event_id, round(f.ret - f.market_ret, 6) AS day0_ar FROM ev LEFT JOIN f ON f.symbol = ev.symbol AND f.idx = ev.i0")
def day0_ar(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features.day0_ar(P.announcements(spark, sf_dir), P.facts(spark, sf_dir))
    return _rounded(made.select("event_id", "day0_ar"), ("day0_ar",))


@register("d16_calendar_fill", f"""WITH {P.sql_calendar()}
SELECT n.n_nationkey AS symbol, s.idx, b0.volume FROM nation n JOIN s ON true LEFT JOIN b0 ON b0.symbol = n.n_nationkey AND b0.date = s.session""")
def calendar_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol on every session, null where it did not trade."""
    cal = P.sessions(spark, sf_dir)
    last = cal.count() - 1
    grid = P.load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("symbol"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("idx"))
    grid = grid.join(F.broadcast(cal), "idx")
    return grid.join(P.bars(spark, sf_dir).withColumnRenamed("date", "session").select("symbol", "session", "volume"), ["symbol", "session"], "left").select("symbol", F.col("idx").cast("long").alias("idx"), "volume")


@register("d18_window_facts", f"""WITH {P.sql_calendar()} SELECT k.symbol, k.i0, count(*) AS n, sum(f.volume) AS volume
FROM (SELECT DISTINCT symbol, i0 FROM ev WHERE i0 IS NOT NULL) k JOIN f ON f.symbol = k.symbol AND f.idx BETWEEN k.i0 - 20 AND k.i0 - 1 GROUP BY ALL""")
def window_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = P.announcements(spark, sf_dir).select("symbol", F.col("i0").alias("idx"))
    rows = features.keyed_facts(keys, P.facts(spark, sf_dir))
    window = features.before(-20, -1)
    framed = rows.select("symbol", F.col("idx").alias("i0"), "_event", F.count("_bar").over(window).alias("n"), F.sum("volume").over(window).alias("volume"))
    return framed.where("_event AND n > 0").drop("_event")


@register("d15_market_join", f"WITH {P.sql_calendar()} SELECT b0.symbol, b0.date, round(b0.close / m0.close, 6) AS ratio FROM b0 JOIN m0 USING (date)")
def market_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = P.market(spark, sf_dir).select("date", F.col("close").alias("index_close"))
    return P.bars(spark, sf_dir).join(index, "date").select("symbol", "date", F.round(F.col("close") / F.col("index_close"), 6).alias("ratio"))


@register("j21_universe", f"""WITH {P.sql_calendar()}
SELECT ev.event_id, coalesce(f.close_raw >= 1000, false) AND type <> 'P' AS in_universe FROM ev LEFT JOIN f ON f.symbol = ev.symbol AND f.idx = ev.i0 - 30""")
def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = P.facts(spark, sf_dir).select("symbol", (F.col("idx") + 30).alias("i0"), (F.col("close_raw") / 1000).alias("price"))
    joined = P.announcements(spark, sf_dir).join(price, ["symbol", "i0"], "left")
    return joined.select("event_id", features.in_universe(F.col("price"), F.col("type"), ("P",)).alias("in_universe"))


@register("j22_oriented", f"""WITH {P.sql_calendar()}
SELECT ev.event_id, round(f.ret * nullif(sign(f.ret - f.market_ret), 0), 6) AS oriented FROM ev JOIN f ON f.symbol = ev.symbol AND f.idx = ev.i0""")
def orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.facts(spark, sf_dir).select("symbol", F.col("idx").alias("i0"), "ret", "market_ret")
    joined = P.announcements(spark, sf_dir).join(r, ["symbol", "i0"])
    return joined.select("event_id", F.round(features.oriented(F.col("ret"), F.col("ret") - F.col("market_ret")), 6).alias("oriented"))


@register("e11_residual_sd", f"""WITH {P.sql_calendar()}
SELECT symbol, round(sqrt((regr_syy(ret, market_ret) - regr_sxy(ret, market_ret) ^ 2 / regr_sxx(ret, market_ret)) / (count(*) - 1)), 6) AS resid_sd,
       round(regr_slope(ret, market_ret), 6) AS beta, round(regr_intercept(ret, market_ret), 6) AS alpha, round(stddev_samp(ret), 6) AS sd
FROM f WHERE ret IS NOT NULL AND market_ret IS NOT NULL GROUP BY symbol""")
def residual_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.facts(spark, sf_dir).where("ret IS NOT NULL AND market_ret IS NOT NULL")
    r, m = F.col("ret"), F.col("market_ret")
    resid = F.sqrt((F.regr_syy(r, m) - F.regr_sxy(r, m) * F.regr_sxy(r, m) / F.regr_sxx(r, m)) / (F.count("*") - 1))
    made = rows.groupBy("symbol").agg(resid.alias("resid_sd"), F.regr_slope(r, m).alias("beta"), F.regr_intercept(r, m).alias("alpha"), F.stddev_samp(r).alias("sd"))
    return _rounded(made, ("resid_sd", "beta", "alpha", "sd"))


@register("f19_last_five", f"WITH {P.sql_calendar()} SELECT symbol, sum(volume) FILTER (WHERE idx > mx - 5) AS last5, sum(volume) AS total FROM f, (SELECT max(idx) AS mx FROM s) GROUP BY symbol")
def last_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.facts(spark, sf_dir)
    newest = P.sessions(spark, sf_dir).agg(F.max("idx").alias("mx")).first().mx
    return rows.groupBy("symbol").agg(F.sum(F.when(F.col("idx") > newest - 5, F.col("volume"))).alias("last5"), F.sum("volume").alias("total"))
