"""Queries of events, id map, day-0 rules, scoring, matching and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import calendar, daymove, entity, events, idmap, scoring
from . import proxies as P
from .registry import register
from .relational import DAY, RANGES, ranges

load = P.load

# ---------------------------------------------------------------- scoring

SCORED = """
x AS (SELECT o_orderkey AS event_id, o_totalprice AS size, substr(o_orderpriority, 1, 1) AS division, CAST(o_orderdate AS DATE) AS day0,
             CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice - o_custkey END AS m1, CAST((o_orderkey * 7919) % 1009 AS DOUBLE) AS m2,
             coalesce(l.toxic = 1 OR l.quality = 0, false) AS charged
      FROM orders LEFT JOIN labels l ON l.doc_id = o_orderkey % 1000),
p0 AS (SELECT *, row_number() OVER (ORDER BY size, event_id) AS rn, count(*) OVER () AS n FROM x),
p1 AS (SELECT *, CAST(greatest(1, ceil((rn - 1) * 5.0 / (n - 1))) AS INT) AS size_q FROM p0),
p2 AS (SELECT *, size_q || '/' || division AS g, count(*) OVER (PARTITION BY size_q, division) AS ng, count(*) OVER (PARTITION BY size_q) AS nq FROM p1),
p3 AS (SELECT *, CASE WHEN ng >= 20 THEN g WHEN nq >= 20 THEN size_q || '/all' ELSE 'all' END AS peer_group FROM p2),
p4 AS (SELECT *, median(m1) OVER (PARTITION BY peer_group) AS med1, median(m2) OVER (PARTITION BY peer_group) AS med2 FROM p3),
p5 AS (SELECT *, median(abs(m1 - med1)) OVER (PARTITION BY peer_group) AS mad1, median(abs(m2 - med2)) OVER (PARTITION BY peer_group) AS mad2 FROM p4),
p6 AS (SELECT *, CASE WHEN m1 IS NOT NULL THEN greatest(-5, least(5, (m1 - med1) / nullif(1.4826 * mad1, 0))) END AS z_m1, greatest(-5, least(5, (m2 - med2) / nullif(1.4826 * mad2, 0))) AS z_m2 FROM p5),
p7 AS (SELECT *, CASE WHEN z_m1 IS NOT NULL AND z_m2 IS NOT NULL THEN (z_m1 + z_m2) / 2 END AS composite FROM p6)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events with two measures, a size, a division and a label."""
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("_d"), "toxic", "quality")
    o = load(spark, sf_dir, "orders").withColumn("_d", F.col("o_orderkey") % 1000).join(F.broadcast(labels) if labels.count() < 100_000 else labels, "_d", "left")
    key = F.col("o_orderkey")
    x = o.select(
        key.alias("event_id"), F.col("o_totalprice").alias("size"), F.substring("o_orderpriority", 1, 1).alias("division"), F.to_date("o_orderdate").alias("day0"),
        F.when(key % 11 != 0, F.col("o_totalprice") - F.col("o_custkey")).alias("m1"), ((key * 7919) % 1009).cast("double").alias("m2"),
        F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)).alias("charged"))
    return scoring.peer_z(x, ["m1", "m2"], "size", "division")


@register("j23_peer_z", f"WITH {SCORED} SELECT event_id, size_q, peer_group, round(z_m1 + 1e-9, 6) AS z_m1, round(z_m2 + 1e-9, 6) AS z_m2, round(composite + 1e-9, 6) AS composite FROM p7")
def peer_z(spark, sf_dir):
    z = [F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("z_m1", "z_m2", "composite")]
    return scored(spark, sf_dir).select("event_id", "size_q", "peer_group", *z)


LIFT = """(SELECT {share} AS share, round(sum(CASE WHEN rn <= k THEN y ELSE 0 END) / any_value(k) / nullif(avg(y), 0), 6) AS lift, CAST(sum(CASE WHEN rn <= k THEN y ELSE 0 END) AS BIGINT) AS hits, CAST(any_value(k) AS BIGINT) AS k
  FROM (SELECT row_number() OVER (ORDER BY composite DESC NULLS LAST, event_id) AS rn, greatest(1, ceil({share} * count(*) OVER ())) AS k, CAST(charged AS INT) AS y FROM p7))"""


@register("j25_lift", f"WITH {SCORED} SELECT * FROM {LIFT.format(share='CAST(0.05 AS DOUBLE)')} UNION ALL SELECT * FROM {LIFT.format(share='CAST(0.01 AS DOUBLE)')}")
def lift(spark, sf_dir):
    return scoring.lifts(scored(spark, sf_dir), "composite", F.col("charged"), (0.05, 0.01)).withColumn("lift", F.round("lift", 6))


AUC = """(SELECT '{s}' AS score, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 6) AS auc FROM (
  SELECT CAST(charged AS INT) AS y, rank() OVER (ORDER BY coalesce({s}, -1e300)) + (count(*) OVER (PARTITION BY coalesce({s}, -1e300)) - 1) / 2 AS r FROM p7))"""


@register("j26_auc", f"WITH {SCORED} SELECT * FROM {AUC.format(s='composite')} UNION ALL SELECT * FROM {AUC.format(s='m2')} UNION ALL SELECT * FROM {AUC.format(s='z_m1')}")
def auc(spark, sf_dir):
    return scoring.aucs(scored(spark, sf_dir), ["composite", "m2", "z_m1"], F.col("charged")).withColumn("auc", F.round("auc", 6))


@register("j27_evaluate", f"""WITH {SCORED} SELECT 'composite' AS score, a.lift AS top5_lift, a.hits, a.k, b.lift AS top1_lift, c.auc
FROM {LIFT.format(share='CAST(0.05 AS DOUBLE)')} a, {LIFT.format(share='CAST(0.01 AS DOUBLE)')} b, {AUC.format(s='composite')} c""")
def evaluate(spark, sf_dir):
    made = scoring.evaluate(scored(spark, sf_dir), ["composite"], F.col("charged"))
    return made.withColumns({c: F.round(c, 6) for c in ("top5_lift", "top1_lift", "auc")})


@register("j28_budget_capture", f"""WITH {SCORED} SELECT CAST(sum(CASE WHEN rn <= 50 THEN y ELSE 0 END) AS BIGINT) AS caught, CAST(sum(y) AS BIGINT) AS charged, round(sum(CASE WHEN rn <= 50 THEN y ELSE 0 END) / sum(y), 6) AS share
FROM (SELECT CAST(charged AS INT) AS y, row_number() OVER (PARTITION BY date_trunc('month', day0) ORDER BY composite DESC NULLS LAST, event_id) AS rn FROM p7)""")
def budget(spark, sf_dir):
    return scoring.budget_capture(scored(spark, sf_dir), "composite", F.col("charged"), "day0").withColumn("share", F.round("share", 6))


@register("j24_composite", "SELECT doc_id, round(CASE WHEN n >= 2 THEN (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / n END, 6) AS composite FROM (SELECT doc_id, a, b, c, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 1.5::DOUBLE END AS a, CASE WHEN toxic = 1 THEN 2.25::DOUBLE END AS b, CAST(doc_id AS DOUBLE) AS c FROM labels))")
def composite(spark, sf_dir):
    rows = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 1.5).alias("a"), F.when(F.col("toxic") == 1, 2.25).alias("b"), F.col("doc_id").cast("double").alias("c"))
    return rows.select("doc_id", F.round(stats.row_mean(["a", "b", "c"]), 6).alias("composite"))


# ---------------------------------------------------------------- events and times

FORMS = "CASE WHEN o_orderpriority = '1-URGENT' THEN CASE o_orderkey % 3 WHEN 0 THEN 'DEFM14A' WHEN 1 THEN 'SC 14D9' ELSE 'SC TO-T' END WHEN o_orderpriority = '5-LOW' AND o_orderkey % 2 = 0 THEN '10-K' ELSE '8-K' END"
ITEM_TEXT = "CASE o_orderpriority WHEN '2-HIGH' THEN '2.02, 9.01' WHEN '3-MEDIUM' THEN '1.01' WHEN '4-NOT SPECIFIED' THEN '7.01,12.02' ELSE '8.01' END"


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings: form and items from the priority, stamp from the key."""
    p, k = F.col("o_orderpriority"), F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    stamp = F.to_timestamp_ntz(F.date_format(day, "yyyy-MM-dd")) + F.make_dt_interval(secs=(k * 37 % 86400).cast("int"))
    shown = F.when(k % 3 == 0, "DEFM14A").when(k % 3 == 1, "SC 14D9").otherwise("SC TO-T")
    return load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cik"), k.cast("string").alias("accession"), day.alias("filing_date"), stamp.alias("accepted_json"),
        F.when(p == "1-URGENT", shown).when((p == "5-LOW") & (k % 2 == 0), "10-K").otherwise("8-K").alias("form"),
        F.when(p == "2-HIGH", "2.02, 9.01").when(p == "3-MEDIUM", "1.01").when(p == "4-NOT SPECIFIED", "7.01,12.02").otherwise("8.01").alias("items"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "fund").when(F.col("c_mktsegment") == "MACHINERY", "operating")
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cik"), F.col("c_name").alias("name"), kind.alias("entity_type"), F.lit("X").alias("tickers"), F.lit("").alias("former_names"), F.col("c_custkey").alias("ord"))


TIMES_SQL = f"""
fl AS (SELECT o_custkey AS cik, CAST(o_orderkey AS VARCHAR) AS accession, {DAY} AS filing_date, CAST({DAY} AS TIMESTAMP) + to_seconds((o_orderkey * 37) % 86400) AS accepted_json, {FORMS} AS form, {ITEM_TEXT} AS items FROM orders),
op AS (SELECT DISTINCT cik FROM fl JOIN customer ON c_custkey = cik WHERE form IN ('10-K', '10-Q') AND c_mktsegment <> 'BUILDING' AND filing_date BETWEEN DATE '1995-06-01' AND DATE '2001-01-31'),
e8 AS (SELECT fl.* FROM fl JOIN op USING (cik) WHERE form = '8-K' AND filing_date BETWEEN DATE '1995-06-01' AND DATE '2001-01-31'),
tf AS (SELECT cik, filing_date AS t, min(form) AS form FROM fl WHERE form IN ('PREM14A', 'DEFM14A', 'SC 14D9', 'SC14D9C', 'SC 13E3') AND filing_date BETWEEN DATE '1995-06-01' AND DATE '2001-01-31' + 120 GROUP BY 1, 2),
deals AS (SELECT cik, t, form FROM (SELECT *, lag(t) OVER (PARTITION BY cik ORDER BY t) AS b FROM tf) WHERE b IS NULL OR t - b > 120),
acq AS (SELECT e.cik, accession, filing_date, accepted_json, 'acquisition_target' AS event_type, d.form || ' ' || CAST(t AS VARCHAR) AS evidence FROM e8 e JOIN deals d ON d.cik = e.cik AND t - filing_date BETWEEN 0 AND 120
        WHERE items = '1.01' QUALIFY row_number() OVER (PARTITION BY e.cik, t ORDER BY filing_date DESC, accepted_json DESC, accession DESC) = 1),
ty AS (SELECT * FROM (SELECT * FROM acq UNION ALL SELECT cik, accession, filing_date, accepted_json, 'earnings', '' FROM e8 WHERE items = '2.02, 9.01'
        UNION ALL SELECT cik, accession, filing_date, accepted_json, 'other_material_candidate', '' FROM e8 WHERE items IN ('7.01,12.02', '8.01'))
       QUALIFY row_number() OVER (PARTITION BY accession, event_type ORDER BY cik, evidence) = 1)"""


def built(spark: SparkSession, sf_dir: str, exact: DataFrame | None = None) -> DataFrame:
    return events.build_events(companies(spark, sf_dir), filings(spark, sf_dir), P.sessions(spark, sf_dir), "1995-06-01", "2001-01-31", exact)


@register("j05_build_events", f"WITH {TIMES_SQL} SELECT substr(event_type, 1, 3) || '-' || accession AS event_id, cik, event_type, evidence FROM ty")
def build_events(spark, sf_dir):
    return built(spark, sf_dir).select("event_id", "cik", "event_type", "evidence")


@register("j03_resolve_times", f"""WITH {P.sql_calendar()}, {TIMES_SQL},
cd AS (SELECT accession, event_type, filing_date, k, accepted_json - to_hours(k * off) AS ts
       FROM (SELECT *, 17 - CAST(date_part('hour', (CAST(filing_date AS TIMESTAMP) + INTERVAL 17 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS INT) AS off FROM ty), (SELECT CAST(range AS INT) AS k FROM range(0, 3))),
cc AS (SELECT *, date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + date_part('second', ts) AS sec, CAST(ts AS DATE) AS d FROM cd),
nx AS (SELECT cc.*, (SELECT min(session) FROM s WHERE session >= cc.d) AS on_or, (SELECT min(session) FROM s WHERE session > cc.d) AS aft FROM cc),
ti AS (SELECT *, CASE WHEN sec < 57600 THEN on_or ELSE aft END AS d0, CASE WHEN d = on_or AND sec <= 63000 THEN on_or ELSE aft END AS implied FROM nx),
tr AS (SELECT *, CASE WHEN sec BETWEEN 21600 AND 79200 AND implied IS NOT DISTINCT FROM filing_date THEN 3 WHEN sec BETWEEN 21600 AND 79200 THEN 2 ELSE 1 END AS tier FROM ti),
be AS (SELECT * FROM tr QUALIFY tier = max(tier) OVER (PARTITION BY accession, event_type))
SELECT substr(event_type, 1, 3) || '-' || accession AS event_id, min(d0) AS day0, CAST(count(DISTINCT d0) AS INT) AS day0_candidates FROM be GROUP BY accession, event_type""")
def resolve_times(spark, sf_dir):
    return built(spark, sf_dir).select("event_id", "day0", "day0_candidates")


@register("j41_hour_histogram", "SELECT CAST(date_part('hour', ts) AS INT) AS hour, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def hour_histogram(spark, sf_dir):
    return events.hour_histogram(load(spark, sf_dir, "events"), "ts").withColumn("share", F.round("share", 6))


# ---------------------------------------------------------------- id map


@register("j06_ticker_ranges", f"""WITH h AS (SELECT o_orderpriority || '-' || CAST(o_custkey % 40 AS VARCHAR) AS ticker, o_custkey AS cik, CASE WHEN o_custkey % 4 = 0 AND o_orderstatus = 'O' THEN NULL ELSE {DAY} END AS delisted FROM orders),
l AS (SELECT ticker, cik, CASE WHEN count(*) > count(delisted) THEN NULL ELSE max(delisted) END AS delisted FROM h GROUP BY 1, 2)
SELECT ticker, cik, last_value(delisted IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY delisted NULLS LAST, CAST(cik AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS valid_from, delisted AS valid_to FROM l""")
def ticker_ranges(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    ticker = F.concat_ws("-", "o_orderpriority", (F.col("o_custkey") % 40).cast("string"))
    delisted = F.when(~((F.col("o_custkey") % 4 == 0) & (F.col("o_orderstatus") == "O")), F.to_date("o_orderdate"))
    raw = o.select(ticker.alias("ticker"), F.col("o_custkey").alias("cik"), F.lit("n").alias("name"), F.lit("CS").alias("type"), F.lit(None).cast("string").alias("composite_figi"), delisted.alias("delisted"))
    return idmap.ticker_ranges(raw).select("ticker", "cik", "valid_from", "valid_to")


@register("j08_event_tickers", f"""WITH v AS (SELECT o_orderpriority AS t, date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS volume FROM orders GROUP BY 1, 2),
h AS (SELECT o.o_orderkey, m.ticker, m.valid_to, (SELECT sum(v.volume) FROM v WHERE v.t = m.ticker AND v.m BETWEEN date_trunc('month', o.o_orderdate) - INTERVAL 1 MONTH AND date_trunc('month', o.o_orderdate)) AS vol
  FROM orders o LEFT JOIN ({RANGES}) m ON m.cik = o.o_custkey AND (m.valid_from IS NULL OR {DAY} >= m.valid_from) AND (m.valid_to IS NULL OR {DAY} <= m.valid_to))
SELECT CAST(o_orderkey AS VARCHAR) AS event_id, ticker, CASE WHEN ticker IS NOT NULL THEN 'map' END AS ticker_source FROM h QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY round(coalesce(vol, 0), 2) DESC, ticker) = 1""")
def event_tickers(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    ev = o.select(F.col("o_orderkey").cast("string").alias("event_id"), F.col("o_custkey").alias("cik"), F.to_date("o_orderdate").alias("day0"))
    vol = o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.sum("o_totalprice").alias("volume"))
    return idmap.event_tickers(ev, ranges(spark, sf_dir).withColumn("type", F.lit("CS")), vol).select("event_id", "ticker", "ticker_source")


@register("j15_coverage", f"""WITH h AS (SELECT o_orderkey, o_orderstatus, {DAY} AS d, EXISTS (SELECT 1 FROM ({RANGES}) m WHERE m.cik = o_custkey AND m.ticker = '1-URGENT' AND (m.valid_from IS NULL OR {DAY} >= m.valid_from) AND (m.valid_to IS NULL OR {DAY} <= m.valid_to)) AS hit FROM orders)
SELECT o_orderstatus AS event_type, CAST(year(d) AS INT) AS year, count(*) AS n, count(*) FILTER (WHERE hit) AS with_ticker, round(avg(hit::INT), 6) AS share FROM h GROUP BY 1, 2""")
def coverage(spark, sf_dir):
    ev = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("cik"), F.col("o_orderstatus").alias("event_type"), F.to_date("o_orderdate").alias("day0"))
    t = idmap.event_tickers(ev, ranges(spark, sf_dir).where("ticker = '1-URGENT'").withColumn("type", F.lit("CS")))
    return idmap.coverage(ev, t).withColumn("share", F.round("share", 6))


SPAC_SQL = r"'(?i)\bacquisition\s+(?:corp|corporation|company|co|inc|ltd|limited|holdings)\b|\bacquisitions?\s+corp\b|\bblank check\b'"
FIRM = "CASE c_custkey % 9 WHEN 1 THEN 'Alpha Acquisition Corp' WHEN 2 THEN 'Acquisition Partners' ELSE c_name END"
FORMER = "CASE c_custkey % 10 WHEN 3 THEN 'Older Name|Beta Acquisitions Corp.' ELSE 'Older Name' END"


@register("j16_audit_targets", f"""WITH t AS (SELECT o_orderkey, o_custkey, {DAY} AS d, CASE WHEN o_orderkey % 2 = 0 THEN 'T' || (o_custkey % 50) END AS ticker FROM orders WHERE o_orderpriority = '3-MEDIUM'),
f AS (SELECT o_custkey, {DAY} AS fd, CASE o_orderkey % 5 WHEN 0 THEN 'SC TO-T' WHEN 1 THEN '25-NSE' WHEN 2 THEN 'SC 13E3' WHEN 3 THEN '25' ELSE '15-12B' END AS form FROM orders WHERE o_orderstatus = 'P'),
x AS (SELECT t.*, (SELECT min(fd) FROM f WHERE f.o_custkey = t.o_custkey AND form IN ('25-NSE', '15-12B') AND fd BETWEEN d AND d + 730) AS exit_date,
  EXISTS (SELECT 1 FROM f WHERE f.o_custkey = t.o_custkey AND form IN ('SC 14D9', 'SC 13E3') AND fd BETWEEN d - 30 AND d + 365) AS tender FROM t),
y AS (SELECT x.*, CASE WHEN c_nationkey < 3 OR regexp_matches({FIRM} || '|' || {FORMER} || '|' || CASE WHEN ticker IS NOT NULL AND c_custkey % 7 = 0 AND d >= DATE '1997-01-01' THEN 'Gamma Blank Check Co' ELSE '' END, {SPAC_SQL}) THEN 'spac'
  WHEN tender THEN 'tender_or_13e3' WHEN exit_date IS NOT NULL THEN 'delisted_after' ELSE 'unconfirmed' END AS category FROM x JOIN customer ON c_custkey = o_custkey)
SELECT CAST(o_orderkey AS VARCHAR) AS event_id, category, category IN ('tender_or_13e3', 'delisted_after') AS in_target_set, exit_date FROM y""")
def audit_targets(spark, sf_dir):
    o = load(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    k, own = F.col("o_orderkey"), lambda c: F.concat(F.lit("T"), (F.col(c) % 50).cast("string"))
    t = o.where("o_orderpriority = '3-MEDIUM'").select(k.cast("string").alias("event_id"), F.col("o_custkey").alias("cik"), F.col("d").alias("day0"), F.when(k % 2 == 0, own("o_custkey")).alias("ticker"))
    form = F.element_at(F.array(*map(F.lit, ("SC TO-T", "25-NSE", "SC 13E3", "25", "15-12B"))), (k % 5 + 1).cast("int"))
    f = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("cik"), form.alias("form"), F.col("d").alias("filing_date"))
    c, n = load(spark, sf_dir, "customer"), F.col("c_custkey")
    firms = c.select(n.alias("cik"), F.when(n % 9 == 1, "Alpha Acquisition Corp").when(n % 9 == 2, "Acquisition Partners").otherwise(F.col("c_name")).alias("name"),
                     F.when(n % 10 == 3, "Older Name|Beta Acquisitions Corp.").otherwise("Older Name").alias("former_names"), F.when(F.col("c_nationkey") < 3, "6770").otherwise("2834").alias("sic"))
    m = c.select(own("c_custkey").alias("ticker"), n.alias("cik"), F.when(n % 7 == 0, "Gamma Blank Check Co").otherwise("Plain").alias("name"), F.lit("1997-01-01").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return idmap.audit_targets(t, f, firms, m)


# ---------------------------------------------------------------- day-0 rules


@register("j17_daily_rule", f"""WITH {P.sql_calendar()},
rw AS (SELECT symbol, date, volume, close / lag(close) OVER w - mc / lag(mc) OVER w AS ar, row_number() OVER w AS i FROM (SELECT b0.symbol, b0.date, b0.close, b0.volume, m0.close AS mc FROM b0 JOIN m0 USING (date)) WINDOW w AS (PARTITION BY symbol ORDER BY date)),
e AS (SELECT event_id, symbol, day0, CASE WHEN event_id % 2 = 0 THEN (SELECT session FROM s WHERE s.idx = ev.i0 - 1) END AS acc, (SELECT i FROM rw WHERE rw.symbol = ev.symbol AND rw.date = ev.day0) AS i0 FROM ev WHERE day0 IS NOT NULL),
j AS (SELECT e.event_id, rw.date, rw.ar, rw.volume, rw.i - e.i0 AS rel FROM e JOIN rw ON rw.symbol = e.symbol AND rw.i BETWEEN e.i0 - 250 AND e.i0),
b1 AS (SELECT event_id, median(ar) AS md, nullif(median(volume), 0) AS mv, count(ar) AS n FROM j WHERE rel <= -31 GROUP BY 1),
b2 AS (SELECT event_id, any_value(mv) AS mv, any_value(n) AS n, greatest(0.05, 3 * 1.4826 * median(abs(ar - md))) AS thr FROM j JOIN b1 USING (event_id) WHERE rel <= -31 GROUP BY 1 HAVING any_value(n) >= 60),
c AS (SELECT j.*, thr, volume / mv AS vr, (SELECT product(1 + coalesce(k.ar, 0)) FROM j k WHERE k.event_id = j.event_id AND k.rel >= j.rel) - 1 AS cum FROM j JOIN b2 USING (event_id) WHERE rel >= -2),
k AS (SELECT *, CASE WHEN abs(ar) >= thr AND vr >= 3 THEN thr WHEN abs(ar) >= 0.05 AND vr >= 10 THEN 0.05 END AS bar FROM c),
h AS (SELECT event_id, list(date ORDER BY date) FILTER (WHERE sign(cum) = sign(ar) AND abs(cum) >= bar / 2) AS hits, max(date) FILTER (WHERE rel = -1) AS prev FROM k GROUP BY 1),
z AS (SELECT e.*, h.event_id IS NOT NULL AS ok, coalesce(h.prev = acc AND list_contains(hits, acc), false) AS sh, coalesce(hits, []) AS hits FROM e LEFT JOIN h USING (event_id))
SELECT event_id, CASE WHEN sh THEN acc ELSE day0 END AS day0, CASE WHEN NOT ok THEN '8k_no_data' WHEN sh THEN 'late_8k_shift' WHEN list_contains(hits, day0) THEN '8k_confirmed' ELSE '8k_no_move' END AS basis, CAST(sh AS INT) AS shift,
  array_to_string(list_transform(list_filter(hits, lambda d: d < CASE WHEN sh THEN acc ELSE day0 END), lambda d: CAST(d AS VARCHAR)), '|') AS prior_moves FROM z""")
def daily_rule(spark, sf_dir):
    rows = daymove.market_rows(P.bars(spark, sf_dir), P.market(spark, sf_dir))
    before = P.sessions(spark, sf_dir).select((F.col("idx") + 1).alias("i0"), F.col("session").alias("_before"))
    ev = P.announcements(spark, sf_dir).where("day0 IS NOT NULL").join(F.broadcast(before), "i0", "left")
    # Half of the filings come in at 17:00 of the session before.
    stamp = F.to_timestamp_ntz(F.date_format("_before", "yyyy-MM-dd")) + F.make_dt_interval(hours=F.lit(17))
    ev = ev.select("event_id", "symbol", F.col("day0").alias("day0_8k"), F.when(F.col("event_id") % 2 == 0, stamp).alias("accepted"))
    return daymove.choose_day0(ev, rows).drop("note")


@register("j18_first_move", """WITH s AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS idx FROM (SELECT DISTINCT CAST(ts AS DATE) AS session FROM events)),
b AS (SELECT user_id, ts, idx, 100 + value / 10 AS c, CASE WHEN event_id % 5 = 0 THEN 900.0 ELSE 100.0 END AS v, date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + floor(date_part('second', ts)) AS sec
      FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1) JOIN s ON session = CAST(ts AS DATE)),
r AS (SELECT * FROM b WHERE sec >= 34200 AND sec < 57600),
cl AS (SELECT user_id, idx, max_by(c, ts) AS close FROM r GROUP BY 1, 2),
e AS (SELECT DISTINCT user_id, idx AS i0 FROM b),
bc AS (SELECT e.user_id, i0, close, close / lag(close) OVER (PARTITION BY e.user_id, i0 ORDER BY idx) - 1 AS ret FROM e JOIN cl ON cl.user_id = e.user_id AND idx BETWEEN i0 - 12 AND i0 - 3),
sd AS (SELECT user_id, i0, count(*) AS n, greatest(0.05, 3 * coalesce(stddev_samp(ret), 0)) AS thr FROM bc GROUP BY 1, 2 HAVING count(*) >= 3),
bv AS (SELECT e.user_id, i0, median(v) AS bv FROM e JOIN r ON r.user_id = e.user_id AND idx BETWEEN i0 - 12 AND i0 - 3 GROUP BY 1, 2),
w AS (SELECT e.i0, b.*, median(c) OVER (PARTITION BY e.user_id, i0 ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS nxt FROM e JOIN b ON b.user_id = e.user_id AND idx BETWEEN i0 - 2 AND i0),
x AS (SELECT w.*, cl.close AS ref, thr, bv FROM w JOIN sd USING (user_id, i0) JOIN bv USING (user_id, i0) LEFT JOIN cl ON cl.user_id = w.user_id AND cl.idx = CASE WHEN sec >= 57600 THEN w.idx ELSE w.idx - 1 END),
h AS (SELECT user_id, i0, min(ts) AS hit_ts, arg_min(c / ref - 1, ts) AS move FROM x WHERE ref > 0 AND abs(c / ref - 1) >= thr AND v >= 5 * bv AND (nxt / ref - 1) * CASE WHEN c > ref THEN 1 ELSE -1 END >= thr / 2 GROUP BY 1, 2)
SELECT e.user_id, e.i0, epoch_us(hit_ts) AS at_us, round(move, 6) AS move, round(thr, 6) AS threshold FROM e LEFT JOIN sd USING (user_id, i0) LEFT JOIN h USING (user_id, i0)""")
def first_move(spark, sf_dir):
    """Events as minutes of a user's stock, each user's days as its filings' day 0."""
    one = F.row_number().over(Window.partitionBy("user_id", "ts").orderBy("event_id"))
    raw = load(spark, sf_dir, "events")
    cal = calendar.numbered(raw.select(F.to_date("ts").alias("session")))
    b = raw.withColumn("rn", one).where("rn = 1").select(F.col("user_id").alias("symbol"), "ts", (100 + F.col("value") / 10).alias("c"), F.when(F.col("event_id") % 5 == 0, 900.0).otherwise(100.0).alias("v"))
    days = b.select("symbol", F.to_date("ts").alias("day0")).distinct()
    ev = days.join(F.broadcast(cal.withColumnRenamed("session", "day0")), "day0").select(F.struct("symbol", F.col("idx").alias("i0")).alias("event_id"), "symbol", "day0")
    made = daymove.first_move(ev, b, cal)
    return made.select(F.col("event_id.symbol").alias("user_id"), F.col("event_id.i0").alias("i0"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.round("move", 6).alias("move"), F.round("threshold", 6).alias("threshold"))


# ---------------------------------------------------------------- matching


@register("d09_session_distance", f"WITH {P.sql_calendar()} SELECT a.event_id AS a, b.event_id AS b, b.i0 - a.i0 AS gap FROM ev a JOIN ev b ON a.cik = b.cik AND a.type = 'F' AND b.type = 'O' AND abs(a.i0 - b.i0) <= 3")
def session_distance(spark, sf_dir):
    ev = P.announcements(spark, sf_dir)
    a = ev.where("type = 'F'").select("cik", F.col("event_id").alias("a"), F.col("i0").alias("ai"))
    b = ev.where("type = 'O'").select("cik", F.col("event_id").alias("b"), F.col("i0").alias("bi"))
    return a.join(b, "cik").where(F.abs(F.col("ai") - F.col("bi")) <= 3).select("a", "b", (F.col("bi") - F.col("ai")).alias("gap"))


@register("j10_match", f"""WITH {P.sql_calendar()},
t AS (SELECT o_orderkey AS row_id, o_custkey AS cik, CASE WHEN o_orderkey % 3 = 0 THEN {DAY} + 2 END AS ad, CASE WHEN o_orderkey % 3 = 1 THEN {DAY} - 5 END AS lt,
        CASE o_orderstatus WHEN 'F' THEN 'earnings' ELSE 'acquisition_target' END AS et, 'in ' || CAST(year(o_orderdate) AS VARCHAR) AS evd, {DAY} + 900 AS rd FROM orders WHERE o_orderpriority = '5-LOW'),
e AS (SELECT event_id, cik, CASE type WHEN 'P' THEN 'acquisition_target' ELSE 'earnings' END AS etype, day0, i0 FROM ev WHERE day0 IS NOT NULL),
t2 AS (SELECT t.*, (SELECT min(idx) FROM s WHERE session >= t.ad) AS ai FROM t),
p AS (SELECT t2.*, e.event_id, e.etype, e.day0, e.i0 FROM t2 JOIN e ON e.cik = t2.cik AND e.day0 < t2.rd),
a AS (SELECT row_id, event_id, i0 - ai AS sg FROM p WHERE ai IS NOT NULL AND abs(i0 - ai) <= 3 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY et = etype DESC, abs(i0 - ai), day0, event_id) = 1),
b AS (SELECT row_id, event_id FROM p WHERE ad IS NULL AND lt IS NOT NULL AND day0 > lt AND day0 <= lt + 30 QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY et = etype DESC, day0, event_id) = 1),
c AS (SELECT row_id, count(*) AS n, min(event_id) AS one, count(*) FILTER (WHERE 'in ' || CAST(year(day0) AS VARCHAR) = evd) AS ny, min(event_id) FILTER (WHERE 'in ' || CAST(year(day0) AS VARCHAR) = evd) AS oney FROM p
       WHERE ad IS NULL AND lt IS NULL AND et = 'acquisition_target' AND etype = 'acquisition_target' GROUP BY 1),
k AS (SELECT DISTINCT cik, true AS known FROM e),
fu AS (SELECT t2.row_id, t2.cik, t2.ad, t2.lt, t2.et, known, a.event_id AS ae, a.sg, b.event_id AS be, c.n, CASE WHEN n = 1 THEN one WHEN ny = 1 THEN oney END AS ce FROM t2 LEFT JOIN k USING (cik) LEFT JOIN a USING (row_id) LEFT JOIN b USING (row_id) LEFT JOIN c USING (row_id)),
g AS (SELECT *, CASE WHEN ad IS NOT NULL THEN ae WHEN lt IS NOT NULL THEN be ELSE ce END AS event_id FROM fu)
SELECT row_id, cik, event_id, CASE WHEN ad IS NOT NULL THEN sg END AS session_gap, CASE WHEN event_id IS NOT NULL THEN CASE WHEN ad IS NOT NULL THEN 'announcement_date' WHEN lt IS NOT NULL THEN 'last_trade_date' ELSE 'target_only' END END AS date_source,
  CASE WHEN event_id IS NULL THEN CASE WHEN known IS NULL THEN 'no_event_for_cik' WHEN ad IS NOT NULL THEN 'no_event_in_window' WHEN lt IS NOT NULL THEN 'no_event_after_trades' WHEN et <> 'acquisition_target' THEN 'no_dates' WHEN n IS NULL THEN 'no_target_event' ELSE 'ambiguous_target' END END AS reason FROM g""")
def match(spark, sf_dir):
    o = load(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").withColumn("d", F.to_date("o_orderdate"))
    k = F.col("o_orderkey") % 3
    t = o.select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("cik"), F.lit(None).cast("string").alias("name_reason"), F.when(k == 0, F.date_add("d", 2)).alias("announcement_date"), F.when(k == 1, F.date_sub("d", 5)).alias("last_trade_date"),
                 F.when(F.col("o_orderstatus") == "F", "earnings").otherwise("acquisition_target").alias("event_type"), F.concat(F.lit("in "), F.year("d").cast("string")).alias("evidence"), F.date_add("d", 900).alias("release_date"))
    ev = P.announcements(spark, sf_dir).where("day0 IS NOT NULL").select("event_id", "cik", F.when(F.col("type") == "P", "acquisition_target").otherwise("earnings").alias("event_type"), "day0")
    return entity.match_events(t, ev, P.sessions(spark, sf_dir))


@register("j11_charged", "SELECT d.doc_id AS event_id, count(l.doc_id) > 0 AS is_charged, string_agg(DISTINCT CAST(l.quality AS VARCHAR), '|' ORDER BY CAST(l.quality AS VARCHAR)) AS lr_numbers FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND l.toxic = 1 GROUP BY 1")
def charged(spark, sf_dir):
    ev = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"))
    lab = load(spark, sf_dir, "labels").where("toxic = 1")
    m = lab.select(F.col("doc_id").alias("row_id"), F.col("doc_id").alias("event_id"))
    return entity.charged(ev, m, lab.select(F.col("doc_id").alias("row_id"), F.col("quality").cast("string").alias("lr_no"))).select("event_id", "is_charged", "lr_numbers")


@register("j09_resolve_cik_exact", "SELECT o_orderkey, c_custkey AS cik, CASE WHEN c_custkey IS NOT NULL THEN 'exact' END AS name_method FROM orders LEFT JOIN customer ON c_custkey = CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_custkey END")
def resolve_cik(spark, sf_dir):
    """Names as written in releases: other case, tags and legal forms."""
    o = load(spark, sf_dir, "orders")
    number = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    name = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("CUSTOMER#"), number, F.lit(", Inc. /DE/"))).otherwise("Zzyzx Qwerty")
    made = entity.resolve_cik(o.select("o_orderkey", name.alias("issuer_name")), companies(spark, sf_dir))
    return made.select("o_orderkey", "cik", "name_method")


# ---------------------------------------------------------------- text


WRITTEN = "CASE s_suppkey % 7 WHEN 0 THEN s_name || ', Inc. /DE/' WHEN 1 THEN 'The ' || s_name || ' & Sons Co.' WHEN 2 THEN s_name || ' Trust d/b/a Other Name' WHEN 3 THEN 'O''' || s_name || ' Class A' WHEN 4 THEN 'The Company, Inc.' WHEN 5 THEN s_name || '/NEW/ International Holdings' ELSE s_name END"
STOP_SQL = "['inc', 'incorporated', 'corp', 'corporation', 'co', 'company', 'ltd', 'limited', 'plc', 'holdings', 'holding', 'group', 'lp', 'llc', 'sa', 'nv', 'ag', 'the', 'de', 'class', 'a', 'b', '']"


@register("t01_company_name", rf"""SELECT s_suppkey, array_to_string(list_filter(string_split(regexp_replace(replace(regexp_replace(regexp_replace(lower({WRITTEN}), '/[a-z]{{2,3}}/?', ' ', 'g'), '\bd/?b/?a\b.*$', ' ', 'g'), '&', ' and '), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: NOT list_contains({STOP_SQL}, w)), ' ') AS name FROM supplier""")
def company_name(spark, sf_dir):
    k, n = F.col("s_suppkey") % 7, F.col("s_name")
    forms = (F.concat(n, F.lit(", Inc. /DE/")), F.concat(F.lit("The "), n, F.lit(" & Sons Co.")), F.concat(n, F.lit(" Trust d/b/a Other Name")), F.concat(F.lit("O'"), n, F.lit(" Class A")),
             F.lit("The Company, Inc."), F.concat(n, F.lit("/NEW/ International Holdings")), n)
    written = F.element_at(F.array(*forms), (k + 1).cast("int"))
    return load(spark, sf_dir, "supplier").select("s_suppkey", text.company_name(written).alias("name"))


@register("t02_canonical_quote", r"""SELECT doc_id, contains(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), lower(trim(regexp_replace(substr(text, 5, 60), '\s+', ' ', 'g')))) AS found FROM documents""")
def canonical_quote(spark, sf_dir):
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", F.contains(text.canonical(t), text.canonical(F.substring(t, 5, 60))).alias("found"))


STATED = "CASE o_orderkey % 8 WHEN 0 THEN strftime(d, '%B %-d, %Y') WHEN 1 THEN strftime(d, '%b. %-d %Y') WHEN 2 THEN strftime(d, '%-m/%-d/%Y') WHEN 3 THEN strftime(d, '%m/%d/%Y') WHEN 4 THEN strftime(d, '%-d %B %Y') WHEN 5 THEN strftime(d, '%B %Y') WHEN 6 THEN strftime(d + 1, '%B %-d, %Y') ELSE upper(strftime(d, '%B  %-d, %Y')) END"


@register("j33_verify_date", rf"""WITH x AS (SELECT o_orderkey, {DAY} AS d FROM orders),
y AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN d END AS d, CASE WHEN o_orderkey % 13 <> 0 THEN 'On  ' || {STATED} || ' it said' END AS q, 'News. ON ' || CASE WHEN o_orderkey % 5 = 0 THEN 'some day' ELSE {STATED} END || ' it SAID so.' AS t FROM x),
z AS (SELECT *, contains(lower(trim(regexp_replace(t, '\s+', ' ', 'g'))), lower(trim(regexp_replace(q, '\s+', ' ', 'g')))) AS found,
  regexp_matches(q, '(?i)(?:' || strftime(d, '%B') || '|' || strftime(d, '%b') || ')\.?\s+' || strftime(d, '%-d,?') || '\s+' || strftime(d, '%Y') || '|\b' || strftime(d, '%-m/%-d/%Y') || '\b|\b' || strftime(d, '%m/%d/%Y') || '\b') AS holds FROM y)
SELECT o_orderkey, CASE WHEN found AND holds THEN d END AS day, CASE WHEN d IS NULL THEN 'none_given' WHEN q IS NULL OR NOT found THEN 'quote_not_in_release' WHEN NOT holds THEN 'quote_lacks_full_date' ELSE 'verified' END AS reason FROM z""")
def verify_date(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    forms = [F.date_format(d, f) for f in ("MMMM d, yyyy", "MMM. d yyyy", "M/d/yyyy", "MM/dd/yyyy", "d MMMM yyyy", "MMMM yyyy")]
    stated = F.element_at(F.array(*forms, F.date_format(F.date_add(d, 1), "MMMM d, yyyy"), F.upper(F.date_format(d, "MMMM  d, yyyy"))), (k % 8 + 1).cast("int"))
    quote = F.when(k % 13 != 0, F.concat(F.lit("On  "), stated, F.lit(" it said")))
    body = F.concat(F.lit("News. ON "), F.when(k % 5 == 0, "some day").otherwise(stated), F.lit(" it SAID so."))
    return load(spark, sf_dir, "orders").select("o_orderkey", text.verify_date(F.when(k % 11 != 0, d), quote, body).alias("v")).select("o_orderkey", "v.*")


@register("t03_any_date", f"SELECT o_orderkey, {DAY} AS d FROM orders")
def any_date(spark, sf_dir):
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 5
    written = F.when(k == 0, F.date_format(d, "MMMM d, yyyy")).when(k == 1, F.date_format(d, "MMM. d, yyyy")).when(k == 2, F.date_format(d, "d MMMM yyyy")).when(k == 3, F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "MM/dd/yyyy"))
    return load(spark, sf_dir, "orders").select("o_orderkey", text.any_date(written).alias("d"))


@register("t04_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_props(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))


@register("t05_redirect_target", "SELECT page_id, url AS target FROM pages")
def redirect_target(spark, sf_dir):
    url, k = F.col("url"), F.col("page_id") % 3
    coded = F.translate(F.regexp_replace(F.base64(F.encode(url, "UTF-8")), "=+$", ""), "+/", "-_")
    link = F.when(k == 0, url).when(k == 1, F.concat(F.lit("https://s.example/l/?uddg="), F.url_encode(url), F.lit("&r=1"))).otherwise(F.concat(F.lit("https://s.example/ck?x=1&u=a1"), F.translate(coded, "\r\n", "")))
    return load(spark, sf_dir, "pages").select("page_id", text.redirect_target(link).alias("target"))


@register("t06_sic_division", "SELECT p_partkey, CASE WHEN s BETWEEN 1 AND 9 THEN 'A' WHEN s BETWEEN 10 AND 14 THEN 'B' WHEN s BETWEEN 15 AND 17 THEN 'C' WHEN s BETWEEN 20 AND 39 THEN 'D' WHEN s BETWEEN 40 AND 49 THEN 'E' WHEN s BETWEEN 50 AND 51 THEN 'F' WHEN s BETWEEN 52 AND 59 THEN 'G' WHEN s BETWEEN 60 AND 67 THEN 'H' WHEN s BETWEEN 70 AND 89 THEN 'I' WHEN s BETWEEN 91 AND 99 THEN 'J' ELSE '?' END AS division FROM (SELECT p_partkey, CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey * 13) % 10000 // 100 END AS s FROM part)")
def sic_division(spark, sf_dir):
    """Codes with and without leading zeros; every 17th is missing or a word."""
    k = F.col("p_partkey")
    code = (k * 13 % 10000).cast("string")
    written = F.when(k % 34 == 0, "none").when(k % 17 != 0, F.when(k % 2 == 0, F.lpad(code, 4, "0")).otherwise(code))
    return load(spark, sf_dir, "part").select("p_partkey", text.sic_division(written).alias("division"))


@register("t07_years_in", r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\b((?:19|20)\d{2})\b', 1), lambda y: CAST(y AS INT)))), ',') AS years FROM documents")
def years_in(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(text.years_in(F.col("text")).cast("array<string>"), ",").alias("years"))


@register("j44_truncation", "SELECT count(*) AS n, count(*) FILTER (WHERE length(text) > (5120 - 1500) * 4) AS cut, round(count(*) FILTER (WHERE length(text) > (5120 - 1500) * 4) / count(*), 6) AS share FROM documents")
def truncation(spark, sf_dir):
    long = F.length("text") > (5120 - 1500) * 4
    return load(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_if(long).alias("cut"), F.round(F.count_if(long) / F.count("*"), 6).alias("share"))


READ_TICKER = "CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN m WHEN 3 THEN m || 'W' WHEN 4 THEN m || '.UN' WHEN 5 THEN 'T' || (o_orderkey % 60) WHEN 6 THEN m || 'R' ELSE 'T' || ((o_custkey + 1) % 50) END"


@register("j14_classify", f"""WITH r AS (SELECT DISTINCT 'T' || ((c_custkey + k) % 50) AS ticker, c_custkey AS cik FROM customer, (SELECT unnest([0, 1]) AS k)),
x AS (SELECT o_orderkey, o_custkey, m, {READ_TICKER} AS f FROM (SELECT *, 'T' || (o_custkey % 50) AS m FROM orders))
SELECT o_orderkey, CASE WHEN coalesce(f, '') = '' THEN 'no_ticker_in_release' WHEN f = m THEN 'agree' WHEN regexp_full_match(f, m || '[.-]?(U|UN|W|WS|WT)') THEN 'units_or_warrants'
  WHEN NOT EXISTS (SELECT 1 FROM r WHERE ticker = f) THEN 'release_ticker_not_in_map' WHEN EXISTS (SELECT 1 FROM r WHERE ticker = f AND cik = o_custkey) THEN 'same_company_other_ticker' ELSE 'release_ticker_other_company' END AS outcome FROM x""")
def classify(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = lambda x: F.concat(F.lit("T"), x.cast("string"))
    m = t(c % 50)
    read = F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), m, F.concat(m, F.lit("W")), F.concat(m, F.lit(".UN")), t(k % 60), F.concat(m, F.lit("R")), t((c + 1) % 50)), (k % 8 + 1).cast("int"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", c.alias("cik"), m.alias("map_ticker"), read.alias("release_ticker"))
    held = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cik"), F.explode(F.array(t(F.col("c_custkey") % 50), t((F.col("c_custkey") + 1) % 50))).alias("ticker"))
    return idmap.classified(rows, held).select("o_orderkey", "outcome")


@register("c_new_york_offset", f"SELECT DISTINCT {DAY} AS d, 17 - CAST(date_part('hour', (CAST({DAY} AS TIMESTAMP) + INTERVAL 17 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS INT) AS hours FROM orders")
def new_york_offset(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return load(spark, sf_dir, "orders").select(d.alias("d")).distinct().select("d", calendar.new_york_offset_hours(F.col("d")).alias("hours"))
