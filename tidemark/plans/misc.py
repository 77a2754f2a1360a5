"""Queries of models, pages, releases, loads and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import calendar, checks, entity, idmap, models, releases
from ..sources import bars, warehouse
from ..streaming import windows
from . import proxies as P
from .registry import register
from .study import TIMES_SQL, built, scored

load = P.load
DAY = "CAST(o_orderdate AS DATE)"


@register("k01_isolation_forest")
def isolation_forest(spark, sf_dir):
    df = scored(spark, sf_dir).select("event_id", "z_m1", "z_m2", "charged")
    return models.isolation_forest(df, df, ["z_m1", "z_m2"])


@register("k02_boosted_trees")
def boosted(spark, sf_dir):
    df = scored(spark, sf_dir).select("event_id", "z_m1", "z_m2", "charged")
    return models.supervised(df, df, ["z_m1", "z_m2"], "charged")


@register("k03_out_of_fold")
def out_of_fold(spark, sf_dir):
    df = scored(spark, sf_dir).select("event_id", "z_m1", "z_m2", "charged")
    return models.out_of_fold(df, ["z_m1", "z_m2"], "charged", "event_id")


UNESCAPE = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
TITLE = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"


@register("j36_page_texts", f"SELECT page_id, trim(regexp_replace({UNESCAPE.format(TITLE)}, '\\s+', ' ', 'g')) AS headline, CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2023-11-02 06:00:00' + to_hours(page_id % 5) WHEN page_id % 3 = 1 THEN TIMESTAMP '2024-01-15 14:30:00' END AS published, CASE page_id % 3 WHEN 0 THEN 'json-ld' WHEN 1 THEN 'page text' ELSE 'no time on page' END AS published_from, CAST(len(regexp_extract_all(html, '<a href')) AS BIGINT) AS n_links FROM pages")
def page_texts(spark, sf_dir):
    """Pages with a stamp in UTC, with a visible Eastern time, or a date alone."""
    k = F.col("page_id")
    stamp = F.format_string('<script type="application/ld+json">{"@graph": [{"datePublished": "2023-11-02T%02d:00:00Z"}]}</script>', k % 5 + 10)
    added = F.when(k % 3 == 0, stamp).when(k % 3 == 1, "<p>Jan. 15, 2024, 2:30 PM ET</p>").otherwise('<time datetime="2024-01-15">x</time><meta name="date" content="2024-01-15">')
    return releases.page_texts(load(spark, sf_dir, "pages").select("page_id", F.concat("html", added).alias("html"))).drop("n_text")


@register("j35_parse_releases", """SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN 20000 + page_id END AS lr_no, CASE WHEN page_id % 7 <> 0 THEN 'SEC v. Doe No. ' || page_id END AS respondents,
CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 IN (0, 1, 2) THEN DATE '2019-03-04' + CAST(page_id % 300 AS INT) WHEN page_id % 5 = 3 THEN DATE '2020-02-03' END AS release_date,
page_id % 7 <> 0 AND page_id % 2 = 0 AS is_insider_candidate, page_id % 7 <> 0 AND page_id % 3 = 0 AS mentions_finra, page_id % 7 <> 0 AND page_id % 3 = 1 AS mentions_options,
CASE WHEN page_id % 7 <> 0 THEN length(html) > 0 END AS has_text FROM pages""")
def parse_releases(spark, sf_dir):
    """Pages as releases: heads of several forms, a footer that is cut off, the
    page's own article between them. Every seventh has no head."""
    k, d = F.col("page_id"), F.date_add(F.lit("2019-03-04").cast("date"), (F.col("page_id") % 300).cast("int"))
    written = lambda f: F.date_format(d, f)
    day = (F.when(k % 5 == 0, F.concat(F.lit(" / "), written("MMMM d, yyyy"))).when(k % 5 == 1, F.concat(F.lit(" / "), written("MMM. d yyyy")))
           .when(k % 5 == 2, F.concat(F.lit("</p><p>"), written("MMMM d. yyyy"))).otherwise(F.lit("")))
    head = F.when(k % 7 != 0, F.concat(F.lit("<p>Litigation Release No. "), (k + 20000).cast("string"), day, F.lit("</p>"))).otherwise(F.lit("<p>A notice</p>"))
    clause = F.concat(F.when(k % 2 == 0, "<p>He was tipped.</p>").otherwise(""), F.when(k % 3 == 0, "<p>FINRA helped.</p>").when(k % 3 == 1, "<p>He bought call options.</p>").otherwise("<p>Employee options, finra</p>"))
    stamp = F.when(k % 5 == 3, '<time datetime="2020-02-03T10:00">x</time>').otherwise("")
    whole = F.concat(F.lit("<html><body><nav>insider trading FINRA</nav><main><h1>SEC v. Doe No. "), k.cast("string"), F.lit("</h1>"), head, clause, F.lit("<article>"), F.regexp_extract("html", "(?s)<p>(.*?)</p>", 0), F.lit("</article><p>Last Reviewed or Updated: insider trading, FINRA, options contract</p></main>"), stamp, F.lit("</body></html>"))
    made = releases.parse_releases(load(spark, sf_dir, "pages").select("page_id", whole.alias("html")))
    return made.select("page_id", "lr_no", "respondents", "release_date", "is_insider_candidate", "mentions_finra", "mentions_options", (F.length("text") > 0).alias("has_text"))


@register("j45_result_links", f"""WITH a AS (SELECT unnest(regexp_extract_all(html, '<a href="(/[A-Za-z]+)">([^<]*)</a>', 1)) AS url, unnest(regexp_extract_all(html, '<a href="(/[A-Za-z]+)">([^<]*)</a>', 2)) AS t FROM pages)
SELECT url, bool_or(lower(trim(t)) IN ('the', 'of', 'and')) AS whole FROM a GROUP BY 1""")
def result_links(spark, sf_dir):
    """Article links of all pages by their path, and whether some link's words
    are all in the headline (a score of 100)."""
    made = releases.result_links(load(spark, sf_dir, "pages"), r"^/[A-Za-z]+$", "the of and")
    return made.select("url", (F.col("score") == 100).alias("whole"))


FLAGS = r"SELECT doc_id, regexp_matches(text, '(?i)insider trading|material,?\s+non-?public|non-?public information|in advance of the .{0,80}announcement|ahead of (?:the|an) .{0,40}announce|\btipp(?:ed|ee|ees|er|ing)\b') AS is_insider_candidate, regexp_matches(text, '(?i)\b(call|put)\s+options?\b|\boptions?\s+contracts?\b') AS mentions_options, regexp_matches(text, 'Financial Industry Regulatory Authority|\bFINRA\b') AS mentions_finra, regexp_matches(text, '(?i)market abuse unit') AS mentions_market_abuse_unit, regexp_matches(text, '(?i)analysis and detection center') AS mentions_detection_center FROM documents"


@register("j35_mention_flags", FLAGS)
def mention_flags(spark, sf_dir):
    flags = text.release_flags(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", *[flags[c].alias(c) for c in ("is_insider_candidate", "mentions_options", "mentions_finra", "mentions_market_abuse_unit", "mentions_detection_center")])


@register("j31_date_anomalies", """WITH o AS (SELECT o_orderkey AS lr_no, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE DATE '1992-01-01' + CAST(o_orderkey // 10 AS INT) + CASE WHEN o_orderkey % 89 = 0 THEN 60 ELSE 0 END END AS d FROM orders),
m AS (SELECT *, median(date_diff('day', DATE '1970-01-01', d)) OVER w AS md, count(d) OVER w AS n FROM o WINDOW w AS (ORDER BY lr_no ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
SELECT lr_no, d AS release_date, CASE WHEN d IS NULL THEN 'no_date' ELSE 'out_of_sequence' END AS problem, CASE WHEN n >= 3 THEN round_even(date_diff('day', DATE '1970-01-01', d) - md, 0) END AS days_from_neighbours FROM m WHERE d IS NULL OR (n >= 3 AND abs(date_diff('day', DATE '1970-01-01', d) - md) > 30)""")
def date_anomalies(spark, sf_dir):
    k = F.col("o_orderkey")
    d = F.date_add(F.lit("1992-01-01").cast("date"), (F.floor(k / 10) + F.when(k % 89 == 0, 60).otherwise(0)).cast("int"))
    rows = load(spark, sf_dir, "orders").select(k.alias("lr_no"), F.when(k % 97 != 0, d).alias("release_date"))
    return releases.date_anomalies(rows)


CLAUSES = ("He bought shares of it.", "He bought call options of it.", "He sold stock and puts.", "She exercised vested stock options and left.", "He watched the stock price and shares rose.", "He bought securities.", "ADRs and employee options were named. Options too.")
_CLAUSE = "CASE CAST(doc_id % 7 AS INT) " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CLAUSES)) + " END"
_STOCK = r"regexp_matches(regexp_replace(t, '(?i)\bstocks?\b\s*(-\s*)?(broker|price|market|exchange|options?|trading plan|purchase plan)|\bshares?\b\s+(price|rose|fell|increased|decreased|dropped|jumped|climbed|declined)', ' ', 'g'), '(?i)\bstocks?\b|\bshares?\b|\bADRs?\b|\bADSs?\b|American Deposit[ao]ry')"
_EMPLOYEE = r"'(?i)\b(?:vested|employee|exercis\w*)\b[^.]{0,60}?\b(?:stock )?options?\b'"


@register("j34_check_instruments", rf"""WITH x AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'options' WHEN 1 THEN 'stock' WHEN 2 THEN 'both' WHEN 3 THEN 'other' ELSE 'unknown' END AS v, coalesce(text, '') || '. ' || {_CLAUSE} AS t FROM documents),
y AS (SELECT doc_id, v, {_STOCK} AS st, regexp_matches(t, {_EMPLOYEE}) AS em, regexp_matches(regexp_replace(t, {_EMPLOYEE}, ' ', 'g'), '(?i)\boptions?\b|\b(?:call|put)s\b') AS op FROM x)
SELECT doc_id, CASE WHEN v = 'options' AND NOT op THEN CASE WHEN em THEN 'stock' ELSE 'unknown' END WHEN v = 'stock' AND NOT st THEN 'unknown' WHEN v = 'both' AND NOT (st AND op) THEN CASE WHEN st THEN 'stock' WHEN op THEN 'options' ELSE 'unknown' END ELSE v END AS instruments,
  CASE WHEN v = 'options' AND NOT op THEN CASE WHEN em THEN 'employee_options' ELSE 'options_not_in_release' END WHEN v = 'stock' AND NOT st THEN 'stock_not_in_release' WHEN v = 'both' AND NOT (st AND op) THEN 'both_not_in_release' ELSE 'ok' END AS reason FROM y""")
def check_instruments(spark, sf_dir):
    """Every whole text with a clause behind it, against five claims."""
    k = F.col("doc_id")
    claimed = F.element_at(F.array(*map(F.lit, ("options", "stock", "both", "other", "unknown"))), (k % 5 + 1).cast("int"))
    clause = F.element_at(F.array(*map(F.lit, CLAUSES)), (k % 7 + 1).cast("int"))
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(". "), clause)
    return load(spark, sf_dir, "documents").select("doc_id", text.check_instruments(claimed, said).alias("c")).select("doc_id", "c.*")


@register("j46_accept_page", f"""WITH x AS (SELECT o_orderkey, (o_orderkey * 7919) % 101 AS score, CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 6 AS INT) + 1 END AS page, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 2 AS INT) END AS dl, CAST(o_orderdate AS DATE) AS filed FROM orders)
SELECT o_orderkey, CASE WHEN page IS NULL THEN 'no_date' WHEN dl IS NOT NULL THEN CASE WHEN score < 75 THEN 'title' WHEN page <> dl THEN 'date' ELSE 'accepted' END WHEN score < 85 THEN 'title' WHEN filed - page BETWEEN 0 AND 3 THEN 'accepted' ELSE 'date' END AS verdict FROM x""")
def accept_page(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    page = F.when(k % 17 != 0, F.date_add(F.date_sub(d, (k % 6).cast("int")), 1))
    dateline = F.when(k % 3 != 0, F.date_sub(d, (k % 2).cast("int")))
    return load(spark, sf_dir, "orders").select("o_orderkey", releases.accept_page(k * 7919 % 101, page, dateline, d).alias("verdict"))


@register("b13_resume_ledger", "SELECT o_custkey, o_orderpriority FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
def resume_ledger(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    keys = ["o_custkey", "o_orderpriority"]
    return bars.todo(o.select(*keys).distinct(), o.where("o_orderstatus = 'P'"), keys)


@register("d21_newest_rows", "SELECT doc_id, quality, toxic, 1 AS version FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, quality, NULL, 0 FROM labels WHERE quality = 0")
def newest_rows(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    return warehouse.newest([labels.select("doc_id", "quality"), labels.where("quality = 1")], ["doc_id"])


@register("s01_tumbling_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    return windows.tumbling_counts(load(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@register("s02_sessions", """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def sessions(spark, sf_dir):
    return windows.sessions(load(spark, sf_dir, "events"))


@register("j01_exchange_calendar", """WITH RECURSIVE d AS (SELECT unnest(generate_series(DATE '2021-01-01', DATE '2024-12-31', INTERVAL 1 DAY))::DATE AS session)
SELECT session FROM d WHERE isodow(session) < 6 AND session NOT IN (
 DATE '2021-01-01', DATE '2021-01-18', DATE '2021-02-15', DATE '2021-04-02', DATE '2021-05-31', DATE '2021-07-05', DATE '2021-09-06', DATE '2021-11-25', DATE '2021-12-24',
 DATE '2022-01-17', DATE '2022-02-21', DATE '2022-04-15', DATE '2022-05-30', DATE '2022-06-20', DATE '2022-07-04', DATE '2022-09-05', DATE '2022-11-24', DATE '2022-12-26',
 DATE '2023-01-02', DATE '2023-01-16', DATE '2023-02-20', DATE '2023-04-07', DATE '2023-05-29', DATE '2023-06-19', DATE '2023-07-04', DATE '2023-09-04', DATE '2023-11-23', DATE '2023-12-25',
 DATE '2024-01-01', DATE '2024-01-15', DATE '2024-02-19', DATE '2024-03-29', DATE '2024-05-27', DATE '2024-06-19', DATE '2024-07-04', DATE '2024-09-02', DATE '2024-11-28', DATE '2024-12-25')""")
def exchange_calendar(spark, sf_dir):
    return calendar.exchange_sessions(spark, "2021-01-01", "2024-12-31").select("session")


@register("j39_hand_check_rates", "SELECT count(*) AS n, round(avg((quality IS NOT NULL)::INT), 6) AS issuer_rate, round(avg((toxic = 0)::INT), 6) AS date_rate FROM labels")
def hand_check(spark, sf_dir):
    """Checked rows against extracted ones: same issuer always, date where not toxic."""
    lab = load(spark, sf_dir, "labels")
    day = F.lit("2024-01-05").cast("date")
    checked = lab.select(F.col("doc_id").alias("lr_no"), F.lit("Acme Corp.").alias("issuer_name"), day.alias("announcement_date"))
    extracted = lab.select(F.col("doc_id").alias("lr_no"), F.lit("ACME Corporation").alias("issuer_name"), F.when(F.col("toxic") == 0, day).alias("announcement_date"))
    pairs = entity.best_pairs(extracted, checked)
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 6)
    return pairs.agg(F.count("*").alias("n"), rate("ok_issuer").alias("issuer_rate"), rate("ok_date").alias("date_rate"))


@register("j42_trade_size", "SELECT l_suppkey, max(l_quantity) AS most, sum(l_quantity) AS total, round(max(l_quantity) / sum(l_quantity), 6) AS share FROM lineitem GROUP BY 1")
def trade_size(spark, sf_dir):
    """The largest number that a text names against the window's volume."""
    said = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", F.concat(F.lit("bought "), F.col("l_quantity").cast("int").cast("string"), F.lit(" shares")).alias("t"))
    n = F.array_max(F.transform(F.regexp_extract_all("t", F.lit(r"(\d+) shares"), F.lit(1)), lambda x: x.cast("double")))
    g = said.withColumn("n", n).groupBy("l_suppkey").agg(F.max("n").alias("most"), F.sum("l_quantity").alias("total"))
    return g.withColumn("share", F.round(F.col("most") / F.col("total"), 6))


CLASS_SQL = """WITH n AS (SELECT p_partkey, 'S' || (p_partkey // 3) || substr('ABC', 1 + CAST(p_partkey % 3 AS INT), 1) AS t, CASE WHEN p_partkey % 15 = 4 THEN 'Different Firm' ELSE 'Widget ' || (p_partkey // 3) END AS firm FROM part),
v AS (SELECT t AS symbol, firm, date_trunc('month', l_shipdate)::DATE AS month, sum(CASE WHEN l_partkey % 3 = 2 THEN 40 ELSE 1 END * l_quantity) AS volume FROM lineitem JOIN n ON p_partkey = l_partkey GROUP BY ALL),
e AS (SELECT o_orderkey AS event_id, o_orderstatus AS event_type, t AS ticker, firm, date_trunc('month', o_orderdate)::DATE AS month FROM orders JOIN n ON p_partkey = o_orderkey % (SELECT count(*) FROM part)),
j AS (SELECT event_id, event_type, ticker, max(struct_pack(volume := b.volume, symbol := b.symbol)) AS s, any_value(coalesce(a.volume, 0)) AS own_volume
      FROM e LEFT JOIN v a ON a.symbol = e.ticker AND a.month = e.month JOIN v b ON b.month = e.month AND b.symbol <> e.ticker AND b.firm = e.firm AND left(b.symbol, -1) = left(e.ticker, -1) AND length(b.symbol) = length(e.ticker) WHERE length(e.ticker) >= 4 GROUP BY 1, 2, 3)
SELECT event_id, event_type, ticker, s.symbol AS sibling, s.volume AS sibling_volume, own_volume, round(s.volume / greatest(own_volume, 1), 6) AS ratio FROM j WHERE s.volume >= 10 * greatest(own_volume, 1)"""


@register("j43_share_classes", CLASS_SQL)
def share_classes(spark, sf_dir):
    """Parts in threes as a firm's share classes; one in fifteen is another firm."""
    k = F.col("p_partkey")
    parts = load(spark, sf_dir, "part")
    n = parts.select(k, F.concat(F.lit("S"), F.floor(k / 3).cast("string"), F.substr(F.lit("ABC"), (k % 3 + 1).cast("int"), F.lit(1))).alias("ticker"),
                     F.when(k % 15 == 4, "Different Firm Inc").otherwise(F.concat(F.lit("Widget "), F.floor(k / 3).cast("string"), F.lit(" Corp Series A Common Stock"))).alias("name"))
    quantity = F.when(F.col("l_partkey") % 3 == 2, 40).otherwise(1) * F.col("l_quantity")
    v = load(spark, sf_dir, "lineitem").join(n, F.col("l_partkey") == k).groupBy(F.col("ticker").alias("symbol"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("month")).agg(F.sum(quantity).alias("volume"))
    ev = load(spark, sf_dir, "orders").withColumn("p_partkey", F.col("o_orderkey") % parts.count()).join(n, "p_partkey").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderstatus").alias("event_type"), "ticker", F.to_date("o_orderdate").alias("day0"))
    return idmap.thin_share_classes(ev, v, n.select("ticker", "name")).withColumn("ratio", F.round("ratio", 6))



@register("j13_fill_worklist", f"""WITH e AS (SELECT o_custkey AS cik, CAST(year(o_orderdate) AS INT) AS year, {DAY} AS d, CAST(o_orderkey AS VARCHAR) AS accession, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS p FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT cik, year, array_to_string(list(accession ORDER BY p, d DESC, accession)[1:4], '|') AS accessions, max(d) AS last_day0 FROM e WHERE NOT (cik % 10 = 0 AND year = 1997) GROUP BY 1, 2 HAVING bool_or(p < 2)""")
def fill_worklist(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "P", "acquisition_target").when(F.col("o_orderstatus") == "F", "earnings").otherwise("other")
    key = F.col("o_orderkey").cast("string")
    ev = o.select(key.alias("event_id"), key.alias("accession"), F.col("o_custkey").alias("cik"), F.to_date("o_orderdate").alias("day0"), kind.alias("event_type"))
    t = o.select(key.alias("event_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "T").alias("ticker"))
    seen = load(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("cik"), F.lit(1997).alias("year"))
    return idmap.fill_worklist(ev, t, seen, ("earnings", "acquisition_target")).withColumn("accessions", F.array_join("accessions", "|"))


@register("j40_day0_check", f"""WITH {P.sql_calendar()}, c AS (SELECT event_id, i0, CASE WHEN event_id % 50 = 0 THEN i0 - 1 ELSE i0 END AS t FROM ev)
SELECT count(t) AS checked, count(*) FILTER (WHERE i0 <> t) AS different, count(*) FILTER (WHERE t IS NULL) AS missing, count(*) FILTER (WHERE i0 <> t) <= 5 AS passed FROM (SELECT c.i0, s.idx AS t FROM c LEFT JOIN s ON s.idx = c.t)""")
def day0_check(spark, sf_dir):
    cal = P.sessions(spark, sf_dir)
    ev = P.announcements(spark, sf_dir)
    true = F.when(F.col("event_id") % 50 == 0, F.col("i0") - 1).otherwise(F.col("i0"))
    checked = ev.select("event_id", true.alias("idx")).join(F.broadcast(cal), "idx", "left").select("event_id", F.col("session").alias("true_day0"))
    return checks.day0_check(checks.session_differences(checked, ev, cal))


@register("j38_release_documents", f"""WITH d AS (SELECT o_orderkey AS a, o_custkey % 300 AS c, {DAY} AS d, CASE o_orderkey % 4 WHEN 0 THEN '8-K' WHEN 1 THEN '425' WHEN 2 THEN '10-K' ELSE 'DEFA14A' END AS form, o_orderstatus = 'F' AS ex, o_orderstatus <> 'O' OR o_orderkey % 2 = 0 AS pr FROM orders),
o AS (SELECT * FROM d WHERE form <> '10-K' AND (ex OR (pr AND form <> '8-K')))
SELECT CAST(a AS VARCHAR) AS accession, CASE WHEN ex THEN 'exhibit' WHEN EXISTS (SELECT 1 FROM o WHERE o.c = d.c AND o.a <> d.a AND o.d BETWEEN d.d AND d.d + 1) THEN 'related' WHEN pr THEN 'primary' END AS source FROM d""")
def release_documents(spark, sf_dir):
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    key = k.cast("string").alias("accession")
    form = F.element_at(F.array(*map(F.lit, ("8-K", "425", "10-K", "DEFA14A"))), (k % 4 + 1).cast("int"))
    f = o.select(key, (F.col("o_custkey") % 300).alias("cik"), form.alias("form"), F.to_date("o_orderdate").alias("filing_date"))
    exhibits = o.where("o_orderstatus = 'F'").select(key, F.lit("exhibit").alias("kind"), F.lit(1).alias("seq"), F.lit("x").alias("text"))
    primary = o.where("o_orderstatus <> 'O' OR o_orderkey % 2 = 0").select(key, F.lit("primary").alias("kind"), F.lit(0).alias("seq"), F.lit("p").alias("text"))
    return checks.release_documents(f, exhibits.unionByName(primary)).select("accession", "source")


PLACES = ("(NYSE: {})", "(NASDAQ Capital Market: {})", "nyse american : {}", '(NasdaqGS: "{}")', "(OTC: {})", "(NYSE {})")


@register("j37_ticker_in_text", r"""WITH x AS (SELECT c_custkey, 'TK' || substr('ABCDEFGHIJ', 1 + CAST(c_custkey % 10 AS INT), 1) AS tk, c_name AS n FROM customer),
y AS (SELECT c_custkey, n, CASE WHEN c_custkey % 4 = 3 THEN 'Somebody' ELSE n || ', Inc.' END || ' ' || CASE c_custkey % 6 WHEN 0 THEN '(NYSE: ' || tk || ')' WHEN 1 THEN '(NASDAQ Capital Market: ' || tk || ')' WHEN 2 THEN 'nyse american : ' || tk WHEN 3 THEN '(NasdaqGS: "' || tk || '")' WHEN 4 THEN '(OTC: ' || tk || ')' ELSE '(NYSE ' || tk || ')' END AS t FROM x)
SELECT c_custkey, CASE WHEN contains(t, n) THEN nullif(regexp_extract(t, '(?i)\(?\b(?:NYSE|NASDAQ|AMEX)(?:[\s-]*(?:American|Arca|MKT|Global|Select|Capital|Stock|Market|GS|GM|CM)){0,4}\s*:\s*"?((?-i:[A-Z]{1,5}(?:\.[A-Z])?))\b', 1), '') END AS ticker FROM y""")
def ticker_in_text(spark, sf_dir):
    """Releases that write a company's former name and its ticker in several forms."""
    c, k = load(spark, sf_dir, "customer"), F.col("c_custkey")
    tk = F.concat(F.lit("TK"), F.substr(F.lit("ABCDEFGHIJ"), (k % 10 + 1).cast("int"), F.lit(1)))
    forms = [F.replace(F.lit(p), F.lit("{}"), tk) for p in PLACES]
    said = F.concat(F.when(k % 4 == 3, "Somebody").otherwise(F.concat("c_name", F.lit(", Inc."))), F.lit(" "), F.element_at(F.array(*forms), (k % 6 + 1).cast("int")))
    rows = c.select("c_custkey", said.alias("t"), F.concat(F.lit("Quite Another Present Title|"), "c_name").alias("n"))
    return releases.tickers_from_text(rows, "t", "n").select("c_custkey", "ticker")


ISSUERS = ("Acme Inc", "Acme, Inc.", "ACME Corp", "a biotech company", 'Acme Inc ("Acme")')


@register("j32_clean_events", """WITH x AS (SELECT doc_id, quality = 1 AS q, toxic = 1 AS x, doc_id % 3 AS k FROM labels),
y AS (SELECT doc_id, CASE WHEN x THEN 'earnings' WHEN q THEN 'financing' ELSE 'unknown' END AS t1, CASE WHEN k = 0 THEN 'financing' ELSE 'unknown' END AS t0, k FROM x),
m AS (SELECT *, t0 = t1 OR t0 = 'unknown' OR t1 = 'unknown' AS same FROM y),
r AS (SELECT doc_id, 'Acme Inc' AS issuer_name, CASE WHEN same AND t0 = 'unknown' THEN t1 ELSE t0 END AS ty, CASE WHEN same THEN 'both' ELSE 'stock' END AS want, k FROM m
      UNION ALL SELECT doc_id, 'Acme, Inc.', t1, 'options', k FROM m WHERE NOT same
      UNION ALL SELECT doc_id, 'ACME Corp', 'other', 'stock', k FROM m WHERE k <> 1)
SELECT CAST(doc_id AS VARCHAR) AS lr_no, issuer_name, CASE WHEN ty = 'unknown' THEN 'other' ELSE ty END AS event_type, CASE WHEN k = 2 AND want = 'both' THEN 'stock' WHEN k = 2 AND want = 'options' THEN 'unknown' ELSE want END AS instruments,
  CASE WHEN k = 2 AND want = 'both' THEN 'both_not_in_release' WHEN k = 2 AND want = 'options' THEN 'options_not_in_release' ELSE 'ok' END AS instruments_check,
  CASE WHEN issuer_name = 'Acme Inc' THEN 'verified' ELSE 'none_given' END AS date_check FROM r""")
def clean_events(spark, sf_dir):
    """Four events a release: two of one issuer, one of another, one unnamed."""
    lab, k, n = load(spark, sf_dir, "labels"), F.col("doc_id") % 3, F.col("ord")
    second = F.when(F.col("toxic") == 1, "earnings").when(F.col("quality") == 1, "financing").otherwise("unknown")
    first = F.when(k == 0, "financing").otherwise("unknown")
    named = F.when(n == 0, 'Acme Inc (the "Company")').when(n == 1, "Acme, Inc.").when((n == 2) & (k != 1), "ACME Corp").otherwise("a biotech company")
    day = F.when(n == 0, F.lit("2019-03-04").cast("date"))
    rows = lab.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        F.col("doc_id").cast("string").alias("lr_no"), "ord", named.alias("issuer_name"), F.lit(None).cast("string").alias("ticker"), day.alias("announcement_date"), F.lit("before  March 4, 2019").alias("announcement_evidence"),
        F.lit(None).cast("date").alias("last_trade_date"), F.lit(None).cast("string").alias("trade_evidence"), F.when(n == 0, first).when(n == 1, second).otherwise("unknown").alias("event_type"),
        F.when(n == 1, "options").otherwise("stock").alias("instruments"), F.lit("long").alias("direction"))
    body = F.concat(F.lit("He bought shares Before March 4, 2019"), F.when(k == 2, ".").otherwise(" and call options."))
    texts = lab.select(F.col("doc_id").cast("string").alias("lr_no"), body.alias("text"))
    return releases.clean_events(rows, texts).select("lr_no", "issuer_name", "event_type", "instruments", "instruments_check", "date_check")


LINES = ("Some Company", "Some Company 5% Notes due 2030", "Some MLP Units", "Firm Senior Housing Trust", "Firm Pfd Series A", "Firm When-Issued", "Firm Index Fund", "Plain Firm")
_LINE = "CASE CAST(p_partkey % 8 AS INT) " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(LINES)) + " END"
SYMBOLS = ("ROOT", "ROOTW", "ROOT.U", "ROOT-WS", "OTHER", "ZVZZT", "NTEST.B", "ROOTRT", "ROOTX")
_SYMBOL = "CASE CAST(p_size % 9 AS INT) " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(SYMBOLS)) + " END"


@register("j07_map_filter", rf"""WITH r AS (SELECT p_partkey, {_SYMBOL} AS ticker, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey // 4 END AS cik, {_LINE} AS name, CASE p_partkey % 7 WHEN 0 THEN 'CS' WHEN 1 THEN 'ADRC' WHEN 2 THEN 'PFD' WHEN 3 THEN 'GDR' WHEN 4 THEN 'ETF' ELSE 'untyped' END AS type FROM part)
SELECT p_partkey, ticker, type FROM r WHERE NOT regexp_matches(ticker, 'TEST|^Z[A-Z]ZZT') AND NOT regexp_matches(name, '(?i)\bnotes?\b|\bdebentures?\b|\bpreferred\b|\bpfd\b|\bwarrants?\b|\bwhen[ -]issued\b|%')
  AND (type IN ('CS', 'ADRC', 'ADRP', 'ADRS', 'OS', 'NYRS', 'GDR') OR (type = 'untyped' AND cik IS NOT NULL AND NOT regexp_matches(name, '(?i)\b(warrants?|units?|rights?|preferred|pfd|depositary shares?|notes?|debentures?|etf|etn|fund|index|trust preferred|subordinated|senior|%)\b|%')
  AND NOT EXISTS (SELECT 1 FROM r b WHERE b.cik = r.cik AND b.ticker <> r.ticker AND regexp_matches(r.ticker, '^' || regexp_escape(b.ticker) || '[.-]?(W|WS|WT|U|UN|R|RT)$'))))""")
def map_filter(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    raw = load(spark, sf_dir, "part").select(k, pick(SYMBOLS, F.col("p_size") % 9).alias("ticker"), F.when(k % 5 != 0, F.floor(k / 4)).alias("cik"), pick(LINES, k % 8).alias("name"), pick(("CS", "ADRC", "PFD", "GDR", "ETF", None, None), k % 7).alias("type"))
    return idmap.map_filter(raw).select("p_partkey", "ticker", "type")


# ---------------------------------------------------------------- operators that others hold within


@register("d11_causal_join", f"SELECT a.o_orderkey AS release, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND CAST(b.o_orderdate AS DATE) < CAST(a.o_orderdate AS DATE) GROUP BY 1")
def causal_join(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("d"))
    return o.join(o.select("o_custkey", F.col("d").alias("day0")), "o_custkey").where("day0 < d").groupBy(F.col("o_orderkey").alias("release")).agg(F.count("*").alias("n"))


@register("d17_raw_onto_adjusted", f"WITH {P.sql_calendar()} SELECT b0.symbol, b0.date, round(b0.close + 1e-9, 6) AS close, r.close_raw FROM b0 LEFT JOIN (SELECT symbol, date, close_raw FROM b0 WHERE symbol % 3 <> 0) r USING (symbol, date)")
def raw_onto_adjusted(spark, sf_dir):
    """Bars of both adjustments as the bar table holds them: raw closes onto adjusted rows."""
    b = P.bars(spark, sf_dir)
    both = b.select("symbol", "date", F.lit("all").alias("adjustment"), "close", "volume").unionByName(b.where("symbol % 3 <> 0").select("symbol", "date", F.lit("raw").alias("adjustment"), F.col("close_raw").alias("close"), "volume"))
    return bars.with_raw_close(both).select("symbol", "date", F.round(F.col("close") + 1e-9, 6).alias("close"), "close_raw")


@register("e04_min_max", "SELECT o_custkey, min(o_orderdate) AS first, max(o_orderdate) AS last, min(o_totalprice) AS least FROM orders GROUP BY 1")
def min_max(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.min("o_totalprice").alias("least"))


_FIT = "FROM lineitem GROUP BY 1"


@register("e12_ols", f"SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept {_FIT}")
def ols(spark, sf_dir):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"))


@register("e13_fit_residual", f"SELECT l_suppkey, round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ^ 2 / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 1)), 4) AS sd {_FIT}")
def fit_residual(spark, sf_dir):
    y, x = F.col("l_extendedprice"), F.col("l_quantity")
    left = F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_sxy(y, x) / F.regr_sxx(y, x)
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.sqrt(left / (F.count("*") - 1)), 4).alias("sd"))


def _first(spark, sf_dir, table, by, order, columns):
    rows = load(spark, sf_dir, table).withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return rows.where("rn = 1").select(*columns)


@register("f02_type_preference", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'P' DESC, o_orderkey) = 1")
def type_preference(spark, sf_dir):
    return _first(spark, sf_dir, "orders", ["o_custkey"], [F.desc(F.col("o_orderstatus") == "P"), "o_orderkey"], ["o_custkey", "o_orderkey"])


@register("f04_newest_version", "SELECT o_orderkey FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)")
def newest_version(spark, sf_dir):
    newest = F.max("o_orderdate").over(Window.partitionBy("o_custkey"))
    return load(spark, sf_dir, "orders").withColumn("m", newest).where("o_orderdate = m").select("o_orderkey")


@register("f10_latest_holder", "SELECT o_custkey, o_orderkey FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS d FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY d DESC NULLS FIRST, o_orderkey) = 1")
def latest_holder(spark, sf_dir):
    ended = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return _first(spark, sf_dir, "orders", ["o_custkey"], [ended.desc_nulls_first(), "o_orderkey"], ["o_custkey", "o_orderkey"])


@register("f13_monthly_rank", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place FROM orders")
def monthly_rank(spark, sf_dir):
    w = Window.partitionBy(F.date_trunc("month", "o_orderdate")).orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("place"))


@register("f18_average_rank", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS place FROM part")
def average_rank(spark, sf_dir):
    """Ranks of distinct values by running counts, joined back to the rows."""
    parts = load(spark, sf_dir, "part").select("p_partkey", "p_size")
    sizes = parts.groupBy("p_size").agg(F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("p_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(sizes.withColumn("place", below + (F.col("n") + 1) / 2)), "p_size").select("p_partkey", "place")


@register("g01_multi_key_sort", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderdate, o_orderstatus DESC, o_orderkey) AS keys FROM orders GROUP BY 1")
def multi_key_sort(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", F.desc("o_orderstatus"), "o_orderkey")
    rows = load(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("k"), F.row_number().over(w).alias("rn"))
    keys = F.transform(F.sort_array(F.collect_list(F.struct("rn", "k"))), lambda x: x.k)
    return rows.groupBy("o_custkey").agg(F.array_join(keys, "|").alias("keys"))


@register("g03_earliest_after", f"SELECT a.o_orderkey, arg_min(b.o_orderkey, struct_pack(x := b.o_orderstatus <> a.o_orderstatus, d := b.o_orderdate, k := b.o_orderkey)) AS next FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate AND CAST(b.o_orderdate AS DATE) <= CAST(a.o_orderdate AS DATE) + 30 GROUP BY 1")
def earliest_after(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    b = o.withColumnsRenamed({"o_orderkey": "k", "o_orderstatus": "s", "o_orderdate": "d"})
    j = o.join(b, "o_custkey").where((F.col("d") > F.col("o_orderdate")) & (F.to_date("d") <= F.date_add("o_orderdate", 30)))
    return j.groupBy("o_orderkey").agg(F.min_by("k", F.struct(F.col("s") != F.col("o_orderstatus"), "d", "k")).alias("next"))


@register("h04_keep_last", "SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def keep_last(spark, sf_dir):
    return _first(spark, sf_dir, "orders", ["o_custkey", "o_orderpriority"], [F.desc("o_orderdate"), F.desc("o_orderkey")], ["o_custkey", "o_orderpriority", "o_orderkey"])


@register("j04_exact_times", f"""WITH {P.sql_calendar()}, {TIMES_SQL},
x AS (SELECT ty.*, CASE WHEN CAST(accession AS BIGINT) % 3 = 0 THEN CAST(filing_date AS TIMESTAMP) + INTERVAL 16 HOUR + to_minutes(CAST(CAST(accession AS BIGINT) % 2 AS INT) - 1) END AS et FROM ty)
SELECT substr(event_type, 1, 3) || '-' || accession AS event_id, et AS accepted_et, CASE WHEN date_part('hour', et) < 16 THEN (SELECT min(session) FROM s WHERE session >= CAST(et AS DATE)) ELSE (SELECT min(session) FROM s WHERE session > CAST(et AS DATE)) END AS day0, 1 AS day0_candidates, 'index_header' AS day0_basis FROM x WHERE et IS NOT NULL
UNION ALL SELECT substr(event_type, 1, 3) || '-' || accession, NULL, NULL, NULL, 'earliest_candidate' FROM x WHERE et IS NULL""")
def exact_times(spark, sf_dir):
    """Every third filing with a header time at or just before the close."""
    o = load(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    at = F.to_timestamp_ntz(F.date_format("o_orderdate", "yyyy-MM-dd")) + F.make_dt_interval(hours=F.lit(16), mins=(F.col("o_orderkey") % 2 - 1).cast("int"))
    made = built(spark, sf_dir, o.select(F.col("o_orderkey").cast("string").alias("accession"), at.alias("accepted_et")))
    own = F.col("day0_basis") == "index_header"
    return made.select("event_id", *[F.when(own, F.col(c)).alias(c) for c in ("accepted_et", "day0", "day0_candidates")], "day0_basis")


@register("j12_name_supplement", """WITH firm AS (SELECT c_custkey AS cik, 'Firm ' || (c_custkey // 2) || ' Holdings' AS name, CASE WHEN c_custkey % 3 = 0 THEN 'Elder ' || c_custkey ELSE '' END AS former FROM customer),
keys AS (SELECT cik, lower('Firm ' || (cik // 2)) AS key FROM firm UNION SELECT cik, lower(former) FROM firm WHERE former <> ''),
rg AS (SELECT 'F' || (p_partkey % 997) AS ticker, CASE WHEN p_partkey % 4 = 0 THEN p_partkey + 1000000 WHEN p_partkey % 4 = 1 THEN p_partkey % 700 END AS map_cik, CASE WHEN p_partkey % 2 = 0 THEN 'Elder ' || (p_partkey % 1500) ELSE 'Firm ' || (p_partkey % 750) END AS name, CASE WHEN p_partkey % 5 = 0 THEN DATE '1997-06-01' END AS vf, CASE WHEN p_partkey % 7 = 0 THEN DATE '1999-06-01' END AS vt FROM part),
mi AS (SELECT o_custkey AS cik, CAST(year(o_orderdate) AS INT) AS year, min(CAST(o_orderdate AS DATE)) AS f, max(CAST(o_orderdate AS DATE)) AS l FROM orders GROUP BY 1, 2),
ok AS (SELECT *, lower(name) AS key, map_cik IS NULL OR map_cik NOT IN (SELECT cik FROM firm) OR EXISTS (SELECT 1 FROM keys k WHERE k.cik = map_cik AND k.key = lower(rg.name)) AS loose FROM rg),
hi AS (SELECT mi.*, ticker, ok.name, map_cik, ok.key FROM mi JOIN keys USING (cik) JOIN ok USING (key) WHERE loose AND (map_cik IS NULL OR (map_cik <> mi.cik AND length(ok.key) >= 5)) AND (vf IS NULL OR vf <= l) AND (vt IS NULL OR vt >= f)),
one AS (SELECT cik, year, f, l, min(ticker) AS ticker, max(struct_pack(n := name, c := map_cik, k := key)) AS m FROM hi GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT ticker) = 1)
SELECT cik, year, ticker FROM one WHERE NOT EXISTS (SELECT 1 FROM rg h WHERE h.ticker = one.ticker AND h.map_cik <> one.cik AND (h.vf IS NULL OR h.vf <= l) AND (h.vt IS NULL OR h.vt >= f) AND h.map_cik IN (SELECT cik FROM firm) AND NOT EXISTS (SELECT 1 FROM keys k WHERE k.cik = h.map_cik AND k.key = one.m.k))
  AND NOT EXISTS (SELECT 1 FROM customer WHERE 'F' || (c_custkey % 200) = one.ticker AND c_custkey <> one.cik AND one.year = 1996)""")
def name_supplement(spark, sf_dir):
    n, k = F.col("c_custkey"), F.col("p_partkey")
    c = load(spark, sf_dir, "customer")
    s = lambda x: x.cast("string")
    firms = c.select(n.alias("cik"), F.concat(F.lit("Firm "), s(F.floor(n / 2)), F.lit(" Holdings, Inc.")).alias("name"), F.when(n % 3 == 0, F.concat(F.lit("Elder "), s(n), F.lit(" Corp"))).otherwise("").alias("former_names"))
    title = F.when(k % 2 == 0, F.concat(F.lit("Elder "), s(k % 1500))).otherwise(F.concat(F.lit("Firm "), s(k % 750)))
    rg = load(spark, sf_dir, "part").select(F.concat(F.lit("F"), s(k % 997)).alias("ticker"), F.when(k % 4 == 0, k + 1000000).when(k % 4 == 1, k % 700).alias("cik"), F.concat(title, F.lit(" Inc. Class A Common Stock")).alias("name"),
                                            F.when(k % 5 == 0, F.lit("1997-06-01").cast("date")).alias("valid_from"), F.when(k % 7 == 0, F.lit("1999-06-01").cast("date")).alias("valid_to"))
    d = F.to_date("o_orderdate")
    missing = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cik"), F.year("o_orderdate").alias("year")).agg(F.min(d).alias("first"), F.max(d).alias("last"))
    held = c.select(n.alias("cik"), F.lit(1996).alias("year"), F.concat(F.lit("F"), s(n % 200)).alias("ticker"))
    return idmap.name_supplement(missing, firms, rg, None, held).select("cik", "year", "ticker")


@register("j47_filled_worklist", f"""WITH x AS (SELECT o_orderkey AS event_id, {DAY} AS d, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '8k_no_data' WHEN 2 THEN 'late_8k_shift' ELSE '8k_confirmed' END AS basis, CASE WHEN o_orderkey % 3 = 0 THEN {DAY} - 1 WHEN o_orderkey % 3 = 1 THEN {DAY} END AS m FROM orders)
SELECT event_id, CASE WHEN basis IS NOT NULL THEN d END AS daily_day0, basis, m = CASE WHEN basis IS NOT NULL THEN d END AS same_day, CASE WHEN basis IS NULL THEN 'no ticker or bars' WHEN basis = '8k_no_data' THEN 'too little history' WHEN m IS NULL THEN 'no minute move' ELSE '' END AS note FROM x""")
def filled_worklist(spark, sf_dir):
    o, k, d = load(spark, sf_dir, "orders"), F.col("o_orderkey"), F.to_date("o_orderdate")
    basis = F.when(k % 4 == 1, "8k_no_data").when(k % 4 == 2, "late_8k_shift").otherwise("8k_confirmed")
    daily = o.where("o_orderkey % 4 <> 0").select(k.alias("event_id"), d.alias("day0"), basis.alias("basis"), F.lit("").alias("prior_moves"))
    at = F.to_timestamp_ntz(F.date_format(F.when(k % 3 == 0, F.date_sub(d, 1)).otherwise(d), "yyyy-MM-dd"))
    moves = o.where("o_orderkey % 3 <> 2").select(k.alias("event_id"), at.alias("ts"))
    return checks.filled_worklist(o.select(k.alias("event_id")), daily, moves).select("event_id", "daily_day0", "basis", "same_day", "note")
