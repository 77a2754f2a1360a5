import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import html, text
from tidemark.operators import releases
from tidemark.sources import bars, shortsale, warehouse
from tidemark.sources.paged import PagedJson
from tidemark.streaming import windows

D = dt.date
PAGE = """<html><head><title>T</title><script>var x = 'hidden';</script>
<script type="application/ld+json">{"@graph": [{"datePublished": "2023-11-02T10:00:00Z"}]}</script></head><body><nav>insider trading</nav><main><h1>SEC v. Doe</h1>
<p>Litigation Release No. 25000 / June 5. 2023</p><p>He traded <b>shares</b> before&nbsp;the news; he was tipped.</p><p>Last Reviewed or Updated: FINRA</p></main><a href="/a?b=1">Go <i>on</i></a></body></html>"""


def test_html():
    assert "hidden" not in html.visible_text(PAGE) and "He traded shares before the news" in html.visible_text(PAGE)
    number, who, body, day = html.release(PAGE)
    assert (number, who, day) == (25000, "SEC v. Doe", D(2023, 6, 5)) and body.startswith("Litigation Release") and body.endswith("he was tipped.")
    assert html.page_title(PAGE) == "SEC v. Doe" and html.links(PAGE) == [("/a?b=1", "Go on")]
    assert html.page_time(PAGE) == (dt.datetime(2023, 11, 2, 6, 0), "json-ld")
    assert html.visible_text(None) == "" and html.page_title("") == "" and html.release("<p>No head</p>") is None


def test_references_end_in_a_semicolon(spark):
    """A reference cut short or of no known name stays as written, as in the SQL of j36."""
    said = "<script type='application/ld+json'>{\"a\": \"x &amp y\"}</script><!-- &amp --><a href='/a?copy=1&copy=2'>A&ampB &#65; &#66 &zz; &amp;lt; &lt;b&gt; AT&T &amp</a><h1>Ly &amp;&quot; and&amp</h1>"
    r = html._read(said)
    assert r.ld == ['{"a": "x &amp y"}'] and r.links == [("/a?copy=1&copy=2", "A&ampB A &#66 &zz; &lt; <b> AT&T &amp")]
    pages = spark.createDataFrame([(1, said)], "page_id long, html string")
    assert releases.page_texts(pages).first().headline == 'Ly &" and&amp'


@pytest.mark.parametrize(("body", "want"), [
    ("Litigation Release No. 24000 / Dec. 18, 2020\nx", D(2020, 12, 18)), ("Litigation Release No. 24000 / January 13 2020", D(2020, 1, 13)), ("Litigation Release No. 24000\nSept. 5, 2019\nFiled March 1, 2018", D(2019, 9, 5)),
    ("Litigation Release No. 24000\nSEC v. Doe\nMarch 1, 2018", None), ("Litigation Release No. 24000 / Smarch 1, 2018", None),
])
def test_header_dates(body, want):
    assert html.header_date(body) == want


@pytest.mark.parametrize(("page", "want"), [
    ('<time datetime="2023-11-02">x</time>', None), ('<time datetime="2023-11-02T10:00:00">x</time>', None), ('<time datetime="2023-01-02T10:00:00-05:00">x</time>', dt.datetime(2023, 1, 2, 10)),
    ('<meta itemprop="datePublished" content="2023-07-02T10:00:00+0000">', dt.datetime(2023, 7, 2, 6)), ("<p>NEW YORK, Nov 02, 2023, 06:00 ET</p>", dt.datetime(2023, 11, 2, 6)), ("<p>November 2, 2023 06:30 PM Eastern Daylight Time</p>", dt.datetime(2023, 11, 2, 18, 30)),
    ("<p>November 2, 2023 06:30 GMT</p>", None),
])
def test_page_times(page, want):
    assert html.page_time(page)[0] == want


INDEX = """<table class="tableFile"><tr><th>Seq</th></tr><tr><td>1</td><td>Report</td><td><a href="/ix?doc=/d/main.htm">main.htm</a></td><td>8-K</td></tr>
<tr><td>2</td><td>x</td><td><a href="/d/ex992.htm">a</a></td><td>EX-99.2</td></tr><tr><td>3</td><td>x</td><td><a href="/d/ex991.htm">a</a></td><td> ex-99.1 </td></tr><tr><td>short</td></tr></table>"""


def test_filing_index():
    base = "https://host.example/f/index.htm"
    assert html.exhibit_url(INDEX, base) == "https://host.example/d/ex991.htm"
    assert html.primary_url(INDEX, base) == "https://host.example/d/main.htm"
    assert html.exhibit_url("<p>none</p>", base) is None and html.primary_url("", base) is None


RELEASE = """Exhibit 99.1
FOR IMMEDIATE RELEASE
Filed by Widget Corp pursuant to Rule 425
Widget Corp Announces Agreement to Combine with
Gadget Holdings in an All-Stock Deal
A sub-heading that is quite a lot longer than the headline itself
DENVER, Nov. 2, 2023 /PRNewswire/ -- Widget said today, as of March 1, 2020, ..."""


def test_exhibits():
    wire, day, headline = html.read_exhibit(RELEASE)
    assert (wire, day) == ("PR Newswire", D(2023, 11, 2))
    assert headline == "Widget Corp Announces Agreement to Combine with Gadget Holdings in an All-Stock Deal"
    assert html.read_exhibit("Tiny Firm Wins\nMay 3, 2021 something")[1:] == (D(2021, 5, 3), "Tiny Firm Wins")
    assert html.read_exhibit("") == (None, None, None)


def test_page_acceptance():
    page = '<meta property="og:title" content="Widget Corp Announces Agreement"><meta name="date" content="2023-11-02T10:00:00Z">'
    head, day = "Widget Corp Announces Agreement", D(2023, 11, 2)
    assert html.check_page(page, head, day, None)[:2] == (dt.datetime(2023, 11, 2, 6), "meta")
    assert html.check_page(page, head, D(2023, 11, 1), None)[1] == "published 2023-11-02 06:00 ET, dateline 2023-11-01"
    assert html.check_page(page, "Something Else Entirely Happened", day, None)[1].startswith("title match")
    assert html.check_page(page, head, None, D(2023, 11, 4))[0] is not None
    assert html.check_page(page, head, None, D(2023, 11, 9))[1] == "published 2023-11-02 ET, filed 2023-11-09"
    assert html.check_page("<h1>x</h1>", head, day, None)[1] == "no time on page"
    assert html.on_wire("https://www.prnewswire.com/x") and not html.on_wire("https://notprnewswire.com/x")


BOTH = "Acme Works (NYSE: ACM) agreed. " + "More words. " * 15 + "Zeta Corp (NASDAQ: ZET) did too"


@pytest.mark.parametrize(("t", "name", "want"), [
    (BOTH, "Acme Works Holdings", "ACM"), (BOTH, "zetas corp", "ZET"), (BOTH, "ZWX Corp|Zeta Corp.", "ZET"), ("Acme Works (NYSE: ACM) and Zeta (NYSE: ZET)", "Acme Works", "ZET"),
    ("The IBM unit (NYSE: IBM)", "IBM", "IBM"), ("PHX sold its arm to a partner called Realgood Worldwide (NYSE: RLG)", "PHX Corp", None), ("Someone else (NYSE: SE)", "Quite Different Company", None), ("none here", "Acme", None),
    ("Old Energy Corp. (nasdaq capital market: OLD)", "New Title Inc|Old Energy Corp", "OLD"), ('Acme Works, Inc. NYSE American: "ACW"', "ACME WORKS INC /DE/", "ACW"), ("Acme Works (OTC: ACW)", "Acme Works", None), ("Acme Works (NYSE: acw)", "Acme Works", None),
    ("x" * 8000 + "Acme Works (NYSE: ACW)", "Acme Works", None),
])
def test_ticker_for(t, name, want):
    assert html.ticker_for(t, name)[0] == want


def test_parse_releases(spark):
    r = releases.parse_releases(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert (r[0].lr_no, r[0].release_date, r[0].is_insider_candidate, r[0].mentions_options, r[0].mentions_finra) == (25000, D(2023, 6, 5), True, False, False)
    assert r[1].lr_no is None and r[1].text is None and not r[1].is_insider_candidate


def test_dates_and_checks(spark):
    written = ["Sept. 5, 2023", "5 June 2023", "2023-06-05", "June 5 2023", "06/05/2023", "soon", None]
    got = [r.d for r in spark.createDataFrame([(i, w) for i, w in enumerate(written)], "i int, w string").orderBy("i").select(text.any_date(F.col("w")).alias("d")).collect()]
    assert got == [D(2023, 9, 5), D(2023, 6, 5), D(2023, 6, 5), D(2023, 6, 5), D(2023, 6, 5), None, None]
    rows = [(D(2023, 6, 5), "on  june 5, 2023 it", "x On June 5,\n2023 it was"), (D(2023, 6, 5), "in June 2023", "in June 2023"), (D(2023, 6, 5), "not there", "body"), (None, "q", "q")]
    checks = [r.c for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d date, q string, t string").orderBy("i").select(text.verify_date(F.col("d"), F.col("q"), F.col("t")).alias("c")).collect()]
    assert [c.day for c in checks] == [D(2023, 6, 5), None, None, None]
    assert [c.reason for c in checks] == ["verified", "quote_lacks_full_date", "quote_not_in_release", "none_given"]


@pytest.mark.parametrize(("claim", "said", "want"), [
    ("options", "She exercised vested stock options.", ("stock", "employee_options")), ("options", "He bought shares.", ("unknown", "options_not_in_release")), ("options", "He bought calls.", ("options", "ok")),
    ("stock", "The stock price rose; shares fell.", ("unknown", "stock_not_in_release")), ("stock", "He bought ADRs.", ("stock", "ok")), ("both", "He sold stock.", ("stock", "both_not_in_release")),
    ("both", "He bought options.", ("options", "both_not_in_release")), ("both", "He traded securities.", ("unknown", "both_not_in_release")), ("both", "Stock and puts.", ("both", "ok")), ("other", "", ("other", "ok")),
])
def test_check_instruments(spark, claim, said, want):
    got = spark.createDataFrame([(claim, said)], "c string, t string").select(text.check_instruments(F.col("c"), F.col("t")).alias("x")).first().x
    assert tuple(got) == want


def event(**kw):
    base = dict(lr_no="1", ord=0, issuer_name="Acme Inc", ticker=None, announcement_date=None, announcement_evidence=None, last_trade_date=None, trade_evidence=None, event_type="unknown", instruments="stock", direction="unknown")
    return tuple((base | kw).values())


FIELDS = "lr_no string, ord int, issuer_name string, ticker string, announcement_date date, announcement_evidence string, last_trade_date date, trade_evidence string, event_type string, instruments string, direction string"
BODY = "He bought shares and call options on January 5, 2020, January 9, 2020 and May 5, 2021, before March 4, 2020 and June 6, 2022."


def test_clean_events(spark):
    trade = lambda d, q: {"last_trade_date": d, "trade_evidence": q}
    rows = [
        event(**trade(D(2020, 1, 5), "on January 5, 2020")), event(ord=1, issuer_name='Acme, Inc. ("Acme")', event_type="earnings", instruments="options", direction="long", **trade(D(2020, 1, 9), "January 9, 2020")),
        event(ord=2, event_type="acquisition_target", **trade(D(2021, 5, 5), "May 5, 2021")), event(ord=3, issuer_name="Buyer Co", event_type="acquirer"), event(ord=4, issuer_name="an unnamed company"),
        event(ord=5, announcement_date=D(2020, 3, 4), announcement_evidence="not a quote", **trade(D(2020, 1, 1), "on January 1, 2020")),
        event(lr_no="2", issuer_name="Buyer Co", event_type="acquirer", instruments="options", direction="short"), event(lr_no="2", ord=1, issuer_name="Buyer Co", event_type="acquirer", instruments="options", direction="sell"),
        event(lr_no="3", announcement_date=D(2020, 3, 4), announcement_evidence="before March 4, 2020"), event(lr_no="3", ord=1, announcement_date=D(2022, 6, 6), announcement_evidence="June 6, 2022"),
    ]
    texts = spark.createDataFrame([("1", BODY), ("2", "He sold short."), ("3", BODY)], "lr_no string, text string")
    got = [tuple(r) for r in releases.clean_events(spark.createDataFrame(rows, FIELDS), texts).select("lr_no", "issuer_name", "event_type", "announcement_date", "date_check", "last_trade_date", "trade_check", "instruments", "instruments_check", "direction").orderBy("lr_no", "event_type", "announcement_date").collect()]
    assert got == [
        ("1", "Acme Inc", "acquisition_target", None, "none_given", D(2021, 5, 5), "verified", "stock", "ok", "unknown"),
        ("1", "Acme Inc", "earnings", None, "none_given", D(2020, 1, 9), "verified", "both", "ok", "long"),
        ("2", "Buyer Co", "acquirer", None, "none_given", None, "none_given", "unknown", "options_not_in_release", "both"),
        ("3", "Acme Inc", "other", D(2020, 3, 4), "verified", None, "none_given", "stock", "ok", "unknown"),
        ("3", "Acme Inc", "other", D(2022, 6, 6), "verified", None, "none_given", "stock", "ok", "unknown"),
    ]


def test_combined_claims():
    assert [releases.combined(v) for v in (["unknown"], ["stock", "unknown"], ["stock", "options"], ["long", "sell"], ["stock", "other"], [])] == ["unknown", "stock", "both", "both", "other", "unknown"]


def test_traded_events(spark):
    payload = {"release_kind": "complaint", "is_insider_trading_case": True, "events": [{"issuer_name": "Acme Inc", "announcement_date": "2023-06-05", "announcement_evidence": "June 5, 2023", "instruments": "options"}, {"issuer_name": "a company"}]}
    p = spark.createDataFrame([("1", "m", True, json.dumps(payload)), ("1", "n", True, json.dumps(payload)), ("2", "m", False, "{")], "lr_no string, model string, ok boolean, payload string")
    t = spark.createDataFrame([("1", "On June 5, 2023 shares rose.")], "lr_no string, text string")
    got = releases.traded_events(p, t).orderBy("model").collect()
    assert [(r.lr_no, r.model, r.release_kind, r.issuer_name, r.date_check, r.instruments, r.instruments_check) for r in got] == [("1", m, "complaint", "Acme Inc", "verified", "unknown", "options_not_in_release") for m in "mn"]


def test_date_anomalies(spark):
    rows = [(i, D(2020, 1, 1) + dt.timedelta(days=i + (90 if i == 30 else 0)) if i != 12 else None) for i in range(60)]
    got = {(r.lr_no, r.problem) for r in releases.date_anomalies(spark.createDataFrame(rows, "lr_no int, release_date date")).collect()}
    assert got == {(30, "out_of_sequence"), (12, "no_date")}


def test_date_anomalies_across_blocks(spark, monkeypatch):
    """Blocks of seven places give what one window over all gives."""
    rows = [(i * 3, D(2020, 1, 1) + dt.timedelta(days=i + (90 if i % 13 == 5 else 0)) if i % 11 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "lr_no int, release_date date")
    whole = {tuple(r) for r in releases.date_anomalies(df).collect()}
    monkeypatch.setattr(releases, "BLOCK", 7)
    assert {tuple(r) for r in releases.date_anomalies(df).collect()} == whole and len(whole) > 6


def test_short_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Date|Symbol|Short Volume|ShortExemptVolume|TotalVolume|Market\n20240102|AAA|500|1|900|Q\n20240102|BBB|x|0|10|Q\n|CCC|1|1|1|Q\n2\n")
    (tmp_path / "b.txt").write_text("Date|Symbol|ShortVolume|TotalVolume|Market\n20240102|aaa|200|400|N\n1\n")
    (tmp_path / "c.txt").write_text("What|Ever\n1|2\n")
    a, b = (shortsale.read_daily(spark, str(tmp_path / f"{n}.txt"), n.upper()) for n in "ab")
    got = {r.symbol: (r.short_volume, r.short_exempt_volume, r.total_volume, r.facilities) for r in shortsale.sum_facilities([a, b]).collect()}
    assert got == {"AAA": (700, 1, 1300, "A|B"), "BBB": (None, 0, 10, "A")}
    with pytest.raises(ValueError):
        shortsale.read_daily(spark, str(tmp_path / "c.txt"))
    assert shortsale.facilities_for("2018-07-31") != shortsale.facilities_for("2018-08-01")
    (tmp_path / "t.txt").write_text("MarketCenter|Symbol|Date|Time|ShortType|Size|Price|LinkIndicator\nN|AAA|20240102|1|S|500|1|\nN|AAA|20240102|1|S|50|1|\nN|AAA|2024|1|S|1|1|\n1\n")
    assert [tuple(r) for r in shortsale.trades_daily(spark, str(tmp_path / "t.txt")).collect()] == [("AAA", D(2024, 1, 2), 2, 550, 1)]


def test_bars_and_pages(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"bars": {"AAA": [{"t": "2024-01-02T05:00:00Z", "o": 1, "h": 2, "l": 1, "c": 1.5, "v": 10, "n": 3, "vw": 1.4}]}, "next_page_token": None}))
    assert [tuple(r)[:3] for r in bars.read_bars(spark, str(tmp_path / "p.json")).collect()] == [("AAA", D(2024, 1, 2), 1.0)]
    assert bars.read_minutes(spark, str(tmp_path / "p.json")).first().ts == dt.datetime(2024, 1, 2, 0, 0)
    s = spark.createDataFrame([("brk/b",), ("ABR-D",), (" spy ",)], "symbol string")
    assert {r.symbol for r in bars.clean_symbols(s).collect()} == {"BRK.B", "SPY"}
    pages = tmp_path / "pages"
    pages.mkdir()
    for i in range(3):
        (pages / f"p{i}.json").write_text(json.dumps({"results": [{"ticker": f"T{i}", "active": True}]}))
    spark.dataSource.register(PagedJson)
    read = lambda start: sorted(r.ticker for r in spark.read.format("paged_json").option("path", pages.as_uri()).option("start", start).load().collect())
    assert read(0) == ["T0", "T1", "T2"] and read(2) == ["T2"] and read(9) == []


def test_warehouse(spark, tmp_path):
    w = warehouse.Warehouse(spark, f"file://{tmp_path}/wh")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert not w.exists("raw.t") and w.tables() == []
    w.replace("raw.t", a)
    w.upsert("raw.t", spark.createDataFrame([(2, "z"), (3, "q")], "k long, v string"), ["k"])
    w.update("raw.t", spark.createDataFrame([(1, None), (3, "new")], "k long, v string"), "k")
    assert {tuple(r) for r in w.read("raw.t").collect()} == {(1, "x"), (2, "z"), (3, "new")}
    w.append("raw.t", spark.createDataFrame([(4, "d")], "k long, v string"))
    w.delete_insert("raw.t", spark.createDataFrame([(4, "e")], "k long, v string"), "k")
    assert w.read("raw.t").where("k = 4").first().v == "e" and w.tables() == ["raw.t"]
    w.view("tt", "raw.t")
    assert spark.table("tt").count() == 4
    other = warehouse.Warehouse(spark, f"file://{tmp_path}/other")
    assert w.copy_to(other) == ["raw.t"] and w.copy_to(other) == []
    warehouse.write_json_array(a, str(tmp_path / "a.json"))
    assert json.load(open(tmp_path / "a.json"))[0] == {"k": 1, "v": "x"}
    warehouse.write_csv(a.coalesce(1), str(tmp_path / "csv"))
    assert {tuple(r) for r in warehouse.read_hand_check(spark, str(tmp_path / "csv")).collect()} == {("1", "x"), ("2", "y")}


def test_streaming_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.stream_table(spark, str(tmp_path / "in"), batch)
    q = windows.load_available(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()
    counted = windows.tumbling_counts(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    counted.awaitTermination(120)
    assert {(r.start, r.event_type, r.n) for r in spark.table("tumbling").collect()} == {(r.start, r.event_type, r.n) for r in windows.tumbling_counts(batch).collect()}


def test_result_links_and_redirects(spark):
    page = '<a href="https://s/?uddg=https%3A%2F%2Fw.com%2Fnews%2F1&r=1">Acme to merge</a><a href="https://w.com/news/1">x</a><a href="https://w.com/other">Acme to merge</a>'
    got = [tuple(r) for r in releases.result_links(spark.createDataFrame([(page,)], "html string"), r"/news/\d+", "Acme to merge").collect()]
    assert got == [("https://w.com/news/1", 100.0)]


def test_empty_frames(spark):
    e = spark.createDataFrame(pd.DataFrame({"page_id": pd.Series([], dtype="int64"), "html": pd.Series([], dtype="str")}), "page_id long, html string")
    assert releases.parse_releases(e).count() == 0 and releases.page_texts(e).count() == 0
