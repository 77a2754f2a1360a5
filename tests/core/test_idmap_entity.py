import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fuzzy, text
from tidemark.operators import calendar, entity, idmap

D = dt.date
RAW = "ticker string, cik long, name string, type string, composite_figi string, delisted date"


def test_ranges_follow_each_other(spark):
    raw = spark.createDataFrame([
        ("SIX", 1, "Six Flags", "CS", None, D(2024, 7, 1)), ("SIX", 2, "Six New", "CS", None, None), ("FB", 3, "Facebook", "CS", None, D(2022, 6, 8)), ("META", 3, "Meta", "CS", None, None),
        ("SIX", 1, "Six Flags", "CS", None, D(2020, 1, 1)), ("OPN", None, "No cik", None, "BBG1", D(2019, 1, 1)), ("OPN", 9, "Later", "CS", None, None),
    ], RAW)
    got = {(r.ticker, r.cik): (r.valid_from, r.valid_to) for r in idmap.ticker_ranges(raw).collect()}
    assert got == {("SIX", 1): (None, D(2024, 7, 1)), ("SIX", 2): (D(2024, 7, 2), None), ("FB", 3): (None, D(2022, 6, 8)), ("META", 3): (None, None), ("OPN", None): (None, D(2019, 1, 1)), ("OPN", 9): (D(2019, 1, 2), None)}


def test_all_null_dates_stay_dates(spark):
    raw = spark.createDataFrame([("A", 1, "A", "CS", None, None)], RAW)
    assert dict(idmap.ticker_ranges(raw).dtypes)["valid_from"] == "date"


def events_frame(spark):
    return spark.createDataFrame([("e1", 1, D(2024, 7, 1), "earnings"), ("e2", 3, D(2021, 1, 4), "earnings"), ("e3", 3, D(2023, 1, 4), "acquisition_target"), ("e4", 77, D(2023, 1, 4), "earnings")], "event_id string, cik long, day0 date, event_type string")


def ranges_frame(spark):
    return spark.createDataFrame([("SIX", 1, "CS", None, D(2024, 7, 1)), ("FB", 3, "CS", None, D(2022, 6, 8)), ("META", 3, "CS", D(2022, 6, 9), None), ("METAW", 3, "WARRANT", None, None)], "ticker string, cik long, type string, valid_from date, valid_to date")


def test_event_tickers_volume_and_supplement(spark):
    volume = spark.createDataFrame([("META", D(2022, 12, 1), 5.0), ("METAW", D(2023, 1, 1), 4.0), ("FB", D(2021, 1, 1), 9.0)], "symbol string, month date, volume double")
    extra = spark.createDataFrame([(77, 2023, "PRS", False), (77, 2022, "NO", False)], "cik long, year int, ticker string, conflict boolean")
    got = {r.event_id: (r.ticker, r.ticker_source) for r in idmap.event_tickers(events_frame(spark), ranges_frame(spark), volume, extra).collect()}
    assert got == {"e1": ("SIX", "map"), "e2": ("FB", "map"), "e3": ("META", "map"), "e4": ("PRS", "press_release")}
    plain = {r.event_id: r.ticker for r in idmap.event_tickers(events_frame(spark), ranges_frame(spark)).collect()}
    assert plain["e3"] == "META" and plain["e4"] is None


def test_map_filter(spark):
    rows = [("ACM", 1, "Acme Inc", "CS"), ("ACMW", 1, "Acme Inc", None), ("ACM.U", 1, "Acme", None), ("NEW", 2, "New Co", None), ("NOTE", 2, "New Co 5% Notes due 2030", "CS"), ("ZVZZT", 3, "Test", "CS"),
            ("ADR", None, "x", "ADRC"), ("PFD", 4, "P", "PFD"), ("MLP", 5, "Pipes LP Units", "CS"), ("MLU", 5, "Pipes LP Units", None), ("NOC", None, "No Cik", None), ("CTEST.B", 6, "C", "CS"), ("WI", 7, "Firm When-Issued", "GDR")]
    raw = spark.createDataFrame(rows, "ticker string, cik long, name string, type string")
    assert {(r.ticker, r.type) for r in idmap.map_filter(raw).collect()} == {("ACM", "CS"), ("NEW", "untyped"), ("ADR", "ADRC"), ("MLP", "CS")}


RANGE = "ticker string, cik long, name string, valid_from date, valid_to date"


def test_name_supplement(spark):
    missing = spark.createDataFrame([(k, 2021, D(2021, 3, 1), D(2021, 9, 1)) for k in (10, 11, 12, 13, 14)], "cik long, year int, first date, last date")
    companies = spark.createDataFrame([(10, "Rare Widgets Inc", "Older Widgets Corp"), (11, "Common Name Co", None), (12, "Parent Sub Corp", "Parent Corp"), (13, "GTX Corp", ""), (14, "Late Listing Inc", ""), (99, "Parent Corp", "Other Title")], "cik long, name string, former_names string")
    ranges = spark.createDataFrame([("RWI", None, "Rare Widgets Inc. Common Stock", None, None), ("CN1", None, "Common Name", None, None), ("CN2", None, "Common Name Ltd", None, None), ("PAR", 99, "Parent Corp", None, None),
                                    ("GTXI", 500, "GTx Inc", None, None), ("LATE", None, "Late Listing", D(2022, 1, 1), None)], RANGE)
    volume = spark.createDataFrame([("RWI", D(2021, 2, 1), 10.0), ("PAR", D(2021, 4, 1), 5.0)], "symbol string, month date, volume double")
    holders = spark.createDataFrame([(5, 2021, "ZZZ")], "cik long, year int, ticker string")
    got = {(r.cik, r.ticker, r.how) for r in idmap.name_supplement(missing, companies, ranges, volume, holders).collect()}
    assert got == {(10, "RWI", "name match: 'Rare Widgets Inc. Common Stock' in the map has no CIK"), (12, "PAR", "name match: 'Parent Corp' in the map under CIK 99")}
    taken = spark.createDataFrame([(5, 2021, "RWI"), (99, 2021, "PAR")], "cik long, year int, ticker string")
    assert idmap.name_supplement(missing, companies, ranges, volume, taken).count() == 0
    # A company known under other names only, holding the ticker in those dates.
    held = ranges.unionByName(spark.createDataFrame([("RWI", 11, "Common Name", None, None)], RANGE))
    assert {r.cik for r in idmap.name_supplement(missing, companies, held, volume, holders).collect()} == {12}


def test_worklist_coverage_and_misses(spark):
    ev = events_frame(spark).withColumn("accession", F.concat(F.lit("a-"), "event_id"))
    t = idmap.event_tickers(ev, ranges_frame(spark))
    assert [(r.cik, r.year, r.accessions) for r in idmap.fill_worklist(ev, t).collect()] == [(77, 2023, ["a-e4"])]
    assert {(r.event_type, r.year): r.with_ticker for r in idmap.coverage(ev, t).collect()}[("earnings", 2023)] == 0
    for exchanges, tickers, want in (("", "XX", "otc_ticker"), ("OTC|Nasdaq", "XX|YY", "exchange_ticker"), (None, None, "no_ticker")):
        companies = spark.createDataFrame([(77, exchanges, tickers)], "cik long, exchanges string, tickers string")
        assert [(r.edgar_now, r.n) for r in idmap.misses(ev, t, companies).collect()] == [(want, 1)]


def test_worklist_puts_earnings_first(spark):
    kinds = ["other_material_candidate", "acquisition_target", "earnings", "earnings", "acquisition_target", "earnings"]
    ev = spark.createDataFrame([(f"e{i}", f"a{i}", 1, D(2021, 1 + i, 5), k) for i, k in enumerate(kinds)], "event_id string, accession string, cik long, day0 date, event_type string")
    t = spark.createDataFrame([("e5", "HAS"), ("e0", None)], "event_id string, ticker string")
    row = idmap.fill_worklist(ev, t).first()
    assert (row.accessions, row.last_day0) == (["a3", "a2", "a4", "a1"], D(2021, 5, 5))
    assert idmap.fill_worklist(ev, t, kinds=("something",)).count() == 0
    assert idmap.fill_worklist(ev, t, spark.createDataFrame([(1, 2021)], "cik long, year int")).count() == 0


def test_audit(spark):
    t = spark.createDataFrame([(f"a{i}", i, D(2022, 1, 10), f"T{i}") for i in range(1, 9)], "event_id string, cik long, day0 date, ticker string")
    f = spark.createDataFrame([(1, "25-NSE", D(2022, 6, 1)), (2, "SC 13E3", D(2022, 2, 1)), (3, "15-12B", D(2022, 5, 1)), (4, "15-12B", D(2025, 1, 1)), (5, "SC 14D9", D(2021, 1, 1)), (6, "SC TO-T", D(2022, 2, 1)), (6, "25", D(2022, 3, 1)), (7, "25-NSE", D(2022, 6, 1))], "cik long, form string, filing_date date")
    c = spark.createDataFrame([(i, "Big Motors" if i == 3 else "X Capital Holdings", "Early Bird Acquisitions Corp" if i == 3 else "", "6770" if i == 8 else "2834") for i in range(1, 9)], "cik long, name string, former_names string, sic string")
    m = spark.createDataFrame([("T7", 7, "Some Acquisition Company", None, None), ("T1", 1, "Some Acquisition Company", D(2023, 1, 1), None), ("ZZ", 2, "Blank Check Co", None, None)], RANGE)
    got = {r.event_id: r.category for r in idmap.audit_targets(t, f, c, m).collect()}
    assert got == {"a1": "delisted_after", "a2": "tender_or_13e3", "a3": "spac", "a4": "unconfirmed", "a5": "unconfirmed", "a6": "unconfirmed", "a7": "spac", "a8": "spac"}
    assert {r.event_id: r.category for r in idmap.audit_targets(t, f, c).collect()}["a7"] == "delisted_after"


def test_classify(spark):
    rows = [("T", None, 1), ("T", "T", 1), ("T", "T.U", 1), ("T", "TWS", 1), ("T", "TR", 1), ("T", "OWN", 1), ("T", "OTH", 1)]
    r = spark.createDataFrame([("T", 1), ("OWN", 1), ("OWN", 2), ("OTH", 2)], "ticker string, cik long")
    got = {x.release_ticker: x.outcome for x in idmap.classified(spark.createDataFrame(rows, "map_ticker string, release_ticker string, cik long"), r).collect()}
    assert got == {None: "no_ticker_in_release", "T": "agree", "T.U": "units_or_warrants", "TWS": "units_or_warrants", "TR": "release_ticker_not_in_map", "OWN": "same_company_other_ticker", "OTH": "release_ticker_other_company"}


def test_thin_share_classes(spark):
    ev = spark.createDataFrame([("e1", "earnings", "ABCB", D(2021, 3, 9)), ("e2", "earnings", "ABCA", D(2021, 3, 9)), ("e3", "earnings", "XYZ", D(2021, 3, 9)), ("e4", "earnings", "FRPH", D(2021, 3, 9))], "event_id string, event_type string, ticker string, day0 date")
    v = spark.createDataFrame([("ABCA", D(2021, 3, 1), 500.0), ("ABCB", D(2021, 3, 1), 50.0), ("ABCK", D(2021, 3, 1), 900.0), ("FRPH", D(2021, 3, 1), 1.0), ("FRPT", D(2021, 3, 1), 900.0)], "symbol string, month date, volume double")
    n = spark.createDataFrame([("ABCA", "Abc Inc Series A Common Stock"), ("ABCB", "ABC, Inc. Class B"), ("ABCK", "Abc Inc. Series C"), ("FRPH", "Frp Holdings"), ("FRPT", "Freshpet")], "ticker string, name string")
    assert [(r.event_id, r.sibling, r.ratio) for r in idmap.thin_share_classes(ev, v, n).collect()] == [("e1", "ABCK", 18.0)]


def test_names_and_resolution(spark):
    companies = spark.createDataFrame([(1, "Acme Holdings, Inc. /DE/", "Old Acme Corp", 0), (2, "ACME INC", "", 1), (3, "Johnson & Johnson", None, 2), (4, "Pacific Biosciences of California", "", 3), (5, "Global Trust International", "", 4)], "cik long, name string, former_names string, ord int")
    names = ["Acme Inc.", "Old Acme Corporation", "Johnson and Johnson", "Pacific Bioscience of California", "Nobody Known", "", None, "Global", "The Company Inc"]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, issuer_name string")
    got = {r.i: (r.cik, r.name_method, r.name_reason) for r in entity.resolve_cik(rows, companies).collect()}
    assert got == {0: (1, "exact", None), 1: (1, "exact", None), 2: (3, "exact", None), 3: (4, "fuzzy", None), 4: (None, None, "no_company"), 5: (None, None, "no_name"), 6: (None, None, "no_name"), 7: (5, "fuzzy", None), 8: (None, None, "no_name")}


@pytest.mark.parametrize(("a", "b", "score"), [("a b", "b a c", 100.0), ("abc", "abd", 200 * 2 / 6), ("", "x", 0.0), ("fuzzy was a bear", "fuzzy fuzzy was a bear", 100.0)])
def test_token_set_ratio(a, b, score):
    assert fuzzy.token_set_ratio(a, b) == pytest.approx(score)


def test_partial_ratio():
    assert fuzzy.partial_ratio("acme", "the acme corp") == 100.0
    assert fuzzy.partial_ratio("abcd", "xxabxdxx") == pytest.approx(75.0)
    assert fuzzy.partial_ratio("", "x") == 0.0


def test_match_cascade(spark):
    cal = calendar.exchange_sessions(spark, "2022-01-01", "2023-12-31")
    ev = spark.createDataFrame([("t1", 1, "acquisition_target", D(2022, 6, 6)), ("n1", 1, "earnings", D(2022, 6, 7)), ("t2", 2, "acquisition_target", D(2022, 3, 1)), ("t3", 2, "acquisition_target", D(2023, 3, 1)), ("n4", 4, "earnings", D(2022, 5, 2))], "event_id string, cik long, event_type string, day0 date")
    F_ = "row_id long, cik long, name_reason string, announcement_date date, last_trade_date date, event_type string, evidence string, release_date date"
    rows = [(1, 1, None, D(2022, 6, 4), None, "acquisition_target", None, None), (2, 1, None, None, D(2022, 5, 20), "earnings", None, None), (3, 2, None, None, None, "acquisition_target", "said in 2023", None),
            (4, 2, None, None, None, "acquisition_target", "", None), (5, 9, None, None, None, "earnings", None, None), (6, None, "no_name", None, None, None, None, None), (7, 4, None, None, None, "earnings", None, None),
            (8, 4, None, None, None, "acquisition_target", None, None), (9, 4, None, D(2022, 9, 1), None, "earnings", None, None), (10, 4, None, None, D(2022, 9, 1), "earnings", None, None), (11, 1, None, D(2022, 6, 6), None, "acquisition_target", None, D(2022, 1, 1))]
    got = {r.row_id: (r.event_id, r.reason) for r in entity.match_events(spark.createDataFrame(rows, F_), ev, cal).collect()}
    assert got == {1: ("t1", None), 2: ("n1", None), 3: ("t3", None), 4: (None, "ambiguous_target"), 5: (None, "no_event_for_cik"), 6: (None, "no_name"), 7: (None, "no_dates"), 8: (None, "no_target_event"), 9: (None, "no_event_in_window"), 10: (None, "no_event_after_trades"), 11: (None, "no_event_in_window")}


def test_security_and_issuer_names(spark):
    df = spark.createDataFrame([("Acme Holdings Inc. Class A Common Stock", 'Acme  Corp (the "Company")')], "a string, b string")
    r = df.select(text.name_key(F.col("a")).alias("a"), text.clean_issuer(F.col("b")).alias("b")).first()
    assert (r.a, r.b) == ("acme", "Acme Corp")
    names = ["Acme Corp", "a biotech company", "Company A", "", None, "Unknown", "Post's employer", "Acme (a Delaware corporation)", "The Gap", "null", "3M"]
    named = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(text.is_named(F.col("n")).alias("x")).collect()
    assert [x.x for x in named] == [True, False, False, False, False, False, False, False, True, False, False]


@pytest.mark.parametrize(("name", "want"), [("APPLE INC /CA/", "apple"), ("O'Brien & Sons d/b/a Pub", "o brien and sons"), ("First Trust International Bancorp", "first trust international bancorp"), ("Class A Co", ""), (None, "")])
def test_names_in_both_languages(spark, name, want):
    assert text.name_of(name) == want
    assert spark.createDataFrame([(name,)], "n string").select(text.company_name(F.col("n"))).first()[0] == want


def test_sic_divisions(spark):
    codes = {"0100": "A", "1800": "?", "2834": "D", "283": "A", "9000": "?", "9100": "J", "6770": "H", "": "?", None: "?", "word": "?", "99": "?"}
    got = spark.createDataFrame([(c,) for c in codes], "c string").select("c", text.sic_division(F.col("c")).alias("d")).collect()
    assert {r.c: r.d for r in got} == codes
