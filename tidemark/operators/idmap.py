"""Dated ticker-to-company map: ranges, interval joins, supplement, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Kinds of security kept; what the names of others say, for all rows
# and for untyped ones; exchange test symbols; what turns a ticker into its
# warrant, unit or right; the national exchanges.
STOCK_TYPES = ("CS", "ADRC", "ADRP", "ADRS", "OS", "NYRS", "GDR")
NOT_STOCK_TYPED = r"(?i)\bnotes?\b|\bdebentures?\b|\bpreferred\b|\bpfd\b|\bwarrants?\b|\bwhen[ -]issued\b|%"
NOT_STOCK_NAME = (
    r"(?i)\b(warrants?|units?|rights?|preferred|pfd|depositary shares?|notes?|debentures?|"
    r"etf|etn|fund|index|trust preferred|subordinated|senior|%)\b|%"
)
TEST_SYMBOL = r"TEST|^Z[A-Z]ZZT"
LINE_SUFFIX = r"[.-]?(W|WS|WT|U|UN|R|RT)$"
UNIT_SUFFIX = r"[.\-]?(?:U|UN|W|WS|WT)$"
EXCHANGES = ("NYSE", "Nasdaq", "CBOE", "NYSE American", "NYSE Arca", "NYSE MKT", "BATS")
SHORT_KEY = 5


def interval_join(events: DataFrame, ranges: DataFrame, day: str, how: str = "left") -> DataFrame:
    """Events with the map rows valid on their day; open ends are null.

    The company is the equi key, the dates a residual on its few rows.
    """
    e, r = events.alias("e"), ranges.alias("r")
    d = F.col(f"e.{day}")
    on = (F.col("e.cik") == F.col("r.cik")) & (F.col("r.valid_from").isNull() | (d >= F.col("r.valid_from"))) & (F.col("r.valid_to").isNull() | (d <= F.col("r.valid_to")))
    return e.join(r, on, how).drop(F.col("r.cik"))


def ticker_ranges(raw: DataFrame) -> DataFrame:
    """Ranges per ticker from holders with delisting dates.

    ``raw``: ticker, cik, name, type, composite_figi, delisted (date). The
    latest row of each holder (its cik, else its figi) stands for it; a null
    delisting is still active, thus the latest. Each range starts the day
    after the last non-null end before it; the first is open.
    """
    holder = F.coalesce(F.col("cik").cast("string"), F.concat(F.lit("figi:"), F.coalesce("composite_figi", F.lit("?"))))
    latest = Window.partitionBy("ticker", "_h").orderBy(F.col("delisted").desc_nulls_first(), F.desc("name"))
    rows = raw.withColumn("_h", holder).withColumn("_rn", F.row_number().over(latest)).where("_rn = 1")
    ends = Window.partitionBy("ticker").orderBy(F.col("delisted").asc_nulls_last(), "_h").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("valid_from", F.date_add(F.last("delisted", ignorenulls=True).over(ends), 1)).withColumn("valid_to", F.col("delisted"))
    return rows.drop("_h", "_rn", "delisted")


def map_filter(raw: DataFrame) -> DataFrame:
    """Rows that may be a company's stock, a missing type as ``untyped``.

    No test symbols, notes, preferred shares, warrants or when-issued lines;
    of a kept type, or untyped with a cik, no other security by name, and not
    another ticker of the company plus a warrant, unit or right suffix.
    """
    named = F.coalesce("name", F.lit(""))
    clean = raw.where(~F.col("ticker").rlike(TEST_SYMBOL) & ~named.rlike(NOT_STOCK_TYPED)).withColumn("type", F.coalesce("type", F.lit("untyped")))
    typed = clean.where(F.col("type").isin(*STOCK_TYPES))
    untyped = clean.where((F.col("type") == "untyped") & F.col("cik").isNotNull() & ~named.rlike(NOT_STOCK_NAME)).alias("a")
    others = raw.select(F.col("cik"), F.col("ticker").alias("root")).where("cik IS NOT NULL").distinct().alias("b")
    line = F.rlike(F.col("a.ticker"), F.concat(F.lit("^\\Q"), F.col("b.root"), F.lit(f"\\E{LINE_SUFFIX}")))
    on = (F.col("a.cik") == F.col("b.cik")) & (F.col("a.ticker") != F.col("b.root")) & line
    return typed.unionByName(untyped.join(others, on, "left_anti").select(*raw.columns))


def monthly_volume(short_daily: DataFrame) -> DataFrame:
    """(symbol, month, volume): the small aggregate that breaks ties between tickers."""
    return short_daily.groupBy("symbol", F.to_date(F.date_trunc("month", "date")).alias("month")).agg(F.sum("total_volume").alias("volume"))


def event_tickers(events: DataFrame, ranges: DataFrame, volume: DataFrame | None = None, supplement: DataFrame | None = None) -> DataFrame:
    """(event_id, ticker, ticker_type, ticker_source): the map's ticker on day 0,
    else the supplement's by company and year unless it conflicts.

    Of several tickers the one with most volume in the month of day 0 and
    the one before wins, then common stock, then the later end (open last).
    """
    hits = interval_join(events.select("event_id", "cik", "day0"), ranges.select("cik", "ticker", F.col("type").alias("ticker_type"), "valid_from", "valid_to"), "day0")
    if volume is not None:
        month = F.to_date(F.date_trunc("month", "day0"))
        keyed = hits.withColumn("month", F.explode(F.array(month, F.add_months(month, -1)))).join(volume.withColumnRenamed("symbol", "ticker"), ["ticker", "month"], "left")
        keys = ["event_id", "cik", "day0", "ticker", "ticker_type", "valid_from", "valid_to"]
        hits = keyed.groupBy(*keys).agg(F.sum("volume").alias("_v"))
    else:
        hits = hits.withColumn("_v", F.lit(None).cast("double"))
    order = [F.coalesce("_v", F.lit(0.0)).desc(), F.coalesce(F.col("ticker_type") == "CS", F.lit(False)).desc(), F.col("valid_to").asc_nulls_last(), F.col("ticker")]
    best = hits.withColumn("_rn", F.row_number().over(Window.partitionBy("event_id").orderBy(*order))).where("_rn = 1").drop("_rn", "_v", "valid_from", "valid_to")
    if supplement is None:
        return best.select("event_id", "ticker", "ticker_type", F.when(F.col("ticker").isNotNull(), "map").alias("ticker_source"))
    extra = supplement.where(F.col("ticker").isNotNull() & ~F.coalesce("conflict", F.lit(False))).select("cik", F.col("year").alias("_y"), F.col("ticker").alias("_t"))
    j = best.withColumn("_y", F.year("day0")).join(extra, ["cik", "_y"], "left")
    source = F.when(F.col("ticker").isNotNull(), "map").when(F.col("_t").isNotNull(), "press_release")
    return j.select("event_id", F.coalesce("ticker", "_t").alias("ticker"), "ticker_type", source.alias("ticker_source"))


def coverage(events: DataFrame, tickers: DataFrame) -> DataFrame:
    """Share of events with a ticker by type and year."""
    j = events.join(tickers, "event_id", "left")
    return j.groupBy("event_type", F.year("day0").alias("year")).agg(F.count("*").alias("n"), F.count("ticker").alias("with_ticker"), F.avg(F.col("ticker").isNotNull().cast("double")).alias("share"))


def misses(events: DataFrame, tickers: DataFrame, companies: DataFrame) -> DataFrame:
    """Events without a ticker by what the company lists now: an exchange
    ticker, only others, or none."""
    j = events.join(tickers.where("ticker IS NOT NULL"), "event_id", "left_anti").join(companies.select("cik", F.col("exchanges").alias("_x"), F.col("tickers").alias("_t")), "cik")
    listed = F.arrays_overlap(F.split(F.coalesce("_x", F.lit("")), r"\|"), F.array(*map(F.lit, EXCHANGES)))
    state = F.when(listed, "exchange_ticker").when(F.coalesce("_t", F.lit("")) != "", "otc_ticker").otherwise("no_ticker")
    return j.groupBy("event_type", state.alias("edgar_now")).agg(F.count("*").alias("n"))


def all_names(companies: DataFrame) -> DataFrame:
    """(cik, name): current and former names, one a row."""
    former = F.split(F.coalesce("former_names", F.lit("")), r"\|")
    return companies.select("cik", F.explode(F.concat(F.array("name"), former)).alias("name")).where("name <> ''")


def name_supplement(missing: DataFrame, companies: DataFrame, ranges: DataFrame, volume: DataFrame | None, holders: DataFrame) -> DataFrame:
    """Tickers for company-years without one, by equal name keys.

    ``missing``: cik, year, first, last (event dates). ``companies``: cik,
    name, former_names (pipe-joined). ``ranges``: ticker, cik (nullable),
    name, valid_from, valid_to. ``volume``: symbol, month, volume (None: not
    looked at). ``holders``: cik, year, ticker already carried.

    A map row fits if its dates overlap and it has no cik, or another one that
    the companies don't know or know under that name, and then a key of five
    characters or more. Exactly one ticker must fit; no differently named
    company may hold it in those dates, nobody else's events may carry it that
    year, and it must trade from the month before the events to their end.
    """
    keys = all_names(companies).select("cik", text.name_key(F.col("name")).alias("key")).where("key <> ''").distinct()
    mapped = ranges.select("ticker", F.col("cik").alias("map_cik"), F.col("name").alias("map_name"), text.name_key(F.col("name")).alias("key"), "valid_from", "valid_to").where("key <> ''")
    # Map rows whose cik is unknown, or known under the row's own name, may be anyone's of that name.
    known = companies.select(F.col("cik").alias("map_cik")).distinct().withColumn("_known", F.lit(True))
    same = keys.select(F.col("cik").alias("map_cik"), "key").withColumn("_same", F.lit(True))
    mapped = mapped.join(known, "map_cik", "left").join(same, ["map_cik", "key"], "left")
    loose = F.col("map_cik").isNull() | F.col("_known").isNull() | F.col("_same").isNotNull()
    mapped = mapped.withColumn("loose", loose).drop("_known", "_same")
    dates = lambda f, u: (F.col(f).isNull() | (F.col(f) <= F.col("last"))) & (F.col(u).isNull() | (F.col(u) >= F.col("first")))
    other_cik = F.col("map_cik").isNull() | ((F.col("map_cik") != F.col("cik")) & (F.length("key") >= SHORT_KEY))
    hits = missing.join(keys, "cik").join(mapped, "key").where(other_cik & F.col("loose") & dates("valid_from", "valid_to"))
    found = F.max(F.struct("map_name", "map_cik", "key")).alias("m")
    one = hits.groupBy("cik", "year", "first", "last").agg(F.count_distinct("ticker").alias("n"), F.min("ticker").alias("ticker"), found).where("n = 1").select("cik", "year", "first", "last", "ticker", "m.*")
    # A holder of the ticker in those dates, known under other names only, rules it out.
    own_keys = F.collect_set("key").alias("_names")
    holding = ranges.where("cik IS NOT NULL").select(F.col("ticker").alias("_t"), F.col("cik").alias("_c"), F.col("valid_from").alias("_f"), F.col("valid_to").alias("_u"))
    holding = holding.join(keys.groupBy(F.col("cik").alias("_c")).agg(own_keys), "_c", "left").join(known.withColumnRenamed("map_cik", "_c"), "_c", "left")
    stranger = F.col("_known").isNotNull() & ~F.coalesce(F.array_contains("_names", F.col("key")), F.lit(False))
    one = one.join(holding, (F.col("ticker") == F.col("_t")) & (F.col("cik") != F.col("_c")) & stranger & dates("_f", "_u"), "left_anti")
    h = holders.select(F.col("cik").alias("_c"), F.col("year").alias("_y"), F.col("ticker").alias("_t"))
    one = one.join(h, (F.col("ticker") == F.col("_t")) & (F.col("year") == F.col("_y")) & (F.col("cik") != F.col("_c")), "left_anti")
    if volume is not None:
        from_month = F.to_date(F.date_trunc("month", F.add_months("first", -1)))
        one = one.join(volume, (F.col("ticker") == F.col("symbol")) & F.col("month").between(from_month, F.col("last")) & (F.col("volume") > 0), "left_semi")
    under = F.when(F.col("map_cik").isNull(), "has no CIK").otherwise(F.concat(F.lit("under CIK "), F.col("map_cik").cast("string")))
    said = F.concat(F.lit("name match: '"), "map_name", F.lit("' in the map "), under)
    return one.select("cik", "year", "ticker", F.lit(False).alias("conflict"), said.alias("how"))


def fill_worklist(events: DataFrame, tickers: DataFrame, supplement: DataFrame | None = None, kinds: tuple[str, ...] = (), per_company: int = 4) -> DataFrame:
    """Company-years with events that the map gives no ticker, and up to four
    accessions to look at: earnings first, then acquisition targets, then
    others, newest first.

    ``supplement`` (cik, year) takes out company-years already looked at;
    ``kinds`` keeps those with such an event. Adds last_day0.
    """
    rows = events.join(tickers.where("ticker IS NOT NULL"), "event_id", "left_anti").withColumn("year", F.year("day0"))
    if supplement is not None:
        rows = rows.join(supplement.select("cik", "year"), ["cik", "year"], "left_anti")
    priority = F.when(F.col("event_type") == "earnings", 0).when(F.col("event_type") == "acquisition_target", 1).otherwise(2)
    age = -F.datediff("day0", F.lit("1970-01-01").cast("date"))
    lists = F.sort_array(F.collect_list(F.struct(priority.alias("p"), age.alias("a"), F.col("accession").alias("x"))))
    wanted = F.bool_or(F.col("event_type").isin(*kinds)) if kinds else F.lit(True)
    g = rows.groupBy("cik", "year").agg(lists.alias("l"), F.max("day0").alias("last_day0"), wanted.alias("w")).where("w")
    return g.select("cik", "year", F.transform(F.slice("l", 1, per_company), lambda v: v.x).alias("accessions"), "last_day0")


def classify(found: Column, mapped: Column, in_map: Column, same_company: Column) -> Column:
    """Outcome of a ticker read in a release against the map's.

    ``in_map``: the map has the release's ticker; ``same_company``: it gives
    it to the same company on some date.
    """
    missing = found.isNull() | (found == "")
    units = F.rlike(found, F.concat(F.lit("^\\Q"), mapped, F.lit(f"\\E{UNIT_SUFFIX}")))
    return (F.when(missing, "no_ticker_in_release").when(found == mapped, "agree").when(units, "units_or_warrants")
            .when(~F.coalesce(in_map, F.lit(False)), "release_ticker_not_in_map")
            .when(F.coalesce(same_company, F.lit(False)), "same_company_other_ticker").otherwise("release_ticker_other_company"))


def classified(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """``rows`` (cik, map_ticker, release_ticker) with ``outcome``; ``ranges``: ticker, cik."""
    held = ranges.select(F.col("ticker").alias("release_ticker"), F.lit(True).alias("_in")).distinct()
    own = ranges.select(F.col("ticker").alias("release_ticker"), "cik", F.lit(True).alias("_own")).distinct()
    j = rows.join(held, "release_ticker", "left").join(own, ["release_ticker", "cik"], "left")
    return j.withColumn("outcome", classify(F.col("release_ticker"), F.col("map_ticker"), F.col("_in"), F.col("_own"))).drop("_in", "_own")


# Names of blank-check companies, forms of targets and of companies that leave, and days to look ahead.
SPAC_NAME = (
    r"(?i)\bacquisition\s+(?:corp|corporation|company|co|inc|ltd|limited|holdings)\b"
    r"|\bacquisitions?\s+corp\b|\bblank check\b"
)
TARGET_ONLY_FORMS, EXIT_FORMS, EXIT_DAYS = ("SC 14D9", "SC 13E3"), ("25-NSE", "15-12B"), 730


def audit_targets(targets: DataFrame, filings: DataFrame, companies: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Category of each acquisition target: spac, tender_or_13e3,
    delisted_after or unconfirmed, in that order of precedence.

    ``targets``: event_id, cik, day0, and ticker if ``ranges`` (ticker, cik,
    name, valid_from, valid_to) is given. ``companies``: cik, name,
    former_names, sic. A blank-check company shows by its SIC 6770, a current
    or former name, or the day-0 ticker's name in the map. Tender and
    going-private forms count from 30 days before to 365 after day 0; the
    first exit filing within 730 days is the exit date.
    """
    t = targets.join(companies.select("cik").distinct(), "cik", "left_semi")
    f = filings.select(F.col("cik").alias("_c"), "form", "filing_date")
    on = (F.col("cik") == F.col("_c")) & F.expr("filing_date BETWEEN date_sub(day0, 30) AND date_add(day0, 365)")
    tender = t.join(f.where(F.col("form").isin(*TARGET_ONLY_FORMS)), on, "left_semi").select("event_id", F.lit(True).alias("_tender"))
    left = (F.col("cik") == F.col("_c")) & F.expr(f"filing_date BETWEEN day0 AND date_add(day0, {EXIT_DAYS})")
    out = t.join(f.where(F.col("form").isin(*EXIT_FORMS)), left, "left").groupBy("event_id", "cik", "day0").agg(F.min("filing_date").alias("exit_date"))
    by_code = companies.where(F.col("sic").cast("string") == "6770").select("cik")
    by_name = all_names(companies).where(F.col("name").rlike(SPAC_NAME)).select("cik")
    spac = by_code.unionByName(by_name).distinct().withColumn("_spac", F.lit(True))
    j = out.join(tender, "event_id", "left").join(spac, "cik", "left")
    flag = F.coalesce("_spac", F.lit(False))
    if ranges is not None:
        named = ranges.where(F.col("name").rlike(SPAC_NAME)).select("ticker", "cik", "valid_from", "valid_to")
        mapped = interval_join(targets.select("event_id", "cik", "day0", F.col("ticker").alias("_own")), named, "day0", "inner")
        mapped = mapped.where("ticker = _own").select("event_id", F.lit(True).alias("_mapped")).distinct()
        j = j.join(mapped, "event_id", "left")
        flag = flag | F.coalesce("_mapped", F.lit(False))
    category = F.when(flag, "spac").when(F.coalesce("_tender", F.lit(False)), "tender_or_13e3").when(F.col("exit_date").isNotNull(), "delisted_after").otherwise("unconfirmed")
    return j.select("event_id", category.alias("category"), category.isin("tender_or_13e3", "delisted_after").alias("in_target_set"), "exit_date")


def thin_share_classes(events: DataFrame, volume: DataFrame, names: DataFrame, times: float = 10.0) -> DataFrame:
    """Events priced on a share class when a sibling trades ``times`` as much.

    ``events``: event_id, event_type, ticker, day0. ``volume``: symbol, month,
    volume. ``names``: ticker, name. A sibling has the same length (four
    letters or more), all but the last letter in common, and the same company
    name once class and series words are gone. Returns event_id, event_type,
    ticker, sibling (of most volume), sibling_volume, own_volume, ratio.
    """
    stem = lambda c: F.substring(c, F.lit(1), F.length(c) - 1)
    key = names.groupBy("ticker").agg(F.min("name").alias("name")).select("ticker", text.share_class_key(F.col("name")).alias("company")).where("company <> ''")
    traded = volume.join(key.withColumnRenamed("ticker", "symbol"), "symbol").withColumns({"root": stem(F.col("symbol")), "n": F.length("symbol")})
    ev = events.where(F.length("ticker") >= 4).join(key, "ticker").select("event_id", "event_type", "ticker", "company", stem(F.col("ticker")).alias("root"), F.length("ticker").alias("n"), F.to_date(F.date_trunc("month", "day0")).alias("month"))
    own = ev.join(volume.select(F.col("symbol").alias("ticker"), "month", F.col("volume").alias("own_volume")), ["ticker", "month"], "left")
    sib = own.join(traded, ["root", "n", "month", "company"]).where("symbol <> ticker")
    best = sib.groupBy("event_id", "event_type", "ticker", F.coalesce("own_volume", F.lit(0.0)).alias("own_volume")).agg(F.max(F.struct("volume", "symbol")).alias("s"))
    out = best.select("event_id", "event_type", "ticker", F.col("s.symbol").alias("sibling"), F.col("s.volume").alias("sibling_volume"), "own_volume")
    return out.withColumn("ratio", F.col("sibling_volume") / F.greatest(F.col("own_volume"), F.lit(1.0))).where(F.col("ratio") >= times)
