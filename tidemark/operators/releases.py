"""Releases: page reading, date anomalies, clean events, page acceptance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fuzzy, html, text
from ..functions.stats import global_rank, median_of


def _added(rows: DataFrame, fields: str, read) -> DataFrame:
    """``rows`` with the columns that ``read`` makes of each batch, in one pass."""
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(fields).fields])
    names = [f.name for f in T.StructType.fromDDL(fields).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = list(zip(*read(pdf))) or [()] * len(names)
            yield pdf.assign(**{n: pd.Series(list(c), index=pdf.index, dtype="object") for n, c in zip(names, made)})

    return rows.mapInPandas(run, schema)


def parse_releases(pages: DataFrame, body: str = "html") -> DataFrame:
    """``pages`` with lr_no, respondents, text, release_date and the mention
    flags; all null or false where the page has no release header."""
    found = _added(pages, "lr_no long, respondents string, text string, release_date date", lambda pdf: (html.release(x) or (None, None, None, None) for x in pdf[body]))
    return found.withColumns(text.release_flags(F.col("text")))


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id with title, publication time (Eastern) and where it was read,
    text length and number of links; each page is parsed once."""

    def read(pdf):
        for x in pdf["html"]:
            r = html._read(x)
            t, how = html.page_time(None, r)
            yield html.page_title(None, r), t, how, len(html._lines(r)), len(r.links)

    return _added(pages.select("page_id", "html"), "headline string, published timestamp_ntz, published_from string, n_text long, n_links long", read).drop("html")


def read_exhibits(exhibits: DataFrame, body: str = "html") -> DataFrame:
    """``exhibits`` with wire, dateline and headline of the press release."""
    return _added(exhibits, "wire string, dateline date, headline string", lambda pdf: (html.read_exhibit(html.visible_text(x)) for x in pdf[body]))


def index_urls(indexes: DataFrame, body: str = "html", url: str = "url") -> DataFrame:
    """Filing indexes with the URLs of their press release and main document."""
    return _added(indexes, "exhibit_url string, primary_url string", lambda pdf: ((html.exhibit_url(x, u), html.primary_url(x, u)) for x, u in zip(pdf[body], pdf[url])))


def check_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (html, headline, dateline, filed) with published (null unless
    the page passes as the release), how or why not, and the title's score."""
    missing = lambda d: None if pd.isna(d) else d

    def read(pdf):
        for x, h, d, f in zip(pdf["html"], pdf["headline"], pdf["dateline"], pdf["filed"]):
            yield html.check_page(x, h or "", missing(d), missing(f))

    return _added(pages, "published timestamp_ntz, how string, score double", read)


def result_links(pages: DataFrame, path_regex: str, title: str) -> DataFrame:
    """(url, score): article links of search pages, redirects decoded, by title
    similarity; a link found twice keeps its best score."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(href, fuzzy.token_set_ratio(t.lower(), title.lower())) for x in pdf["html"] for href, t in html.links(x)]
            yield pd.DataFrame(rows, columns=["href", "score"]).astype({"href": "object", "score": "float64"})

    found = pages.select("html").mapInPandas(read, "href string, score double")
    own = found.withColumn("url", text.redirect_target(F.col("href"))).where(F.col("url").rlike(path_regex))
    return own.groupBy("url").agg(F.max("score").alias("score"))


def accept_page(score: Column, page_date: Column, dateline: Column, filed: Column) -> Column:
    """``accepted`` or why a page is not the release."""
    with_line = F.when(score < 75, "title").when(page_date != dateline, "date").otherwise("accepted")
    near = F.datediff(filed, page_date).between(0, 3)
    without = F.when(score < 85, "title").when(~near, "date").otherwise("accepted")
    return F.when(page_date.isNull(), "no_date").when(dateline.isNotNull(), with_line).otherwise(without)


#: Numbers of a block of the anomaly check, and rows that a block sees beside it.
BLOCK, AROUND, LEAST_AROUND, MOST_DAYS = 20_000, 5, 3, 30


def date_anomalies(releases: DataFrame, number: str = "lr_no", date: str = "release_date") -> DataFrame:
    """Releases without a date, or over 30 days from the median of the eleven
    around them by number: (number, date, problem, days_from_neighbours).

    Neighbours are found by place, and places by ``global_rank``: blocks of
    consecutive places take five rows of either side along, so no task holds
    all releases.
    """
    days = F.datediff(date, F.lit("1970-01-01").cast("date")).cast("double")
    ranked = global_rank(releases.select(number, date, days.alias("_days"), F.col(number).cast("double").alias("_key")), "_key", number, "_place", "_all")
    home = F.floor(F.col("_place") / BLOCK)
    sides = F.array_distinct(F.array(home, F.floor((F.col("_place") - AROUND) / BLOCK), F.floor((F.col("_place") + AROUND) / BLOCK)))
    dealt = ranked.withColumn("_home", home).withColumn("_block", F.explode(sides))
    w = Window.partitionBy("_block").orderBy("_place").rowsBetween(-AROUND, AROUND)
    near = F.collect_list("_days").over(w)
    dealt = dealt.withColumn("_near", near).where("_block = _home")
    gap = F.when(F.size("_near") >= LEAST_AROUND, F.col("_days") - median_of(F.col("_near")))
    problem = F.when(F.col(date).isNull(), "no_date").when(F.abs(gap) > MOST_DAYS, "out_of_sequence")
    return dealt.select(number, date, problem.alias("problem"), F.rint(gap).alias("days_from_neighbours")).where("problem IS NOT NULL")


# ---------------------------------------------------------------- events of releases

DAYS_APART = 30
_KINDS = ({"stock", "options", "both"}, {"long", "short", "sell", "both"})


def combined(values: list[str]) -> str:
    """One word for several claims: the only known one, ``both`` where all are of
    one kind, else ``other``; ``unknown`` where none is known."""
    known = {v for v in values if v and v != "unknown"}
    if len(known) <= 1:
        return next(iter(known), "unknown")
    return "both" if any(known <= kind for kind in _KINDS) else "other"


def _same_event(a: dict, b: dict) -> bool:
    """Same issuer, and neither types, dates nor trade dates speak against it."""
    kinds = {a["event_type"], b["event_type"]}
    days = [abs((a[f] - b[f]).days) if a[f] and b[f] else 0 for f in ("announcement_date", "last_trade_date")]
    return a["_key"] == b["_key"] and (len(kinds) == 1 or "unknown" in kinds) and days[0] == 0 and days[1] <= DAYS_APART


def merge_events(rows: list[dict]) -> list[dict]:
    """Fold a release's events in order: an event joins the first kept one that
    it can be the same as.

    The first known type and verified date stand, of trade dates the latest;
    claims of instruments and directions are combined. With any acquisition
    target among the events, acquirers go. An unknown type becomes ``other``.
    """
    kept: list[dict] = []
    for row in rows:
        into = next((k for k in kept if _same_event(k, row)), None)
        if into is None:
            kept.append(row | {"_instruments": [row["instruments"]], "_directions": [row["direction"]]})
            continue
        into["_instruments"].append(row["instruments"])
        into["_directions"].append(row["direction"])
        if into["event_type"] == "unknown":
            into["event_type"] = row["event_type"]
        if into["announcement_date"] is None and row["announcement_date"] is not None:
            into |= {f: row[f] for f in ("announcement_date", "date_check", "announcement_evidence")}
        if row["last_trade_date"] is not None and (into["last_trade_date"] is None or row["last_trade_date"] > into["last_trade_date"]):
            into |= {f: row[f] for f in ("last_trade_date", "trade_check", "trade_evidence")}
    if any(k["event_type"] == "acquisition_target" for k in kept):
        kept = [k for k in kept if k["event_type"] != "acquirer"]
    for k in kept:
        k["event_type"] = "other" if k["event_type"] == "unknown" else k["event_type"]
        k["instruments"], k["direction"] = combined(k["_instruments"]), combined(k["_directions"])
    return kept


EVENT_FIELDS = (
    "issuer_name string, ticker string, announcement_date date, date_check string, announcement_evidence string, "
    "last_trade_date date, trade_check string, trade_evidence string, event_type string, instruments string, direction string"
)


def clean_events(extracted: DataFrame, releases: DataFrame) -> DataFrame:
    """Checked and merged events per release.

    ``extracted``: lr_no, ord, issuer_name, ticker, announcement_date,
    announcement_evidence, last_trade_date, trade_evidence, event_type,
    instruments, direction. ``releases``: lr_no, text. Events without a named
    issuer go; a date stays only if its quote is in the release and states it;
    instruments are held to what the release says (``instruments_check``).
    The fold depends on row order, so each release's few rows are folded in
    Python; everything else is in Catalyst.
    """
    issuer = text.clean_issuer(F.col("issuer_name"))
    rows = extracted.withColumn("issuer_name", issuer).where(text.is_named(F.col("issuer_name"))).join(releases.select("lr_no", F.col("text").alias("_t")), "lr_no", "left")
    rows = rows.withColumns({
        "_key": text.canonical(F.regexp_replace("issuer_name", r"[^\w\s]", "")),
        "_a": text.verify_date(F.col("announcement_date"), F.col("announcement_evidence"), F.col("_t")),
        "_l": text.verify_date(F.col("last_trade_date"), F.col("trade_evidence"), F.col("_t")),
        "event_type": F.coalesce("event_type", F.lit("unknown")),
    })
    checked = {"announcement_date": "_a.day", "date_check": "_a.reason", "last_trade_date": "_l.day", "trade_check": "_l.reason"}
    fields = [f.name for f in T.StructType.fromDDL(EVENT_FIELDS).fields]
    rows = rows.select("lr_no", "ord", "_key", *[F.col(checked.get(n, n)).alias(n) for n in fields])
    schema = T.StructType([rows.schema["lr_no"], *T.StructType.fromDDL(EVENT_FIELDS).fields])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("ord", kind="stable").astype(object)
        return pd.DataFrame(merge_events(ordered.where(ordered.notna(), None).to_dict("records")), columns=["lr_no", *fields])

    merged = rows.groupBy("lr_no").applyInPandas(fold, schema).join(releases.select("lr_no", F.col("text").alias("_t")), "lr_no", "left")
    merged = merged.withColumn("_c", text.check_instruments(F.col("instruments"), F.col("_t")))
    return merged.withColumn("instruments", F.col("_c.instruments")).withColumn("instruments_check", F.col("_c.reason")).drop("_c", "_t")


# Structure of an extraction's stored payload.
PAYLOAD = T.StructType.fromJson({"type": "struct", "fields": [
    {"name": "release_kind", "type": "string", "nullable": True, "metadata": {}},
    {"name": "is_insider_trading_case", "type": "boolean", "nullable": True, "metadata": {}},
    {"name": "events", "nullable": True, "metadata": {}, "type": {"type": "array", "containsNull": True, "elementType": {"type": "struct", "fields": [
        {"name": n, "type": "string", "nullable": True, "metadata": {}}
        for n in ("issuer_name", "ticker", "announcement_date", "announcement_evidence", "last_trade_date", "trade_evidence", "event_type", "instruments", "direction")]}}},
]})


def traded_events(payloads: DataFrame, releases: DataFrame) -> DataFrame:
    """Checked events of stored payloads (lr_no, model, ok, payload), one model's
    rows of a release folded together."""
    run = F.to_json(F.struct("lr_no", "model"))
    parsed = payloads.where("ok").withColumn("p", F.from_json("payload", PAYLOAD)).withColumn("_run", run)
    rows = parsed.select(F.col("_run").alias("lr_no"), F.posexplode("p.events").alias("ord", "e")).select("lr_no", "ord", "e.*")
    rows = rows.withColumns({"announcement_date": F.col("announcement_date").try_cast("date"), "last_trade_date": F.col("last_trade_date").try_cast("date")})
    texts = parsed.select("_run", "lr_no").join(releases.select("lr_no", "text"), "lr_no", "left").select(F.col("_run").alias("lr_no"), "text")
    cleaned = clean_events(rows, texts).withColumnRenamed("lr_no", "_run")
    heads = parsed.select("_run", "lr_no", "model", "p.release_kind", "p.is_insider_trading_case")
    return heads.join(cleaned, "_run").drop("_run")


def tickers_from_text(rows: DataFrame, body: str, name: str, out: str = "ticker") -> DataFrame:
    """``rows`` with the exchange-tagged ticker that stands behind the name
    (current and former ones, pipe-joined) and how it was chosen."""
    return _added(rows, f"{out} string, {out}_how string", lambda pdf: (html.ticker_for(t, n) for t, n in zip(pdf[body], pdf[name])))
