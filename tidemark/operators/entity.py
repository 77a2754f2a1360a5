"""Issuers in releases to companies, and releases to events."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import fuzzy, text
from .calendar import next_session_map

FUZZY = 92
NEAR_SESSIONS, AFTER_DAYS = 3, 30


def company_keys(companies: DataFrame) -> DataFrame:
    """(key, cik): normalised current and former names; of a key held by
    several companies the first row (order, name place) wins.

    ``companies``: cik, name, former_names (pipe-joined), ord.
    """
    former = F.filter(F.split(F.coalesce("former_names", F.lit("")), r"\|"), lambda x: x != "")
    names = companies.select("cik", "ord", F.posexplode(F.concat(F.array("name"), former)).alias("at", "n"))
    keyed = names.select("cik", text.company_name(F.col("n")).alias("key"), "ord", "at").where("key <> ''")
    return keyed.groupBy("key").agg(F.min(F.struct("ord", "at", "cik")).alias("f")).select("key", "f.ord", "f.at", "f.cik")


@F.pandas_udf(DoubleType())
def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([fuzzy.token_set_ratio(x, y) for x, y in zip(a, b)])


def resolve_cik(rows: DataFrame, companies: DataFrame, name: str = "issuer_name", threshold: float = FUZZY) -> DataFrame:
    """``rows`` with cik, name_method (exact, fuzzy), name_score, name_reason.

    Exact keys first. Names left over meet only keys that share a word with
    them; words on very many keys don't block, unless a name has no other.
    The best token-set ratio from ``threshold`` on wins, ties by company order.
    """
    keys = company_keys(companies)
    named = rows.withColumn("_key", text.company_name(F.col(name)))
    distinct = named.select("_key").distinct().where("_key <> ''")
    exact = distinct.join(keys, F.col("_key") == F.col("key")).select("_key", "cik", F.lit("exact").alias("name_method"), F.lit(100.0).alias("name_score"))
    rest = distinct.join(exact, "_key", "left_anti")
    words = keys.select("key", "ord", "at", "cik", F.explode(F.array_distinct(F.split("key", " "))).alias("w"))
    common = words.groupBy("w").agg(F.count("*").alias("n"))
    own = rest.select("_key", F.explode(F.array_distinct(F.split("_key", " "))).alias("w")).join(common, "w")
    # A name is looked up by its rarer words: all but those far more common than its rarest.
    rare = F.min("n").over(Window.partitionBy("_key"))
    own = own.withColumn("_least", rare).where("n <= 50 * _least").select("_key", "w")
    pairs = own.join(words, "w").select("_key", "key", "ord", "at", "cik").distinct()
    scored = pairs.withColumn("s", _token_set("_key", "key")).where(F.col("s") >= threshold)
    best = scored.groupBy("_key").agg(F.min(F.struct((-F.col("s")).alias("neg"), "ord", "at", "cik")).alias("b"))
    fuzzy_rows = best.select("_key", "b.cik", F.lit("fuzzy").alias("name_method"), (-F.col("b.neg")).alias("name_score"))
    found = exact.unionByName(fuzzy_rows)
    reason = F.when(F.col("_key") == "", "no_name").when(F.col("cik").isNull(), "no_company")
    return named.join(found, "_key", "left").withColumn("name_reason", reason).drop("_key")


def match_events(traded: DataFrame, events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Each resolved release row's event, or the reason why there is none.

    ``traded``: row_id, cik, name_reason, announcement_date, last_trade_date,
    event_type, evidence, release_date. ``events``: event_id, cik,
    event_type, day0. Day 0 must be before the release. By announcement date
    (within three sessions, a non-session counts as the next one), else by
    last trade date (first event in the 30 days after), else the company's
    only acquisition target, if need be the only one in a year that the
    evidence names.
    """
    cal = F.broadcast(next_session_map(sessions).select(F.col("day").alias("_day"), "idx"))
    t = traded.join(cal.withColumnsRenamed({"_day": "announcement_date", "idx": "ai"}), "announcement_date", "left")
    e = events.join(cal.withColumnsRenamed({"_day": "day0", "idx": "di"}), "day0", "left").select("event_id", F.col("cik").alias("_c"), F.col("event_type").alias("etype"), "day0", "di")
    on = (F.col("cik") == F.col("_c")) & (F.col("release_date").isNull() | (F.col("day0") < F.col("release_date")))
    pairs = t.join(e, on)
    fits = F.col("event_type").isin("acquisition_target", "earnings") & (F.col("event_type") == F.col("etype"))
    gap = F.abs(F.col("di") - F.col("ai"))
    by_date = pairs.where(F.col("ai").isNotNull() & (gap <= NEAR_SESSIONS)).groupBy("row_id").agg(F.min(F.struct((~fits).alias("o"), gap.alias("g"), "day0", "event_id", "etype", (F.col("di") - F.col("ai")).alias("sg"))).alias("a"))
    after = F.col("day0") <= F.date_add("last_trade_date", AFTER_DAYS)
    by_trade = pairs.where("announcement_date IS NULL AND last_trade_date IS NOT NULL").where((F.col("day0") > F.col("last_trade_date")) & after).groupBy("row_id").agg(F.min(F.struct((~fits).alias("o"), "day0", "event_id", "etype")).alias("b"))
    only = pairs.where("announcement_date IS NULL AND last_trade_date IS NULL AND event_type = 'acquisition_target' AND etype = 'acquisition_target'")
    in_year = F.array_contains(text.years_in(F.coalesce("evidence", F.lit(""))), F.year("day0"))
    target = only.groupBy("row_id").agg(F.count("*").alias("n"), F.min(F.struct("event_id", "etype")).alias("one"), F.count_if(in_year).alias("ny"), F.min(F.when(in_year, F.struct("event_id", "etype"))).alias("oney"))
    known = events.select(F.col("cik")).distinct().withColumn("_known", F.lit(True))
    j = t.join(known, "cik", "left").join(by_date, "row_id", "left").join(by_trade, "row_id", "left").join(target, "row_id", "left")
    one = F.when(F.col("n") == 1, F.col("one")).when(F.col("ny") == 1, F.col("oney"))
    has_a, has_t = F.col("announcement_date").isNotNull(), F.col("last_trade_date").isNotNull()
    event_id = F.coalesce(F.when(has_a, F.col("a.event_id")).when(has_t, F.col("b.event_id")).otherwise(one.event_id))
    reason = (F.when(F.col("name_reason").isNotNull(), F.col("name_reason")).when(F.col("_known").isNull(), "no_event_for_cik")
              .when(has_a & F.col("a").isNull(), "no_event_in_window").when(~has_a & has_t & F.col("b").isNull(), "no_event_after_trades")
              .when(~has_a & ~has_t & (F.col("event_type") != "acquisition_target"), "no_dates").when(~has_a & ~has_t & F.col("n").isNull(), "no_target_event")
              .when(~has_a & ~has_t & one.isNull(), "ambiguous_target"))
    source = F.when(has_a, "announcement_date").when(has_t, "last_trade_date").otherwise("target_only")
    return j.select("row_id", "cik", event_id.alias("event_id"), F.when(has_a, F.col("a.sg")).alias("session_gap"), F.when(event_id.isNotNull(), source).alias("date_source"), F.when(event_id.isNull(), reason).alias("reason"))


def charged(events: DataFrame, matches: DataFrame, releases: DataFrame) -> DataFrame:
    """``events`` with is_charged and lr_numbers (sorted, pipe-joined)."""
    m = matches.where("event_id IS NOT NULL").join(releases.select("row_id", "lr_no"), "row_id").groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("lr_no")), "|").alias("lr_numbers"))
    return events.join(m, "event_id", "left").withColumn("is_charged", F.col("lr_numbers").isNotNull())


def best_pairs(extracted: DataFrame, checked: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Hand-checked rows with the extracted row of the same release whose
    issuer is most alike; rates of agreement follow from ``ok_issuer``, ``ok_date``."""
    e = extracted.select("lr_no", F.col("issuer_name").alias("_n"), F.col("announcement_date").alias("_d"))
    j = checked.join(e, "lr_no", "left").withColumn("s", F.when(F.col("_n").isNotNull() & F.col("issuer_name").isNotNull(), _token_set(text.company_name(F.coalesce("issuer_name", F.lit(""))), text.company_name(F.coalesce("_n", F.lit(""))))))
    keys = checked.columns
    best = j.groupBy(*keys).agg(F.max(F.struct(F.coalesce("s", F.lit(-1.0)).alias("s"), F.col("_n").alias("n"), F.col("_d").alias("d"))).alias("m"))
    both_missing = F.col("issuer_name").isNull() & F.col("m.n").isNull()
    return best.select(*keys, (both_missing | (F.col("m.s") >= threshold)).alias("ok_issuer"), F.col("announcement_date").eqNullSafe(F.col("m.d")).alias("ok_date"))


def gate(rates: Iterable[float], least: float = 0.90) -> bool:
    return all(r >= least for r in rates)
