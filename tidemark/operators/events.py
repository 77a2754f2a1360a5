"""Filings into typed announcements with a resolved day 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import calendar

# Forms that only the target of a deal files, and those that make a filer a company of the study.
TARGET_FORMS = ("PREM14A", "DEFM14A", "SC 14D9", "SC14D9C", "SC 13E3")
PERIODIC_FORMS = ("10-K", "10-Q")
GAP_DAYS = 120
# Acceptance hours of the feed, and the last time that still counts for the day (17:30).
OPEN_SECONDS, SHUT_SECONDS, SAME_DAY_SECONDS = 6 * 3600, 22 * 3600, 17 * 3600 + 1800


def has_item(items: str | Column, code: str) -> Column:
    """The exact code in a comma list; '12.02' does not hold '2.02'."""
    c = F.col(items) if isinstance(items, str) else items
    return F.coalesce(F.array_contains(F.transform(F.split(c, ","), lambda x: F.trim(x)), code), F.lit(False))


def deal_starts(filings: DataFrame, company: str, date: str, gap: int = GAP_DAYS) -> DataFrame:
    """First filing of each deal: no filing of the company in the ``gap`` days
    before. The gap is to the previous filing, so a chain of filings is one
    deal however long it runs."""
    before = F.lag(date).over(Window.partitionBy(company).orderBy(date))
    return filings.withColumn("_b", before).where(F.col("_b").isNull() | (F.datediff(date, "_b") > gap)).drop("_b")


def resolve_times(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Day 0 of events whose stamp is off by 0, 1 or 2 times the UTC offset.

    ``events``: event_id, accepted_json (timestamp_ntz), filing_date. A
    candidate is the stamp less k offsets; those within acceptance hours
    whose implied filing date is the filing date come first, then those
    within hours, then all. Of the best tier the earliest day 0 wins, ties
    by least k. Adds accepted_et, day0, day0_candidates (distinct day 0s).
    """
    offset = calendar.new_york_offset_hours(F.to_date("accepted_json"))
    c = events.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    c = c.withColumn("_ts", F.col("accepted_json") - F.make_dt_interval(hours=(offset * F.col("_k")).cast("int")))
    c = calendar.day0(c, sessions, "_ts", "_day0")
    days = F.broadcast(calendar.next_session_map(sessions).select(F.col("day").alias("_day"), "is_session", "after", "on_or_after"))
    c = c.withColumn("_day", F.to_date("_ts")).join(days, "_day", "left")
    sec = calendar.seconds_of_day("_ts")
    implied = F.when(F.col("is_session") & (sec <= SAME_DAY_SECONDS), F.col("on_or_after")).otherwise(F.col("after"))
    hours = sec.between(OPEN_SECONDS, SHUT_SECONDS)
    tier = F.when(hours & implied.eqNullSafe(F.col("filing_date")), 3).when(hours, 2).otherwise(1)
    keys = [F.col(x) for x in events.columns]
    best = F.max("_tier").over(Window.partitionBy("event_id"))
    c = c.withColumn("_tier", tier).withColumn("_best", best).where("_tier = _best")
    # A candidate past the calendar has no day 0 and comes last.
    first = F.min(F.struct(F.col("_day0").isNull(), F.col("_day0").alias("day0"), F.col("_k"), F.col("_ts").alias("ts"))).alias("_f")
    out = c.groupBy(*keys).agg(first, F.count_distinct("_day0").cast("int").alias("day0_candidates"))
    return out.select(*events.columns, F.col("_f.ts").alias("accepted_et"), F.col("_f.day0").alias("day0"), "day0_candidates")


def with_exact_times(events: DataFrame, exact: DataFrame | None, sessions: DataFrame) -> DataFrame:
    """Replace resolved times by exact ones (accession, accepted_et) where known;
    ``day0_basis`` tells which: ``index_header`` or ``earliest_candidate``."""
    if exact is None:
        return events.withColumn("day0_basis", F.lit("earliest_candidate"))
    known = calendar.day0(exact.select("accession", F.col("accepted_et").alias("_et")), sessions, "_et", "_d0")
    j = events.join(known, "accession", "left")
    hit = F.col("_et").isNotNull()
    return j.withColumns({
        "accepted_et": F.coalesce("_et", "accepted_et"), "day0": F.when(hit, F.col("_d0")).otherwise(F.col("day0")),
        "day0_candidates": F.when(hit, 1).otherwise(F.col("day0_candidates")), "day0_basis": F.when(hit, "index_header").otherwise("earliest_candidate"),
    }).drop("_et", "_d0")


def build_events(companies: DataFrame, filings: DataFrame, sessions: DataFrame, first: str = "2016-01-01", last: str = "2025-12-31", exact: DataFrame | None = None) -> DataFrame:
    """Typed announcements of operating companies that file periodic reports.

    ``companies``: cik, entity_type. ``filings``: cik, accession,
    filing_date, accepted_json, form, items. A company counts if it filed a
    10-K or 10-Q from ``first`` to ``last``; a missing entity type counts as
    operating. Types are not exclusive: earnings (item 2.02),
    acquisition_target (the latest item-1.01 filing at most 120 days before a
    deal's first target form, which may come up to 120 days after ``last``)
    and other_material_candidate (7.01 or 8.01 without 1.01 and 2.02).
    """
    start, end = F.lit(first).cast("date"), F.lit(last).cast("date")
    filed = F.col("filing_date")
    operating = companies.where(F.coalesce("entity_type", F.lit("operating")) == "operating").select("cik")
    universe = filings.where(F.col("form").isin(*PERIODIC_FORMS) & filed.between(start, end)).join(operating, "cik", "left_semi").select("cik").distinct()
    eight = filings.where((F.col("form") == "8-K") & filed.between(start, end)).join(universe, "cik", "left_semi")
    e202, e101, e701, e801 = (has_item("items", x) for x in ("2.02", "1.01", "7.01", "8.01"))
    earnings = eight.where(e202).withColumns({"event_type": F.lit("earnings"), "evidence": F.lit("")})
    other = eight.where((e701 | e801) & ~e101 & ~e202).withColumns({"event_type": F.lit("other_material_candidate"), "evidence": F.lit("")})
    shown = filings.where(F.col("form").isin(*TARGET_FORMS) & filed.between(start, F.date_add(end, GAP_DAYS)))
    targets = shown.groupBy("cik", F.col("filing_date").alias("_t")).agg(F.min("form").alias("_form"))
    deals = deal_starts(targets, "cik", "_t")
    near = eight.where(e101).join(deals, "cik").where(F.datediff("_t", "filing_date").between(0, GAP_DAYS))
    latest = Window.partitionBy("cik", "_t").orderBy(F.desc("filing_date"), F.col("accepted_json").desc_nulls_first(), F.desc("accession"))
    acquired = near.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1")
    acquired = acquired.withColumns({"event_type": F.lit("acquisition_target"), "evidence": F.concat_ws(" ", "_form", F.col("_t").cast("string"))}).drop("_rn", "_t", "_form")
    typed = acquired.unionByName(earnings).unionByName(other)
    once = Window.partitionBy("accession", "event_type").orderBy("cik", "evidence")
    typed = typed.withColumn("_rn", F.row_number().over(once)).where("_rn = 1").drop("_rn")
    typed = typed.withColumn("event_id", F.concat(F.substring("event_type", 1, 3), F.lit("-"), "accession"))
    slim = typed.select("event_id", "cik", "accession", "filing_date", "accepted_json", "items", "event_type", "evidence")
    return with_exact_times(resolve_times(slim, sessions), exact, sessions)


def hour_histogram(filings: DataFrame, ts: str = "accepted_json") -> DataFrame:
    """Filings by hour of the stamp with their share."""
    g = filings.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
