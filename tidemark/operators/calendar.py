"""Trading sessions and session arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds of the day at which a session's news window closes (16:00).
CLOSE = 16 * 3600
#: Days for which a date is mapped to its next session, at most.
REACH = 15

# Closures of the exchange that no yearly rule gives.
ONE_OFF_CLOSURES = (
    "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02",
    "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09",
)


def exchange_sessions(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(session, idx): weekdays without the exchange's holidays, by rule.

    New Year, Presidents' Day, Good Friday, Memorial Day, Juneteenth (from
    2022), Independence Day, Labor Day, Thanksgiving, Christmas, King's
    birthday (from 1998) and one-off closures. A holiday on a Saturday moves
    to Friday except New Year, one on a Sunday to Monday.
    """
    days = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS session")
    y, m, d = F.year("session"), F.month("session"), F.dayofmonth("session")
    dow = F.dayofweek("session")  # 1 is Sunday

    def fixed(month: int, day: int, to_friday: bool = True) -> Column:
        on = (m == month) & (d == day)
        monday = (m == month) & (d == day + 1) & (dow == 2)
        before = F.date_add("session", 1)
        friday = (F.month(before) == month) & (F.dayofmonth(before) == day) & (dow == 6)
        return on | monday | (friday if to_friday else F.lit(False))

    def nth_monday(month: int, n: int) -> Column:
        return (m == month) & (dow == 2) & (d > 7 * (n - 1)) & (d <= 7 * n)

    holidays = [
        fixed(1, 1, to_friday=False),
        nth_monday(1, 3) & (y >= 1998),
        nth_monday(2, 3),
        F.date_add("session", 2) == easter(F.year("session")),
        (m == 5) & (dow == 2) & (d > 24),
        fixed(6, 19) & (y >= 2022),
        fixed(7, 4),
        nth_monday(9, 1),
        (m == 11) & (dow == 5) & (d > 21) & (d <= 28),
        fixed(12, 25),
        F.date_format("session", "yyyy-MM-dd").isin(*ONE_OFF_CLOSURES),
    ]
    closed = holidays[0]
    for h in holidays[1:]:
        closed = closed | h
    return numbered(days.where(~dow.isin(1, 7) & ~closed))


def easter(year: Column) -> Column:
    """Easter Sunday of a year by the Gregorian computus (two-stage form)."""
    golden = year % 19
    century = F.floor(year / 100)
    epact = (century - F.floor(century / 4) - F.floor((8 * century + 13) / 25) + 19 * golden + 15) % 30
    moon = epact - F.floor(epact / 28) * (1 - F.floor(epact / 28) * F.floor(F.lit(29) / (epact + 1)) * F.floor((21 - golden) / 11))
    weekday = (year + F.floor(year / 4) + moon + 2 - century + F.floor(century / 4)) % 7
    offset = moon - weekday
    month = 3 + F.floor((offset + 40) / 44)
    day = offset + 28 - 31 * F.floor(month / 4)
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))


def numbered(sessions: DataFrame, column: str = "session") -> DataFrame:
    """(session, idx) of distinct sessions, idx from 0 by date.

    One row a session, so the single-partition window stays a few thousand
    rows however much data the sessions come from.
    """
    order = Window.orderBy("session")
    return sessions.select(F.col(column).alias("session")).where("session IS NOT NULL").distinct().withColumn("idx", (F.row_number().over(order) - 1).cast("long"))


def next_session_map(sessions: DataFrame) -> DataFrame:
    """(day, on_or_after, after, is_session, idx): each calendar day's sessions.

    Days run from ``REACH`` days before the first session to the last one.
    ``on_or_after`` is the first session from the day on, ``after`` the first
    later one (null past the last). One equi-join then replaces a search.
    """
    later = F.lead("session").over(Window.orderBy("session"))
    earlier = F.lag("session").over(Window.orderBy("session"))
    spans = sessions.select("session", "idx", later.alias("later"), F.coalesce(F.date_add(earlier, 1), F.date_sub("session", REACH)).alias("from"))
    days = spans.select("session", "idx", "later", F.explode(F.sequence("from", "session")).alias("day"))
    on = F.col("day") == F.col("session")
    return days.select("day", F.col("session").alias("on_or_after"), F.when(on, F.col("later")).otherwise(F.col("session")).alias("after"), on.alias("is_session"), "idx")


def seconds_of_day(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def day0(events: DataFrame, sessions: DataFrame, ts: str = "accepted", out: str = "day0") -> DataFrame:
    """First session in which news of ``ts`` could trade, as column ``out``.

    The day itself if it is a session and the time is before the close,
    otherwise the next session; null beyond the calendar or for a null time.
    """
    days = F.broadcast(next_session_map(sessions).select(F.col("day").alias("_day"), "on_or_after", "after"))
    joined = events.withColumn("_day", F.to_date(ts)).join(days, "_day", "left")
    return joined.withColumn(out, F.when(seconds_of_day(ts) < CLOSE, F.col("on_or_after")).otherwise(F.col("after"))).drop("_day", "on_or_after", "after")


def new_york_offset_hours(day: Column) -> Column:
    """Hours from New York to UTC (4 or 5) at local noon of a day."""
    noon = F.to_timestamp_ntz(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 12:00:00")))
    utc = F.convert_timezone(F.lit("America/New_York"), F.lit("UTC"), noon)
    return (F.hour(utc) - 12).cast("int")
