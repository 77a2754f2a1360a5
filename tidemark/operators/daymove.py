"""When a stock moved first: the daily rule and the minute-bar rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import MAD_SCALE, bound, median_of
from .calendar import CLOSE, seconds_of_day

# Of the daily rule, then of the minute rule.
FLOOR, DEVIATIONS, LEAST_BASE = 0.05, 3.0, 60
VOLUME_TIMES, HEAVY_TIMES = 3.0, 10.0
LOOKBACK, BASE_FIRST, BASE_LAST = 2, 250, 31
MINUTE_VOLUME_TIMES, PERSIST, BASE_SESSIONS, WINDOW_SESSIONS = 5.0, 15, 10, 2
OPEN = 9 * 3600 + 1800


def market_rows(bars: DataFrame, market: DataFrame) -> DataFrame:
    """symbol, date, volume, ar: rows on which stock and market both have a
    bar, with the stock's return over its row before less the market's."""
    # By number, so that the costly frames over these rows stay in as many tasks.
    bars = bars.repartition(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol")
    both = bars.select("symbol", "date", "close", "volume").join(F.broadcast(market.select("date", F.col("close").alias("_m"))), "date")
    w = Window.partitionBy("symbol").orderBy("date")
    ret = lambda c: F.col(c) / F.nullif(F.lag(c).over(w), F.lit(0.0)) - 1
    return both.select("symbol", "date", "volume", (ret("close") - ret("_m")).alias("ar"))


def choose_day0(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Daily rule: does the news belong to the session before the filing's?

    ``events``: event_id, symbol (may be null), day0_8k, accepted (Eastern,
    may be null). ``rows``: symbol, date, ar, volume; rows count, not
    sessions. Returns event_id, day0, basis, shift, note, prior_moves (dates,
    pipe-joined).

    A row among the two before S = day0_8k and S itself is a move if its
    |ar| reaches max(5 %, 3 robust SDs of the baseline) on 3 median volumes,
    or 5 % on 10, and the cumulative ar from it through S keeps its sign and
    half of the bar that it cleared. Day 0 moves back one row only if the
    filing was accepted on that very day after the close and that row is a
    move. Basis: late_8k_shift, 8k_confirmed (S is a move), 8k_no_move,
    8k_no_data (no row S, or under 60 returns in its baseline), no_ticker.

    All statistics of a row come from frames over its own symbol, once for
    each (symbol, day) that any event asks for; events then join by equality.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    base = w.rowsBetween(-BASE_FIRST, -BASE_LAST)
    back = {f"{c}{j}": F.lag(c, j).over(w) for c in ("date", "ar", "volume") for j in range(1, LOOKBACK + 1)}
    asked = events.where("symbol IS NOT NULL").select("symbol", F.col("day0_8k").alias("date")).distinct().withColumn("_asked", F.lit(True))
    # Frames cost far more than their rows' bytes: partitions by number, which stay apart.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.select("symbol", "date", "ar", "volume").join(asked, ["symbol", "date"], "left").repartition(parts, "symbol")
    framed = marked.withColumns({"_ars": F.collect_list("ar").over(base), "_vols": F.collect_list("volume").over(base), **back})
    known = framed.where("_asked").withColumnsRenamed({"date": "date0", "ar": "ar0", "volume": "volume0"})
    spread = bound(median_of(F.col("_ars")), lambda mid: median_of(F.transform("_ars", lambda x: F.abs(x - mid))))
    known = known.withColumns({"_n": F.size("_ars"), "_vol": F.nullif(median_of(F.col("_vols")), F.lit(0.0)), "_thr": F.greatest(F.lit(FLOOR), DEVIATIONS * MAD_SCALE * spread)})
    cumulative: Column = F.lit(1.0)
    for j in range(LOOKBACK + 1):
        cumulative = cumulative * (1 + F.coalesce(f"ar{j}", F.lit(0.0)))
        a, times = F.col(f"ar{j}"), F.col(f"volume{j}") / F.col("_vol")
        large, heavy = (F.abs(a) >= F.col("_thr")) & (times >= VOLUME_TIMES), (F.abs(a) >= FLOOR) & (times >= HEAVY_TIMES)
        bar = F.when(large, F.col("_thr")).when(heavy, F.lit(FLOOR))
        whole = cumulative - 1
        holds = (F.signum(whole) == F.signum(a)) & (F.abs(whole) >= bar / 2)
        shown = F.format_string("%s: AR %+.1f%% on %.0fx volume, %+.1f%% through %s", F.col(f"date{j}").cast("string"), a * 100, times, whole * 100, F.col("date0").cast("string"))
        known = known.withColumns({f"_hit{j}": F.coalesce(holds, F.lit(False)), f"_say{j}": shown})
    keep = [f"{c}{j}" for c in ("date", "_hit", "_say") for j in range(LOOKBACK + 1)]
    known = known.select("symbol", F.col("date0").alias("day0_8k"), "_n", "_thr", *keep)
    j = events.select("event_id", "symbol", "day0_8k", "accepted").join(known, ["symbol", "day0_8k"], "left")
    enough = F.coalesce(F.col("_n") >= LEAST_BASE, F.lit(False))
    late = (F.to_date("accepted") == F.col("date1")) & (seconds_of_day("accepted") >= CLOSE)
    shift = enough & F.coalesce(late & F.col("_hit1"), F.lit(False))
    basis = (F.when(F.col("symbol").isNull(), "no_ticker").when(~enough, "8k_no_data").when(shift, "late_8k_shift")
             .when(F.col("_hit0"), "8k_confirmed").otherwise("8k_no_move"))
    two, one = F.when(F.col("_hit2"), F.col("date2")), F.when(F.col("_hit1") & ~shift, F.col("date1"))
    prior = F.when(enough, F.concat_ws("|", two.cast("string"), one.cast("string"))).otherwise("")
    earlier = F.concat_ws("; ", F.when(F.col("_hit2"), F.col("_say2")), F.when(F.col("_hit1"), F.col("_say1")))
    flag = F.when(earlier != "", F.concat(F.lit("; announcement-sized moves before day 0 kept in the window: "), earlier)).otherwise("")
    bar = F.format_string("; threshold %.1f%%", F.col("_thr") * 100)
    note = (F.when(basis == "no_ticker", "no ticker for the company on day 0")
            .when(F.col("_n").isNull(), F.format_string("no bar for %s", F.col("day0_8k").cast("string")))
            .when(~enough, F.format_string(f"%d baseline sessions (need {LEAST_BASE})", F.col("_n")))
            .when(shift, F.concat(F.format_string("8-K accepted %s, after the close; ", F.date_format("accepted", "yyyy-MM-dd HH:mm")), F.col("_say1"), bar))
            .when(F.col("_hit0"), F.concat(F.col("_say0"), bar, flag))
            .otherwise(F.concat(F.format_string("no announcement-sized move on %s", F.col("day0_8k").cast("string")), bar, flag)))
    return j.select("event_id", F.when(shift, F.col("date1")).otherwise(F.col("day0_8k")).alias("day0"), basis.alias("basis"), shift.cast("int").alias("shift"), note.alias("note"), prior.alias("prior_moves"))


def first_move(events: DataFrame, bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Minute-bar rule: the first minute of a large, heavy and lasting move.

    ``events``: event_id, symbol, day0. ``bars``: symbol, ts (Eastern), c, v;
    those on a day that is no session are left out. ``sessions``: session,
    idx. Searched are the two sessions before day 0 and day 0; the ten before
    them are the baseline. A minute is a move if its price is max(5 %, 3 SDs
    of the baseline closes' returns) from the last regular close (its own
    day's from 16:00 on, else the session's before), its volume five medians
    of the baseline's regular minutes, and the median price of the next 15
    minutes keeps half of the threshold in its direction.

    One row per event: event_id, ts, move, threshold, note; ts is null where
    no minute qualifies, and the note says why.
    """
    cal = F.broadcast(sessions.select(F.col("session").alias("_day"), "idx"))
    b = bars.withColumn("_day", F.to_date("ts")).join(cal, "_day").withColumn("_sec", seconds_of_day("ts"))
    regular = (F.col("_sec") >= OPEN) & (F.col("_sec") < CLOSE)
    closes = b.where(regular).groupBy("symbol", "idx").agg(F.max_by("c", "ts").alias("close"))
    ev = events.join(cal.withColumnsRenamed({"_day": "day0", "idx": "i0"}), "day0").select("event_id", "symbol", "i0")
    first = F.greatest(F.lit(0).cast("long"), F.col("i0") - WINDOW_SESSIONS)
    span = lambda lo, hi: F.explode(F.filter(F.sequence(lo, hi), lambda x: x >= 0))
    # Baseline: sessions before the window, joined by equality on each of them.
    base = ev.withColumn("idx", span(F.col("i0") - WINDOW_SESSIONS - BASE_SESSIONS, F.col("i0") - WINDOW_SESSIONS - 1))
    by_event = Window.partitionBy("event_id").orderBy("idx")
    returns = base.join(closes, ["symbol", "idx"]).withColumn("_r", F.col("close") / F.nullif(F.lag("close").over(by_event), F.lit(0.0)) - 1)
    spread = returns.groupBy("event_id").agg(F.stddev_samp("_r").alias("sd"), F.count("close").alias("n_close"))
    volume = base.join(b.where(regular).select("symbol", "idx", "v"), ["symbol", "idx"]).groupBy("event_id").agg(F.median("v").alias("base_v"))
    known = ev.select("event_id").join(spread, "event_id", "left").join(volume, "event_id", "left")
    enough = F.coalesce((F.col("n_close") >= 3) & F.col("base_v").isNotNull(), F.lit(False))
    known = known.select("event_id", "base_v", enough.alias("enough"), F.greatest(F.lit(FLOOR), DEVIATIONS * F.coalesce("sd", F.lit(0.0))).alias("thr"))
    # Window: minutes from its first session to day 0, with the close that each compares with.
    window = ev.withColumn("idx", span(first, F.col("i0"))).join(b.select("symbol", "idx", "ts", "c", "v", "_sec"), ["symbol", "idx"])
    window = window.withColumn("_ref", F.when(F.col("_sec") >= CLOSE, F.col("idx")).otherwise(F.col("idx") - 1))
    window = window.join(closes.withColumnsRenamed({"idx": "_ref", "close": "ref"}), ["symbol", "_ref"], "left").withColumn("ref", F.when(F.col("ref") > 0, F.col("ref")))
    ahead = Window.partitionBy("event_id").orderBy("ts").rowsBetween(1, PERSIST)
    window = window.withColumn("_next", median_of(F.collect_list("c").over(ahead)))
    j = window.join(known, "event_id")
    move = F.col("c") / F.col("ref") - 1
    lasting = (F.col("_next") / F.col("ref") - 1) * F.when(move > 0, 1).otherwise(-1) >= F.col("thr") / 2
    hit = F.coalesce(F.col("enough") & (F.abs(move) >= F.col("thr")) & (F.col("v") >= MINUTE_VOLUME_TIMES * F.col("base_v")) & lasting, F.lit(False))
    found = j.groupBy("event_id").agg(F.min(F.when(hit, F.struct("ts", move.alias("move"), (F.col("v") / F.nullif(F.col("base_v"), F.lit(0.0))).alias("times")))).alias("h"), F.max(F.abs(move)).alias("most"), F.count("*").alias("n_bars"))
    out = known.join(found, "event_id", "left")
    none = F.coalesce("n_bars", F.lit(0)) == 0
    note = (F.when(~F.col("enough") & none, "no minute bars").when(~F.col("enough"), "too little trading before the window for a baseline")
            .when(F.col("h").isNotNull(), F.format_string("%+.1f%% from the close on %.0fx median minute volume; threshold %.1f%%", F.col("h.move") * 100, F.col("h.times"), F.col("thr") * 100))
            .otherwise(F.format_string("no move met the rules (largest %.1f%% vs threshold %.1f%%)", F.col("most") * 100, F.col("thr") * 100)))
    return out.select("event_id", F.col("h.ts").alias("ts"), F.col("h.move").alias("move"), F.when(F.col("enough"), F.col("thr")).alias("threshold"), note.alias("note"))
