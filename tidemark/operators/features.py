"""Event windows: abnormal volume, market-model returns, share shifts.

All features of an event use sessions before its day 0 only. Windows of one
shape are one set of frames, looked at from different sessions: the sessions
that any event asks for join the symbol's facts by equality, and range frames
over the session number give every sum of window and baseline in one sorted
pass. Nothing is joined by range, no fact is repeated, and a frame adds its
rows in session order, so equal inputs give equal bits however the data is
partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.stats import median_of

#: First and last relative session of window and baseline.
WINDOWS = {"pre": ((-20, -1), (-250, -31)), "placebo": ((-70, -51), (-300, -81))}
LEAST_WINDOW, LEAST_BASE, LAST = 10, 60, 5
PRICE_BEFORE = 30


def session_returns(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Bars with ``idx`` and ``ret``: close over the previous *session's* close - 1.

    A missing session gives null: bars are matched to the session before by
    number, which is the calendar-filled lag without filling the calendar.
    """
    on = bars.join(F.broadcast(sessions.withColumnRenamed("session", "date")), "date")
    w = Window.partitionBy("symbol").orderBy("idx")
    previous = F.when(F.lag("idx").over(w) == F.col("idx") - 1, F.lag("close").over(w))
    return on.withColumn("ret", F.col("close") / F.nullif(previous, F.lit(0.0)) - 1)


def row_returns(bars: DataFrame) -> DataFrame:
    """Bars with ``ret`` over the previous *row* of the symbol, gaps or not."""
    w = Window.partitionBy("symbol").orderBy("date")
    return bars.withColumn("ret", F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1)


def keyed_facts(keys: DataFrame, facts: DataFrame) -> DataFrame:
    """``facts`` with ``_event`` on the sessions (symbol, idx) of ``keys``, which
    become rows without measures where the symbol has no fact.

    Frames cost far more than their rows' bytes, so partitions by symbol are
    set by number; adaptive execution would melt them into one.
    """
    asked = keys.where("idx IS NOT NULL").select("symbol", F.col("idx").cast("long").alias("idx")).distinct().withColumn("_event", F.lit(True))
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return facts.withColumn("_bar", F.lit(1)).join(asked, ["symbol", "idx"], "full").repartition(parts, "symbol")


def before(lo: int, hi: int) -> WindowSpec:
    """The symbol's rows from session ``lo`` to ``hi`` relative to the row's own."""
    return Window.partitionBy("symbol").orderBy("idx").rangeBetween(lo, hi)


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0).cast("double"))


def event_features(events: DataFrame, facts: DataFrame, windows: dict = WINDOWS) -> DataFrame:
    """One row per (symbol, i0, window) with all event features.

    ``events``: symbol, i0 (number of sessions before day 0). ``facts``:
    symbol, idx, close_raw, volume, ret, market_ret, short_volume,
    total_volume, trades, small_trades; any measure may be null. Events of
    symbols without any fact give no row. Gates make features null, never NaN.
    """
    ev = events.where("i0 IS NOT NULL").select("symbol", F.col("i0").cast("long").alias("i0")).distinct()
    # A window ends right before the session it is looked at from.
    shapes: dict[tuple[int, int, int], list[tuple[str, int]]] = {}
    for name, ((w0, w1), (b0, b1)) in windows.items():
        shapes.setdefault((w0 - w1 - 1, b0 - w1 - 1, b1 - w1 - 1), []).append((name, w1 + 1))
    made = []
    for shape, named in shapes.items():
        sides = F.explode(F.array(*[F.struct(F.lit(n).alias("window"), (F.col("i0") + shift).alias("idx")) for n, shift in named]))
        looks = ev.select("symbol", "i0", sides.alias("s")).select("symbol", "i0", "s.*")
        made.append(looks.join(_window_features(looks, facts, *shape), ["symbol", "idx"]).drop("idx"))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    price = facts.select("symbol", (F.col("idx") + PRICE_BEFORE).alias("i0"), F.col("close_raw").alias("price_d30"))
    return out.join(price, ["symbol", "i0"], "left").select("symbol", "i0", "window", "n_window", "n_baseline", "price_d30", *FEATURES)


FEATURES = ("dollar_volume", "abn_volume", "last5_share", "car", "scar", "beta", "short_share_abn", "short_share_z", "abn_short_trades", "small_trade_share_abn")


def _window_features(keys: DataFrame, facts: DataFrame, w0: int, b0: int, b1: int) -> DataFrame:
    """Features of (symbol, idx) over the window from ``w0`` to the session before
    idx, and the baseline from ``b0`` to ``b1``, both relative to idx."""
    paired, flow = F.col("ret").isNotNull() & F.col("market_ret").isNotNull(), F.col("total_volume") > 0
    r, m = F.when(paired, F.col("ret")), F.when(paired, F.col("market_ret"))
    rows = keyed_facts(keys, facts).select(
        "symbol", "idx", "_event", "_bar", "volume", (F.col("close_raw") * F.col("volume")).alias("dollar"), F.col("trades").alias("q"), F.col("small_trades").alias("z"),
        r.alias("r"), m.alias("m"), (r * r).alias("rr"), (m * m).alias("mm"), (r * m).alias("rm"),
        F.when(flow, F.col("short_volume")).alias("sh"), F.when(flow, F.col("total_volume")).alias("tot"),
        F.when(flow, F.col("short_volume") / F.nullif(F.col("total_volume"), F.lit(0.0))).alias("share"))
    w, b = before(w0, -1), before(b0, b1)

    def whole(aggregate: Column, lo: int, hi: int) -> Column:
        """A count or sum of whole numbers over a frame: what comes up to its
        end less what comes before it, both running sums."""
        upto = lambda k: F.coalesce(aggregate.over(Window.partitionBy("symbol").orderBy("idx").rangeBetween(Window.unboundedPreceding, k)), F.lit(0))
        return upto(hi) - upto(lo - 1)

    counted = {"n": F.count("volume"), "r": F.count("r"), "d": F.count("share"), "q": F.sum("q"), "z": F.sum("z")}
    framed = rows.select(
        "symbol", "idx", "_event", F.count("_bar").over(Window.partitionBy("symbol")).alias("bars"),
        *[whole(c, w0, -1).alias(f"{n}_w") for n, c in counted.items()], *[whole(c, b0, b1).alias(f"{n}_b") for n, c in counted.items()],
        F.sum("volume").over(w).alias("sw"), F.sum("volume").over(before(-LAST, -1)).alias("last5"), F.sum("r").over(w).alias("sr"), F.sum("m").over(w).alias("sm"),
        F.sum("sh").over(w).alias("shw"), F.sum("tot").over(w).alias("tw"),
        F.sum("volume").over(b).alias("sb"), F.collect_list("dollar").over(b).alias("dollars"),
        *[F.sum(c).over(b).alias(f"b_{c}") for c in ("r", "m", "rr", "mm", "rm")],
        F.sum("sh").over(b).alias("shb"), F.sum("tot").over(b).alias("tb"), F.stddev_samp("share").over(b).alias("sd_share"),
    ).where("_event AND bars > 0")
    n = F.nullif(F.col("r_b"), F.lit(0))
    spread = lambda xy, x, y: F.col(f"b_{xy}") - F.col(f"b_{x}") * F.col(f"b_{y}") / n
    a = framed.withColumns({"sxx": spread("mm", "m", "m"), "sxy": spread("rm", "r", "m"), "syy": spread("rr", "r", "r"), "vw": _ratio(F.col("sw"), F.col("n_w")), "vb": _ratio(F.col("sb"), F.col("n_b"))})
    a = a.withColumnsRenamed({"n_w": "n_window", "n_b": "n_baseline", "r_w": "rw", "r_b": "rb", "d_w": "dw", "d_b": "db", "q_w": "qw", "q_b": "qb", "z_w": "zw", "z_b": "zb"})
    a = a.withColumn("beta", _ratio(F.col("sxy"), F.col("sxx"))).withColumn("alpha", (F.col("b_r") - F.col("beta") * F.col("b_m")) / F.nullif(F.col("rb"), F.lit(0)))
    volume_ok = (F.col("n_window") >= LEAST_WINDOW) & (F.col("n_baseline") >= LEAST_BASE) & (F.col("vw") > 0) & (F.col("vb") > 0)
    return_ok = volume_ok & (F.col("rb") >= LEAST_BASE) & (F.col("rw") >= LEAST_WINDOW)
    flow_ok = (F.col("dw") >= LEAST_WINDOW) & (F.col("db") >= LEAST_BASE)
    residual = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - _ratio(F.col("sxy") * F.col("sxy"), F.col("sxx"))) / (F.col("rb") - 1))
    car = F.when(return_ok, F.col("sr") - F.col("alpha") * F.col("rw") - F.col("beta") * F.col("sm"))
    # Windows are cut at the first session; absent sessions count as no trades.
    length = lambda lo, hi: F.greatest(F.lit(0), F.col("idx") + hi - F.greatest(F.lit(0), F.col("idx") + lo) + 1).cast("double")
    lw, lb = length(w0, -1), length(b0, b1)
    double = lambda c: F.col(c).cast("double")
    short_abn = F.when(flow_ok, _ratio(F.col("shw"), F.col("tw")) - _ratio(F.col("shb"), F.col("tb")))
    return a.select(
        "symbol", "idx", "n_window", "n_baseline", median_of(F.col("dollars")).alias("dollar_volume"),
        F.when(volume_ok, F.ln("vw") - F.ln("vb")).alias("abn_volume"),
        F.when(volume_ok, _ratio(F.coalesce("last5", F.lit(0.0)), F.col("sw"))).alias("last5_share"),
        car.alias("car"), F.when(return_ok, _ratio(car, residual * F.sqrt(double("rw")))).alias("scar"),
        F.when(return_ok, F.col("beta")).alias("beta"),
        short_abn.alias("short_share_abn"), F.when(flow_ok & (F.col("sd_share") > 0), _ratio(short_abn, F.col("sd_share") / F.sqrt(double("dw")))).alias("short_share_z"),
        F.when(F.col("qb") > 0, F.ln(_ratio(F.col("qw"), lw) + 1) - F.ln(_ratio(F.col("qb"), lb) + 1)).alias("abn_short_trades"),
        F.when((F.col("qb") > 0) & (F.col("qw") > 0), _ratio(double("zw"), double("qw")) - _ratio(double("zb"), double("qb"))).alias("small_trade_share_abn"),
    )


def day0_ar(events: DataFrame, returns: DataFrame) -> DataFrame:
    """``events`` (symbol, i0) with ``day0_ar``: stock less market return of day 0.

    Null if the stock or the market lacks day 0 or the session before.
    """
    r = returns.select("symbol", F.col("idx").alias("i0"), (F.col("ret") - F.col("market_ret")).alias("day0_ar"))
    return events.join(r, ["symbol", "i0"], "left")


# Kinds of security outside the universe.
EXCLUDED_TYPES = ("ADRC", "ADRP", "ADRS", "GDR", "NYRS")


def in_universe(price: Column, kind: Column, excluded: tuple[str, ...] = EXCLUDED_TYPES) -> Column:
    """Price of at least 1 and a type outside the excluded ones; nulls: no price
    is out, no type is in."""
    return F.coalesce(price >= 1, F.lit(False)) & ~F.coalesce(kind.isin(*excluded), F.lit(False))


def oriented(scar: Column, day0: Column) -> Column:
    """scar in the direction of the day-0 return; null if that is 0 or null."""
    return scar * F.nullif(F.signum(day0), F.lit(0.0))
