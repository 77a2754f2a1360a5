import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import calendar, daymove, features, models, scoring


def history(seed=1, n=420, boost=0):
    """Bars of one symbol and the market on n weekdays; the last 20 before 380 boosted."""
    rng = np.random.default_rng(seed)
    days = [d.date() for d in pd.bdate_range("2020-01-01", periods=n)]
    market = 100 * np.cumprod(1 + rng.normal(0, 0.01, n))
    close = 50 * np.cumprod(1 + rng.normal(0, 0.015, n))
    volume = rng.lognormal(10, 0.1, n)
    short = 0.3 * volume
    if boost:
        volume[360:380] *= 3
        short[360:380] = 0.7 * volume[360:380]
        short[:360] = 0.3 * volume[:360]
    return days, market, close, volume, short


def facts(spark, days, market, close, volume, short):
    cal = calendar.numbered(spark.createDataFrame([(d,) for d in days], "session date"))
    bars = spark.createDataFrame([(1, d, float(c), float(c), float(v), float(s), float(v), int(v) % 50, int(v) % 7) for d, c, v, s in zip(days, close, volume, short)],
                                 "symbol int, date date, close double, close_raw double, volume double, short_volume double, total_volume double, trades long, small_trades long")
    index = spark.createDataFrame([(0, d, float(m)) for d, m in zip(days, market)], "symbol int, date date, close double")
    m = features.session_returns(index, cal).select("idx", F.col("ret").alias("market_ret"))
    return features.session_returns(bars, cal).join(m, "idx", "left")


def numpy_features(market, close, volume, short, i0=380):
    r, m = np.diff(close) / close[:-1], np.diff(market) / market[:-1]
    w, b = slice(i0 - 21, i0 - 1), slice(i0 - 251, i0 - 31)
    beta, alpha = np.polyfit(m[b], r[b], 1)
    resid = (r[b] - alpha - beta * m[b]).std(ddof=1)
    car = (r[w] - alpha - beta * m[w]).sum()
    vw, vb = volume[i0 - 20 : i0], volume[i0 - 250 : i0 - 30]
    sw, sb = short[i0 - 20 : i0].sum() / vw.sum(), short[i0 - 250 : i0 - 30].sum() / vb.sum()
    return {"abn_volume": math.log(vw.mean()) - math.log(vb.mean()), "car": car, "scar": car / (resid * math.sqrt(20)), "beta": beta, "short_share_abn": sw - sb, "last5_share": vw[-5:].sum() / vw.sum(), "dollar_volume": np.median((close * volume)[i0 - 250 : i0 - 30]), "price_d30": close[i0 - 30]}


def test_features_equal_numpy(spark):
    h = history(boost=1)
    ev = spark.createDataFrame([(1, 380)], "symbol int, i0 long")
    got = features.event_features(ev, facts(spark, *h)).where("window = 'pre'").first().asDict()
    for k, v in numpy_features(*h[1:]).items():
        assert got[k] == pytest.approx(v, rel=1e-9), k
    assert (got["n_window"], got["n_baseline"]) == (20, 220)
    assert got["short_share_abn"] == pytest.approx(0.4, abs=0.02)


def test_no_look_ahead(spark):
    """Changing every row from day 0 on moves no feature."""
    h = history(2)
    changed = [h[0], *(np.where(np.arange(420) >= 380, x * 7, x) for x in h[1:])]
    ev = spark.createDataFrame([(1, 380)], "symbol int, i0 long")
    a, b = ([r.asDict() for r in features.event_features(ev, facts(spark, *x)).orderBy("window").collect()] for x in (h, changed))
    assert a == b and len(a) == 2


def test_short_history_has_no_features(spark):
    h = [x[:50] for x in history(3)]
    got = features.event_features(spark.createDataFrame([(1, 45)], "symbol int, i0 long"), facts(spark, *h)).where("window = 'pre'").first()
    assert got.abn_volume is None and got.scar is None and got.short_share_abn is None


def peers(spark, n=500, charged=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        shift = (2, 3, 4) if i < charged else (0, 0, 0)
        rows.append((f"e{i:04d}", float(rng.lognormal(10, 2)), rng.choice(["2834", "6022", "7372", "1311"]).item(), *(float(rng.normal() + s) for s in shift), i < charged))
    return spark.createDataFrame(rows, "event_id string, dollar_volume double, sic string, a double, b double, c double, is_charged boolean")


def test_planted_signal_ranks_on_top(spark):
    df = scoring.peer_z(peers(spark), ["a", "b", "c"], "dollar_volume", "sic").cache()
    top = scoring.lift(df, "composite", F.col("is_charged"), 0.05).first()
    assert top.hits >= 10 and top.lift > 10
    assert scoring.auc(df, "composite", F.col("is_charged")).first().auc > 0.95
    made = models.isolation_forest(df, df, ["z_a", "z_b", "z_c"], trees=60)
    assert scoring.auc(made, "isolation_forest", F.col("is_charged")).first().auc > 0.9


def test_lift_auc_and_budget_exact(spark):
    df = spark.createDataFrame([(f"e{i}", float(i), dt.date(2024, 1 + i % 2, 3), i in (19, 18, 0)) for i in range(20)], "event_id string, s double, d date, y boolean")
    one = scoring.lift(df.where("event_id <> 'e18' AND event_id <> 'e0'"), "s", F.col("y"), 0.05).first()
    assert (one.lift, one.hits, one.k) == (18.0, 1, 1)
    assert tuple(scoring.budget_capture(df, "s", F.col("y"), "d", 5).first())[:2] == (2, 3)
    ties = df.withColumn("s", F.when(F.col("s") > 9, 1.0))
    assert scoring.auc(ties, "s", F.col("y")).first().auc == pytest.approx(((2 * (8 * 0.5 + 9)) + (8 * 0 + 9 * 0.5)) / (3 * 17))
    assert scoring.auc(df.where("y"), "s", F.col("y")).first().auc is None


def test_peer_fallback_pool(spark):
    rows = [(f"e{i:03d}", float(i // 50), "A" if i % 50 < 40 else "B", 1.0) for i in range(250)]
    df = scoring.peer_groups(spark.createDataFrame(rows, "event_id string, size double, div string, x double"), "size", "div")
    sizes = {r.peer_group: r["count"] for r in df.groupBy("peer_group").count().collect()}
    assert sum(n for g, n in sizes.items() if g.endswith("/all")) == 50 and all(n < 20 for g, n in sizes.items() if g.endswith("/all"))


def test_features_do_not_depend_on_partitions(spark):
    """Equal bits over repeated runs and other numbers of partitions."""
    h, ev = history(5, boost=1), spark.createDataFrame([(1, k) for k in (350, 380, 400)], "symbol int, i0 long")
    runs = []
    for n in (4, 1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        runs.append([r.asDict() for r in features.event_features(ev.repartition(n), facts(spark, *h).repartition(n)).orderBy("i0", "window").collect()])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 6


def test_excluded_types(spark):
    rows = spark.createDataFrame([(2.0, "CS"), (0.5, "CS"), (None, "CS"), (2.0, None), (2.0, "ADRS"), (2.0, "NYRS"), (2.0, "ADRW")], "p double, k string")
    assert [r.x for r in rows.select(features.in_universe(F.col("p"), F.col("k")).alias("x")).collect()] == [True, False, False, True, False, False, True]


def daily(spark, changes, accepted="late", n=300, at=280, seed=3):
    """A calm stock with (place, return, volume times) changes, and its filing at ``at``."""
    rng = np.random.default_rng(seed)
    days = [d.date() for d in pd.bdate_range("2022-01-03", periods=n)]
    ar, volume = rng.normal(0, 0.01, n), np.full(n, 1000.0)
    for place, size, times in changes:
        ar[place], volume[place] = size, 1000.0 * times
    rows = spark.createDataFrame([(1, d, float(a), float(v)) for d, a, v in zip(days, ar, volume)], "symbol int, date date, ar double, volume double")
    stamps = {"late": (days[at - 1], 17), "morning": (days[at], 8), "in session": (days[at - 1], 15), "two before": (days[at - 2], 18)}
    stamp = dt.datetime.combine(stamps[accepted][0], dt.time(stamps[accepted][1])) if accepted else None
    ev = spark.createDataFrame([("e", 1, days[at], stamp)], "event_id string, symbol int, day0_8k date, accepted timestamp_ntz")
    return days, daymove.choose_day0(ev, rows).first()


@pytest.mark.parametrize(("changes", "accepted", "basis", "prior"), [
    ([(279, 0.3, 10)], "late", "late_8k_shift", []),
    ([(279, 0.3, 10)], "morning", "8k_no_move", [279]),
    ([(279, 0.3, 10)], "in session", "8k_no_move", [279]),
    ([(279, 0.3, 10)], "two before", "8k_no_move", [279]),
    ([(280, 0.3, 10)], "late", "8k_confirmed", []),
    ([(280, -0.3, 10)], None, "8k_confirmed", []),
    ([(278, 0.2, 5), (279, 0.3, 10)], "late", "late_8k_shift", [278]),
    ([(279, 0.3, 10), (280, -0.3, 10)], "late", "8k_confirmed", []),  # undone by S itself
    ([(279, 0.06, 12)], "late", "late_8k_shift", []),  # small, but on heavy volume
    ([(279, 0.04, 12)], "late", "8k_no_move", []),
    ([(279, 0.3, 1)], "late", "8k_no_move", []),
    ([(277, 0.3, 10)], "late", "8k_no_move", []),
    ([], "late", "8k_no_move", []),
])
def test_daily_rule(spark, changes, accepted, basis, prior):
    days, r = daily(spark, changes, accepted)
    shifted = basis == "late_8k_shift"
    assert (r.basis, r["shift"], r.day0) == (basis, int(shifted), days[279 if shifted else 280])
    assert r.prior_moves == "|".join(str(days[i]) for i in prior)


def test_daily_rule_notes(spark):
    days, r = daily(spark, [(279, 0.3, 10)])
    assert r.note.startswith(f"8-K accepted {days[279]} 17:00, after the close; {days[279]}: AR +30.0% on 10x volume, ") and "threshold 5.0%" in r.note
    days, r = daily(spark, [(278, 0.3, 10)])
    assert r.note.startswith(f"no announcement-sized move on {days[280]}; threshold 5.0%; announcement-sized moves before day 0")


def test_daily_rule_takes_a_robust_deviation(spark):
    """A few shocks in the baseline don't raise the bar; a volatile stock's bar is higher."""
    shocks = [(k, 0.5, 1) for k in (60, 90, 120, 150)]
    assert daily(spark, [*shocks, (279, 0.08, 5)])[1].basis == "late_8k_shift"
    loud = [(k, 0.05 if k % 2 else -0.05, 1) for k in range(30, 250)]
    assert daily(spark, [*loud, (279, 0.08, 5)])[1].basis == "8k_no_move"
    assert daily(spark, [*loud, (279, 0.3, 5)])[1].basis == "late_8k_shift"


def test_daily_rule_without_history(spark):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 2), 0.5, 9.0), (1, dt.date(2024, 1, 3), 0.5, 9.0)], "symbol int, date date, ar double, volume double")
    ev = spark.createDataFrame([("e", 1, dt.date(2024, 1, 3), None), ("f", 2, dt.date(2024, 1, 3), None), ("g", None, dt.date(2024, 1, 3), None), ("h", 1, dt.date(2024, 1, 4), None)], "event_id string, symbol int, day0_8k date, accepted timestamp_ntz")
    got = {r.event_id: (r.basis, r.note) for r in daymove.choose_day0(ev, rows).collect()}
    assert got == {"e": ("8k_no_data", "0 baseline sessions (need 60)"), "f": ("8k_no_data", "no bar for 2024-01-03"), "g": ("no_ticker", "no ticker for the company on day 0"), "h": ("8k_no_data", "no bar for 2024-01-04")}


def minutes(jump=None, days=15, calm=1000.0):
    """Bars every two minutes from 9:30 to 19:30; from ``jump`` = (day, minute) on 20 % up, six times the volume there."""
    rows, rng = [], random.Random(1)
    for d in range(days):
        for m in range(0, 600, 2):
            t = dt.datetime(2024, 3, 4) + dt.timedelta(days=d, hours=9, minutes=30 + m)
            up = jump is not None and (d, m) >= jump
            at = jump is not None and d == jump[0] and up
            rows.append(("A", t, 100 + rng.uniform(-0.05, 0.05) + 20 * up, 6 * calm if at else 50.0 if t.hour >= 16 else calm + rng.random()))
    return rows


@pytest.mark.parametrize(("jump", "day", "found"), [((13, 420), 14, (13, 420)), ((14, 100), 14, (14, 100)), ((14, 100), 13, None), ((11, 100), 14, None), (None, 14, None)])
def test_first_move(spark, jump, day, found):
    """Only day 0 and the two sessions before it are searched."""
    bars = spark.createDataFrame(minutes(jump), "symbol string, ts timestamp_ntz, c double, v double")
    cal = calendar.numbered(bars.select(F.to_date("ts").alias("session")))
    ev = spark.createDataFrame([("e", "A", dt.date(2024, 3, 4) + dt.timedelta(days=day))], "event_id string, symbol string, day0 date")
    got = daymove.first_move(ev, bars, cal).first()
    if found is None:
        assert got.ts is None and got.note.startswith("no move met the rules")
    else:
        assert got.ts == dt.datetime(2024, 3, 4, 9, 30) + dt.timedelta(days=found[0], minutes=found[1])
        assert got.move == pytest.approx(0.2, abs=0.01) and got.threshold == pytest.approx(0.05)


def test_first_move_without_baseline(spark):
    bars = spark.createDataFrame(minutes((4, 100), days=5), "symbol string, ts timestamp_ntz, c double, v double")
    cal = calendar.numbered(bars.select(F.to_date("ts").alias("session")))
    ev = spark.createDataFrame([("e", "A", dt.date(2024, 3, 8)), ("f", "B", dt.date(2024, 3, 8))], "event_id string, symbol string, day0 date")
    got = {r.event_id: (r.ts, r.note) for r in daymove.first_move(ev, bars, cal).collect()}
    assert got == {"e": (None, "too little trading before the window for a baseline"), "f": (None, "no minute bars")}


def labelled(spark, n=4_000):
    """Rows of few distinct values, nulls among them, with a label that depends on both features."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 12, n).astype(float), rng.integers(0, 9, n).astype(float)
    y = rng.random(n) < 0.1 + 0.5 * ((a > 6) & (b < 4))
    rows = [(f"e{i}", None if i % 11 == 0 else float(a[i]), float(b[i]), None if i % 17 == 0 else bool(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "event_id string, a double, b double, y boolean")


def test_boosted_trees_equal_sparks_in_few_jobs(spark, monkeypatch):
    df = labelled(spark).cache()
    scores = lambda made, c: {r.event_id: r[c] for r in made.collect()}
    jobs = lambda g: len(spark.sparkContext.statusTracker().getJobIdsForGroup(g))
    spark.sparkContext.setJobGroup("oof", "oof")
    made = models.out_of_fold(df, ["a", "b"], "y", "event_id", iterations=20)
    got = scores(made, "supervised_oof")
    spark.sparkContext.setJobGroup("one", "one")
    one = scores(models.supervised(df, df, ["a", "b"], "y", iterations=20), "supervised")
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs("oof") <= 20 and jobs("one") <= 12
    assert made.columns == ["event_id", "a", "b", "y", "supervised_oof"] and len(got) == len(one) == 4_000
    # Folds as by one window over each class, and no model has seen its own fold.
    y = F.coalesce("y", F.lit(False))
    order = Window.partitionBy(y).orderBy(F.md5(F.col("event_id").cast("binary")))
    fold = {r.event_id: r.f for r in df.withColumn("f", F.row_number().over(order) % 5).collect()}
    assert fold == {r.event_id: r._fold for r in models._dealt(df, "y", "event_id", 5).collect()}
    seen = df.join(spark.createDataFrame(list(fold.items()), "event_id string, f int"), "event_id").cache()
    alone = scores(models.supervised(seen.where("f <> 2"), seen.where("f = 2"), ["a", "b"], "y", iterations=20), "supervised")
    assert alone == {e: pytest.approx(got[e], abs=1e-12) for e, f in fold.items() if f == 2}
    # Rows of too many different bins go to Spark's own trees.
    monkeypatch.setattr(models, "MOST_CELLS", 10)
    assert scores(models.supervised(df, df, ["a", "b"], "y", iterations=20), "supervised") == {e: pytest.approx(p, abs=1e-9) for e, p in one.items()}


def test_too_few_labels_have_no_boosted_score(spark):
    df = labelled(spark, 50).withColumn("y", F.col("event_id") == "e3")
    assert {r.supervised for r in models.supervised(df, df, ["a"], "y").collect()} == {None}
    assert {r.supervised_oof for r in models.out_of_fold(df, ["a"], "y", "event_id").collect()} == {None}
    assert {r.supervised for r in models.supervised(df.where("y IS NULL"), df, ["a"], "y").collect()} == {None}


def test_forest_of_two_columns_scores_by_cells():
    """Bit for bit the depths of a walk through each tree, in far fewer steps."""
    rng = np.random.default_rng(1)
    for columns in (1, 2, 3):
        sample = np.clip(rng.standard_t(3, (3_000, columns)), -5, 5)
        sample[::11] = 0
        forest = models.IsolationForest(sample, trees=40)
        own = [t for t in forest.trees if not isinstance(t, float)]
        x = np.vstack([sample, [[t[1]] * columns for t in own], np.full((1, columns), 9.0)])
        walked = np.zeros(len(x))
        for tree in forest.trees:
            forest._depths(tree, x, np.arange(len(x)), walked)
        steps = []
        forest._depths = lambda *a, _walk=forest._depths: (steps.append(1), _walk(*a))
        got = forest.score(x)
        assert (got == 2.0 ** (-walked / 40 / models._path_length(256))).all()
        assert bool(steps) == (columns == 3)


def test_auc_orders_scores_by_ranges(spark):
    """No task orders all distinct scores; ranks of ties and nulls as counted by hand."""
    rng = np.random.default_rng(5)
    rows = [(None if i % 13 == 0 else float(rng.integers(0, 400)) / 7, float(rng.normal()), bool(rng.random() < 0.2), i % 29 == 0) for i in range(3_000)]
    df = spark.createDataFrame([(a, b, None if n else y) for a, b, y, n in rows], "a double, b double, y boolean")
    y = np.array([bool(y) and not n for _, _, y, n in rows])
    made = scoring.aucs(df, ["a", "b"], F.col("y"))
    got = {r.score: r.auc for r in made.collect()}
    for i, name in enumerate(("a", "b")):
        s = pd.Series([-np.inf if r[i] is None else r[i] for r in rows]).rank().to_numpy()
        want = (s[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
        assert got[name] == pytest.approx(want, abs=1e-12)
        assert scoring.auc(df, name, F.col("y")).first().auc == got[name]
    assert scoring.auc(df.where("y IS NULL"), "a", F.col("y")).first().auc is None
    assert scoring.auc(df.where("false"), "a", F.col("y")).first().auc is None
    # The one window over whole scores is over ranges, a row each; distinct scores are dealt by range first.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and not [line for line in plan.splitlines() if "Window [" in line and "[s#" in line and "_part" not in line]
