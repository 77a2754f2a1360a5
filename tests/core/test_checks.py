import datetime as dt

from tidemark.operators import calendar, checks

D = dt.date


def test_day0_differences(spark):
    cal = calendar.exchange_sessions(spark, "2023-01-01", "2023-12-31")
    true = spark.createDataFrame([("a", D(2023, 6, 5)), ("b", D(2023, 7, 5)), ("c", D(2023, 6, 3)), ("d", D(2023, 6, 5))], "event_id string, true_day0 date")
    made = spark.createDataFrame([("a", D(2023, 6, 5)), ("b", D(2023, 7, 3)), ("c", D(2023, 6, 5))], "event_id string, day0 date")
    diff = checks.session_differences(true, made, cal)
    assert {r.event_id: r["diff"] for r in diff.collect()} == {"a": 0, "b": -1, "c": None, "d": None}
    assert tuple(checks.day0_check(diff).first()) == (2, 1, 2, True)
    assert not checks.day0_check(diff, most=0).first().passed


def test_worklist_notes(spark):
    work = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "event_id string")
    daily = spark.createDataFrame([("a", D(2023, 6, 5), "late_8k_shift", ""), ("b", D(2023, 6, 6), "8k_no_data", ""), ("c", D(2023, 6, 7), "8k_no_move", "")], "event_id string, day0 date, basis string, prior_moves string")
    moves = spark.createDataFrame([("a", dt.datetime(2023, 6, 5, 16, 30)), ("z", dt.datetime(2023, 6, 5, 16, 30))], "event_id string, ts timestamp_ntz")
    got = {r.event_id: (r.same_day, r.note) for r in checks.filled_worklist(work, daily, moves).collect()}
    assert got == {"a": (True, ""), "b": (None, "too little history"), "c": (None, "no minute move"), "d": (None, "no ticker or bars")}
    assert checks.filled_worklist(work, daily).count() == 4


def test_release_lookup(spark):
    f = spark.createDataFrame([("1", 7, "8-K", D(2023, 1, 3)), ("2", 7, "8-K", D(2023, 1, 2)), ("3", 7, "8-K", D(2023, 1, 4)), ("4", 8, "8-K", D(2023, 1, 2)), ("5", 9, "8-K", D(2023, 1, 2)), ("6", 9, "425", D(2023, 1, 2)), ("7", 9, "10-Q", D(2023, 1, 2))], "accession string, cik long, form string, filing_date date")
    d = spark.createDataFrame([("1", "exhibit", 2, "late"), ("1", "exhibit", 1, "ex"), ("2", "primary", 0, "p2"), ("3", "primary", 0, "p3"), ("6", "primary", 0, "p6"), ("7", "exhibit", 0, "p7")], "accession string, kind string, seq int, text string")
    got = {r.accession: (r.text, r.source) for r in checks.release_documents(f, d).collect()}
    assert got == {"1": ("ex", "exhibit"), "2": ("ex", "related"), "3": ("p3", "primary"), "4": (None, None), "5": ("p6", "related"), "6": ("p6", "primary"), "7": ("p7", "exhibit")}


def test_freeze_gate(tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init")
    (tmp_path / "f").write_text("x")
    run("add", "f")
    run("commit", "-m", "x")
    assert not checks.frozen(str(tmp_path))
    run("tag", "freeze-1")
    assert checks.frozen(str(tmp_path))
    (tmp_path / "f").write_text("y")
    assert not checks.frozen(str(tmp_path))


def test_model_queries_run_the_whole_job(monkeypatch):
    """500 trees, 100 iterations, five folds: the operators' own figures."""
    import inspect

    from tidemark.operators import models
    from tidemark.plans import misc

    class Rows:
        def select(self, *columns):
            return self

    got = {}
    monkeypatch.setattr(misc, "scored", lambda spark, sf_dir: Rows())
    for name, query in (("isolation_forest", misc.isolation_forest), ("supervised", misc.boosted), ("out_of_fold", misc.out_of_fold)):
        signature = inspect.signature(getattr(models, name))

        def spy(*args, _name=name, _signature=signature, **kwargs):
            call = _signature.bind(*args, **kwargs)
            call.apply_defaults()
            got[_name] = call.arguments

        monkeypatch.setattr(models, name, spy)
        query(None, "")
    assert got["isolation_forest"]["trees"] == 500 and got["supervised"]["iterations"] == 100
    assert (got["out_of_fold"]["folds"], got["out_of_fold"]["iterations"]) == (5, 100)
