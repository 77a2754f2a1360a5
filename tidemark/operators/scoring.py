"""Peer scores, lift, AUC, alert budgets and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import cuts_of, global_rank, quantile_bin, robust_z, row_mean

LEAST_PEERS, BINS = 20, 5


def peer_groups(df: DataFrame, size: str, division: str, event_id: str = "event_id") -> DataFrame:
    """Adds size_q and peer_group: size quintile and division, falling back.

    A missing size counts as the median size, a missing division as ``?``. A
    group under 20 events goes to ``q/all``; that pool holds only the events that fell back, not the
    whole quintile. Where the quintile itself has under 20, it is ``all``.
    """
    missing, cuts = df.agg(F.count_if(F.col(size).isNull()), cuts_of(size)).first()
    # An exact median holds the table's different sizes in one task; only a missing size asks for it.
    middle = df.agg(F.median(size)).first()[0] if missing else None
    df = df.withColumn("_size", F.coalesce(F.col(size), F.lit(middle)).cast("double"))
    df = global_rank(df, "_size", event_id, "_rank", "_all", cuts or []).withColumn("size_q", quantile_bin(F.col("_rank"), F.col("_all"), BINS))
    df = df.withColumn("_g", F.concat_ws("/", F.col("size_q").cast("string"), F.coalesce(F.col(division), F.lit("?"))))
    # A bin's size follows from the number of rows, as bins are cut by rank.
    up_to = lambda q: F.floor(q * (F.col("_all") - 1) / BINS) + 1
    in_bin = up_to(F.col("size_q")) - F.when(F.col("size_q") > 1, up_to(F.col("size_q") - 1)).otherwise(0)
    df = df.withColumn("_n", F.count("*").over(Window.partitionBy("_g")))
    group = F.when(F.col("_n") >= LEAST_PEERS, F.col("_g")).when(in_bin >= LEAST_PEERS, F.concat(F.col("size_q").cast("string"), F.lit("/all"))).otherwise("all")
    return df.withColumn("peer_group", group).drop("_size", "_rank", "_all", "_g", "_n")


def peer_z(df: DataFrame, measures: list[str], size: str, division: str, event_id: str = "event_id") -> DataFrame:
    """``df`` with z_<measure> within peer groups, and their ``composite``."""
    df = peer_groups(df, size, division, event_id)
    for m in measures:
        df = robust_z(df, m, ["peer_group"], f"z_{m}")
    return df.withColumn("composite", row_mean([f"z_{m}" for m in measures]))


def lifts(df: DataFrame, score: str, label: Column, shares: tuple[float, ...], event_id: str = "event_id") -> DataFrame:
    """One row per share: share, lift, hits, k of the top share; a null score
    ranks last, a base rate of 0 gives a null lift.

    A report: the ranks are worked out at once, over rows kept meanwhile.
    """
    # Descending score, null last: ascending order of its negative, a null as plus infinity.
    key = F.coalesce(-F.col(score).cast("double"), F.lit(float("inf")))
    slim = df.select(key.alias("s"), F.col(event_id).alias("e"), F.coalesce(label, F.lit(False)).cast("int").alias("y")).persist()
    try:
        rows = global_rank(slim, "s", "e", "rn")
        k = {s: F.greatest(F.lit(1), F.ceil(F.lit(s) * F.col("n"))) for s in shares}
        each = [F.struct(F.lit(s).alias("share"), F.sum(F.when(F.col("rn") <= n, F.col("y"))).alias("hits"), F.first(n).alias("k")) for s, n in k.items()]
        found = rows.agg(F.array(*each).alias("each"), F.avg("y").alias("base")).first()
    finally:
        slim.unpersist()
    made = []
    for r in found.each:
        hits, k = r.hits or 0, r.k or 0
        made.append((float(r.share), hits / k / found.base if k and found.base else None, hits, k))
    return df.sparkSession.createDataFrame(made, "share double, lift double, hits long, k long")


def lift(df: DataFrame, score: str, label: Column, share: float, event_id: str = "event_id") -> DataFrame:
    """One row: lift, hits, k of the top share."""
    return lifts(df, score, label, (share,), event_id).drop("share")


def aucs(df: DataFrame, scores: list[str], label: Column) -> DataFrame:
    """score, auc: area under the curve by average ranks; null scores come last,
    ties count half, one class alone gives null.

    Ranks follow from counts per distinct score, for all scores in one pass:
    they are summed first, dealt by range to as many tasks as the session shuffles
    to, and ordered there; a range comes after the counts of those before it.
    """
    y = F.coalesce(label, F.lit(False)).cast("int")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.coalesce(F.col(s).cast("double"), F.lit(float("-inf"))).alias("s")) for s in scores]))
    g = df.select(each.alias("e"), y.alias("y")).groupBy("e.score", "e.s").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("p"))
    # A number of partitions of one's own is not merged by size, and a score is in one range.
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = g.repartitionByRange(ranges, "score", "s").withColumn("_part", F.spark_partition_id())
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Twice the rank within the range, a whole number.
    twice = dealt.withColumn("_rank", 2 * before(Window.partitionBy("_part", "score").orderBy("s")) + F.col("n") + 1)
    parts = twice.groupBy("_part", "score").agg(F.sum(F.col("_rank") * F.col("p")).alias("r"), F.sum("n").alias("n"), F.sum("p").alias("p"))
    # A row a range: ordering them is small.
    whole = parts.withColumn("r", (F.col("r") + 2 * before(Window.partitionBy("score").orderBy("_part")).cast("decimal(19,0)") * F.col("p")))
    t = whole.groupBy("score").agg(F.sum("r").cast("double").alias("r"), F.sum("p").cast("double").alias("pos"), F.sum(F.col("n") - F.col("p")).cast("double").alias("neg"))
    return t.select("score", ((F.col("r") - F.col("pos") * (F.col("pos") + 1)) / F.nullif(2 * F.col("pos") * F.col("neg"), F.lit(0.0))).alias("auc"))


def auc(df: DataFrame, score: str, label: Column) -> DataFrame:
    """One row: ``aucs`` of one score; null without rows."""
    return aucs(df, [score], label).agg(F.max("auc").alias("auc"))


def evaluate(df: DataFrame, scores: list[str], label: Column, event_id: str = "event_id") -> DataFrame:
    """One row per score: lift and hits at 5 % and 1 %, and AUC."""
    parts = []
    for s in scores:
        name = F.lit(s).alias("score")
        both = lifts(df, s, label, (0.05, 0.01), event_id)
        parts.append(both.where("share > 0.02").select(name, F.col("lift").alias("top5_lift"), "hits", "k"))
        parts.append(both.where("share < 0.02").select(name, F.col("lift").alias("top1_lift")))
    parts.append(aucs(df, scores, label))
    # One-row results side by side: united, then the one value of each column.
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    return every.groupBy("score").agg(*[F.max(c).alias(c) for c in ("top5_lift", "hits", "k", "top1_lift", "auc")])


def budget_capture(df: DataFrame, score: str, label: Column, day: str, per_month: int = 50, event_id: str = "event_id") -> DataFrame:
    """One row: charged events among the top ``per_month`` of each month, all charged, and their share."""
    w = Window.partitionBy(F.date_trunc("month", day)).orderBy(F.col(score).desc_nulls_last(), event_id)
    y = F.coalesce(label, F.lit(False)).cast("int")
    g = df.select(F.row_number().over(w).alias("rn"), y.alias("y")).agg(F.coalesce(F.sum(F.when(F.col("rn") <= per_month, F.col("y"))), F.lit(0)).alias("caught"), F.coalesce(F.sum("y"), F.lit(0)).alias("charged"))
    return g.withColumn("share", F.col("caught") / F.nullif(F.col("charged"), F.lit(0)))


def verdicts(evaluated: DataFrame, placebo: DataFrame, budget: DataFrame, short_gain: float | None) -> dict[str, str]:
    """Texts for the study's four hypotheses from the small result tables."""
    rows = {r.score: r for r in evaluated.collect()}
    best = max(rows.values(), key=lambda r: (r.top5_lift or 0.0, r.score))
    other = {r.score: r for r in placebo.collect()}
    share = budget.first().share
    say = lambda good: "supported" if good else "not supported"
    return {
        "H1": say((best.top5_lift or 0) >= 2),
        "H3": say((short_gain or 0) > 0),
        "H5": say((best.auc or 0) > (other[best.score].auc or 0) if best.score in other else False),
        "H6": say((share or 0) >= 0.25),
        "best": best.score,
    }


def report(evaluated: DataFrame, title: str) -> str:
    """A Markdown table of a small evaluation frame."""
    rows, names = evaluated.collect(), evaluated.columns
    show = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [f"## {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"
