"""Hand checks of day 0, work-lists, release lookup and the freeze gate."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Events whose day 0 may differ in a check before it fails.
MOST_DIFFERENT = 5


def session_differences(checked: DataFrame, resolved: DataFrame, sessions: DataFrame) -> DataFrame:
    """event_id, diff: sessions from the hand-checked day (``true_day0``) to the
    resolved one; null where either is missing or no session."""
    cal = F.broadcast(sessions)
    a = checked.join(cal.withColumnsRenamed({"session": "true_day0", "idx": "_a"}), "true_day0", "left")
    b = resolved.select("event_id", "day0").join(cal.withColumnsRenamed({"session": "day0", "idx": "_b"}), "day0", "left")
    return a.join(b.select("event_id", "_b"), "event_id", "left").select("event_id", (F.col("_b") - F.col("_a")).alias("diff"))


def day0_check(differences: DataFrame, most: int = MOST_DIFFERENT) -> DataFrame:
    """One row: checked, different, missing, passed."""
    g = differences.agg(F.count("diff").alias("checked"), F.count_if(F.col("diff") != 0).alias("different"), F.count_if(F.col("diff").isNull()).alias("missing"))
    return g.withColumn("passed", F.col("different") <= most)


def filled_worklist(worklist: DataFrame, daily: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """The work-list with the daily rule's result and, where the minute rule
    found a move, whether both name the same day; what is missing is a note."""
    j = worklist.join(daily.select("event_id", F.col("day0").alias("daily_day0"), "basis", "prior_moves"), "event_id", "left")
    if moves is None:
        moves = daily.select("event_id").limit(0).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    j = j.join(moves.select("event_id", F.to_date("ts").alias("minute_day")), "event_id", "left")
    note = F.when(F.col("basis").isNull(), "no ticker or bars").when(F.col("basis") == "8k_no_data", "too little history").when(F.col("minute_day").isNull(), "no minute move")
    return j.withColumn("same_day", F.col("minute_day") == F.col("daily_day0")).withColumn("note", F.coalesce(note, F.lit("")))


# Forms under which a company also files its press release.
RELATED_FORMS = ("8-K", "425", "DEFA14A", "SC14D9C", "SC 14D9-C", "SC TO-C", "8-K12B", "6-K")


def release_documents(filings: DataFrame, documents: DataFrame) -> DataFrame:
    """The press release of each filing: its own exhibit, else one that the
    company filed that day or the next, else its primary document.

    ``filings``: accession, cik, form, filing_date. ``documents``: accession,
    kind (``exhibit`` or ``primary``), seq, text. Another filing of a related
    form offers its exhibit, or its primary document where it has none and is
    no 8-K; the first by accession counts. Adds text and source.
    """
    ranked = documents.groupBy("accession", "kind").agg(F.min_by("text", "seq").alias("text"))
    own = ranked.where("kind = 'exhibit'").select("accession", F.col("text").alias("_own"))
    primary = ranked.where("kind = 'primary'").select("accession", F.col("text").alias("_primary"))
    j = filings.join(own, "accession", "left").join(primary, "accession", "left")
    offered = F.coalesce("_own", F.when(F.col("form") != "8-K", F.col("_primary")))
    shared = j.where(F.col("form").isin(*RELATED_FORMS)).select(F.col("accession").alias("_acc"), "cik", "filing_date", offered.alias("_text")).where("_text IS NOT NULL")
    # A filing meets those of its own day and of the day after, by equality.
    near = j.where("_own IS NULL").select("accession", "cik", F.explode(F.array("filing_date", F.date_add("filing_date", 1))).alias("filing_date"))
    related = near.join(shared, ["cik", "filing_date"]).where("accession <> _acc").groupBy("accession").agg(F.min_by("_text", "_acc").alias("_related"))
    j = j.join(related, "accession", "left")
    source = F.when(F.col("_own").isNotNull(), "exhibit").when(F.col("_related").isNotNull(), "related").when(F.col("_primary").isNotNull(), "primary")
    return j.withColumn("text", F.coalesce("_own", "_related", "_primary")).withColumn("source", source).drop("_own", "_related", "_primary")


def frozen(folder: str, tag_prefix: str = "freeze-") -> bool:
    """The test period may be scored: a clean tree on a commit with a freeze tag."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=False).stdout.strip()
    return not git("status", "--porcelain") and any(t.startswith(tag_prefix) for t in git("tag", "--points-at", "HEAD").split())
