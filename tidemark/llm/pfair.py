"""Mixing sources to target weights by Pfair scheduling, in DataFrame terms.

Each source's rows, in a fixed shuffled order, form blocks of ``block_docs``.
In the fluid ideal every source that still has blocks gets its exact target
share of each slot: after t slots source s has a(t) blocks, all a(t) sum to
t, and where a source ends the others keep their mutual weights. Block j is
released when a(t) reaches j (rounded down to a slot) and due when it reaches
j + 1 (rounded up). Earliest deadline first meets every such window, so at
any slot each source is less than one block from its target.

The windows follow from the weights in whole numbers, without running the
schedule: the ideal slot at which a source has j blocks is a sum over the
sources, those that have ended by their blocks, the others by their weights.
Only the choice among released blocks needs an order; it is one fold over the
slots, whose state is the released blocks, at most one a source. So blocks
grow with the table: there are ``MOST_BLOCKS`` of them at most, beside the
last, shorter one of each source, and the fold is as long at any size. Rows
find their block by number; they are never in one task.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a block at least, and blocks of a table at most (less those of sources' ends).
BLOCK_DOCS, MOST_BLOCKS = 16, 65_536
#: Slots of a run of the fold, whose picks are gathered apart.
RUN = 256
#: Cells for each doubling of a source's length, in which ends of sources are looked up.
CELLS = 64
WHOLE = "decimal(38,0)"
#: Weights as whole numbers may sum to so much, or products could pass 38 digits.
MOST_WEIGHT = 10**15


def _source_key(source: str) -> Column:
    """Text of the source; null and the empty text stay apart."""
    return F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def _numbered(docs: DataFrame, source: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_src`` and ``_k``, the row's number in its source from
    0; and the groups of rows: _src, _group, count, _start.

    Rows of a source go by the md5 of their id. The first three digits part
    a source into 4,096 groups which are numbered apart; the groups' sums
    give each its first number. A source with a third of all rows thus
    spreads over as many tasks, and the join has the window's partitioning.
    """
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.withColumns({"_src": _source_key(source), "_md5": digest, "_group": F.substring(digest, 1, 3)})
    counts = rows.groupBy("_src", "_group").count()
    before = Window.partitionBy("_src").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("_src", "_group", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")), "starts")
    within = Window.partitionBy("_src", "_group").orderBy("_md5", *order)
    numbered = rows.withColumn("_n", F.row_number().over(within))
    joined = numbered.join(starts.drop("count"), ["_src", "_group"])
    return joined.withColumn("_k", F.col("_start") + F.col("_n") - 1).drop("_md5", "_group", "_n", "_start"), starts


def whole_weights(weights: dict[str | None, float]) -> dict[str | None, int]:
    """The weights, as they are written in decimals, as whole numbers of equal ratio."""
    exact = {k: Fraction(str(v)) for k, v in weights.items()}
    if not exact or min(exact.values()) <= 0:
        raise ValueError("weights must be positive")
    scale = lcm(*(f.denominator for f in exact.values()))
    whole = {k: int(f * scale) for k, f in exact.items()}
    if sum(whole.values()) > MOST_WEIGHT:
        raise ValueError("weights span too many digits")
    return whole


def sources_of(starts: DataFrame, weights: dict[str | None, float] | None, block_docs: int, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(_src, docs, size, n, w): rows, rows of a block, blocks and whole weight
    of each source.

    Without weights the target is the square root of a source's size (to a
    thousandth). A source that ``weights`` doesn't name gets the least weight.
    """
    sources = starts.groupBy("_src").agg(F.sum("count").alias("docs"))
    if weights is None:
        w = F.floor(F.sqrt(F.col("docs").cast("double")) * 1000).cast("long")
    else:
        whole = whole_weights(weights)
        w = F.lit(min(whole.values())).cast("long")
        for name, value in whole.items():
            w = F.when(F.col("_src") == F.lit("-" if name is None else f"={name}"), F.lit(value).cast("long")).otherwise(w)
    size = F.greatest(F.lit(block_docs).cast("long"), F.ceil(F.sum("docs").over(Window.partitionBy(F.lit(0))) / most_blocks))
    sized = sources.withColumn("size", size)
    return sized.select("_src", "docs", "size", F.expr("(docs + size - 1) div size").alias("n"), w.alias("w"))


def _cell(v: Column) -> Column:
    return F.floor(F.log2(v) * CELLS).cast("int")


def ends_by_cell(sources: DataFrame) -> DataFrame:
    """Ends of sources, by the cell of n / w: what has ended before the cell
    (``done`` blocks; ``rest`` weight goes on), and the ends within it.

    Sources of equal n / w are one end. Cells are on a logarithmic scale and
    without gaps, some thousands for any table.
    """
    ends = sources.withColumn("_v", F.col("n") / F.col("w")).groupBy("_v").agg(F.sum("n").alias("sn"), F.sum("w").alias("sw"), F.min_by("n", "_src").alias("n"), F.min_by("w", "_src").alias("w"))
    cells = ends.groupBy(_cell(F.col("_v")).alias("cell")).agg(F.sum("sn").alias("sn"), F.sum("sw").alias("sw"), F.collect_list(F.struct("n", "w", "sn", "sw")).alias("ends"))
    span = cells.agg(F.min("cell").alias("a"), F.max("cell").alias("b"), F.sum("sw").alias("all"))
    every = span.select("all", F.explode(F.sequence(F.col("a") - 1, F.col("b"))).alias("cell")).join(cells, "cell", "left")
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"done": F.coalesce(F.sum("sn").over(before), F.lit(0)), "rest": F.col("all") - F.coalesce(F.sum("sw").over(before), F.lit(0))}
    kind = "array<struct<n:bigint,w:bigint,sn:bigint,sw:bigint>>"
    return every.withColumns(sums).select("cell", "done", "rest", F.coalesce("ends", F.array().cast(kind)).alias("ends"))


def windows(blocks: DataFrame, sources: DataFrame) -> DataFrame:
    """``blocks`` (_src, block) with release ``r`` and deadline ``d`` in slots.

    A source of weight w has j blocks when each other one has min(n, w' j/w):
    in whole numbers (done w + rest j) / w, with ``done`` over the sources
    that end by then and ``rest`` over the others.
    """
    cells = stored(ends_by_cell(sources), "ends")
    low = cells.agg(F.min("cell")).first()[0]
    if low is None:
        return blocks.select("_src", "block", F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("d"))
    points = blocks.join(sources.select("_src", "w"), "_src").withColumn("_p", F.explode(F.array(F.lit(0), F.lit(1))))
    j = F.col("block") + F.col("_p")
    points = points.withColumns({"_j": j, "cell": F.greatest(F.lit(low), F.coalesce(_cell(F.nullif(j, F.lit(0)) / F.col("w")), F.lit(low)))})
    joined = points.join(cells, "cell")
    ended = F.filter("ends", lambda e: e.n.cast(WHOLE) * F.col("w") <= F.col("_j").cast(WHOLE) * e.w)
    total = lambda field: F.aggregate(ended, F.lit(0).cast("long"), lambda a, e: a + e[field])
    at = joined.select("_src", "block", "_p", "_j", "w", (F.col("done") + total("sn")).cast(WHOLE).alias("_a"), (F.col("rest") - total("sw")).cast(WHOLE).alias("_b"))
    at = at.withColumn("_x", (F.expr(f"cast(_a * w + _b * _j as {WHOLE})")))
    slot = F.when(F.col("_p") == 0, F.expr("_x div w")).otherwise(F.expr(f"cast(_x + w - 1 as {WHOLE}) div w"))
    return at.groupBy("_src", "block").agg(F.max(F.when(F.col("_p") == 0, slot)).alias("r"), F.max(F.when(F.col("_p") == 1, slot)).alias("d"))


def earliest_deadline_first(due: DataFrame, total: int) -> DataFrame:
    """(_src, block, slot) of blocks (_src, block, r, d): each slot takes the
    released block of the earliest deadline, ties by source."""
    come = due.groupBy("r").agg(F.collect_list(F.struct("d", "_src", "block")).alias("come"))
    item = "struct<d:bigint,_src:string,block:bigint>"
    every = due.sparkSession.range(total).withColumnRenamed("id", "r").join(come, "r", "left")
    every = every.select("r", F.expr(f"r div {RUN}").alias("run"), F.coalesce("come", F.array().cast(f"array<{item}>")).alias("come"))
    in_order = lambda c, field: F.transform(F.array_sort(F.collect_list(c)), lambda x: x[field])
    runs = every.groupBy("run").agg(in_order(F.struct("r", "come"), "come").alias("slots"))
    one = runs.agg(in_order(F.struct("run", "slots"), "slots").alias("runs"))
    step = f"""
      aggregate(runs,
        named_struct('pool', cast(array() as array<{item}>), 'done', cast(array() as array<array<{item}>>)),
        (all, slots) -> transform(array(
          aggregate(slots,
            named_struct('pool', all.pool, 'picks', cast(array() as array<{item}>)),
            (acc, come) -> transform(
              array(if(size(come) = 0, acc.pool, array_sort(concat(acc.pool, come)))),
              pool -> named_struct('pool', slice(pool, 2, size(pool)), 'picks', concat(acc.picks, slice(pool, 1, 1))))[0])),
          run -> named_struct('pool', run.pool, 'done', concat(all.done, array(run.picks))))[0],
        all -> all.done)
    """
    picks = one.select(F.posexplode(F.expr(step)).alias("run", "picks")).select("run", F.posexplode("picks").alias("at", "x"))
    return picks.select("x._src", "x.block", (F.col("run").cast("long") * RUN + F.col("at")).alias("slot"))


def placed(sources: DataFrame) -> DataFrame:
    """(_src, block, size, slot, base): each block's slot and the rows before it.

    Blocks are few at any size of the table, so their running sum is in one task.
    """
    made = sources.select("_src", F.explode(F.expr("sequence(0L, n - 1)")).alias("block"))
    due = stored(windows(made, sources), "windows")
    slots = stored(earliest_deadline_first(due, due.count()), "slots")
    rows = F.least("size", F.col("docs") - F.col("block") * F.col("size"))
    before = F.sum(rows).over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    return slots.join(sources.select("_src", "docs", "size"), "_src").select("_src", "block", "size", "slot", F.coalesce(before, F.lit(0)).alias("base"))


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, *, source: str = "source", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` with ``block``, ``slot`` and ``position`` in the mix.

    Needs ``doc_id`` and the source column. A null source is a source of
    its own, null ids go by the empty text, repeated rows each get their own
    place, an empty table gives no rows; added names replace equal ones.
    ``position`` counts rows before it, from 0. No row is dropped or repeated.
    Blocks have ``block_docs`` rows, more in a table of over MOST_BLOCKS such.
    """
    keep = [c for c in docs.columns if c not in ("block", "slot", "position")]
    tie = [F.col("doc_id"), F.xxhash64(*[F.col(c) for c in keep])]
    numbered, starts = _numbered(docs.select(*keep), source, tie)
    sources = stored(sources_of(starts, weights, block_docs), "sources")
    # Bounded: MOST_BLOCKS rows, and one more for each source.
    blocks = stored(placed(sources), "blocks")
    rows = numbered.join(F.broadcast(sources.select("_src", "size")), "_src").withColumn("block", F.expr("_k div size")).drop("size")
    rows = rows.join(F.broadcast(blocks), ["_src", "block"])
    return rows.withColumn("position", F.col("base") + F.col("_k") - F.col("block") * F.col("size")).select(*keep, "block", "slot", "position")


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, **options) -> DataFrame:
    """The rows of ``docs``, all of them and with its columns, in mixed order."""
    return schedule(docs, weights, **options).orderBy("position").select(*docs.columns)
