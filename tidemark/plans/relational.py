"""Relational base: one query per filter, join, aggregate, window or set form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .proxies import load
from .registry import register

DAY = "CAST(o_orderdate AS DATE)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))


# ---------------------------------------------------------------- projections and filters


@register("c01_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def in_list(spark, sf_dir):
    return load(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "5-LOW")).select("o_orderkey", "o_orderpriority")


@register("c02_between", f"SELECT o_orderkey FROM orders WHERE {DAY} BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND year(o_orderdate) = 1996")
def between(spark, sf_dir):
    return _orders(spark, sf_dir).where(F.col("d").between("1996-01-01", "1997-06-30") & (F.year("d") == 1996)).select("o_orderkey")


@register("c03_default_null", "SELECT doc_id, coalesce(CASE WHEN lang <> 'en' THEN lang END, 'operating') = 'operating' AS operating FROM documents")
def default_null(spark, sf_dir):
    lang = F.when(F.col("lang") != "en", F.col("lang"))
    return load(spark, sf_dir, "documents").select("doc_id", (F.coalesce(lang, F.lit("operating")) == "operating").alias("operating"))


ITEMS = "concat_ws(', ', CAST(o_custkey % 9 AS VARCHAR) || '.01', CAST(o_orderkey % 7 AS VARCHAR) || '.02', '12.02')"


@register("c04_item_membership", f"SELECT o_orderkey, list_contains(list_transform(string_split({ITEMS}, ','), lambda x: trim(x)), '2.02') AS has FROM orders")
def item_membership(spark, sf_dir):
    items = F.concat_ws(", ", F.concat((F.col("o_custkey") % 9).cast("string"), F.lit(".01")), F.concat((F.col("o_orderkey") % 7).cast("string"), F.lit(".02")), F.lit("12.02"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.array_contains(F.transform(F.split(items, ","), lambda x: F.trim(x)), "2.02").alias("has"))


@register("c05_item_substring", f"SELECT o_orderkey FROM orders WHERE {ITEMS} LIKE '% 2.02%'")
def item_substring(spark, sf_dir):
    items = F.concat_ws(", ", F.concat((F.col("o_custkey") % 9).cast("string"), F.lit(".01")), F.concat((F.col("o_orderkey") % 7).cast("string"), F.lit(".02")), F.lit("12.02"))
    return load(spark, sf_dir, "orders").where(items.like("% 2.02%")).select("o_orderkey")


@register("c06_regex_predicates", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)(re|st)') AND NOT regexp_matches(p_type, '^(SMALL|LARGE)')")
def regex_predicates(spark, sf_dir):
    return load(spark, sf_dir, "part").where(F.col("p_name").rlike("(?i)(re|st)") & ~F.col("p_type").rlike("^(SMALL|LARGE)")).select("p_partkey")


RANGES = f"SELECT o_custkey AS cik, o_orderpriority AS ticker, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE min({DAY}) END AS valid_from, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE max({DAY}) END AS valid_to FROM orders GROUP BY 1, 2"


def ranges(spark, sf_dir):
    """Dated map of (cik, ticker): some ends open."""
    m = _orders(spark, sf_dir).groupBy(F.col("o_custkey").alias("cik"), F.col("o_orderpriority").alias("ticker")).agg(F.min("d").alias("valid_from"), F.max("d").alias("valid_to"))
    return m.withColumn("valid_from", F.when(F.col("cik") % 5 != 0, F.col("valid_from"))).withColumn("valid_to", F.when(F.col("cik") % 3 != 0, F.col("valid_to")))


@register("c07_open_range", f"SELECT cik, ticker FROM ({RANGES}) WHERE (valid_from IS NULL OR DATE '1998-01-01' >= valid_from) AND (valid_to IS NULL OR DATE '1998-01-01' <= valid_to)")
def open_range(spark, sf_dir):
    day = F.lit("1998-01-01").cast("date")
    return ranges(spark, sf_dir).where((F.col("valid_from").isNull() | (day >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (day <= F.col("valid_to")))).select("cik", "ticker")


@register("c08_distinct_from", f"SELECT cik, ticker FROM ({RANGES}) WHERE valid_from IS DISTINCT FROM valid_to")
def distinct_from(spark, sf_dir):
    return ranges(spark, sf_dir).where(~F.col("valid_from").eqNullSafe(F.col("valid_to"))).select("cik", "ticker")


@register("c09_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def not_in(spark, sf_dir):
    return load(spark, sf_dir, "customer").join(load(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@register("c10_exists_regex", "SELECT p_partkey FROM part a WHERE EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_partkey <> a.p_partkey AND starts_with(a.p_name, string_split(b.p_name, ' ')[1]))")
def exists_regex(spark, sf_dir):
    a = load(spark, sf_dir, "part").alias("a")
    b = load(spark, sf_dir, "part").select("p_brand", "p_partkey", F.split("p_name", " ")[0].alias("head")).alias("b")
    on = (F.col("a.p_brand") == F.col("b.p_brand")) & (F.col("a.p_partkey") != F.col("b.p_partkey")) & F.rlike(F.col("a.p_name"), F.concat(F.lit("^\\Q"), F.col("b.head"), F.lit("\\E")))
    return a.join(b, on, "left_semi").select("p_partkey")


@register("c11_complement", "SELECT doc_id, contains(text, 'the') AND NOT contains(text, 'token') AND NOT contains(text, 'und') AS other FROM documents")
def complement(spark, sf_dir):
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", (t.contains("the") & ~t.contains("token") & ~t.contains("und")).alias("other"))


@register("c12_exclude", "SELECT * EXCLUDE (r_name) FROM region")
def exclude(spark, sf_dir):
    return load(spark, sf_dir, "region").drop("r_name")


@register("c13_source_tag", f"SELECT o_orderkey, CASE WHEN m.ticker IS NOT NULL THEN 'map' WHEN o_orderstatus = 'F' THEN 'press_release' END AS src, coalesce(m.ticker, o_orderstatus) AS ticker FROM orders LEFT JOIN (SELECT * FROM ({RANGES}) WHERE ticker = '1-URGENT') m ON m.cik = o_custkey")
def source_tag(spark, sf_dir):
    m = ranges(spark, sf_dir).where("ticker = '1-URGENT'").select(F.col("cik").alias("o_custkey"), "ticker")
    j = load(spark, sf_dir, "orders").join(m, "o_custkey", "left")
    return j.select("o_orderkey", F.when(F.col("ticker").isNotNull(), "map").when(F.col("o_orderstatus") == "F", "press_release").alias("src"), F.coalesce("ticker", "o_orderstatus").alias("ticker"))


@register("c14_category_order", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'spac' WHEN c_mktsegment = 'BUILDING' THEN 'tender_or_13e3' WHEN c_nationkey < 10 THEN 'delisted_after' ELSE 'unconfirmed' END AS category FROM customer")
def category_order(spark, sf_dir):
    c = F.when(F.col("c_acctbal") < 0, "spac").when(F.col("c_mktsegment") == "BUILDING", "tender_or_13e3").when(F.col("c_nationkey") < 10, "delisted_after").otherwise("unconfirmed")
    return load(spark, sf_dir, "customer").select("c_custkey", c.alias("category"))


@register("c15_exclusion_list", "SELECT p_partkey FROM part WHERE NOT coalesce(p_brand IN ('Brand#11', 'Brand#22'), false)")
def exclusion_list(spark, sf_dir):
    return load(spark, sf_dir, "part").where(~F.coalesce(F.col("p_brand").isin("Brand#11", "Brand#22"), F.lit(False))).select("p_partkey")


@register("c16_trim_upper", "SELECT o_orderkey FROM orders WHERE upper(trim(' ' || lower(o_orderstatus) || ' ')) = 'F'")
def trim_upper(spark, sf_dir):
    return load(spark, sf_dir, "orders").where(F.upper(F.trim(F.concat(F.lit(" "), F.lower("o_orderstatus"), F.lit(" ")))) == "F").select("o_orderkey")


# ---------------------------------------------------------------- joins


@register("d01_inner_using", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def inner_using(spark, sf_dir):
    nation = F.broadcast(load(spark, sf_dir, "nation"))
    companies = load(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")
    return load(spark, sf_dir, "orders").join(companies, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n_name")


@register("d02_left_false_fill", "SELECT d.doc_id, coalesce(l.toxic = 1, false) AS is_charged FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_false_fill(spark, sf_dir):
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_charged"))


@register("d03_left_first_row", "SELECT c_custkey, o_orderpriority FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) ON c_custkey = o_custkey")
def left_first_row(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    first = load(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return load(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderpriority")


@register("d04_dated_interval", f"SELECT o_orderkey, m.ticker FROM orders o LEFT JOIN ({RANGES}) m ON m.cik = o.o_custkey AND (m.valid_from IS NULL OR {DAY} >= m.valid_from) AND (m.valid_to IS NULL OR {DAY} <= m.valid_to)")
def dated_interval(spark, sf_dir):
    from ..operators.idmap import interval_join

    return interval_join(_orders(spark, sf_dir).withColumnRenamed("o_custkey", "cik"), ranges(spark, sf_dir), "d").select("o_orderkey", "ticker")


@register("d05_semi", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def semi(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_suppkey")
    return load(spark, sf_dir, "supplier").join(items, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@register("d06_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti(spark, sf_dir):
    return load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@register("d07_self_anti_inequality", "SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_type = a.p_type AND b.p_partkey < a.p_partkey)")
def self_anti(spark, sf_dir):
    """No smaller key exists where the key is its group's least: a sum of the groups
    instead of pairs. A null brand, type or key is below and above nothing."""
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    least = part.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("least"))
    return part.join(least, ["p_brand", "p_type"], "left").where("p_partkey <= least OR least IS NULL OR p_partkey IS NULL").select("p_partkey")


@register("d08_lag_bound", f"SELECT a.o_orderkey AS deal, b.o_orderkey AS filing, date_diff('day', {DAY.replace('o_', 'b.o_')}, {DAY.replace('o_', 'a.o_')}) AS days FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O' AND date_diff('day', {DAY.replace('o_', 'b.o_')}, {DAY.replace('o_', 'a.o_')}) BETWEEN 0 AND 120")
def lag_bound(spark, sf_dir):
    a = _orders(spark, sf_dir).where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("deal"), F.col("d").alias("da"))
    b = _orders(spark, sf_dir).where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("filing"), F.col("d").alias("db"))
    return a.join(b, "o_custkey").withColumn("days", F.datediff("da", "db").cast("long")).where("days BETWEEN 0 AND 120").select("deal", "filing", "days")


@register("d10_after_within", f"SELECT a.o_orderkey AS trade, count(b.o_orderkey) AS n FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND {DAY.replace('o_', 'b.o_')} > {DAY.replace('o_', 'a.o_')} AND {DAY.replace('o_', 'b.o_')} <= {DAY.replace('o_', 'a.o_')} + 30 GROUP BY 1")
def after_within(spark, sf_dir):
    a = _orders(spark, sf_dir).select("o_custkey", F.col("o_orderkey").alias("trade"), F.col("d").alias("da"))
    b = _orders(spark, sf_dir).select("o_custkey", F.col("o_orderkey").alias("hit"), F.col("d").alias("db"))
    near = a.join(b, (a.o_custkey == b.o_custkey) & (F.col("db") > F.col("da")) & (F.col("db") <= F.date_add("da", 30)), "left")
    return near.groupBy("trade").agg(F.count("hit").alias("n"))


@register("d12_month_range_sum", f"""SELECT o.o_orderkey, CAST(sum(v.volume) AS DOUBLE) AS volume FROM orders o
LEFT JOIN (SELECT l_partkey AS k, date_trunc('month', l_shipdate) AS m, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2) v
  ON v.k = o.o_custkey AND v.m BETWEEN date_trunc('month', o.o_orderdate) - INTERVAL 1 MONTH AND date_trunc('month', o.o_orderdate) GROUP BY 1""")
def month_range_sum(spark, sf_dir):
    """Pre-aggregated months, then an equi-join on the month and the one before."""
    v = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("o_custkey"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("m")).agg(F.sum("l_quantity").alias("volume"))
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.array(month, F.add_months(month, -1))).alias("m"))
    return o.join(v, ["o_custkey", "m"], "left").groupBy("o_orderkey").agg(F.sum("volume").alias("volume"))


@register("d13_windowed_exists", f"SELECT a.o_orderkey FROM orders a WHERE a.o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P' AND {DAY.replace('o_', 'b.o_')} BETWEEN {DAY.replace('o_', 'a.o_')} - 30 AND {DAY.replace('o_', 'a.o_')} + 365)")
def windowed_exists(spark, sf_dir):
    a = _orders(spark, sf_dir).where("o_orderstatus = 'F'").alias("a")
    b = _orders(spark, sf_dir).where("o_orderstatus = 'P'").alias("b")
    return a.join(b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & F.expr("b.d BETWEEN date_sub(a.d, 30) AND date_add(a.d, 365)"), "left_semi").select("o_orderkey")


@register("d14_windowed_min", f"SELECT a.o_orderkey, (SELECT min({DAY.replace('o_', 'b.o_')}) FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P' AND {DAY.replace('o_', 'b.o_')} BETWEEN {DAY.replace('o_', 'a.o_')} AND {DAY.replace('o_', 'a.o_')} + 730) AS exit_date FROM orders a WHERE a.o_orderstatus = 'F'")
def windowed_min(spark, sf_dir):
    a = _orders(spark, sf_dir).where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", F.col("d").alias("da"))
    b = _orders(spark, sf_dir).where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.col("d").alias("db"))
    j = a.join(b, (F.col("o_custkey") == F.col("k")) & F.expr("db BETWEEN da AND date_add(da, 730)"), "left")
    return j.groupBy("o_orderkey").agg(F.min("db").alias("exit_date"))


@register("d19_sibling_equi", "SELECT a.p_partkey AS p, b.p_partkey AS q FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey")
def sibling_equi(spark, sf_dir):
    return own_pairs(load(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], "p_partkey").select("p", "q")


#: Rows of a group that meet the whole group in one place, and pairs a task.
TILE, PAIRS_A_TASK = 1_000, 5_000_000


def own_pairs(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """``by``, p and q: every two different keys of a group, both ways.

    The pairs outgrow the rows, so tasks are counted by pairs (at least the
    session's shuffle partitions) and not by bytes: a group is cut into tiles of
    some ``TILE`` rows, and each tile meets a copy of its group, in a task of its own
    if need be. A task holds one tile.
    """
    rows = df.select(*by, F.col(key).alias("p")).dropna()
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    pairs = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_n"))).first()[0] or 0.0
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // PAIRS_A_TASK) + 1)
    large = sizes.where(F.col("_n") > TILE).withColumn("_tiles", F.ceil(F.col("_n") / TILE).cast("int")).drop("_n")
    dealt = rows.join(large, by, "left").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    # A number of partitions of one's own is not merged by size; the sides are sorted, so no side is sent whole.
    tile = dealt.withColumn("_tile", F.pmod(F.xxhash64("p"), F.col("_tiles")).cast("int")).drop("_tiles").repartition(tasks, *by, "_tile")
    group = dealt.select(*by, F.col("p").alias("q"), F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_tile")).repartition(tasks, *by, "_tile")
    return group.hint("merge").join(tile, [*by, "_tile"]).where("p <> q").drop("_tile")


@register("d21_newest_version", "SELECT doc_id, v, score FROM (SELECT doc_id, 1 AS v, quality AS score FROM labels UNION ALL BY NAME SELECT doc_id, 2 AS v, toxic AS score FROM labels WHERE quality = 1) QUALIFY v = max(v) OVER (PARTITION BY doc_id)")
def newest_version(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    both = labels.select("doc_id", F.lit(1).alias("v"), F.col("quality").alias("score")).unionByName(labels.where("quality = 1").select("doc_id", F.lit(2).alias("v"), F.col("toxic").alias("score")))
    return both.withColumn("newest", F.max("v").over(Window.partitionBy("doc_id"))).where("v = newest").drop("newest")


# ---------------------------------------------------------------- aggregates


@register("e01_counts", "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS companies, count(CASE WHEN o_totalprice > 1000 THEN 1 END) AS large FROM orders GROUP BY 1")
def counts(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("companies"), F.count(F.when(F.col("o_totalprice") > 1000, 1)).alias("large"))


@register("e02_grouped_sum", "SELECT l_suppkey, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS volume, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY ALL")
def grouped_sum(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.to_date("l_shipdate").alias("date")).agg(F.sum("l_quantity").alias("volume"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))


@register("e03_conditional_count", "SELECT source, CAST(sum(CAST(contains(text, 'token') AS INT)) AS BIGINT) AS tokens, count(*) FILTER (WHERE n_chars > 1000) AS long FROM documents GROUP BY 1")
def conditional_count(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("text").contains("token")).alias("tokens"), F.count_if(F.col("n_chars") > 1000).alias("long"))


@register("e05_string_agg", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def string_agg(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("priorities"))


@register("e06_ordered_list_slice", f"SELECT o_custkey, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderpriority, {DAY} DESC, o_orderkey)[1:4], '|') AS picks FROM orders GROUP BY 1")
def ordered_list_slice(spark, sf_dir):
    day = -F.datediff("d", F.lit("1970-01-01").cast("date"))
    rows = F.array_sort(F.collect_list(F.struct("o_orderpriority", day.alias("age"), "o_orderkey")))
    return _orders(spark, sf_dir).groupBy("o_custkey").agg(F.array_join(F.transform(F.slice(rows, 1, 4), lambda x: x.o_orderkey.cast("string")), "|").alias("picks"))


@register("e07_having_bool_or", "SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'P')")
def having_bool_or(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("p")).where("p").select("o_custkey")


@register("e08_any_value", "SELECT n_regionkey, any_value(n_regionkey) AS same FROM nation GROUP BY 1")
def any_value(spark, sf_dir):
    return load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.any_value(F.col("n_regionkey")).alias("same"))


@register("e09_median", "SELECT l_returnflag, median(l_extendedprice) AS price, CAST(median(l_linenumber) AS DOUBLE) AS line FROM lineitem GROUP BY 1")
def median(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.median("l_extendedprice").alias("price"), F.median("l_linenumber").alias("line"))


@register("e10_robust_sd", "WITH m AS (SELECT *, median(o_totalprice) OVER (PARTITION BY o_orderpriority) AS med FROM orders) SELECT o_orderpriority, round(median(abs(o_totalprice - med)) * 1.4826, 6) AS robust_sd FROM m GROUP BY 1")
def robust_sd(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").withColumn("med", F.median("o_totalprice").over(Window.partitionBy("o_orderpriority")))
    return rows.groupBy("o_orderpriority").agg(F.round(F.median(F.abs(F.col("o_totalprice") - F.col("med"))) * 1.4826, 6).alias("robust_sd"))


@register("e14_ratio_of_sums", "SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / nullif(sum(l_quantity), 0), 6) AS share FROM lineitem GROUP BY 1")
def ratio_of_sums(spark, sf_dir):
    r = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)) / F.nullif(F.sum("l_quantity"), F.lit(0.0))
    return load(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(r, 6).alias("share"))


@register("e15_product", "SELECT l_orderkey, round(product(1 + l_tax) - 1, 6) AS growth FROM lineitem GROUP BY 1")
def product(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.product(1 + F.col("l_tax")) - 1, 6).alias("growth"))


@register("e16_value_counts", "SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY 1")
def value_counts(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")).agg(F.count("*").alias("n"))


@register("e17_quantiles", "SELECT lang, count(*) AS n, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) AS q3 FROM documents GROUP BY 1")
def quantiles(spark, sf_dir):
    q = lambda p: F.percentile("n_chars", p)
    return load(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"))


@register("e18_crosstab", "SELECT coalesce(o_orderpriority, 'All') AS priority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) AS total FROM orders GROUP BY ROLLUP (o_orderpriority)")
def crosstab(spark, sf_dir):
    """Pivot with margins: a rollup row for all."""
    r = load(spark, sf_dir, "orders").rollup("o_orderpriority")
    made = r.agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"], F.count("*").alias("total"))
    return made.select(F.coalesce("o_orderpriority", F.lit("All")).alias("priority"), "f", "o", "p", "total")


@register("e18_pivot", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def pivot(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0, ["F", "O", "P"])


@register("e19_multi_agg", f"SELECT o_custkey, count(*) AS n, min({DAY}) AS first, max({DAY}) AS last, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders GROUP BY 1")
def multi_agg(spark, sf_dir):
    return _orders(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@register("e20_group_by_all", "SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL ORDER BY ALL")
def group_by_all(spark, sf_dir):
    load(spark, sf_dir, "orders").createOrReplaceTempView("tm_orders_all")
    return spark.sql("SELECT o_orderstatus, CAST(year(o_orderdate) AS BIGINT) AS y, count(*) AS n FROM tm_orders_all GROUP BY ALL ORDER BY ALL")


@register("e21_last_in_group", "SELECT user_id, max_by(value, {'t': ts, 'e': event_id}) AS last_value FROM events GROUP BY 1")
def last_in_group(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@register("e22_share_column", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def share_column(spark, sf_dir):
    g = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


@register("e23_upper_median", "SELECT source, n_chars AS upper_median FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE rn = n // 2 + 1")
def upper_median(spark, sf_dir):
    w = Window.partitionBy("source")
    rows = load(spark, sf_dir, "documents").select("source", "doc_id", "n_chars").withColumn("rn", F.row_number().over(w.orderBy("n_chars", "doc_id"))).withColumn("n", F.count("*").over(w))
    return rows.where("rn = n div 2 + 1").select("source", F.col("n_chars").alias("upper_median"))


@register("e24_max_captured_number", "SELECT event_id, list_max(list_transform(regexp_extract_all(props, '(\\d+)', 1), lambda x: CAST(x AS BIGINT))) AS most FROM events")
def max_captured_number(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.array_max(F.transform(F.regexp_extract_all("props", F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))).alias("most"))


# ---------------------------------------------------------------- windows


@register("f01_best_candidate", f"SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderstatus = 'F' DESC, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE {DAY} END NULLS LAST, o_orderkey) = 1")
def best_candidate(spark, sf_dir):
    order = [F.desc("o_totalprice"), (F.col("o_orderstatus") == "F").desc(), F.when(F.col("o_orderstatus") != "O", F.col("d")).asc_nulls_last(), F.col("o_orderkey")]
    return _orders(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order))).where("rn = 1").select("o_custkey", "o_orderkey")


@register("f03_stratified_sample", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || 'seed'), doc_id) <= 5")
def stratified_sample(spark, sf_dir):
    """The feature is the sample itself: five rows of each source by hash."""
    w = Window.partitionBy("source").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("seed"))), "doc_id")
    return load(spark, sf_dir, "documents").select("doc_id", "source").withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")


@register("f05_gaps_islands", f"SELECT o_custkey, {DAY} AS first_filing FROM (SELECT DISTINCT o_custkey, {DAY} AS o_orderdate FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate) QUALIFY lag({DAY}) OVER w IS NULL OR {DAY} - lag({DAY}) OVER w > 120")
def gaps_islands(spark, sf_dir):
    from ..operators.events import deal_starts

    return deal_starts(_orders(spark, sf_dir).select("o_custkey", "d").distinct(), "o_custkey", "d").select("o_custkey", F.col("d").alias("first_filing"))


@register("f06_latest_before", f"SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {DAY} DESC, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END DESC NULLS FIRST, o_orderkey) = 1")
def latest_before(spark, sf_dir):
    order = [F.desc("d"), F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).desc_nulls_first(), F.col("o_orderkey")]
    return _orders(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order))).where("rn = 1").select("o_custkey", "o_orderkey")


@register("f09_previous_end", f"SELECT cik, ticker, valid_to, last_value(valid_to IGNORE NULLS) OVER (PARTITION BY cik ORDER BY valid_to NULLS LAST, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS starts FROM ({RANGES})")
def previous_end(spark, sf_dir):
    w = Window.partitionBy("cik").orderBy(F.col("valid_to").asc_nulls_last(), "ticker").rowsBetween(Window.unboundedPreceding, -1)
    return ranges(spark, sf_dir).select("cik", "ticker", "valid_to", F.date_add(F.last("valid_to", ignorenulls=True).over(w), 1).alias("starts"))


@register("f11_rolling_median", "SELECT o_orderkey, CASE WHEN count(o_totalprice) OVER w >= 3 THEN median(o_totalprice) OVER w END AS med FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)")
def rolling_median(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-5, 5)
    return load(spark, sf_dir, "orders").select("o_orderkey", F.when(F.count("o_totalprice").over(w) >= 3, F.percentile("o_totalprice", 0.5).over(w)).alias("med"))


@register("f12_forward_median", "SELECT event_id, median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS ahead FROM events")
def forward_median(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, 15)
    return load(spark, sf_dir, "events").select("event_id", F.percentile("value", 0.5).over(w).alias("ahead"))


@register("f14_ranks", "SELECT o_orderkey, rank() OVER w AS r, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS rn, rank() OVER w + (count(*) OVER (PARTITION BY o_orderpriority, o_orderdate) - 1) / 2 AS avg_rank FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC)")
def ranks(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"))
    n = F.count("*").over(Window.partitionBy("o_orderpriority", "o_orderdate"))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.row_number().over(w.orderBy(F.desc("o_orderdate"), "o_orderkey")).cast("long").alias("rn"), (F.rank().over(w) + (n - 1) / 2).alias("avg_rank"))


@register("f15_qcut", "SELECT o_orderkey, CAST(greatest(1, ceil((rn - 1) * 5.0 / (n - 1))) AS INT) AS q FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)")
def qcut(spark, sf_dir):
    from ..functions.stats import quantile_bin

    w = Window.partitionBy("o_orderstatus")
    rank = F.row_number().over(w.orderBy(F.col("o_totalprice").asc_nulls_last(), F.col("o_orderkey").asc_nulls_last()))
    return load(spark, sf_dir, "orders").select("o_orderkey", quantile_bin(rank, F.count("*").over(w), 5).alias("q"))


@register("f16_group_size", "SELECT doc_id, count(*) OVER (PARTITION BY lang, source) AS n FROM documents")
def group_size(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.count("*").over(Window.partitionBy("lang", "source")).alias("n"))


@register("f17_robust_z", "WITH m AS (SELECT *, median(o_totalprice) OVER (PARTITION BY o_orderpriority) AS med FROM orders), a AS (SELECT *, median(abs(o_totalprice - med)) OVER (PARTITION BY o_orderpriority) AS mad FROM m) SELECT o_orderkey, round(greatest(-5, least(5, (o_totalprice - med) / nullif(1.4826 * mad, 0))), 6) AS z FROM a")
def robust_z(spark, sf_dir):
    from ..functions.stats import robust_z

    return robust_z(load(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"], "z").select("o_orderkey", F.round("z", 6).alias("z"))


@register("f20_positional_slice", "SELECT l_orderkey, CAST(sum(l_quantity) FILTER (WHERE rn BETWEEN n - 4 AND n - 2) AS DOUBLE) AS q FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) GROUP BY 1")
def positional_slice(spark, sf_dir):
    w = Window.partitionBy("l_orderkey")
    rows = load(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(w.orderBy("l_shipdate", "l_linenumber", "l_extendedprice"))).withColumn("n", F.count("*").over(w))
    return rows.groupBy("l_orderkey").agg(F.sum(F.when(F.expr("rn BETWEEN n - 4 AND n - 2"), F.col("l_quantity"))).alias("q"))


# ---------------------------------------------------------------- top-k, sets, reshape


@register("g02_candidate_order", f"SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, abs({DAY} - DATE '1998-01-01'), o_orderkey) = 1")
def candidate_order(spark, sf_dir):
    gap = F.abs(F.datediff("d", F.lit("1998-01-01").cast("date")))
    best = F.min_by("o_orderkey", F.struct(F.col("o_orderstatus") != "F", gap, "o_orderkey"))
    return _orders(spark, sf_dir).groupBy("o_custkey").agg(best.alias("o_orderkey"))


@register("g04_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@register("g05_top_share", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END DESC NULLS LAST, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE rn <= greatest(1, ceil(0.05 * n))")
def top_share(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority")
    score = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w.orderBy(score.desc_nulls_last(), "o_orderkey")).alias("rn"), F.count("*").over(w).alias("n"))
    return rows.where(F.col("rn") <= F.greatest(F.lit(1), F.ceil(F.lit(0.05) * F.col("n")))).select("o_orderkey")


@register("g06_top_k_per_month", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) <= 50")
def top_k_per_month(spark, sf_dir):
    w = Window.partitionBy(F.date_trunc("month", "o_orderdate")).orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 50").select("o_orderkey")


@register("g07_hash_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || 'tz'), doc_id LIMIT 50")
def hash_sample(spark, sf_dir):
    """The feature is the deterministic sample of 50."""
    return load(spark, sf_dir, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("tz"))), "doc_id").limit(50)


@register("g08_random_sample")
def random_sample(spark, sf_dir):
    """The feature is a seeded random sample of 30; rows differ between engines."""
    return load(spark, sf_dir, "documents").select("doc_id").orderBy(F.rand(7)).limit(30)


@register("g09_argmin_small", "SELECT o_orderkey, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS k FROM (SELECT o_orderkey, o_orderkey % 5 AS a, o_custkey % 5 AS b, (o_orderkey + o_custkey) % 5 AS c FROM orders)")
def argmin_small(spark, sf_dir):
    parts = [F.col("o_orderkey") % 5, F.col("o_custkey") % 5, (F.col("o_orderkey") + F.col("o_custkey")) % 5]
    best = F.array_min(F.array(*[F.struct(p.alias("v"), F.lit(i).alias("k")) for i, p in enumerate(parts)]))
    return load(spark, sf_dir, "orders").select("o_orderkey", best.k.alias("k"))


@register("h01_union_all", "SELECT o_orderkey, 'urgent' AS kind FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 'open' FROM orders WHERE o_orderstatus = 'O'")
def union_all(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("urgent").alias("kind")).unionByName(o.where("o_orderstatus = 'O'").select("o_orderkey", F.lit("open").alias("kind")))


@register("h02_union_by_name", "SELECT doc_id, quality, NULL AS toxic FROM labels UNION ALL BY NAME SELECT doc_id, toxic FROM labels")
def union_by_name(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    return labels.select("doc_id", "quality").unionByName(labels.select("doc_id", "toxic"), allowMissingColumns=True)


@register("h03_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()


@register("h05_unnest_split", "SELECT event_id, unnest(string_split(event_type || '|' || CAST(user_id AS VARCHAR), '|')) AS part FROM events")
def unnest_split(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.explode(F.split(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), r"\|")).alias("part"))


@register("h06_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_difference(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id").distinct().join(load(spark, sf_dir, "labels"), "doc_id", "left_anti")


@register("h07_wide_to_long", "SELECT doc_id, w.name AS measure, CASE w.name WHEN 'quality' THEN quality ELSE toxic END AS v FROM labels, (VALUES ('quality'), ('toxic')) w(name)")
def wide_to_long(spark, sf_dir):
    return load(spark, sf_dir, "labels").unpivot(["doc_id"], ["quality", "toxic"], "measure", "v")


@register("h08_symbol_set", "SELECT DISTINCT upper(trim(replace(s, '/', '.'))) AS symbol FROM (SELECT p_brand AS s FROM part UNION ALL SELECT lower(p_brand) || ' ' FROM part UNION ALL SELECT 'brk/b') WHERE regexp_full_match(upper(trim(replace(s, '/', '.'))), '[A-Z.#0-9]+')")
def symbol_set(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    names = part.select(F.col("p_brand").alias("s")).unionByName(part.select(F.concat(F.lower("p_brand"), F.lit(" ")).alias("s"))).unionByName(spark.range(1).select(F.lit("brk/b").alias("s")))
    clean = F.upper(F.trim(F.translate("s", "/", ".")))
    return names.select(clean.alias("symbol")).where(F.col("symbol").rlike("^[A-Z.#0-9]+$")).distinct()
