"""Relational archetypes over the star schema."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import relational as R
from quern.plans.registry import query
from quern.sources.tables import table


@query("dept_count", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def dept_count(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("filtered_count", "SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)")
def filtered_count(spark, d):
    nation = table(spark, d, "nation")
    first = nation.agg(F.min("n_name").alias("n_name"))
    keys = nation.join(F.broadcast(first), "n_name").select(F.col("n_nationkey").alias("c_nationkey"))  # first is one row
    return table(spark, d, "customer").join(R.broadcast_checked(keys), "c_nationkey").agg(F.count("*").alias("n"))


@query("avg_having", "SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 4) AS mean_balance FROM customer GROUP BY 1 HAVING count(*) > 5")
def avg_having(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance")).filter("n > 5")


@query("argmax_row", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def argmax_row(spark, d):
    best = table(spark, d, "customer").agg(F.max_by(F.struct("c_custkey", "c_name", "c_acctbal"), F.struct("c_acctbal", -F.col("c_custkey"))).alias("b"))
    return best.select("b.*")


@query("above_group_avg", "SELECT c_custkey, round((c_acctbal / m - 1) * 100, 4) AS percent_above FROM customer JOIN (SELECT c_mktsegment AS s, avg(c_acctbal) AS m FROM customer GROUP BY 1) ON s = c_mktsegment WHERE c_acctbal > m")
def above_group_avg(spark, d):
    return R.above_group_mean(table(spark, d, "customer"), "c_mktsegment", "c_acctbal").select("c_custkey", F.round("percent_above", 4).alias("percent_above"))


@query("top3_share", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders),
g AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total, sum(CASE WHEN k <= 3 THEN o_totalprice END) AS top FROM r GROUP BY 1)
SELECT o_custkey, n, round(total, 2) AS total, round(total / (SELECT sum(o_totalprice) FROM orders), 8) AS share, round(top / total, 6) AS top_share  FROM g""")
def top3_share(spark, d):
    out = R.group_share(table(spark, d, "orders"), "o_custkey", "o_totalprice", 3, "o_orderkey")
    return out.select("o_custkey", "n", F.round("total", 2).alias("total"), F.round("share", 8).alias("share"), F.round("top_share", 6).alias("top_share"))


@query("top_vs_next3", """
WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT o_custkey, max(CASE WHEN k = 1 THEN o_totalprice END) AS top, round(avg(CASE WHEN k BETWEEN 2 AND 4 THEN o_totalprice END), 4) AS next3 FROM r WHERE k <= 4 GROUP BY 1""")
def top_vs_next3(spark, d):
    r = R.top_per_group(table(spark, d, "orders").select("o_custkey", "o_totalprice", "o_orderkey"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 4)
    return r.groupBy("o_custkey").agg(F.max(F.when(F.col("rank") == 1, F.col("o_totalprice"))).alias("top"), F.round(F.avg(F.when(F.col("rank") > 1, F.col("o_totalprice"))), 4).alias("next3"))


@query("left_join_nullable", "SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def left_join_nullable(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    return table(spark, d, "orders").select("o_orderkey").join(items, "o_orderkey", "left")


@query("inner_join_filtered", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def inner_join_filtered(spark, d):
    region = table(spark, d, "region").filter("r_name = 'EUROPE'")
    nation = table(spark, d, "nation").join(R.broadcast_checked(region), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(R.broadcast_checked(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("right_join", "SELECT s_suppkey, n_nationkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def right_join(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_nationkey")


@query("full_outer_join", "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON s_suppkey = c_custkey")
def full_outer_join(spark, d):
    s = table(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey")
    c = table(spark, d, "customer").filter("c_acctbal > 9000").select("c_custkey")
    return s.join(c, F.col("s_suppkey") == F.col("c_custkey"), "full")


@query("semi_join", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def semi_join(spark, d):
    big = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(big, "o_orderkey", "left_semi")


@query("anti_join", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("never_ordered", "SELECT p_partkey FROM part LEFT JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49) ON l_partkey = p_partkey WHERE l_partkey IS NULL")
def never_ordered(spark, d):
    """Parts that nobody ordered 49 or more of; every part was ordered at all."""
    return table(spark, d, "part").select("p_partkey").join(table(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti")


@query("child_count", "SELECT o_orderkey, count(l_orderkey) AS n_children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def child_count(spark, d):
    return R.child_count(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")


@query("latest_order_per_customer", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_order_per_customer(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.latest_per_key(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("rolling_mean_orders", """
SELECT o_orderkey, count(*) OVER w AS n_30d, round(avg(o_totalprice) OVER w, 4) AS mean_30d FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)""")
def rolling_mean_orders(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    out = R.rolling(rows, ["o_custkey"], F.unix_timestamp(F.col("o_orderdate").cast("timestamp")), 30 * 86400, {"n_30d": F.count("*"), "mean_30d": F.avg("o_totalprice")})
    return out.select("o_orderkey", "n_30d", F.round("mean_30d", 4).alias("mean_30d"))


@query("grouped_windows", """
SELECT o_orderkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS pct, round(cume_dist() OVER w, 6) AS cume, lead(o_orderkey) OVER w AS next_order
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""")
def grouped_windows(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return rows.select("o_orderkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pct"), F.round(F.cume_dist().over(w), 6).alias("cume"), F.lead("o_orderkey").over(w).alias("next_order"))


@query("top5_spend", "SELECT o_custkey, round(sum(o_totalprice), 2) AS spend FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 5")
def top5_spend(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).orderBy(F.desc("s"), "o_custkey").limit(5).select("o_custkey", F.round("s", 2).alias("spend"))


@query("lifetime_value", "SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice * 1.08), 2) AS value FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1")
def lifetime_value(spark, d):
    rows = table(spark, d, "orders").filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.round(F.sum(F.col("o_totalprice") * 1.08), 2).alias("value"))


@query("count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1")
def count_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_suppkey").alias("n_suppliers"))


@query("pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("cube_status", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (1, 2)")
def cube_status(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("rollup_counts", "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (1, 2)")
def rollup_counts(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("two_level_counts", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def two_level_counts(spark, d):
    return table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))


@query("zero_filled_counts", "SELECT n_name, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def zero_filled_counts(spark, d):
    n = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "nation").join(n, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("ordered_list", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS orders FROM orders GROUP BY 1")
def ordered_list(spark, d):
    out = R.collect_ordered(table(spark, d, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), F.col("o_orderkey").cast("string"), "l")
    return out.select("o_custkey", F.array_join("l", ",").alias("orders"))


@query("set_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_intersect(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "customer").filter("c_acctbal < 0").select("c_custkey"))


@query("set_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def set_except(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(spark, d, "lineitem").filter("l_quantity > 48").select("l_partkey"))


@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


@query("branches", """
SELECT p_partkey, concat_ws('|', CASE WHEN p_size > 25 THEN 'large' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END, CASE WHEN p_brand = 'Brand#1' THEN 'first' END) AS marks FROM part""")
def branches(spark, d):
    marks = R.all_branches([(F.col("p_size") > 25, F.lit("large")), (F.col("p_retailprice") > 1500, F.lit("dear")), (F.col("p_brand") == "Brand#1", F.lit("first"))])
    return table(spark, d, "part").select("p_partkey", F.array_join(marks, "|").alias("marks"))


@query("apply_when", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority FROM orders")
def apply_when(spark, d):
    return R.apply_when(table(spark, d, "orders"), F.col("o_orderstatus") == "F", "o_orderpriority", F.lower).select("o_orderkey", "o_orderpriority")


@query("safe_division", "SELECT c_custkey, round(c_acctbal / nullif(c_nationkey, 0), 6) AS per_nation FROM customer")
def safe_division(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(F.try_divide("c_acctbal", F.col("c_nationkey").cast("double")), 6).alias("per_nation"))


@query("like_filter", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#3' AND p_name LIKE '%ring%' ORDER BY p_partkey LIMIT 200")
def like_filter(spark, d):
    """Equality and a part of a name, the first 200."""
    return table(spark, d, "part").filter((F.col("p_brand") == "Brand#3") & F.col("p_name").contains("ring")).select("p_partkey", "p_name").orderBy("p_partkey").limit(200)


@query("paging", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def paging(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(20).select("c_custkey")


@query("guarded_sql", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def guarded_sql(spark, d):
    from quern.operators.sql_guard import run_read_only

    return run_read_only(spark, "SELECT o_orderpriority, count(*) AS n FROM guarded_orders WHERE o_totalprice > :least GROUP BY 1", {"least": 1000}, {"guarded_orders": table(spark, d, "orders")})


@query("custom_sort", """
SELECT p_partkey, CASE p_brand WHEN 'Brand#3' THEN 1 WHEN 'Brand#1' THEN 2 ELSE 999 END AS category_rank,
row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#3' THEN 1 WHEN 'Brand#1' THEN 2 ELSE 999 END, lower(p_name), p_partkey) AS place FROM part ORDER BY place LIMIT 50""")
def custom_sort(spark, d):
    ranked = R.custom_order(table(spark, d, "part"), "p_brand", {"Brand#3": 1, "Brand#1": 2}, name="p_name")
    top = ranked.orderBy("category_rank", F.lower("p_name"), "p_partkey").limit(50)  # a report of the first 50
    w = Window.orderBy("category_rank", F.lower("p_name"), "p_partkey")
    return top.select("p_partkey", "category_rank", F.row_number().over(w).cast("long").alias("place"))


@query("snapshot_delta", """
WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT k, c.n AS n, c.n - coalesce(p.n, 0) AS delta FROM c LEFT JOIN p USING (k)""")
def snapshot_delta(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate")
    before = o.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return R.snapshot_delta(*[x.groupBy("k").agg(F.count("*").alias("n")) for x in (o, before)], "k", "n")


@query("scd2_priority", """
WITH s AS (SELECT o_custkey, o_orderpriority, o_orderkey, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
r AS (SELECT * FROM s WHERE n = 1 OR b IS DISTINCT FROM o_orderpriority)
SELECT o_custkey, o_orderpriority, o_orderkey AS valid_from, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS valid_to, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NULL AS is_current FROM r""")
def scd2_priority(spark, d):
    return R.scd2(table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), "o_custkey", "o_orderkey", ["o_orderpriority"])


@query("upsert", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey > 5 UNION ALL SELECT s_suppkey, s_acctbal + 1 FROM supplier WHERE s_suppkey <= 5")
def upsert(spark, d):
    base = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    changes = base.filter("s_suppkey <= 5").withColumn("s_acctbal", F.col("s_acctbal") + 1)
    return R.upsert(base, changes, ["s_suppkey"], [F.col("s_acctbal")])


@query("incremental_load", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-01'")
def incremental_load(spark, d):
    import datetime

    return R.newer_than(table(spark, d, "orders"), "o_orderdate", datetime.datetime(2000, 6, 1)).select("o_orderkey")


@query("alias_canonical", """
SELECT n_nationkey, CASE lower(trim(n_name)) WHEN 'united states' THEN 'usa' WHEN 'united kingdom' THEN 'uk' ELSE lower(trim(n_name)) END AS canonical_name FROM nation""")
def alias_canonical(spark, d):
    aliases = spark.createDataFrame([("UNITED STATES", "usa"), ("United Kingdom", "uk")], "alias string, canonical string")
    return R.with_alias(table(spark, d, "nation").select("n_nationkey", "n_name"), aliases, "n_name", "canonical_name").select("n_nationkey", "canonical_name")
