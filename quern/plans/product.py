"""Event, session, funnel and finance queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import analytics as A
from quern.operators import relational as R
from quern.plans.registry import query
from quern.sources.tables import table

STAGES = ["view", "click", "signup", "purchase"]
_REACHED = """
u AS (SELECT {by} user_id, max((event_type = 'view')::INT) AS a, max((event_type = 'click')::INT) AS b, max((event_type = 'signup')::INT) AS c, max((event_type = 'purchase')::INT) AS e FROM {src} GROUP BY ALL),
s AS (SELECT {by} 0 AS stage_no, 'view' AS stage, sum(a) AS n FROM u GROUP BY ALL UNION ALL SELECT {by} 1, 'click', sum(a * b) FROM u GROUP BY ALL UNION ALL SELECT {by} 2, 'signup', sum(a * b * c) FROM u GROUP BY ALL UNION ALL SELECT {by} 3, 'purchase', sum(a * b * c * e) FROM u GROUP BY ALL)
"""


@query("funnel", "WITH " + _REACHED.format(by="", src="events") + """
SELECT stage, CAST(n AS BIGINT) AS n, round(n * 100.0 / lag(n) OVER w, 2) AS step_conversion, round(n * 100.0 / first(n) OVER w, 2) AS cumulative_conversion, CAST(lag(n) OVER w - n AS BIGINT) AS drop_off
FROM s WINDOW w AS (ORDER BY stage_no)""")
def funnel(spark, d):
    return A.funnel(A.stage_counts(table(spark, d, "events"), STAGES)).select("stage", "n", "step_conversion", "cumulative_conversion", "drop_off")


@query("funnel_by_segment", "WITH ev AS (SELECT *, user_id % 3 AS segment FROM events), " + _REACHED.format(by="segment,", src="ev") + """
, o AS (SELECT segment, max(CASE WHEN stage_no = 3 THEN n END) * 100.0 / max(CASE WHEN stage_no = 0 THEN n END) AS conversion FROM s GROUP BY 1)
SELECT segment, round(conversion, 2) AS conversion, rank() OVER (ORDER BY conversion DESC) AS place FROM o""")
def funnel_by_segment(spark, d):
    ev = table(spark, d, "events").withColumn("segment", F.pmod("user_id", F.lit(3)))
    s = A.stage_counts(ev, STAGES, by=["segment"])
    o = s.groupBy("segment").agg((F.max(F.when(F.col("stage_no") == 3, F.col("n"))) * 100.0 / F.max(F.when(F.col("stage_no") == 0, F.col("n")))).alias("c"))
    return o.select("segment", F.round("c", 2).alias("conversion"), F.rank().over(Window.orderBy(F.desc("c"))).cast("long").alias("place"))


@query("cohort_retention", """
WITH p AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS p FROM events), f AS (SELECT user_id, min(p) AS cohort FROM p GROUP BY 1),
o AS (SELECT cohort, p - cohort AS "offset", count(*) AS users FROM p JOIN f USING (user_id) GROUP BY 1, 2)
SELECT o.cohort, o."offset", o.users, round(o.users / b.users, 6) AS retention FROM o JOIN o b ON b.cohort = o.cohort AND b."offset" = 0""")
def cohort_retention(spark, d):
    return A.cohort_retention(table(spark, d, "events"), "user_id", "ts")


_SESSIONS = """
t AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
n AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) < 21600 THEN 0 ELSE 1 END AS new FROM t),
e AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM n)
"""


@query("sessions", "WITH " + _SESSIONS + "SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n_events, max(s) - min(s) AS duration_s FROM e GROUP BY 1, 2")
def sessions(spark, d):
    return A.session_stats(A.sessionized(table(spark, d, "events"), "user_id", "ts", 6 * 3600, "event_id"), "user_id")


@query("bounce_rate", "WITH " + _SESSIONS + ", x AS (SELECT user_id, session_no, count(*) AS n FROM e GROUP BY 1, 2) SELECT count(*) AS visits, count(DISTINCT user_id) AS visitors, round(avg((n = 1)::INT), 6) AS bounce_rate FROM x")
def bounce_rate(spark, d):
    s = A.session_stats(A.sessionized(table(spark, d, "events"), "user_id", "ts", 6 * 3600, "event_id"), "user_id")
    return s.agg(F.count("*").alias("visits"), F.count_distinct("user_id").alias("visitors"), F.round(F.avg((F.col("n_events") == 1).cast("int")), 6).alias("bounce_rate"))


@query("rate_limit", """
SELECT event_id, count(*) OVER w - 1 AS recent, CASE WHEN count(*) OVER w - 1 >= 3 THEN 'exceeded' WHEN count(*) OVER w - 1 >= 2.4 THEN 'warning' ELSE 'ok' END AS rate_state
FROM (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 14400 PRECEDING AND CURRENT ROW)""")
def rate_limit(spark, d):
    return A.recent_counts(table(spark, d, "events"), "user_id", "ts", 14400, 3).select("event_id", "recent", "rate_state")


@query("tumbling_metrics", "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS bucket, round(avg(value), 4) AS average, min(value) AS minimum, max(value) AS maximum, round(sum(value), 2) AS total, count(value) AS n FROM events GROUP BY 1")
def tumbling_metrics(spark, d):
    return A.bucketed(table(spark, d, "events"), "ts", "value", 3600).select("bucket", F.round("average", 4).alias("average"), "minimum", "maximum", F.round("total", 2).alias("total"), F.col("count").alias("n"))


@query("events_by_type_7d", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30' GROUP BY 1")
def events_by_type_7d(spark, d):
    e = table(spark, d, "events")
    return e.filter((F.col("ts") >= F.lit("2024-01-23").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-30").cast("timestamp_ntz"))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("asof_last_click", """
SELECT a.event_id, b.value AS last_click FROM (SELECT * FROM events WHERE event_type = 'purchase') a
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND a.ts >= b.ts""")
def asof_last_click(spark, d):
    e = table(spark, d, "events")
    left, right = (e.filter(F.col("event_type") == k).select("event_id", "user_id", "ts", "value") for k in ("purchase", "click"))
    return R.asof_join(left.drop("value"), right, "user_id", "ts", "value", "last_click").select("event_id", "last_click")


@query("rolling_7d", """
SELECT event_id, count(*) OVER w AS n_7d, round(sum(value) OVER w, 3) AS value_7d FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW)""")
def rolling_7d(spark, d):
    out = R.rolling(table(spark, d, "events"), ["user_id"], A.seconds("ts"), 7 * 86400, {"n_7d": F.count("*"), "value_7d": F.sum("value")})
    return out.select("event_id", "n_7d", F.round("value_7d", 3).alias("value_7d"))


@query("ffill", """
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM events""")
def ffill(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return R.forward_fill(e, ["user_id"], ["ts", "event_id"], "v", "filled").select("event_id", "filled")


@query("props_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("props_counts", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def props_counts(spark, d):
    e = table(spark, d, "events").select("user_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return e.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("web_stats", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS pageviews, count(DISTINCT user_id) AS visitors FROM events GROUP BY 1, 2")
def web_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("pageviews"), F.count_distinct("user_id").alias("visitors"))


@query("journeys", """
WITH n AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT a, b, count(*) AS n FROM n WHERE b IS NOT NULL GROUP BY 1, 2""")
def journeys(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b")).filter("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("p95_nearest_rank", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
m AS (SELECT event_type, median(value) AS p50, max(value) AS largest FROM events GROUP BY 1)
SELECT event_type, n, round(p50, 6) AS p50, CASE WHEN n < 5 THEN largest ELSE value END AS p95 FROM r JOIN m USING (event_type) WHERE i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)""")
def p95_nearest_rank(spark, d):
    return A.nearest_rank(table(spark, d, "events"), ["event_type"], "value").withColumn("p50", F.round("p50", 6))


@query("signed_share", """
WITH w AS (SELECT o_orderpriority AS k, o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS w FROM orders)
SELECT k, round(sum(greatest(w, 0)) / sum(abs(w)), 6) AS positive_share, round(sum(least(w, 0)) / sum(abs(w)), 6) AS negative_share FROM w GROUP BY 1""")
def signed_share(spark, d):
    o = table(spark, d, "orders")
    mean = o.agg(F.avg("o_totalprice").alias("m"))
    w = o.select(F.col("o_orderpriority").alias("k"), "o_totalprice").join(F.broadcast(mean)).select("k", (F.col("o_totalprice") - F.col("m")).alias("w"))
    return A.signed_share(w, ["k"], "w").select("k", F.round("positive_share", 6).alias("positive_share"), F.round("negative_share", 6).alias("negative_share"))


@query("extent", "SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem")
def extent(spark, d):
    return table(spark, d, "lineitem").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("success_rate", "SELECT user_id, round(coalesce(sum((event_type = 'purchase')::INT) / nullif(sum((event_type IN ('purchase', 'error'))::INT), 0), 0), 6) AS success_rate FROM events GROUP BY 1")
def success_rate(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("ok"), F.count_if(F.col("event_type") == "error").alias("bad"))
    return g.select("user_id", F.round(A.success_rate(F.col("ok"), F.col("bad")), 6).alias("success_rate"))


@query("cac_rollup", """
SELECT r_name AS channel, count(*) AS customers, round(coalesce(round(sum(c_acctbal) / nullif(count(*), 0), 2), 0), 2) AS cac
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (1)""")
def cac_rollup(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("channel"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("channel", F.col("c_acctbal").alias("spend_"), F.lit(1).alias("customers_"))
    return A.acquisition_cost(c, "channel", "spend_", "customers_").select("channel", "customers", "cac")


@query("sample_size", """
WITH b AS (SELECT r_regionkey, (r_regionkey + 1) / 20.0 AS p, 0.02 AS e FROM region)
SELECT r_regionkey, CAST(ceil(2 * (p + e / 2) * (1 - (p + e / 2)) * pow(1.959963984540054 + 0.8416212335729143, 2) / (e * e)) AS BIGINT) AS n_per_arm FROM b""")
def sample_size(spark, d):
    return table(spark, d, "region").select("r_regionkey", A.sample_size((F.col("r_regionkey") + 1) / 20.0, F.lit(0.02)).cast("long").alias("n_per_arm"))


@query("okr_score", """
SELECT s_suppkey, round(CASE WHEN s_suppkey % 3 = 0 THEN (s_acctbal > 5000)::INT::DOUBLE WHEN s_suppkey % 3 = 1 THEN least(1, (s_suppkey % 7) / 4.0)
ELSE greatest(0, least(1, (s_acctbal - 1000) / 4000.0)) END, 6) AS score FROM supplier""")
def okr_score(spark, d):
    k = F.col("s_suppkey") % 3
    kind = F.when(k == 0, "boolean").when(k == 1, "milestone").otherwise("numeric")
    score = A.key_result_score(kind, F.lit(1000.0), F.col("s_acctbal"), F.lit(5000.0), F.lit(False), F.col("s_acctbal") > 5000, F.lit(4), F.col("s_suppkey") % 7)
    return table(spark, d, "supplier").select("s_suppkey", F.round(score, 6).alias("score"))


@query("arr_forecast", """
WITH p AS (SELECT * FROM (VALUES ('base', 0.05), ('high', 0.1), ('low', 0.02)) t(scenario, g)), m AS (SELECT scenario, unnest(range(1, 25)) AS month, g FROM p)
SELECT scenario, CAST(month AS INT) AS month, round(1200000 * pow(1 + g, month), 2) AS arr, round(150000 - round(1200000 * pow(1 + g, month), 2) / 12, 2) AS net_burn FROM m""")
def arr_forecast(spark, d):
    return A.arr_forecast(spark, 1_200_000, 150_000, 2_000_000, {"base": 0.05, "high": 0.1, "low": 0.02}, 24).select("scenario", "month", "arr", "net_burn")


@query("recency_score", """
SELECT o_orderkey, CAST(CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-06-01') < 0 THEN 100 WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-06-01') >= 365 THEN 0
ELSE floor(100 * (1 - date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-06-01') / 365.0::DOUBLE)) END AS INT) AS recency FROM orders""")
def recency_score(spark, d):
    return table(spark, d, "orders").select("o_orderkey", A.recency_score(F.to_date("o_orderdate"), F.lit("2001-06-01").cast("date"), 365).alias("recency"))


@query("score_badge", "SELECT p_partkey, CASE WHEN p_size * 2 >= 80 THEN 'A' WHEN p_size * 2 >= 65 THEN 'B' WHEN p_size * 2 >= 50 THEN 'C' WHEN p_size * 2 >= 35 THEN 'D' ELSE 'E' END AS badge FROM part")
def score_badge(spark, d):
    return table(spark, d, "part").select("p_partkey", A.score_badge(F.col("p_size") * 2).alias("badge"))


@query("weighted_score", "SELECT l_orderkey, round(sum(l_quantity * l_discount) / sum(l_quantity), 10) AS score, avg((l_discount >= 0.05)::INT) >= 0.5 AS passed FROM lineitem GROUP BY 1")
def weighted_score(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg((F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity")).alias("s"), F.avg((F.col("l_discount") >= 0.05).cast("int")).alias("p"))
    return g.select("l_orderkey", F.round("s", 10).alias("score"), (F.col("p") >= 0.5).alias("passed"))
