"""Product, finance and statistical analytics over events and order data. Anchor dates are parameters."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def seconds(ts: str) -> Column:
    return F.unix_timestamp(F.col(ts).cast("timestamp"))


def funnel(counts: DataFrame, stage_no: str = "stage_no", stage: str = "stage", n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """Conversion from the stage before and from the first, and the drop-off, of ordered stages (a row each)."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(stage_no)
    first = F.first(n).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = F.lag(n).over(w)
    return counts.select(
        *by, stage_no, stage, n,
        F.round(F.try_divide(F.col(n) * 100.0, before), 2).alias("step_conversion"),
        F.round(F.coalesce(F.try_divide(F.col(n) * 100.0, first), F.lit(0.0)), 2).alias("cumulative_conversion"),
        (before - F.col(n)).alias("drop_off"),
        F.round((1 - F.try_divide(F.col(n).cast("double"), before)) * 100, 2).alias("drop_off_rate"),
    )


def bottlenecks(steps: DataFrame) -> DataFrame:
    """The step that loses most users, and the one that loses the largest share."""
    w = Window.orderBy("stage_no")
    named = steps.withColumn("step", F.concat_ws(" -> ", F.lag("stage").over(w), "stage")).filter(F.col("drop_off").isNotNull())
    return named.agg(
        F.max_by("step", F.struct("drop_off", -F.col("stage_no"))).alias("bottleneck_absolute"),
        F.max("drop_off").alias("lost"),
        F.max_by("step", F.struct("drop_off_rate", -F.col("stage_no"))).alias("bottleneck_relative"),
    )


def funnel_from_lists(spark: SparkSession, stages: list[str], counts: list[int]) -> DataFrame:
    if not stages:
        raise ValueError("no stages")
    if len(stages) != len(counts):
        raise ValueError("as many counts as stages are needed")
    return funnel(spark.createDataFrame([(i, s, int(c)) for i, (s, c) in enumerate(zip(stages, counts))], "stage_no int, stage string, n long"))


def stage_counts(events: DataFrame, stages: Sequence[str], user: str = "user_id", kind: str = "event_type", by: Sequence[str] = ()) -> DataFrame:
    """Distinct users with an event of each stage and of all stages before it."""
    order = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))])
    seen = events.filter(F.col(kind).isin(*stages)).groupBy(*by, user).agg(F.collect_set(kind).alias("kinds"))
    reached = seen.withColumn("stage", F.explode(F.filter(F.array(*map(F.lit, stages)), lambda s: F.forall(F.slice(F.array(*map(F.lit, stages)), F.lit(1), F.try_element_at(order, s) + 1), lambda p: F.array_contains("kinds", p)))))
    return reached.groupBy(*by, "stage").agg(F.count("*").alias("n")).withColumn("stage_no", F.try_element_at(order, F.col("stage")))


def cohort_retention(events: DataFrame, user: str, ts: str, days: int = 7) -> DataFrame:
    """Users of each first-seen period who are active in each later period, and their share."""
    period = F.floor(seconds(ts) / (86400 * days))
    seen = events.select(user, period.alias("p")).distinct()
    first = seen.groupBy(user).agg(F.min("p").alias("cohort"))
    out = seen.join(first, user).groupBy("cohort", (F.col("p") - F.col("cohort")).alias("offset")).agg(F.count("*").alias("users"))
    base = out.filter("offset = 0").select("cohort", F.col("users").alias("size"))
    return out.join(base, "cohort").select("cohort", "offset", "users", F.round(F.col("users") / F.col("size"), 6).alias("retention"))


def sessionized(events: DataFrame, user: str, ts: str, gap_seconds: int, tie: str) -> DataFrame:
    """Events with their session number: a new one after a gap of at least ``gap_seconds``."""
    w = Window.partitionBy(user).orderBy("_s", tie)
    timed = events.withColumn("_s", seconds(ts))
    new = F.when(F.col("_s") - F.lag("_s").over(w) < gap_seconds, 0).otherwise(1)
    return timed.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def session_stats(sessions: DataFrame, user: str) -> DataFrame:
    return sessions.groupBy(user, "session_no").agg(F.count("*").alias("n_events"), (F.max("_s") - F.min("_s")).alias("duration_s"))


def recent_counts(events: DataFrame, key: str, ts: str, seconds_back: int, limit: int, warn: float = 0.8) -> DataFrame:
    """Events of the key in the window before each event (itself not counted), and whether a limit is reached."""
    w = Window.partitionBy(key).orderBy("_s").rangeBetween(-seconds_back, 0)
    out = events.withColumn("_s", seconds(ts)).withColumn("recent", F.count("*").over(w) - 1).drop("_s")
    state = F.when(F.col("recent") >= limit, "exceeded").when(F.col("recent") >= limit * warn, "warning").otherwise("ok")
    return out.withColumn("rate_state", state)


def bucketed(events: DataFrame, ts: str, value: str, seconds_wide: int) -> DataFrame:
    """Average, minimum, maximum, total and count of each time bucket."""
    start = F.floor(seconds(ts) / seconds_wide) * seconds_wide
    return events.groupBy(start.alias("bucket")).agg(F.avg(value).alias("average"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.sum(value).alias("total"), F.count(value).alias("count"))


def acquisition_cost(df: DataFrame, channel: str, spend: str, customers: str) -> DataFrame:
    """Spend per customer by channel and blended over all (channel null); 0 without customers."""
    out = df.rollup(channel).agg(F.sum(spend).alias("spend"), F.sum(customers).alias("customers"))
    return out.withColumn("cac", F.when(F.col("customers") > 0, F.round(F.col("spend") / F.col("customers"), 2)).otherwise(F.lit(0.0)))


def sample_size(baseline: Column, effect: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Users per arm to tell ``baseline`` from ``baseline + effect`` (two-sided)."""
    z = NormalDist().inv_cdf(1 - alpha / 2) + NormalDist().inv_cdf(power)
    mean = (baseline + (baseline + effect)) / 2
    return F.ceil(2 * mean * (1 - mean) * F.lit(z * z) / (effect * effect))


def key_result_score(kind: Column, baseline: Column, current: Column, target: Column, lower_is_better: Column, done: Column, milestones: Column, reached: Column) -> Column:
    """0 to 1: numeric progress, boolean, or share of milestones."""
    span = F.when(lower_is_better, baseline - target).otherwise(target - baseline)
    moved = F.when(lower_is_better, baseline - current).otherwise(current - baseline)
    numeric = F.when(span == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(moved.cast("double"), span))))
    steps = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(reached.cast("double"), milestones), F.lit(0.0))))
    return F.when(kind == "boolean", F.when(done, 1.0).otherwise(0.0)).when(kind == "milestone", steps).otherwise(numeric)


def okr_status(score: Column) -> Column:
    """Bands of our own: on track from 0.7, at risk from 0.4."""
    return F.when(score >= 0.7, "on_track").when(score >= 0.4, "at_risk").otherwise("off_track")


def arr_forecast(spark: SparkSession, arr: float, costs: float, cash: float, growth: dict[str, float], months: int, cost_growth: float = 0.0) -> DataFrame:
    """Monthly recurring revenue path of each growth scenario in closed form: revenue, burn and cash."""
    rows = spark.createDataFrame([(k, float(g)) for k, g in growth.items()], "scenario string, g double")
    out = rows.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(months))))
    out = out.withColumn("arr", F.round(arr * F.pow(1 + F.col("g"), "month"), 2))
    out = out.withColumn("net_burn", F.round(costs * F.pow(F.lit(1 + cost_growth), F.col("month")) - F.col("arr") / 12, 2))
    spent = F.sum("net_burn").over(Window.partitionBy("scenario").orderBy("month"))
    return out.withColumn("cash", F.round(cash - spent, 2)).withColumn("profitable", F.col("net_burn") <= 0)


def forecast_summary(path: DataFrame) -> DataFrame:
    """First profitable month and the month in which cash is gone, null if never; cash needed until profit."""
    return path.groupBy("scenario").agg(
        F.min(F.when(F.col("profitable"), F.col("month"))).alias("first_profitable_month"),
        F.min(F.when(F.col("cash") < 0, F.col("month"))).alias("runway_month"),
        F.round(F.sum(F.when(F.col("net_burn") > 0, F.col("net_burn")).otherwise(0)), 2).alias("cash_until_profit"),
    )


def saas_metrics(new: Column, expansion: Column, churn: Column, contraction: Column, start: Column) -> dict[str, Column]:
    return {
        "net_new": new + expansion - churn - contraction,
        "quick_ratio": F.coalesce(F.try_divide(new + expansion, churn + contraction), F.lit(0.0)),
        "gross_retention": F.coalesce(F.try_divide(start - churn - contraction, start), F.lit(0.0)),
        "net_retention": F.coalesce(F.try_divide(start + expansion - churn - contraction, start), F.lit(0.0)),
    }


def ratios(assets: Column, liabilities: Column, revenue: Column, income: Column, equity: Column) -> dict[str, Column]:
    """Common financial ratios; null where the divisor is 0."""
    return {"current_ratio": F.try_divide(assets, liabilities), "debt_to_equity": F.try_divide(liabilities, equity), "net_margin": F.try_divide(income, revenue), "return_on_equity": F.try_divide(income, equity), "return_on_assets": F.try_divide(income, assets)}


def training_cost(df: DataFrame, rates: DataFrame, hardware: str, hours: str) -> DataFrame:
    """Hours times the hourly rate of the hardware (``hardware, rate``)."""
    return df.join(rates.withColumnRenamed("hardware", hardware), hardware, "left").withColumn("cost", F.round(F.col(hours) * F.col("rate"), 2))


#: What to try first for an assumption of a category; our own wording.
TESTS = {"desirability": "customer interviews", "viability": "pricing test", "feasibility": "technical spike", "usability": "prototype session"}


def risk_priority(risk: Column, certainty: Column) -> Column:
    return risk * (1 - certainty)


def suggested_test(category: Column) -> Column:
    out = F.lit("small experiment")
    for name, test in TESTS.items():
        out = F.when(F.lower(F.trim(category)) == name, test).otherwise(out)
    return out


def outcome_counts(df: DataFrame, keys: Sequence[str], state: Column) -> DataFrame:
    """``n_success, n_error, n_skipped`` and the success rate over what was not skipped, of each key."""
    ok, bad, skipped = (F.count_if(state == s) for s in ("success", "error", "skipped"))
    return df.groupBy(*keys).agg(ok.alias("n_success"), bad.alias("n_error"), skipped.alias("n_skipped"), success_rate(ok, bad).alias("success_rate"))


def gated(df: DataFrame, keys: Sequence[str], score: str, passed: Column, min_mean: float | None = None, min_pass_rate: float | None = None) -> DataFrame:
    """``mean_score, pass_rate, n, ok`` of each experiment: it is ok where it reaches every bound that is set. No items: not ok."""
    out = df.groupBy(*keys).agg(F.avg(score).alias("mean_score"), F.avg(passed.cast("int")).alias("pass_rate"), F.count("*").alias("n"))
    ok = F.col("n") > 0
    for column, bound in (("mean_score", min_mean), ("pass_rate", min_pass_rate)):
        if bound is not None:
            ok = ok & F.coalesce(F.col(column) >= bound, F.lit(False))
    return out.withColumn("ok", ok)


def success_rate(ok: Column, failed: Column) -> Column:
    return F.coalesce(F.try_divide(ok.cast("double"), ok + failed), F.lit(0.0))


def signed_share(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Positive and negative weight over all absolute weight of each key."""
    total = F.sum(F.abs(F.col(weight)))
    return df.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(F.greatest(F.col(weight), F.lit(0))), total), F.lit(0.0)).alias("positive_share"), F.coalesce(F.try_divide(F.sum(F.least(F.col(weight), F.lit(0))), total), F.lit(0.0)).alias("negative_share"))


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, buckets: int = 4096) -> DataFrame:
    """``keys, value, n, before, total``: each distinct value with its count, the count of smaller ones, and of all.

    Equal values are one row first. Running counts come in two levels: values fall
    into ranges of equal width, whose few totals are summed first, then each range
    on its own, so that a hot key is spread over tasks.
    """
    rows = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ends = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("n").alias("total"))
    rows = rows.join(ends, list(keys)) if keys else rows.join(F.broadcast(ends))
    share = F.coalesce(F.try_divide((F.col(value) - F.col("_lo")).cast("double"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    rows = rows.withColumn("_b", F.floor(share * (buckets - 1)).cast("int"))
    tops = rows.groupBy(*keys, "_b").agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    return rows.join(tops, [*keys, "_b"]).select(*keys, value, "n", (F.col("_before") + F.col("_inner")).alias("before"), "total")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Interpolated quantiles of each key by name, exact, without gathering a key's values in one row."""
    ranked = ranked_values(df, keys, value)
    aggs = []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("total") - 1)
        low, high = F.floor(place), F.ceil(place)

        def at(i: Column) -> Column:
            return F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col(value).cast("double")))

        part = F.max(place - low)
        aggs.append((at(low) + (at(high) - at(low)) * part).alias(name))
    return ranked.groupBy(*keys).agg(*aggs)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.95, few: int = 5) -> DataFrame:
    """Median, and the value at index ``int(n * share)`` in order (the largest below ``few`` values).

    Ranks come from running counts, so no key's values are gathered in one row or task.
    """
    ranked = ranked_values(df, keys, value)
    i = F.least(F.floor(F.col("total") * share), F.col("total") - 1)
    hit = (F.col("before") <= i) & (i < F.col("before") + F.col("n"))
    at = ranked.groupBy(*keys).agg(F.max("total").alias("n"), F.max(value).alias("_largest"), F.max(F.when(hit, F.col(value))).alias("_at"))
    at = at.join(exact_quantiles(df, keys, value, {"p50": 0.5}), list(keys)) if keys else at.join(F.broadcast(exact_quantiles(df, keys, value, {"p50": 0.5})))
    return at.select(*keys, "n", "p50", F.when(F.col("n") < few, F.col("_largest")).otherwise(F.col("_at")).alias("p95"))


def recency_score(day: Column, today: Column, max_days: int = 30) -> Column:
    """100 for today or later, falling to 0 at ``max_days``; whole numbers, cut; 0 without a date."""
    age = F.datediff(today, day)
    return F.when(day.isNull(), 0).when(age < 0, 100).when(age >= max_days, 0).otherwise(F.floor(100 * (1 - age / F.lit(float(max_days))))).cast("int")


def date_confidence(day: Column, start: str, end: str) -> Column:
    return F.when(day.between(start, end), "high").otherwise("low")


def parse_date(text: Column) -> Column:
    """Unix seconds first, then five ISO forms; offsets are read as if they were UTC."""
    t = F.trim(text)
    number = F.when(t.rlike(r"^[+-]?\d+(\.\d+)?$"), F.timestamp_seconds(t.try_cast("double")))
    offset = r"(?:Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)"
    day = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(t, F.lit("y-M-d")))
    moment = F.when(t.rlike(rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}T\d{{1,2}}:\d{{1,2}}:\d{{1,2}}(?:\.\d{{1,6}}{offset}|{offset})?$"), F.try_to_timestamp(F.regexp_substr(t, F.lit(r"^[^T]+T[0-9:]+")), F.lit("y-M-d'T'H:m:s")))
    fraction = F.rpad(F.regexp_extract(t, r"T[0-9:]+\.(\d{1,6})", 1), 6, "0").try_cast("long")
    return F.coalesce(number, day, F.timestamp_micros(F.unix_micros(moment) + F.coalesce(fraction, F.lit(0))))


def epoch_date(seconds: Column) -> Column:
    """The UTC day of Unix seconds as ISO text."""
    return F.date_format(F.to_date(F.timestamp_seconds(seconds)), "yyyy-MM-dd")


def score_badge(score: Column) -> Column:
    """Bands at 80, 65, 50 and 35."""
    return F.when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").when(score >= 35, "D").otherwise("E")


def cell_quality(counts: DataFrame, cell: str = "cell", gene: str = "gene", n: str = "count", min_genes: int = 200, max_genes: int = 5000, max_mito: float = 20.0, min_cells: int = 3, mito_prefix: str = "MT-") -> DataFrame:
    """Long sparse counts without poor cells, then without rare genes."""
    some = counts.filter(F.col(n) > 0)
    cells = some.groupBy(cell).agg(F.count("*").alias("genes"), F.sum(n).alias("total"), F.sum(F.when(F.upper(gene).startswith(mito_prefix), F.col(n)).otherwise(0)).alias("mito"))
    good = cells.filter(F.col("genes").between(min_genes, max_genes) & (F.col("mito") * 100 < max_mito * F.col("total"))).select(cell)
    kept = some.join(good, cell, "left_semi")
    common = kept.groupBy(gene).agg(F.count("*").alias("c")).filter(F.col("c") >= min_cells).select(gene)
    return kept.join(common, gene, "left_semi")


def variable_genes(counts: DataFrame, n_cells: int, gene: str = "gene", n: str = "count", top: int = 2000) -> DataFrame:
    """The genes with the largest dispersion (variance over mean), cells without a count as zeros."""
    s = counts.groupBy(gene).agg(F.sum(n).alias("s"), F.sum(F.col(n) * F.col(n)).alias("q"))
    mean = F.col("s") / n_cells
    return s.withColumn("dispersion", (F.col("q") / n_cells - mean * mean) / mean).orderBy(F.desc("dispersion"), gene).limit(top)
