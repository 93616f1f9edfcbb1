"""Data quality: profiles, scores, outliers, imputing, constraints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.analytics import exact_quantiles

#: Weights of the dimensions of the quality score, and the lower bounds of its bands.
WEIGHTS = {"completeness": 0.30, "consistency": 0.25, "validity": 0.20, "uniqueness": 0.15, "timeliness": 0.10}
BANDS = ((85, "good"), (65, "fair"))
SENTINELS = ["", "n/a", "na", "null", "none", "nan", "-", "?", "unknown", "-999", "9999"]


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, n_rows, n_null, n_distinct`` of all columns in one pass.

    Each row becomes one row a column, counted by value in the map tasks, so a
    column's frequent values do not multiply and no distinct set is held in one task.
    """
    columns = list(columns or df.columns)
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])
    values = df.select(F.inline(cells)).groupBy("i", "v").agg(F.count("*").alias("n"))
    sums = values.groupBy("i").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count("v").alias("n_distinct"))
    names = F.array(*map(F.lit, columns))
    return sums.select(F.get(names, F.col("i")).alias("column_name"), "n_rows", "n_null", "n_distinct")


def quality_score(dimensions: dict[str, Column]) -> Column:
    """0 to 100, from dimensions in 0 to 1."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + weight * dimensions[name]
    return total * 100


def band(score: Column) -> Column:
    return F.when(score >= BANDS[0][0], BANDS[0][1]).when(score >= BANDS[1][0], BANDS[1][1]).otherwise("poor")


def _meet(df: DataFrame, figures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the figures of their group, one row a group."""
    return df.join(figures, list(keys)) if keys else df.join(F.broadcast(figures))


def with_iqr_outliers(df: DataFrame, keys: Sequence[str], value: str, factor: float = 1.5) -> DataFrame:
    out = _meet(df, exact_quantiles(df, keys, value, {"q1": 0.25, "q3": 0.75}), keys)
    width = F.col("q3") - F.col("q1")
    return out.withColumn("outlier", (F.col(value) < F.col("q1") - factor * width) | (F.col(value) > F.col("q3") + factor * width))


def with_z_scores(df: DataFrame, keys: Sequence[str], value: str, limit: float = 3.0) -> DataFrame:
    """``z``, and whether it is an outlier: beyond ``limit`` either way."""
    out = _meet(df, df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s")), keys)
    z = F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))
    return out.withColumn("z", z).withColumn("z_outlier", F.coalesce(F.abs("z") > limit, F.lit(False))).drop("_m", "_s")


def with_modified_z(df: DataFrame, keys: Sequence[str], value: str, limit: float = 3.5) -> DataFrame:
    """0.6745 |x - median| / MAD, null where the MAD is 0; and whether it is beyond ``limit``."""
    first = _meet(df, exact_quantiles(df, keys, value, {"_med": 0.5}), keys).withColumn("_gap", F.abs(F.col(value) - F.col("_med")))
    both = _meet(first, exact_quantiles(first, keys, "_gap", {"_mad": 0.5}), keys)
    out = both.withColumn("modified_z", F.try_divide(0.6745 * F.col("_gap"), F.col("_mad")))
    return out.withColumn("z_outlier", F.coalesce(F.col("modified_z") > limit, F.lit(False))).drop("_med", "_mad", "_gap")


def imputed(df: DataFrame, column: str, how: str, keys: Sequence[str] = ()) -> DataFrame:
    """Nulls filled by mean, median or mode (the smallest of the most frequent) of the group, with an indicator."""
    if how == "mode":
        n = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n"))
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("_n"), column)
        fill = n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*keys, F.col(column).alias("_fill"))
    elif how == "median":
        fill = exact_quantiles(df, keys, column, {"_fill": 0.5})
    else:
        fill = df.groupBy(*keys).agg(F.avg(column).alias("_fill"))
    out = df.join(fill, list(keys), "left") if keys else df.join(F.broadcast(fill), how="left")
    return out.withColumn(f"{column}_missing", F.col(column).isNull()).withColumn(column, F.coalesce(column, "_fill")).drop("_fill")


def without_sparse_columns(df: DataFrame, max_null: float = 0.5) -> DataFrame:
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if (shares[c] or 0) <= max_null])


def silent_failures(text: Column) -> dict[str, Column]:
    """Counts of sentinels, outer spaces and numbers kept as text."""
    t = F.lower(F.trim(text))
    return {"n_sentinel": F.count_if(t.isin(SENTINELS)), "n_outer_space": F.count_if(text != F.trim(text)), "n_numeric_text": F.count_if(t.rlike(r"^[+-]?\d+(\.\d+)?$"))}


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def quarantined(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds the names of the broken rules; a rule that is null is broken. Rows without any are valid."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("broken_rules", broken)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missing_fields(df: DataFrame, required: Sequence[str]) -> Column:
    """Names of required columns that are null or blank in a row."""
    return F.filter(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in required]), lambda x: x.isNotNull())


def freshness(df: DataFrame, ts: str, now: Column, warn_hours: float = 12, error_hours: float = 24, by: Sequence[str] = ()) -> DataFrame:
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.max(ts).cast("timestamp"))) / 3600
    return df.groupBy(*by).agg(age.alias("age_hours")).withColumn("state", F.when(F.col("age_hours").isNull() | (F.col("age_hours") >= error_hours), "error").when(F.col("age_hours") >= warn_hours, "warn").otherwise("ok"))


def timely_share(ts: Column, now: Column, hours: float) -> Column:
    """Share of rows not older than ``hours``; rows without a time are not timely."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))
    return F.avg(F.coalesce((age >= 0) & (age <= int(hours * 3_600_000_000)), F.lit(False)).cast("int"))


def schema_lint(columns: Sequence[tuple[str, str]], keys: Sequence[str] = (), indexed: Sequence[str] | None = None) -> list[str]:
    """Remarks on names and key columns of a table; on the driver, over the schema only.

    With ``indexed``, keys to other tables (``_id`` at the end) that no index has are named.
    """
    import re

    out = [f"{c}: not snake case" for c, _ in columns if not re.fullmatch(r"[a-z][a-z0-9_]*", c)]
    names = [c for c, _ in columns]
    if not any(c == "id" or c.endswith(("_id", "key")) for c in names):
        out.append("no key column")
    if not any(c in {"created_at", "createdat", "loaded_at"} for c in map(str.lower, names)):
        out.append("no creation time")
    if indexed is not None:
        out += [f"{c}: a foreign key without an index" for c in names if c.endswith("_id") and c not in indexed and c not in keys]
    return out + [f"{k}: not a column" for k in keys if k not in names]
