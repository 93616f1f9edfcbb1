"""Joins, argmax rows, latest rows, as-of lookup and other relational shapes as functions of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order that should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def above_group_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows above the mean of their group, with the difference in per cent. Means are grouped first, so a hot group is one row."""
    means = df.groupBy(key).agg(F.avg(value).alias("group_mean"))
    joined = df.join(means, key).filter(F.col(value) > F.col("group_mean"))
    return joined.withColumn("percent_above", (F.col(value) / F.col("group_mean") - 1) * 100)


def group_share(df: DataFrame, key: str, value: str, top: int, order_id: str) -> DataFrame:
    """Each group's total and share of all, and what its ``top`` rows hold of it."""
    ranked = top_per_group(df, [key], [F.desc(value), F.col(order_id)], top).groupBy(key).agg(F.sum(value).alias("top_total"))
    totals = df.groupBy(key).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    whole = totals.agg(F.sum("total").alias("whole"))
    return totals.join(ranked, key).join(F.broadcast(whole)).select(key, "n", "total", (F.col("total") / F.col("whole")).alias("share"), (F.col("top_total") / F.col("total")).alias("top_share"), (F.col("total") / F.col("n")).alias("per_row"))


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str, out: str) -> DataFrame:
    """For each left row the last right value of its key at or before its time.

    Both sides are one stream per key, ordered by time with right rows first at
    equal times; the last value is carried along. One shuffle, no range join.
    """
    a = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(key, time, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = Window.partitionBy(key).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(out, F.last("_v", ignorenulls=True).over(w))
    return both.filter("_side = 1").drop("_side", "_v")


def forward_fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def rolling(df: DataFrame, keys: Sequence[str], seconds: Column, width: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over the last ``width`` seconds of each key, the row itself included."""
    timed = df.withColumn("_s", seconds)
    w = Window.partitionBy(*keys).orderBy("_s").rangeBetween(-width, 0)
    return timed.withColumns({n: a.over(w) for n, a in aggregates.items()}).drop("_s")


def broadcast_checked(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """The broadcast hint, if a count that stops beyond ``max_rows`` finds no more rows; else the rows as they are."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def child_count(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, out: str = "n_children") -> DataFrame:
    """Parents with the number of their children, 0 included; children are counted before the join."""
    n = child.groupBy(F.col(child_key).alias(parent_key)).agg(F.count("*").alias(out))
    return parent.join(n, parent_key, "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def with_alias(df: DataFrame, aliases: DataFrame, column: str, out: str) -> DataFrame:
    """Canonical name by an alias table (``alias, canonical``), else the lower-cased trimmed name itself."""
    plain = F.lower(F.trim(F.col(column)))
    a = aliases.select(F.lower(F.trim("alias")).alias("_alias"), "canonical").dropDuplicates(["_alias"])
    return df.join(a, plain == F.col("_alias"), "left").withColumn(out, F.coalesce("canonical", plain)).drop("_alias", "canonical")


def field_map(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Exactly the given outputs: literals, paths into structs, or expressions."""
    return df.select(*[c.alias(n) for n, c in fields.items()])


def required_path(path: str) -> Column:
    """A path into structs that must have a value: a row without one is an error when it is read."""
    return F.coalesce(F.col(path), F.raise_error(F.lit(f"missing: {path}")))


def without_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All columns but these; a name that is not there is an error, since a typing mistake would let a column through."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.drop(*names)


def reshaped(df: DataFrame, renames: dict[str, str], defaults: dict[str, Column], nested: dict[str, Sequence[str]]) -> DataFrame:
    """Columns renamed, nulls filled, then groups of columns nested as structs."""
    out = df.withColumnsRenamed(renames)
    out = out.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})
    inner = {c for names in nested.values() for c in names}
    return out.select(*[c for c in out.columns if c not in inner], *[F.struct(*names).alias(n) for n, names in nested.items()])


def apply_when(df: DataFrame, condition: Column, column: str, change: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn(column, F.when(condition, change(F.col(column))).otherwise(F.col(column)))


def all_branches(branches: Sequence[tuple[Column, Column]]) -> Column:
    """Every branch whose condition holds gives its value, others null, in order."""
    return F.array(*[F.when(c, v) for c, v in branches])


def repeat_until(df: DataFrame, step: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame], bool], cut: Callable[[DataFrame], DataFrame], max_rounds: int = 100) -> DataFrame:
    """Apply a step until a condition holds; ``cut`` writes each round so that the plan does not grow."""
    for _ in range(max_rounds):
        df = cut(step(df))
        if done(df):
            return df
    raise RuntimeError(f"not done after {max_rounds} rounds")


def in_date_range(df: DataFrame, column: str, start: str | None, end: str | None, require_date: bool = False) -> DataFrame:
    """ISO dates as text, bounds included; rows without a date stay unless one is required."""
    d = F.col(column)
    ok = (F.lit(True) if start is None else d >= start) & (F.lit(True) if end is None else d <= end)
    return df.filter((d.isNull() & F.lit(not require_date)) | (d.isNotNull() & ok))


def within_hours(df: DataFrame, ts: str, hours: float, anchor: Column, limit: int | None = None) -> DataFrame:
    """Look-back: rows of the last ``hours`` before the anchor, newest first; the limit is the feature."""
    age = F.unix_micros(anchor.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    out = df.filter((age >= 0) & (age <= int(hours * 3_600_000_000)))
    return out if limit is None else out.orderBy(F.desc(ts)).limit(limit)


def metadata_equals(metadata: str, wanted: dict[str, str]) -> Column:
    """All wanted entries are there and equal; no metadata is no match."""
    m = F.col(metadata)
    out = m.isNotNull()
    for k, v in wanted.items():
        out = out & F.coalesce(F.try_element_at(m, F.lit(k)) == v, F.lit(False))
    return out


def hash_share(key: str) -> Column:
    """A number in [0, 1) from the MD5 of a key: the same at every run, in every engine."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)


def hash_sample(df: DataFrame, key: str, rate: float) -> DataFrame:
    """Always, never, or a share of the rows, the same ones at every run. Sampling is the feature."""
    if rate <= 0:
        return df.filter(F.lit(False))
    return df if rate >= 1 else df.filter(hash_share(key) < rate)


def bounded_sample(df: DataFrame, key: str, n: int, max_n: int = 10_000) -> DataFrame:
    """At most ``n`` rows by the order of hashed keys. The limit is the feature."""
    return df.orderBy(F.md5(F.col(key).cast("string").cast("binary")), key).limit(max(0, min(n, max_n)))


def union_distinct(parts: Sequence[tuple[str, DataFrame]], key: Column) -> DataFrame:
    """Rows of several sources with their source's name; of rows with one key the earliest source's first stays.

    Repeats go inside each source first, so a hot key is a row a source by then.
    """
    every = None
    for place, (name, df) in enumerate(parts):
        once = df.withColumn("_key", key).dropDuplicates(["_key"]).withColumns({"source": F.lit(name), "_place": F.lit(place)})
        every = once if every is None else every.unionByName(once)
    return latest_per_key(every, ["_key"], [F.col("_place")]).drop("_key", "_place")


def live_entries(accesses: DataFrame, key: str, at: str, now: Column, ttl_s: int, capacity: int) -> DataFrame:
    """What a cache of ``capacity`` entries that live ``ttl_s`` seconds after their last use holds: ``key, last_used``."""
    last = accesses.groupBy(key).agg(F.max(F.col(at)).alias("last_used"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_used").cast("timestamp"))
    return last.filter((age >= 0) & (age < ttl_s * 1_000_000)).orderBy(F.desc("last_used"), key).limit(capacity)


def with_next_ids(base: DataFrame, new: DataFrame, item_id: str, order: Sequence[str]) -> DataFrame:
    """New rows numbered on from the largest id of the base, in order.

    Numbers come from row counts of ordered partitions, so no task sees all rows.
    """
    top = base.agg(F.coalesce(F.max(item_id), F.lit(-1)).cast("long")).first()[0]
    ordered = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    parts = ordered.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = parts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = ordered.join(F.broadcast(starts), "_part")
    return out.withColumn(item_id, (F.lit(top + 1) + F.col("_before") + F.col("_row") - F.col("_first")).cast("long")).drop("_part", "_row", "_first", "_before")


def ordered_distinct(column: Column) -> Column:
    """Trimmed, without empty strings, each kept where it first stands."""
    return F.array_distinct(F.filter(F.transform(column, lambda x: F.trim(x)), lambda x: x != ""))


def collect_ordered(df: DataFrame, keys: Sequence[str], order: Column, value: Column, out: str) -> DataFrame:
    """Values of each key as a list in order."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"]).alias(out))


def custom_order(df: DataFrame, category: str, order: dict[str, int], sub: str | None = None, sub_order: dict[str, dict[str, int]] | None = None, name: str = "name") -> DataFrame:
    """Sort by the rank of the category, of the sub-category, then by lower-cased name.

    Ranks of what is missing: category 999; sub-category 999 if empty, 998 if
    unknown, 997 if its category has no order.
    """
    rank = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))]), F.col(category)), F.lit(999)) if order else F.lit(999)
    second = F.lit(0)
    if sub is not None:
        second = F.lit(997)
        for cat, ranks in (sub_order or {}).items():
            inner = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))]), F.col(sub)), F.lit(998)) if ranks else F.lit(998)
            second = F.when(F.col(category) == cat, inner).otherwise(second)
        second = F.when(F.coalesce(F.col(sub), F.lit("")) == "", 999).otherwise(second)
    return df.withColumn("category_rank", rank).withColumn("sub_rank", second).orderBy("category_rank", "sub_rank", F.lower(name))


def snapshot_delta(current: DataFrame, previous: DataFrame, key: str, value: str) -> DataFrame:
    """Current minus previous; a key that a non-empty previous snapshot lacks counts in full, an empty one gives 0."""
    before = previous.select(key, F.col(value).alias("_before"))
    some = previous.agg((F.count("*") > 0).alias("_some"))
    out = current.join(before, key, "left").join(F.broadcast(some))
    return out.withColumn("delta", F.when(F.col("_some"), F.col(value) - F.coalesce("_before", F.lit(0))).otherwise(F.lit(0))).drop("_before", "_some")


def merge_maps(defaults: Column, overrides: Column) -> Column:
    """The later map wins."""
    kept = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(overrides, k))
    return F.map_concat(kept, overrides)


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Base rows replaced or joined by changes, the newest change of each key; applying it twice changes nothing."""
    newest = latest_per_key(changes, keys, order)
    return base.join(newest.select(*keys), list(keys), "left_anti").unionByName(newest)


def scd2(df: DataFrame, key: str, at: str, attributes: Sequence[str]) -> DataFrame:
    """History rows ``valid_from, valid_to, is_current``: one for each run of equal attributes of a key."""
    w = Window.partitionBy(key).orderBy(at)
    state = F.struct(*attributes)
    runs = df.withColumn("_before", F.lag(state).over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | ~state.eqNullSafe(F.col("_before")))
    return runs.select(key, *attributes, F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to")).withColumn("is_current", F.col("valid_to").isNull())


def newer_than(df: DataFrame, column: str, mark) -> DataFrame:
    """Incremental load: rows past the high-water mark, all of them if there is none."""
    return df if mark is None else df.filter(F.col(column) > F.lit(mark))


def version_key(column: Column) -> Column:
    """Dotted version numbers as an array that sorts by number; other parts count as 0."""
    return F.transform(F.split(column, r"\."), lambda p: F.coalesce(F.try_to_number(F.regexp_extract(p, r"(\d+)", 1), F.lit("999999999")).cast("long"), F.lit(0).cast("long")))
