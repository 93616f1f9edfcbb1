"""Exact copies and near-duplicate pairs by character n-grams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import near_sets as N


def exact_groups(df: DataFrame, key: Column, item_id: str) -> DataFrame:
    """Groups of equal keys: size and smallest id."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(item_id).alias("first_id"))


def drop_exact(df: DataFrame, key: Column, item_id: str) -> DataFrame:
    """The row with the smallest id of each key. Only ids and hashes are grouped; texts stay where they are."""
    stay = df.groupBy(F.sha2(key.cast("binary"), 256).alias("_k")).agg(F.min(item_id).alias(item_id)).select(item_id)
    return df.join(stay, item_id, "left_semi")


def similar_pairs(df: DataFrame, item_id: str, text: str, threshold: float = 0.8, n: int = 3) -> DataFrame:
    """``a, b, similarity`` of items whose n-gram sets have Jaccard similarity of at least ``threshold``.

    Equal sets are one item here, so a group of copies does not multiply; all
    others meet in blocks, see ``near_sets``.
    """
    sets = N.gram_sets(df, item_id, T.comparable(F.col(text)), n).filter(F.col("g").isNotNull())
    return N.near(sets.groupBy("key").agg(F.min("id").alias("id"), F.first("score").alias("score"), F.first("g").alias("g")), threshold)


def drop_near(df: DataFrame, item_id: str, text: str, score: str, threshold: float = 0.7, n: int = 3) -> DataFrame:
    """Rows that lose to no similar row. Within a class of equal n-gram sets the best score, then the smallest id, stays.

    All pairs of classes count, whatever else is dropped: the lower score loses,
    at equal ones the class with the larger smallest id. Pairs stay in their
    tasks; only the losers leave them.
    """
    sets = N.gram_sets(df, item_id, T.comparable(F.col(text)), n, score)
    first = sets.groupBy("key").agg(F.min("id").alias("class_id"))
    w = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    best = sets.withColumn("_r", F.row_number().over(w)).filter("_r = 1").withColumnRenamed("id", "best_id").join(first, "key")
    lost = N.near(best.filter(F.col("g").isNotNull()).select(F.col("class_id").alias("id"), "score", "key", "g"), threshold, losers=True)
    stay = best.select("class_id", "best_id").join(lost.withColumnRenamed("id", "class_id"), "class_id", "left_anti").select(F.col("best_id").alias(item_id))
    return df.join(stay, item_id, "left_semi")


def jaro_winkler(a: Column, b: Column, boost_above: float = 0.7, scale: float = 0.1, prefix: int = 4) -> Column:
    """Byte-wise Jaro similarity, raised for a common prefix where it is above a bound; two empty texts are alike."""
    def jaro(x: bytes, y: bytes) -> float:
        if not x and not y:
            return 1.0
        if not x or not y:
            return 0.0
        reach = max(max(len(x), len(y)) // 2 - 1, 0)
        taken, mine = [False] * len(y), []
        for i, c in enumerate(x):
            for j in range(max(0, i - reach), min(len(y), i + reach + 1)):
                if not taken[j] and y[j] == c:
                    taken[j] = True
                    mine.append(c)
                    break
        if not mine:
            return 0.0
        theirs = [c for c, t in zip(y, taken) if t]
        swapped = sum(p != q for p, q in zip(mine, theirs)) / 2
        m = len(mine)
        return (m / len(x) + m / len(y) + (m - swapped) / m) / 3

    @F.pandas_udf("double")
    def run(p: pd.Series, q: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(p, q):
            x, y = (s or "").encode(), (t or "").encode()
            v = jaro(x, y)
            if v > boost_above:
                n = 0
                while n < min(prefix, len(x), len(y)) and x[n] == y[n]:
                    n += 1
                v += n * scale * (1 - v)
            out.append(v)
        return pd.Series(out)

    return run(a, b)


def best_match(words: DataFrame, candidates: list[str], column: str) -> DataFrame:
    """The most similar of a short list of candidates, the first of equals."""
    rows = words.withColumn("candidate", F.explode(F.array(*map(F.lit, candidates)))).withColumn("similarity", jaro_winkler(F.col(column), F.col("candidate")))
    order = F.array_position(F.array(*map(F.lit, candidates)), F.col("candidate"))
    return rows.groupBy(column).agg(F.max_by(F.struct("candidate", "similarity"), F.struct(F.col("similarity"), -order)).alias("m")).select(column, "m.*")
