"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Documents are encoded once and the histogram is written; from then on only
``(length, number of documents)`` counts, one row for each distinct length.
Suffix sums over the histogram answer for every context limit how many documents
and tokens stay, how many are cut, and what a truncated corpus holds, exactly.

Suffix sums run in two levels: lengths fall into buckets by the whole part of
their square root, so lengths up to n make about sqrt(n) buckets of at most
2 sqrt(n) + 1 lengths. The bucket totals are summed over those few rows, and
each bucket is summed on its own.

Defined results: null and empty texts have length 0 and are counted. Very long
texts are one more length. No rows give no histogram. Repeated rows count each
time. Only the text is read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.bpe_automaton import default_path, token_lengths
from quern.llm.common import documents, written


def histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """``n_tokens, n_docs``: one written row for each distinct length."""
    return written(lengths.groupBy(F.col(column).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs")), "token-histogram")


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length as a limit: documents and tokens up to it, beyond it, and in the corpus truncated to it."""
    rows = hist.withColumn("bucket", F.floor(F.sqrt("n_tokens"))).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    tops = tops.select("bucket", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"))
    whole = hist.agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("all_tokens"))
    within = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = (
        rows.withColumn("docs_inner", F.coalesce(F.sum("n_docs").over(within), F.lit(0)))
        .withColumn("tokens_inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
        .join(F.broadcast(tops), "bucket")  # at most the square root of the longest length
        .join(F.broadcast(whole))  # one row
    )
    over, beyond = F.col("docs_after") + F.col("docs_inner"), F.col("tokens_after") + F.col("tokens_inner")
    return out.select(
        "n_tokens",
        "n_docs",
        (F.col("docs") - over).alias("docs_up_to"),
        (F.col("all_tokens") - beyond).alias("tokens_up_to"),
        over.alias("docs_over"),
        beyond.alias("tokens_over"),
        (F.col("all_tokens") - beyond + over * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("docs") - over) / F.col("docs")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Truncated totals at any limits, whether or not a document has that length."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context long")
    total = F.max(F.col("docs_up_to") + F.col("docs_over"))
    best = sums.join(F.broadcast(asked), F.col("n_tokens") <= F.col("context"), "right").groupBy("context").agg(F.max_by(F.struct("docs_up_to", "tokens_up_to", "docs_over"), "n_tokens").alias("b"), total.alias("total"))
    all_docs = sums.agg(total.alias("docs"))
    out = best.join(F.broadcast(all_docs))
    docs = F.coalesce(F.col("b.docs_up_to"), F.lit(0))
    over = F.coalesce(F.col("b.docs_over"), F.col("docs"), F.lit(0))
    return out.select("context", docs.alias("docs_whole"), over.alias("docs_cut"), (F.coalesce(F.col("b.tokens_up_to"), F.lit(0)) + over * F.col("context")).alias("truncated_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that at least a share of the documents does not exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return sums.join(F.broadcast(asked), F.col("quantile") >= F.col("share") - 1e-12).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(histogram(token_lengths(documents(spark, sf_dir), default_path())))
