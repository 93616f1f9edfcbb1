"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept; its result is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of the documents.

1. ``language_id``: documents that the language model of the corpus rejects go.
2. ``near_dedup``: one document of each component of near copies stays, the one
   with the smallest id. Near copies have five-word shingles of Jaccard similarity
   0.8 or more. Candidates come by op6's method with wider fingerprints and a wider
   radius, whole sets decide; three differing SimHash bits are the rule of op6 alone.
3. ``decontaminate``: documents that hold a whole window of a benchmark item
   (eight words or more in a row) go.
4. ``secrets``: spans of secrets are replaced by a mark; no document goes.
5. ``bpe``: token ids of each whole text, and whether decoding gives it back.

Null and empty texts go in the first stage, since nothing tells their language.
Every stage takes an empty table, repeated rows and further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe_automaton, decontaminate, language_id, near_texts, secrets, simhash_dedup
from quern.llm.common import WRITTEN, columns, documents, given_back, keyed, row_key, without, written

KEY = ["none", "id", "digest"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = language_id.identify(docs, docs, {"key": F.struct(*row_key("doc_id"))}, host=F.col("source"), markup=F.col("text"))
    rejected = written(judged.filter(~F.col("accepted")).select("key.*"), "pipeline-rejected")
    return without(keyed(docs), rejected).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.one_of_each(docs, rows=near_texts.near_texts(docs))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, window: int = 8) -> DataFrame:
    scanned = decontaminate.scan(docs, documents(spark, sf_dir, "benchmark"), [F.struct(*columns(docs)).alias("doc")], window=window)
    return scanned.filter(~F.exists("spans", lambda s: s["n_words"] >= window)).select("doc.*")


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = keyed(docs)
    found = secrets.scan(rows.select(*KEY, F.col("row.text").alias("text")), [F.struct(*KEY).alias("key")])
    found = written(found.filter(F.size("found") > 0).dropDuplicates(["key"]).select("key.*", "found"), "pipeline-secrets")
    # A merge join at every size: texts are shuffled once, in proportion to the input.
    joined = rows.join(found.hint("merge"), KEY, "left").withColumn("clean", F.when(F.col("found").isNotNull(), secrets.redacted(F.col("row.text"), F.col("found"))).otherwise(F.col("row.text")))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("found").isNotNull(), F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return joined.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_automaton.digests(bpe_automaton.encode_decode(docs, bpe_automaton.default_path()), keep=["ids"])


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]

#: No SQL: shingle sets, the language model and the automaton are not expressible. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what only earlier stages read is deleted as soon as the next table is written."""
    docs, held = documents(spark, sf_dir), []
    for k, (name, stage) in enumerate(STAGES):
        before = set(WRITTEN)
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
            given_back(spark, [*held, *(p for p in WRITTEN[:-1] if p not in before)])
            held = WRITTEN[-1:]
    return docs
