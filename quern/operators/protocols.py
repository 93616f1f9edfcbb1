"""Extension points as protocols over DataFrames: scorers, retrievers, vector stores, chunkers as table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import chunking as C
from quern.operators import relational as R
from quern.operators import search as X


def _texts(metadata: dict[str, Column]) -> Column:
    if not metadata:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))])


@dataclass(frozen=True)
class Scorer:
    """Prepare a value, score it, give a reason: three column functions.

    The result is a struct ``status, score, metadata``. A row whose score is null
    has the status ``error`` and no score. Metadata of the scorer, the score and
    the reason are merged, later ones win.
    """

    name: str
    prepare: Column
    score: Callable[[Column], Column]
    reason: Callable[[Column, Column], Column] | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    score_metadata: dict[str, Column] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        rows = df.withColumn("_value", self.prepare).withColumn("_score", self.score(F.col("_value")).cast("double"))
        merged = R.merge_maps(_texts({k: F.lit(v) for k, v in self.metadata.items()}), _texts(self.score_metadata))
        if self.reason is not None:
            merged = R.merge_maps(merged, F.create_map(F.lit("reason"), self.reason(F.col("_value"), F.col("_score")).cast("string")))
        status = F.when(F.col("_score").isNull(), "error").otherwise("success")
        return rows.withColumn(self.name, F.struct(status.alias("status"), F.col("_score").alias("score"), merged.alias("metadata"))).drop("_value", "_score")


def weighted(scores: dict[str, float]) -> Column:
    """Weighted mean of scorers' results by name, over those that succeeded; null if none did."""
    above, below = F.lit(0.0), F.lit(0.0)
    for name, weight in scores.items():
        ok = F.col(f"{name}.status") == "success"
        above, below = above + F.when(ok, F.col(f"{name}.score") * weight).otherwise(0.0), below + F.when(ok, weight).otherwise(0.0)
    return F.try_divide(above, below)


class Retriever(Protocol):
    """Queries in, ``query_id, item, score, rank`` out."""

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame: ...


@dataclass(frozen=True)
class Bm25Retriever:
    """Queries ``query_id, query`` against the texts of documents."""

    documents: DataFrame
    doc_id: str = "doc_id"
    text: str = "text"

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return X.bm25_many(self.documents, queries, self.doc_id, self.text, k=k).select("query_id", F.col(self.doc_id).alias("item"), "score", "rank")


@dataclass(frozen=True)
class VectorRetriever:
    """Queries ``query_id, query`` (vectors) against the vectors of items."""

    items: DataFrame
    item_id: str
    vector: str

    def retrieve(self, queries: DataFrame, k: int = 10) -> DataFrame:
        asked = queries.select("query_id", F.col("query").alias(self.vector))
        return X.vector_search(self.items, asked, self.item_id, self.vector, "query_id", k).select("query_id", F.col(self.item_id).alias("item"), F.col("cos").alias("score"), "rank")


@dataclass(frozen=True)
class VectorStore:
    """Items with ids and vectors; ``added`` is a new store, whose ids go on from the largest."""

    items: DataFrame
    item_id: str
    vector: str
    text: str
    embed: Callable[[list[str]], list[Sequence[float]]]

    def added(self, new: DataFrame, order: Sequence[str], batch: int = 128) -> VectorStore:
        made = X.embedded(new, self.text, self.vector, self.embed, batch)
        numbered = R.with_next_ids(self.items, made, self.item_id, order)
        return VectorStore(self.items.unionByName(numbered.select(*self.items.columns)), self.item_id, self.vector, self.text, self.embed)

    def retriever(self) -> VectorRetriever:
        return VectorRetriever(self.items, self.item_id, self.vector)


def register_chunker(spark: SparkSession, name: str, how: str, **options) -> None:
    """A chunker as a table function in SQL: ``SELECT d.id, c.* FROM docs d, LATERAL name(d.text) c``."""
    fold = C.FOLDS[how]

    class Chunks:
        def eval(self, text: str) -> Iterator[tuple[int, str, int, int, int]]:
            for k, p in enumerate(fold(text or "", **options)):
                yield k, p.content, p.start, p.end, p.tokens

    spark.udtf.register(name, F.udtf(Chunks, returnType="chunk_index int, content string, start int, end int, tokens int"))


def never_failing(call: Callable[[object], object], kind: str) -> Callable[[Column], Column]:
    """A Python function on columns whose errors are nulls, so that one bad row does not end a job."""

    def safe(x):
        try:
            return None if x is None else call(x)
        except Exception:  # whatever an adapter raises
            return None

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(safe)

    return run
