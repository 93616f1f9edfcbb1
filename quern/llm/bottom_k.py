"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the ``k`` smallest distinct 63-bit hashes of a text's shingles of
five words. Sketches of parts merge into the sketch of the whole (``merged``),
and two sketches estimate resemblance, containment and the number of distinct
shingles.

The query also compares each document with an edited copy that borrows from the
next one in descending id order. Rows are dealt to ranges of ids, once, and the
first row of each range is also given to the range before it, so every task
reads its rows in order and holds two texts at a time.

Defined results: words are as elsewhere lower-cased for A-Z; a text of fewer
than five words is one shingle, a text without words (null, empty) has the empty
sketch. Two empty sketches are alike (1.0), an empty and another are not (0.0).
Rows of one id are ordered by a hash of the text, then by the text; a null id
comes last. A table of one row has itself as its next row; an empty table has no
rows. Very long texts are sketched whole. Other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Memo, documents, held, row_type, slices, text_digest, words_of

K = 64
SHINGLE = 5
SPACE = float(1 << 63)
NO_ID = -(1 << 63)


class _WordHash(Memo):
    """Hash of a word, kept for a bounded number of words of bounded length."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= self.KEY:
            self.make_room(1)
            self[word] = h
        return h


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """A 63-bit hash of each shingle, in order."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64)
    w = np.array(list(map(held("word-hashes", lambda: _WordHash(200_000)).__getitem__, words)), dtype=np.uint64)
    width = min(n, shingle)
    with np.errstate(over="ignore"):
        h = np.full(n - width + 1, width, dtype=np.uint64)
        for i in range(width):
            h = (h ^ w[i : n - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(1)).astype(np.int64)


def sketch(text: bytes, k: int = K, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both parts' shingles together."""
    return np.union1d(a, b)[:k]


def distinct(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(s)) if len(s) < k else (k - 1) * SPACE / float(s[-1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = merge(a, b, k)
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(both))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, shared / distinct(a, k))


def as_text(s: np.ndarray) -> str:
    """Sixteen hex digits for each hash, in ascending order."""
    return s.astype(">i8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), dtype=">i8").astype(np.int64)


def sketches(df: DataFrame, keep: list[str], text: str = "text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """The ``keep`` columns, ``sketch`` (array of long) and ``n_distinct`` (estimate) of each row; no shuffle."""
    rows = df.select(F.struct(*keep).alias("kept"), F.col(text).cast("string").alias("text"))
    kind = row_type({"kept": rows.schema["kept"].dataType}, "sketch array<bigint>, n_distinct double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = [sketch((t or "").encode(), k, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(made, pa.list_(pa.int64())), pa.array([distinct(s, k) for s in made])], ["kept", "sketch", "n_distinct"])

    return rows.mapInArrow(run, kind).select("kept.*", "sketch", "n_distinct")


def merged(parts: DataFrame, key: str, k: int = K, salts: int = 64, keys_held: int = 20_000) -> DataFrame:
    """``key, sketch``: the sketch of each key's parts together.

    A task first merges what it has of each key, so a hot key is one sketch a
    task, or one for each ``keys_held`` other keys; these meet in ``salts``
    groups, and the groups' sketches last.
    """
    kind = parts.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_sketches: dict = {}

        def out() -> pa.RecordBatch:
            rows = pa.array(list(held_sketches), key_type), pa.array(list(held_sketches.values()), pa.list_(pa.int64()))
            held_sketches.clear()
            return pa.RecordBatch.from_arrays(list(rows), ["key", "sketch"])

        for batch in batches:
            key_type = batch.schema.field("key").type
            for name, s in zip(batch.column("key").to_pylist(), batch.column("sketch").to_pylist()):
                one = np.array(s or [], dtype=np.int64)
                before = held_sketches.get(name)
                held_sketches[name] = np.unique(one)[:k] if before is None else merge(before, one, k)
            if len(held_sketches) >= keys_held:
                yield out()
        if held_sketches:
            yield out()

    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, k).alias("sketch")
    few = parts.select(F.col(key).alias("key"), "sketch").mapInArrow(run, f"key {kind}, sketch array<bigint>")
    salted = few.withColumn("salt", F.pmod(F.xxhash64("sketch"), F.lit(salts)))
    return salted.groupBy("key", "salt").agg(least).groupBy("key").agg(least).withColumnRenamed("key", key)


def cut_points(keys: list[float], n: int) -> list[tuple[float, int]]:
    """Where ranges begin, in the order of rows: descending keys, and ascending digests where a key is cut more than once."""
    out = []
    for key, times in sorted(Counter(keys).items(), reverse=True):
        out += [(key, -(1 << 63) + j * (1 << 64) // times) for j in range(times)]
    return out[:n]


def with_next(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows dealt to ranges of descending ids: ``range_no, halo, id, text``; halo rows are only looked at.

    An id that very many rows share (null, say) is cut by the rows' digests.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.coalesce("id", F.lit(NO_ID))).withColumn("digest", text_digest("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = keyed.select(F.col("key").cast("double").alias("key")).approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    points = cut_points(cuts, n)
    names = np.array([p[0] for p in points][::-1])  # ascending
    inner: dict[float, np.ndarray] = {key: np.array([d for name, d in points if name == key]) for key, times in Counter(cuts).items() if times > 1}

    def place(key: pd.Series, digest: pd.Series) -> np.ndarray:  # how many points a row is at or behind; the largest ids are range 0
        k = key.to_numpy().astype(float)
        out = len(names) - np.searchsorted(names, k, side="left") if len(names) else np.zeros(len(k), dtype=int)
        for name, digests in inner.items():
            same = k == name
            out[same] += np.searchsorted(digests, digest.to_numpy()[same], side="right") - len(digests)
        return out

    @F.pandas_udf("int")
    def range_of(key: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series(place(key, digest)).astype("int32")

    # One row for each range: bounded by the number of partitions.
    first = F.max(F.struct("key", F.bitwise_not("digest").alias("after")))
    heads = sorted((r, h["key"], ~h["after"]) for r, h in keyed.groupBy(range_of("key", "digest").alias("r")).agg(first).collect())
    also = {(k, d): heads[i - 1][0] for i, (_, k, d) in enumerate(heads) if i}

    @F.pandas_udf("array<struct<range_no:int,halo:int>>")
    def dealt(key: pd.Series, digest: pd.Series) -> pd.Series:
        own = place(key, digest)
        wrap = (heads[0][1], heads[0][2])  # the first row of all follows the last
        out = []
        for k, d, r in zip(key.tolist(), digest.tolist(), own):
            to = [{"range_no": int(r), "halo": 0}]
            if (k, d) in also:
                to.append({"range_no": also[k, d], "halo": 1})
            if (k, d) == wrap:
                to.append({"range_no": heads[-1][0], "halo": 1})
            out.append(to)
        return pd.Series(out)

    spread = keyed.withColumn("d", F.explode(dealt("key", "digest"))).select("d.range_no", "d.halo", "key", "digest", "id", "text")
    return spread.repartitionById(len(points) + 1, F.col("range_no")).sortWithinPartitions("range_no", "halo", F.desc("key"), "digest", "text").select("range_no", "halo", "id", "text")


def compared_with_edits(df: DataFrame, text: str = "text", id_col: str = "doc_id", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Sketches of each text, of its edited copy and of the next text, with their likeness."""

    def finish(row: tuple, following: tuple) -> dict:
        (doc, t, s), (_, next_text, next_sketch) = row, following
        half = len(t) // 2
        edited = (t[: len(t) - half] + next_text[:half]).encode()
        es = sketch(edited, k, shingle)
        return {
            "doc_id": doc, "n_chars": len(t), "edited_sha256": hashlib.sha256(edited).hexdigest(), "fingerprint": as_text(s), "edited_fingerprint": as_text(es),
            "near_edited": resemblance(s, es, k), "near_next": resemblance(s, next_sketch, k), "edited_contained": containment(es, s, k), "n_distinct": distinct(s, k),
        }

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_contained", "n_distinct"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    arrow = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_range, out, seen_halo = None, None, [], False
        for batch in slices(batches, "text", 4 << 20):
            for r, halo, doc, t in zip(*(batch.column(c).to_pylist() for c in ("range_no", "halo", "id", "text"))):
                if r != held_range:
                    held, held_range, seen_halo = None, r, False
                if seen_halo:  # repeated rows of the next range's first id
                    continue
                row = (doc, t, sketch(t.encode(), k, shingle))
                if held is not None:
                    out.append(finish(held, row))
                held, seen_halo = row, bool(halo)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []

    return with_next(df, text, id_col).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_contained double, n_distinct double").withColumnRenamed("doc_id", id_col)


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_edits(documents(spark, sf_dir))
