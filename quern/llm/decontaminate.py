"""Benchmark decontamination: one Aho-Corasick automaton over the test items.

Test questions and answers are normalised to words; each run of ``window``
words of an item is a pattern (an item of fewer words is one pattern). One
automaton over word numbers holds all patterns, and each document is scanned
once. A hit maps back to code points of the original text.

The items are broadcast as word numbers, about the size of their text, which is
measured first. Texts are read in one stage: a task holds a slice of them and
takes it through the automaton, or, beyond ``max_windows`` patterns, through
several automata one after the other, so that a worker's memory is bounded and
nothing is left out. Only beyond ``block_bytes`` (64 MB) of item text, more than
a broadcast should have, does each such block of items get a pass of its own.

Defined results: a null or empty text has no words and no hits; very long texts
are scanned whole. An item with no words has no window. Items that share an id
count once; a null item id counts as the id ''. No items: nothing is hit, words
are counted. Documents may repeat: every row gets its own result; no documents,
no rows. Columns besides the id and the text are not touched, whatever their
names; the document columns in ``keep`` are passed through.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import LOWER, documents, held, row_type, size_in_bytes, slices, text_bytes, written

#: A-Z lower-cased; 0-9, a-z and all bytes of other letters stay; the rest divides words.
NORMAL = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in LOWER)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
HITS = "n_words long, spans array<struct<start:long,end:long,first_word:long,n_words:long>>, items array<string>"


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


@dataclass
class Items:
    """A block of items: distinct words, and each item's id and words as numbers from 1 on."""

    words: list[bytes]
    ids: list[str]
    texts: list[np.ndarray]
    window: int

    def groups(self, max_windows: int) -> list[tuple[int, int]]:
        """Ranges of items with at most ``max_windows`` windows, or of one item."""
        out, first, held_windows = [], 0, 0
        for k, t in enumerate(self.texts):
            n = max(1, len(t) - self.window + 1)
            if k > first and held_windows + n > max_windows:
                out.append((first, k))
                first, held_windows = k, 0
            held_windows += n
        return [*out, (first, len(self.texts))]


def item_blocks(items: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> Iterator[Items]:
    """Blocks of items of bounded size; one block at least, so that words are counted."""
    number: dict[bytes, int] = {}
    ids: list[str] = []
    texts: list[np.ndarray] = []
    size, some = 0, False
    for row in items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text).cast("string")).toLocalIterator():
        words = normal_words((row[1] or "").encode())
        if words:
            ids.append(row[0])
            texts.append(np.array([number.setdefault(w, len(number) + 1) for w in words], dtype=np.int32))
        size += len(row[1] or "")
        if size >= block_bytes:
            yield Items(list(number), ids, texts, window)
            number, ids, texts, size, some = {}, [], [], 0, True
    if texts or not some:
        yield Items(list(number), ids, texts, window)


class Scanner:
    """The automaton of some items. Word numbers: 0 stands for every word that no item has."""

    def __init__(self, block: Items, first: int, past: int):
        import ahocorasick

        windows: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, numbers in zip(block.ids[first:past], block.texts[first:past]):
            words = numbers.tolist()
            for i in range(max(1, len(words) - block.window + 1)):
                windows[tuple(words[i : i + block.window])].add(item)
        self.items = [sorted(x) for x in windows.values()]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for k, numbers in enumerate(windows):
            self.automaton.add_word(numbers, (k, len(numbers)))
        if windows:
            self.automaton.make_automaton()
        self.empty = not windows

    def scan(self, numbers: tuple[int, ...]) -> tuple[set[str], list[tuple[int, int]]]:
        """Items with a window in the words, and the maximal runs of hit words (first, past the last)."""
        items: set[str] = set()
        if self.empty or not any(numbers):
            return items, []
        found = []
        for at, (k, n) in self.automaton.iter(numbers):
            items.update(self.items[k])
            found.append((at + 1 - n, at + 1))
        return items, _united(found)


def scan(docs: DataFrame, items: DataFrame, keep: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 8, block_bytes: int = 64 << 20, max_windows: int = 250_000) -> DataFrame:
    """The ``keep`` columns with ``n_words``, ``spans`` (code points and words of maximal hit runs) and ``items``."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(*keep).alias("kept"), F.col(text).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:long,end:long,first_word:long,n_words:long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    kind = row_type({"kept": rows.schema["kept"].dataType}, f"text string, {HITS}")
    several = size_in_bytes(items, item_text) >= block_bytes
    for block in item_blocks(items, item_id, item_text, window, block_bytes):
        shared = spark.sparkContext.broadcast(block)
        groups = block.groups(max_windows)

        def run(batches: Iterable[pa.RecordBatch], shared=shared, groups=groups, key=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            get = {w: k for k, w in enumerate(shared.value.words, 1)}.get
            for batch in slices(batches, "text", (8 if len(groups) == 1 else 64) << 20):
                texts = text_bytes(batch.column("text"))
                before = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                counts, numbers = [], []
                for raw in texts:
                    words = normal_words(raw)
                    counts.append(len(words))
                    numbers.append(np.array([get(w, 0) for w in words], dtype=np.int32))
                runs = [[(s["first_word"], s["first_word"] + s["n_words"]) for s in x] for x in before[0]]
                found = [set(x) for x in before[1]]
                for first, past in groups:
                    scanner = held(f"automaton {key} {first}", lambda: Scanner(shared.value, first, past))  # noqa: B023
                    for k, x in enumerate(numbers):
                        more, hit = scanner.scan(tuple(x.tolist()))
                        if hit:
                            found[k] |= more
                            runs[k] = _united(runs[k] + hit)
                spans = [_located(raw.decode(), x) if x else [] for raw, x in zip(texts, runs)]
                out = [batch.column("kept"), batch.column("text"), pa.array(counts, pa.int64()), pa.array(spans, batch.schema.field("spans").type), pa.array([sorted(x) for x in found], batch.schema.field("items").type)]
                yield pa.RecordBatch.from_arrays(out, ["kept", "text", "n_words", "spans", "items"])

        rows = rows.mapInArrow(run, kind)
        if several:  # one block of items in memory at a time
            rows = written(rows, "decontaminate")
    return rows.select("kept.*", "n_words", "spans", "items")


def _united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, past in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(past, out[-1][1]))
        else:
            out.append((first, past))
    return out


def _located(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words as code-point spans of the original text."""
    at = np.array([m.span() for m in WORD.finditer(text)])
    return [{"start": int(at[a][0]), "end": int(at[b - 1][1]), "first_word": a, "n_words": b - a} for a, b in runs]


def summary(scanned: DataFrame, min_items: int = 2) -> DataFrame:
    """Counts and digest of ``scan``'s rows."""
    return scanned.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= min_items).alias("contaminated"),
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(scan(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), ["doc_id"]))


OP10_SQL = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n),
hit AS (
  SELECT pos.r, pos.i, pos.n, win.item_id
  FROM pos JOIN win ON win.n = pos.n AND win.s = array_to_string(pos.w[pos.i : pos.i + pos.n - 1], ' ')),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc.doc_id, CAST(len(doc.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
