"""Secret scans with character Markov models, in DataFrame functions only.

Base rules find assignments, access keys and long hex runs. Two first-order
Markov models over characters then judge every other long run of key-like
characters: one of random strings, one of ordinary identifiers. A run whose
log-likelihood ratio per character is above ``threshold`` is a ``random`` span.

Training. The models learn from labelled samples ``(value, random)``. Without
samples of one's own, ``labelled_samples`` labels the corpus: values of base
spans are random, words outside them that are too short to be judged are
ordinary. No judged run is a sample, so keys do not teach the ordinary model
their own transitions. Transition counts are grouped
sums over all samples, at most ``SIZE`` squared rows. Half of the random model
is uniform, since a random key may use characters that no sample had.

Offsets are code points. They come from the lengths of the pieces between
matches, summed by a window over each document's matches, so that a document
with very many matches costs no more than its length. Only matches are
shuffled, never texts.

Defined results: null and empty texts have no span; very long texts are scanned
whole. Repeated rows keep a result each. Spans that begin together stand in the
order of their kinds. An empty corpus trains uniform models and has no result.
Extra columns are not touched, whatever their names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import documents, written

#: The base rules by kind, in the order of ties, and the least length of a match (assign: of its value).
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6

#: Runs that the models judge.
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Whole runs that are too short to be judged, and what is taken out before they are looked for.
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{2,19}(?![A-Za-z0-9+/_=-])"
BASE = f"{ASSIGN}|{ACCESS}|{HEX}"
SIZE = 96
UNIFORM = 1 / 64


def _found(text: Column, kind: int, pattern: str) -> Column:
    """Matches in order: kind, code points since the match before, length, the match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.when(F.size(found) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    return F.zip_with(F.slice(between, 1, F.greatest(F.size(found), F.lit(0))), found, lambda gap, m: F.struct(F.lit(kind).alias("kind"), F.length(gap).cast("long").alias("gap"), F.length(m).cast("long").alias("len"), m.alias("value")))


def matches(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """A row for each match of a base rule or candidate run, and one of kind -1 for each input row.

    Columns: ``row`` (numbers the input rows), ``kept``, ``kind``, ``start``, ``end``, ``value``.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select(F.struct(*keep).alias("kept"), F.col(text).cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    one = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("len"), F.lit("").alias("value")))
    every = F.concat(one, _found(t, 0, ASSIGN), _found(t, 1, ACCESS), _found(t, 2, HEX), _found(t, 3, RUN))
    flat = rows.select("row", "kept", F.posexplode(every).alias("pos", "m")).select("row", "kept", "pos", "m.*")
    order = Window.partitionBy("row", "kind").orderBy("pos")
    flat = flat.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order)).withColumn("start", F.col("end") - F.col("len"))
    value = F.when(F.col("kind") == 0, F.regexp_extract("value", ASSIGN, 2)).otherwise(F.col("value"))
    return flat.select("row", "kept", "kind", "start", "end", value.alias("value")).filter((F.col("kind") != 0) | (F.length("value") >= MIN_VALUE))


def apart(found: DataFrame) -> DataFrame:
    """Without candidate runs that overlap a base span of their row: one window over each row's spans."""
    base = F.col("kind").between(0, 2)
    order = Window.partitionBy("row").orderBy("start", "kind")
    before = F.coalesce(F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    flagged = found.withColumn("before", before).withColumn("after", F.coalesce(after, F.col("end")))
    return flagged.filter((F.col("kind") != 3) | ((F.col("before") <= F.col("start")) & (F.col("after") >= F.col("end")))).drop("before", "after")


def labelled_samples(found: DataFrame, df: DataFrame, text: str = "text") -> DataFrame:
    """``value, random``: distinct values of base spans, and the distinct short words of the texts outside base spans."""
    rest = F.regexp_replace(F.col(text).cast("string"), F.lit(BASE), F.lit(" "))
    ordinary = df.select(F.explode(F.array_distinct(F.regexp_extract_all(rest, F.lit(WORD), F.lit(0)))).alias("value"), F.lit(False).alias("random"))
    return found.filter(F.col("kind").between(0, 2)).select("value", F.lit(True).alias("random")).unionByName(ordinary).distinct()


def _code(c: Column) -> Column:
    """Printable ASCII by position; all else shares the last code."""
    a = F.ascii(c)
    return F.when(a.between(32, 126), a - 32).otherwise(F.lit(SIZE - 1))


def _codes(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: F.length(c) > 0), _code)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all transitions, row by row; each distinct value counts once."""
    pairs = samples.select("random", _codes(F.col("value")).alias("c")).filter(F.size("c") > 1)
    pairs = pairs.select("random", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: a * SIZE + b)).alias("pair"))
    counts = {(r, p): n for r, p, n in pairs.groupBy("random", "pair").count().collect()}  # at most 2 * SIZE^2 rows
    out = []
    for a in range(SIZE):
        seen = {r: sum(counts.get((r, a * SIZE + b), 0) for b in range(SIZE)) for r in (True, False)}
        for b in range(SIZE):
            learned = (counts.get((True, a * SIZE + b), 0) + 32 * UNIFORM) / (seen[True] + 32 * UNIFORM * SIZE)
            ordinary = (counts.get((False, a * SIZE + b), 0) + 0.5 / SIZE) / (seen[False] + 0.5)
            out.append(math.log(0.5 * learned + 0.5 * UNIFORM) - math.log(ordinary))
    return out


def ratio(value: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per transition; null for fewer than two characters."""
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in model])), "array<double>")
    c = _codes(value)
    each = F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.get(table, a * SIZE + b))
    return F.when(F.length(value) > 1, F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / (F.length(value) - 1))


def scan(df: DataFrame, keep: list[str], text: str = "text", samples: DataFrame | None = None, threshold: float = 0.6) -> DataFrame:
    """The ``keep`` columns and ``found``: spans (kind, start, end), by start, then kind as listed."""
    found = written(apart(matches(df, keep, text)), "secret-matches")
    model = train(labelled_samples(found, df, text) if samples is None else samples)
    sure = found.withColumn("llr", F.when(F.col("kind") == 3, ratio(F.col("value"), model)))
    sure = sure.filter((F.col("kind") != 3) | (F.col("llr") > threshold))
    span = F.when(F.col("kind") >= 0, F.struct("start", "kind", "end"))
    grouped = sure.groupBy("row").agg(F.first("kept").alias("kept"), F.array_sort(F.collect_list(span)).alias("found"))
    return grouped.select("kept.*", F.transform("found", lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("found"))


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by the mark."""

    def joined(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        more = F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return F.when((F.size(acc) > 0) & (last["end"] > s["start"]), longer).otherwise(more)

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    runs = F.aggregate(found, none, joined)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(runs, lambda r: r["end"]))
    ends = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.length(text).cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    return F.array_join(pieces, mark)


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """Counts and digests of ``scan``'s rows."""

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"] != "random")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(as_text(base).cast("binary"), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"), count("random"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(scan(documents(spark, sf_dir), ["doc_id"]))
