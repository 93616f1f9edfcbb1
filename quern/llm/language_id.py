"""Language ID: Bayesian fusion of text, markup, address and host evidence.

For a row with language ``l`` unknown::

    log P(l | all) = log P(l | host) + T(text | l) + log P(declared | l) + log P(suffix | l)

* ``T``: mean log-likelihood of the text's byte trigrams under ``l``'s smoothed
  trigram counts, times ``n / (1 + n / TRIGRAMS)``: long texts do not drown all
  else. The whole text is read. A further class ``und`` (undetermined) has equal
  odds for all trigrams.
* ``declared``: the language of the markup (``lang=``), and ``suffix``: the
  last label of the address. Their likelihoods are smoothed counts of what
  languages the texts of such rows have.
* host prior: counts of the host, smoothed towards its suffix's, smoothed
  towards the whole table's, smoothed towards equal odds.

All counts are grouped sums over all rows. A host may hold a third of all rows:
its counts are one row by then, and rows meet them in a plain join, which Spark
can split.

A row is accepted if it has a letter, its best class is not ``und`` and reaches
``min_posterior``.

Defined results: a null or empty text brings no text evidence; a row without a
letter is not accepted. Null or missing hosts, markup and addresses bring no
evidence. No labelled rows: every row is ``und`` and none is accepted; no rows
give no result. Rows may repeat; each has its result. Of equally likely classes
the first in alphabetical order wins, ``und`` last. Very long texts are read
whole, 65,536 trigrams at a time. Kept columns may have any names; other columns
are not touched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import documents, row_type, slices, text_bytes, written

#: Letters of other scripts are bytes of 0x80 and above; the rest of ASCII is one space.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
BITS = 16
DIM = 1 << BITS
UND = "und"
UND_PRIOR = 0.01
TRIGRAMS = 60.0
ALPHA = 0.05
KAPPA = 20.0
MAX_LANGUAGES = 200  # more than ISO 639-1 has; beyond, text_model raises an error


def trigrams(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of the letters, in order; words are set apart by one space."""
    letters = b" ".join(text.translate(LETTERS).split())
    if not letters:
        return np.zeros(0, dtype=np.int64)
    b = np.frombuffer(b" " + letters + b" ", dtype=np.uint8).astype(np.uint32)
    h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def text_model(labelled: DataFrame, text: str = "text", label: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and log-likelihoods (languages and ``und`` x DIM) from all labelled rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            for raw, lang in zip(text_bytes(batch.column("text")), batch.column("lang").to_pylist()):
                if lang not in held:
                    held[lang] = np.zeros(DIM, dtype=np.int64)
                held[lang] += np.bincount(trigrams(raw), minlength=DIM)
        for lang, count in held.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(count[at])], ["lang", "feature", "n"])

    rows = labelled.filter(F.col(label).isNotNull() & (F.col(label) != UND)).select(F.col(label).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    sums = rows.mapInArrow(run, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    sums = written(sums, "language-counts")
    langs = [r[0] for r in sums.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    count = np.zeros((len(langs) + 1, DIM))
    table = sums.toArrow()  # at most MAX_LANGUAGES * DIM rows
    if table.num_rows:
        number = {lang: i for i, lang in enumerate(langs)}
        count[[number[x] for x in table.column("lang").to_pylist()], table.column("feature").to_numpy()] = table.column("n").to_numpy()
    count[:-1] += ALPHA
    count[-1] = 1.0
    return langs, np.log(count / count.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(df: DataFrame, model: tuple[list[str], np.ndarray], keep: dict[str, Column], evidence: dict[str, Column], text: str = "text") -> DataFrame:
    """``kept`` (a struct), the ``evidence`` columns, ``has_letter``, and ``text_ll`` (one double a class, ``und`` last)."""
    shared = df.sparkSession.sparkContext.broadcast(model[1])  # at most MAX_LANGUAGES * DIM floats
    rows = df.select(F.struct(*[c.alias(n) for n, c in keep.items()]).alias("kept"), F.struct(*[c.alias(n) for n, c in evidence.items()]).alias("said"), F.col(text).cast("string").alias("text"))
    kind = row_type({c: rows.schema[c].dataType for c in ("kept", "said")}, "has_letter boolean, text_ll array<double>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ll = np.ascontiguousarray(shared.value.T)
        for batch in slices(batches, "text"):
            out, letters = [], []
            for raw in text_bytes(batch.column("text")):
                f = trigrams(raw)
                n = len(f)
                letters.append(n > 0)
                total = np.zeros(ll.shape[1])
                for i in range(0, n, 1 << 16):
                    total += ll[f[i : i + (1 << 16)]].sum(axis=0, dtype=np.float64)
                out.append(total / n * (n / (1 + n / TRIGRAMS)) if n else total)
            yield pa.RecordBatch.from_arrays([batch.column("kept"), batch.column("said"), pa.array(letters, pa.bool_()), pa.array(out, pa.list_(pa.float64()))], ["kept", "said", "has_letter", "text_ll"])

    return rows.mapInArrow(run, kind).select("kept", "said.*", "has_letter", "text_ll")


def suffix_of(host: Column) -> Column:
    """The last label of a host name."""
    return F.when(host.contains("."), F.element_at(F.split(host, r"\."), -1))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def declared_in(markup: Column) -> Column:
    """Primary language subtag of the first ``lang=`` in the markup."""
    return F.nullif(F.lower(F.regexp_extract(markup, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)), F.lit(""))


def _shares(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``key`` and counts of the best text class (``und`` left out) as an array."""
    best = F.col("best")
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[F.count_if(best == i).cast("double") for i in range(n)]).alias(f"{key}_n"))


def fuse(evidence: DataFrame, langs: list[str], min_posterior: float = 0.5) -> DataFrame:
    """The fields of ``kept``, ``predicted_lang``, ``posterior`` and ``accepted`` of ``text_evidence``'s rows with ``host``, ``suffix`` and ``declared``."""
    n = len(langs)
    if not n:
        return evidence.select("kept.*", F.lit(UND).alias("predicted_lang"), F.lit(1.0).alias("posterior"), F.lit(False).alias("accepted"))
    best = F.when(F.col("has_letter"), F.array_position("text_ll", F.array_max("text_ll")) - 1)
    rows = written(evidence.withColumn("best", best), "language-evidence")
    whole = [float(x or 0) for x in rows.agg(*[F.count_if(F.col("best") == i) for i in range(n)]).first()]
    total = sum(whole)
    globe = [(x + KAPPA / n) / (total + KAPPA) for x in whole]
    by = {k: written(_shares(rows, k, n), f"language-{k}") for k in ("host", "suffix", "declared")}
    for k, counts in by.items():
        rows = rows.join(counts, k, "left")
    flat = F.array(*map(F.lit, globe))

    def total_of(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def smooth(counts: Column, towards: Column) -> Column:
        t = total_of(counts)
        return F.when(counts.isNull(), towards).otherwise(F.zip_with(counts, towards, lambda c, p: (c + KAPPA * p) / (t + KAPPA)))

    def odds(counts: Column) -> Column:  # P(key | l), up to a factor that is the same for all l
        smoothed = smooth(counts, flat)
        return F.when(counts.isNull(), F.array_repeat(F.lit(0.0), n)).otherwise(F.zip_with(smoothed, flat, lambda p, q: F.log(p) - F.log(q)))

    rows = rows.withColumn("suffix_p", smooth(F.col("suffix_n"), flat)).withColumn("prior", smooth(F.col("host_n"), F.col("suffix_p"))).withColumn("said", odds(F.col("declared_n")))
    lps = [F.log(F.get("prior", F.lit(i))) + F.log(F.lit(1 - UND_PRIOR)) + F.get("text_ll", F.lit(i)) + F.get("said", F.lit(i)) for i in range(n)]
    rows = rows.withColumn("lp", F.array(*lps, F.lit(float(np.log(UND_PRIOR))) + F.get("text_ll", F.lit(n))))
    top = F.array_max("lp")
    rows = rows.withColumn("posterior", 1 / F.aggregate("lp", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("lp"))))
    names = F.array(*map(F.lit, [*langs, UND]))
    rows = rows.withColumn("predicted_lang", F.element_at(names, F.array_position("lp", top).cast("int")))
    accepted = F.col("has_letter") & (F.col("predicted_lang") != UND) & (F.col("posterior") >= min_posterior)
    return rows.select("kept.*", "predicted_lang", "posterior", accepted.alias("accepted"))


def identify(df: DataFrame, labelled: DataFrame, keep: dict[str, Column], text: str = "text", host: Column | None = None, url: Column | None = None, markup: Column | None = None, label: str = "lang", min_posterior: float = 0.5) -> DataFrame:
    """The ``keep`` columns, ``predicted_lang``, ``posterior`` and ``accepted`` of each row."""
    nothing = F.lit(None).cast("string")
    if host is None:
        host = host_of(url) if url is not None else nothing
    model = text_model(labelled, label=label)
    more = {"host": host, "suffix": suffix_of(host_of(url)) if url is not None else nothing, "declared": declared_in(markup) if markup is not None else nothing}
    return fuse(text_evidence(df, model, keep, more, text), model[0], min_posterior)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the source stands for the host; markup in a text declares a language."""
    docs = documents(spark, sf_dir)
    return identify(docs, docs, {"doc_id": F.col("doc_id")}, host=F.col("source"), markup=F.col("text"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: visible text, declared markup language, address suffix and host."""
    pages = documents(spark, sf_dir, "pages")
    hidden = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;"
    pages = pages.withColumn("visible", F.regexp_replace("html", hidden, " "))
    return identify(pages, documents(spark, sf_dir), {"page_id": F.col("page_id")}, text="visible", url=F.col("url"), markup=F.col("html"))
