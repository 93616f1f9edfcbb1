"""Chunkers: one row a document in, one row a chunk out.

Chunks by token and stride, windows, tables and headings are column
expressions. Chunkers whose next cut depends on the last one fold over a
document's pieces in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions import text as T

CHUNK = "chunk_index int, content string, start int, end int, tokens int, label string"


def token_chunks(df: DataFrame, keep: list[str], text: str = "text", max_tokens: int = 200, overlap: int = 0) -> DataFrame:
    """Runs of ``max_tokens`` tokens; the last one ends at the last token and none starts in what is already covered."""
    overlap = max(0, min(overlap, max_tokens - 1))
    step = max(1, max_tokens - overlap)
    toks = df.select(*keep, T.tokens(F.col(text)).alias("_t")).filter(F.size("_t") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_t") - F.lit(overlap + 1)), F.lit(step))
    rows = toks.select(*keep, "_t", F.posexplode(starts).alias("chunk_index", "first_token"))
    part = F.slice("_t", F.col("first_token") + 1, F.lit(max_tokens))
    return rows.select(*keep, "chunk_index", "first_token", F.array_join(part, " ").alias("content"), F.size(part).alias("tokens"))


def stride_chunks(df: DataFrame, keep: list[str], text: str = "text", max_tokens: int = 384, stride: int = 192) -> DataFrame:
    """A chunk from every ``stride``-th token, short ones at the end included."""
    toks = df.select(*keep, T.tokens(F.col(text)).alias("_t")).filter(F.size("_t") > 0)
    rows = toks.select(*keep, "_t", F.posexplode(F.sequence(F.lit(0), F.size("_t") - 1, F.lit(stride))).alias("chunk_index", "first_token"))
    part = F.slice("_t", F.col("first_token") + 1, F.lit(max_tokens))
    return rows.select(*keep, "chunk_index", "first_token", F.array_join(part, " ").alias("content"), F.size(part).alias("tokens"))


def late_windows(chunks: DataFrame, key: str, index: str, content: str, width: int = 3, stride: int = 1) -> DataFrame:
    """``width`` neighbouring chunks joined at every ``stride``-th one, short windows at the end included."""
    w = Window.partitionBy(key).orderBy(index).rowsBetween(0, width - 1)
    rows = chunks.select(key, index, F.collect_list(content).over(w).alias("_c"), F.collect_list(index).over(w).alias("merged_from"))
    return rows.filter(F.pmod(index, F.lit(stride)) == 0).select(key, F.col(index).alias("window_start"), F.array_join("_c", " ").alias("content"), "merged_from")


def lines(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    return df.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def is_table_line(line: Column) -> Column:
    t = F.trim(line)
    return t.startswith("|") | ((F.regexp_count(t, F.lit(",")) >= 2) & ~t.rlike(r"[.;]$"))


def table_chunks(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Runs of table lines and of other lines, as ``kind, content, first_line, n_lines``."""
    rows = lines(df, keep, text).withColumn("table", is_table_line(F.col("line")))
    w = Window.partitionBy(*keep).orderBy("line_no")
    rows = rows.withColumn("run", F.sum(F.when(F.col("table").eqNullSafe(F.lag("table").over(w)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy(*keep, "run", "table").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    content = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return out.select(*keep, F.when(F.col("table"), "table").otherwise("text").alias("kind"), content.alias("content"), F.get("l", F.lit(0))["line_no"].alias("first_line"), F.size("l").alias("n_lines")).filter(F.trim("content") != "")


def headed_blocks(df: DataFrame, keep: list[str], text: str = "text", heading: str = r"^#{1,6}\s+(.*)$") -> DataFrame:
    """Lines under each heading (markdown by default) as ``heading, content``; text before the first has none."""
    rows = lines(df, keep, text).withColumn("is_heading", F.col("line").rlike(heading))
    w = Window.partitionBy(*keep).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.count_if("is_heading").over(w)).withColumn("heading", F.last(F.when(F.col("is_heading"), F.regexp_extract("line", heading, 1)), True).over(w))
    out = rows.filter("NOT is_heading").groupBy(*keep, "section", "heading").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return out.select(*keep, F.col("section").cast("int").alias("section"), "heading", T.strip(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("content")).filter("content <> ''")


def markdown_blocks(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Sections with the path of their headings, levels joined by ' > '."""
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    rows = lines(df, keep, text).withColumn("level", level).withColumn("title", F.regexp_extract("line", r"^#{1,6}\s+(.*?)\s*#*$", 1))
    w = Window.partitionBy(*keep).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    for k in range(1, 7):  # the last heading of a level, if no higher one came after it
        at = F.last(F.when(F.col("level") == k, F.struct("line_no", "title")), True).over(w)
        higher = F.max(F.when((F.col("level") > 0) & (F.col("level") < k), F.col("line_no"))).over(w)
        rows = rows.withColumn(f"h{k}", F.when(at["line_no"] > F.coalesce(higher, F.lit(-1)), at["title"]))
    rows = rows.withColumn("path", F.concat_ws(" > ", *[f"h{k}" for k in range(1, 7)])).withColumn("section", F.count_if(F.col("level") > 0).over(w))
    out = rows.filter("level = 0").groupBy(*keep, "section", "path").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    return out.select(*keep, "section", "path", T.strip(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("content")).filter("content <> ''")


def latex_sections(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    parts = F.split(text, r"(?=\\(?:sub){0,2}section\b)")
    rows = df.select(*keep, F.posexplode(parts).alias("chunk_index", "content"))
    return rows.withColumn("title", F.regexp_extract("content", r"\\(?:sub){0,2}section\*?\{([^}]*)\}", 1)).filter(F.trim("content") != "")


def code_blocks(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Fenced code and the prose between, in order."""
    parts = F.split(text, "```", -1)
    rows = df.select(*keep, F.posexplode(parts).alias("i", "raw")).withColumn("code", F.col("i") % 2 == 1)
    lang = F.when(F.col("code"), F.regexp_extract("raw", r"^([A-Za-z0-9_+#.-]*)", 1))
    content = F.when(F.col("code"), F.regexp_replace("raw", r"^[^\n]*\n", "")).otherwise(F.col("raw"))
    return rows.select(*keep, F.col("i").alias("chunk_index"), F.when(F.col("code"), "code").otherwise("text").alias("kind"), lang.alias("language"), T.strip(content).alias("content")).filter("content <> ''")


def cut_at(df: DataFrame, keep: list[str], boundaries: Column, text: str = "text") -> DataFrame:
    """Pieces between given offsets; those outside the text are ignored."""
    inside = F.array_sort(F.array_distinct(F.filter(boundaries, lambda b: (b > 0) & (b < F.length(text)))))
    starts = F.concat(F.array(F.lit(0)), inside)
    ends = F.concat(inside, F.array(F.length(text)))
    spans = F.arrays_zip(starts.alias("start"), ends.alias("end"))
    rows = df.select(*keep, text, F.posexplode(spans).alias("chunk_index", "s"))
    return rows.select(*keep, "chunk_index", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.substring(F.col(text), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("content")).filter(F.trim("content") != "")


# ------------------------------------------------ folds over one document


@dataclass
class Piece:
    content: str
    start: int
    end: int
    tokens: int


_SENTENCE = re.compile(r"[^.!?]+[.!?]+|[^.!?]+$")


def pieces(text: str, pattern: re.Pattern = _SENTENCE) -> list[Piece]:
    """Pieces with a word or mark; a text in which the pattern finds none, such as one of marks only, is one."""
    found = [Piece(m[0], m.start(), m.end(), len(m[0].split())) for m in pattern.finditer(text) if m[0].strip()]
    return found if found or not text.strip() else [Piece(text.strip(), 0, len(text), len(text.split()))]


def _joined(text: str, run: list[Piece]) -> Piece:
    return Piece(text[run[0].start : run[-1].end], run[0].start, run[-1].end, sum(p.tokens for p in run))


def pack_sentences(text: str, max_tokens: int = 300, overlap: int = 0) -> list[Piece]:
    """As many whole sentences as fit; the next chunk begins with the last ``overlap`` of them. A long sentence stays whole."""
    found = pieces(text)
    total = [0, *accumulate(p.tokens for p in found)]  # tokens before each piece
    out: list[Piece] = []
    first = 0
    for k in range(1, len(found) + 1):
        if k == len(found) or total[k + 1] - total[first] > max_tokens:
            out.append(_joined(text, found[first:k]))
            first = max(first, k - overlap)
    return out


def split_tokens(text: str, max_tokens: int, overlap: int = 0) -> list[Piece]:
    words = [m.span() for m in re.finditer(r"\S+", text)]
    overlap = max(0, min(overlap, max_tokens - 1))
    out = []
    for i in range(0, max(1, len(words) - overlap) if words else 0, max(1, max_tokens - overlap)):
        part = words[i : i + max_tokens]
        out.append(Piece(text[part[0][0] : part[-1][1]], part[0][0], part[-1][1], len(part)))
    return out


def recursive(text: str, max_tokens: int = 300, overlap: int = 0) -> list[Piece]:
    """Paragraphs that fit, else their sentences, else runs of tokens; with an overlap, the next chunk's first characters stand between."""
    out: list[Piece] = []
    for m in re.finditer(r"(?:(?!\n{2,}).)+", text, re.DOTALL):
        body = m[0].strip()
        if not body:
            continue
        at = m.start() + m[0].index(body)
        n = len(body.split())
        found = [Piece(body, 0, len(body), n)] if n <= max_tokens else [q for p in pack_sentences(body, max_tokens, 1) for q in ([p] if p.tokens <= max_tokens else [Piece(s.content, s.start + p.start, s.end + p.start, s.tokens) for s in split_tokens(p.content, max_tokens, overlap)])]
        out += [Piece(p.content, p.start + at, p.end + at, p.tokens) for p in found]
    return _interleaved(out, lambda p: p.content[:overlap]) if overlap else out


def slumber(text: str, max_tokens: int = 300, min_tokens: int | None = None, overlap: int = 0) -> list[Piece]:
    """Sentence chunks merged until they have ``min_tokens``, split again where they got too long."""
    least = max(1, min(max_tokens // 2 if min_tokens is None else min_tokens, max_tokens))
    found = pack_sentences(text, max_tokens)
    groups: list[list[Piece]] = []
    size = least
    for p in found:  # a group is full once its tokens reach the least
        if size >= least:
            groups.append([])
            size = 0
        groups[-1].append(p)
        size += p.tokens
    out: list[Piece] = []
    for group in groups:
        content = "\n".join(p.content for p in group)
        whole = Piece(content, group[0].start, group[-1].end, len(content.split()))
        out += [whole] if whole.tokens <= max_tokens else [Piece(s.content, s.start + whole.start, s.end + whole.start, s.tokens) for s in split_tokens(content, max_tokens, overlap)]
    return _interleaved(out, lambda p: " ".join(p.content.split()[:overlap])) if overlap else out


def _interleaved(run: list[Piece], head: Callable[[Piece], str]) -> list[Piece]:
    out = run[:1]
    for p in run[1:]:
        if h := head(p):
            out.append(Piece(h, p.start, p.start + len(h), len(h.split())))
        out.append(p)
    return out


def json_lines(value, path: str = "") -> Iterator[str]:
    """``path: value`` for each leaf."""
    import json

    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from json_lines(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from json_lines(v, f"{path}[{i}]")
    else:
        yield f"{path}: {value if isinstance(value, str) else json.dumps(value)}"


def json_chunks(text: str, max_tokens: int = 300, overlap: int = 0) -> list[Piece]:
    """Flattened JSON in runs of tokens; what does not parse is plain text."""
    import json

    try:
        text = "\n".join(json_lines(json.loads(text)))
    except ValueError:
        pass
    return split_tokens(text, max_tokens, overlap)


def merge_similar(items: list[tuple[str, list[float], int]], threshold: float = 0.85, max_tokens: int = 450) -> list[tuple[str, list[float], int]]:
    """Neighbours (content, vector, tokens) joined while they are alike and fit; vectors are averaged pair by pair."""
    import numpy as np

    out: list[tuple[str, list[float], int]] = []
    for content, vector, n in items:
        if out:
            before, v, m = out[-1]
            a, b = np.asarray(v, float), np.asarray(vector, float)
            size = float(np.linalg.norm(a) * np.linalg.norm(b))
            if size and float(a @ b) / size >= threshold and m + n <= max_tokens:
                out[-1] = (f"{before} {content}", ((a + b) / 2).tolist(), m + n)
                continue
        out.append((content, vector, n))
    return out


FOLDS: dict[str, Callable[..., list[Piece]]] = {"sentence": pack_sentences, "recursive": recursive, "slumber": slumber, "json": json_chunks, "token": split_tokens}


def folded(df: DataFrame, keep: list[str], how: str, text: str = "text", **options) -> DataFrame:
    """Chunks of a fold by name, a row each."""
    rows = df.select(F.struct(*keep).alias("kept"), F.col(text).cast("string").alias("text"))
    fold = FOLDS[how]
    schema = StructType([rows.schema["kept"], *StructType.fromDDL("chunks array<struct<chunk_index:int,content:string,start:int,end:int,tokens:int,label:string>>").fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                made = [[{"chunk_index": k, "content": p.content, "start": p.start, "end": p.end, "tokens": p.tokens, "label": how} for k, p in enumerate(fold(t or "", **options))] for t in part.column("text").to_pylist()]
                kind = pa.list_(pa.struct([("chunk_index", pa.int32()), ("content", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("tokens", pa.int32()), ("label", pa.string())]))
                yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array(made, kind)], ["kept", "chunks"])

    return rows.mapInArrow(run, schema).select("kept.*", F.inline("chunks"))


def semantic_chunks(df: DataFrame, key: str, order: str, content: str, vector: str, threshold: float = 0.85, max_tokens: int = 450) -> DataFrame:
    """``key, chunk_index, content, tokens``: neighbouring chunks of a document joined by the likeness of their vectors.

    Rows are sorted by document and read in Arrow batches: a task holds one
    chunk being joined, whatever the length of its documents. A null content is
    empty; a null vector, or one of another length, is like no other.
    """
    schema = f"key {df.schema[key].dataType.simpleString()}, chunk_index int, content string, tokens int"

    def alike(a: list[float] | None, b: list[float] | None) -> bool:
        import numpy as np

        if a is None or b is None or len(a) != len(b):
            return False
        x, y = np.asarray(a, float), np.asarray(b, float)
        size = float(np.linalg.norm(x) * np.linalg.norm(y))
        return bool(size) and float(x @ y) / size >= threshold

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index, held = None, 0, None  # the key, and the chunk being joined: contents, vector, tokens
        for batch in batches:
            out = []
            for k, c, v in zip(*(batch.column(i).to_pylist() for i in range(3))):
                c = c or ""
                n = len(c.split())
                if held is not None and k == last and held[2] + n <= max_tokens and alike(held[1], v):
                    held = ([*held[0], c], [(x + y) / 2 for x, y in zip(held[1], v)], held[2] + n)
                    continue
                if held is not None:
                    out.append((last, index, " ".join(held[0]), held[2]))
                index = index + 1 if held is not None and k == last else 0
                last, held = k, ([c], v, n)
            if out:
                yield rows(out, batch.schema.field(0).type)
        if held is not None:
            yield rows([(last, index, " ".join(held[0]), held[2])], batch.schema.field(0).type)

    def rows(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((kind, pa.int32(), pa.string(), pa.int32()))], ["key", "chunk_index", "content", "tokens"])

    some = df.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(content).cast("string").alias("content"), F.col(vector).cast("array<double>").alias("vector"))
    made = some.repartition("key").sortWithinPartitions("key", "order").select("key", "content", "vector").mapInArrow(run, schema)
    return made.toDF(key, *["chunk_index", "content", "tokens"] if key not in ("chunk_index", "content", "tokens") else ["_chunk_index", "_content", "_tokens"])


def html_chunks(df: DataFrame, keep: list[str], text: str = "text", **options) -> DataFrame:
    """Visible text of markup, in sentences that fit."""
    return folded(df.withColumn(text, T.html_to_text(F.col(text))), keep, "recursive", text, **options)


def semantic_markdown(df: DataFrame, key: str, vectors: Callable[[DataFrame], DataFrame], text: str = "text", threshold: float = 0.85, max_tokens: int = 450) -> DataFrame:
    """Markdown sections joined by the likeness of the vectors that ``vectors`` adds (a column ``vector``) to the sections."""
    blocks = vectors(markdown_blocks(df, [key], text))
    return semantic_chunks(blocks, key, "section", "content", "vector", threshold, max_tokens)


def auto_chunks(df: DataFrame, keep: list[str], text: str = "text", **options) -> DataFrame:
    """``keep, format, chunk_index, content`` of each text by the chunker of its format.

    Formats: json, html, latex, code, table, markdown, and all other texts recursively.
    """
    marked = df.withColumn("format", T.detect_format(F.col(text)))
    names = [*keep, "format"]

    def of(kind: str) -> DataFrame:
        return marked.filter(F.col("format") == kind)

    def numbered(rows: DataFrame, order: str) -> DataFrame:
        w = Window.partitionBy(*names).orderBy(order)
        return rows.withColumn("chunk_index", F.row_number().over(w) - 1)

    parts = [
        folded(of("json"), names, "json", text, **options),
        html_chunks(of("html"), names, text, **options),
        numbered(latex_sections(of("latex"), names, text).withColumnRenamed("chunk_index", "i"), "i"),
        numbered(code_blocks(of("code"), names, text).withColumnRenamed("chunk_index", "i"), "i"),
        numbered(table_chunks(of("table"), names, text), "first_line"),
        numbered(markdown_blocks(of("markdown"), names, text), "section"),
        folded(of("text"), names, "recursive", text, **options),
    ]
    out = None
    for p in parts:
        p = p.select(*names, F.col("chunk_index").cast("int").alias("chunk_index"), "content")
        out = p if out is None else out.unionByName(p)
    return out
