"""Text as column expressions: normalising, markup, tokens, sentences, formats and extracts.

Java's ``\\w`` and ``\\s`` are ASCII unless ``(?U)`` is set; patterns say which they mean.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.functions.batches import pieces

# Markup that ends a line, entities in the order of decoding, zero-width and invisible characters,
# elements that tell HTML, signals of the other formats, and the pattern of a conventional commit subject.
BLOCK_TAGS = ["p", "div", "section", "article", "header", "footer", "main", "nav", "ul", "ol", "li", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "br"]
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
ZERO_WIDTH = r"[\u200B\u200C\u200D\uFEFF]"
INVISIBLE = r"[\u200B\u200C\u200E\u200F\u00AD\uFEFF\u180E\x{E0001}\x{E0020}-\x{E007F}\u202A-\u202E\u2066-\u2069\u2060-\u2064]"
HTML_TAG = r"(?i)<(html|body|head|div|span|p|h[1-6]|section|article|main|nav|table|ul|ol|li)[^>]*>"
LATEX = r"\\(section|subsection|subsubsection|begin\{document\})"
COMMIT = r"^(feat|fix|perf|refactor|docs|test|build|ci|chore|security|deprecated|remove)(?:\(([a-z0-9._/-]+)\))?(!)?:\s+(.{1,120})$"


@F.arrow_udf(StringType())
def nfc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unicode NFC, a megabyte of text at a time; Spark has no function for it."""
    for batch in batches:
        for i, j in pieces(batch):
            yield pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in batch.slice(i, j - i).to_pylist()], pa.string())


@F.pandas_udf(StringType())
def _numeric_entities(s: pd.Series) -> pd.Series:
    def one(m) -> str:
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else "\ufffd"

    return s.str.replace(r"&#(\d+);|&#x([0-9a-fA-F]+);", one, regex=True)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end; ``trim`` takes spaces only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def trimmed_lines(text: Column) -> Column:
    """White space next to line breaks collapsed, and the whole trimmed."""
    out = F.regexp_replace(F.regexp_replace(text, r"\s+\n", "\n"), r"\n\s+", "\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def normalize_text(text: Column, unicode_form: bool = True) -> Column:
    t = nfc(text) if unicode_form else text
    t = F.regexp_replace(F.regexp_replace(t, ZERO_WIDTH, ""), "\u00a0", " ")
    return trimmed_lines(F.regexp_replace(t, r"\r\n?", "\n"))


def comparable(text: Column) -> Column:
    """Lower case, marks to spaces, runs of spaces to one."""
    t = F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def without_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def html_to_text(html: Column, numeric_entities: bool = True) -> Column:
    """Visible text of markup, block elements on lines of their own.

    Numeric entities need Python; without any in a table, leave them out.
    """
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    t = F.regexp_replace(t, rf"(?i)</?({'|'.join(BLOCK_TAGS)})[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for entity, char in ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(char))
    return trimmed_lines(_numeric_entities(t) if numeric_entities else t)


# Elements that a sanitised text keeps, and the longest language word of a code fence.
ALLOWED_TAGS = ["b", "blockquote", "br", "code", "em", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "i", "li", "ol", "p", "pre", "strong", "sub", "sup", "table", "tbody", "td", "th", "thead", "tr", "ul", "a", "img"]
FENCE_WORD = 48


def sanitize_html(html: Column, allowed: Iterable[str] = ALLOWED_TAGS) -> Column:
    """Elements that are not allowed go, scripts and styles with what they hold; allowed ones lose their attributes.

    Links keep an http or https address, and get ``rel`` and ``target``; a link
    without one loses its element. Images keep such a source. Links and images
    are spelled anew, so nothing else of theirs is left.
    """
    plain = "|".join(t for t in allowed if t not in ("a", "img"))
    t = F.regexp_replace(html, r"(?is)<(script|style|iframe|object|embed)\b[^>]*>.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"""(?is)<a\b[^>]*?\shref\s*=\s*["']?(https?://[^\s"'<>]+)[^>]*>(.*?)</a\s*>""", "\u0001$1\u0002$2\u0003")
    t = F.regexp_replace(t, r"""(?i)<img\b[^>]*?\ssrc\s*=\s*["']?(https?://[^\s"'<>]+)[^>]*>""", "\u0004$1\u0005")
    t = F.regexp_replace(t, rf"(?i)</?(?!(?:{plain})\b)[a-z!][^>]*>", "")
    t = F.regexp_replace(t, rf"(?i)<(/?)({plain})\b[^>]*>", "<$1$2>")
    t = F.regexp_replace(t, "\u0001([^\u0002]*)\u0002", '<a href="$1" rel="nofollow noreferrer noopener" target="_blank">')
    return F.regexp_replace(F.replace(t, F.lit("\u0003"), F.lit("</a>")), "\u0004([^\u0005]*)\u0005", '<img src="$1">')


def plain_fences(text: Column) -> Column:
    """Code fences without hidden remarks: an opening fence keeps one safe word of at most ``FENCE_WORD`` bytes, a closing one nothing.

    Lines are folded from the first to the last, since only what stands before
    tells whether a fence opens or closes: a fence closes with as many marks as
    it opened with.
    """

    def step(state: Column, line: Column) -> Column:
        marks = F.regexp_extract(line, r"^\s*(`{3,})", 1)
        head = F.regexp_extract(line, r"^(\s*`{3,})", 1)
        n = F.length(marks)
        rest = F.substr(line, F.length(head) + 1)
        word = strip(rest)
        safe = (word != "") & word.rlike(r"^[\p{L}\p{Nd}+\-_#.]+$") & (F.octet_length(word) <= FENCE_WORD)
        opened = F.when(safe, F.concat(head, F.when(rest.rlike(r"^\s"), F.lit(" ")).otherwise(F.lit("")), word)).otherwise(head)
        acts = (n >= 3) & ((state["open"] == 0) | (state["open"] == n))
        new = F.when(~acts, line).when(state["open"] > 0, head).otherwise(opened)
        now = F.when(~acts, state["open"]).when(state["open"] > 0, F.lit(0)).otherwise(n)
        return F.struct(now.cast("int").alias("open"), F.concat(state["lines"], F.array(new)).alias("lines"))

    start = F.struct(F.lit(0).alias("open"), F.array().cast("array<string>").alias("lines"))
    return F.when(~text.contains("```"), text).when(text.isNotNull(), F.array_join(F.aggregate(F.split(text, "\n", -1), start, step)["lines"], "\n"))


def tokens(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def truncate_tokens(text: Column, n: int = 5000) -> Column:
    return F.array_join(F.slice(tokens(text), 1, n), " ")


def sentences(text: Column) -> Column:
    """Pieces up to their closing marks, blank ones left out; untrimmed. A text of marks only is one piece, trimmed."""
    found = F.filter(F.regexp_extract_all(text, F.lit(r"([^.!?]+[.!?]+|[^.!?]+$)"), F.lit(1)), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")
    whole = strip(text)
    return F.when((F.size(found) == 0) & (whole != ""), F.array(whole)).otherwise(found)


def _spans(pattern: str, trimmed: bool = False):
    """A function of texts: the matches of a pattern with their offsets, blank ones left out. One scan a text.

    Spans of a piece of about a megabyte of text are held at once, as flat lists and
    Arrow arrays, however many rows Spark puts in a batch.
    """
    import re

    found = re.compile(pattern, re.ASCII)

    def of(texts: list[str | None]) -> pa.Array:
        bodies, starts, ends, rows = [], [], [], []
        for text in texts:
            rows.append(None if text is None else len(bodies))
            for m in found.finditer(text or ""):
                body, start = m[0], m.start()
                if trimmed:
                    start += len(body) - len(body.lstrip(BLANK))
                    body = body.strip(BLANK)
                if body.strip(BLANK):
                    bodies.append(body)
                    starts.append(start)
                    ends.append(start + len(body))
        parts = pa.array(bodies, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())
        return pa.ListArray.from_arrays(pa.array([*rows, len(bodies)], pa.int32()), pa.StructArray.from_arrays(parts, ["text", "start", "end"]))

    @F.arrow_udf("array<struct<text:string,start:int,end:int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for i, j in pieces(batch):
                yield of(batch.slice(i, j - i).to_pylist())

    return run


BLANK = " \t\n\x0b\f\r"


def token_spans(text: Column) -> Column:
    """Tokens with their offsets (code points from 0, end exclusive)."""
    return _spans(r"\S+")(text)


def sentence_spans(text: Column) -> Column:
    """Sentence pieces, white space included, with their offsets."""
    return _spans(r"[^.!?]+[.!?]+|[^.!?]+\Z")(text)


def paragraph_spans(text: Column) -> Column:
    """Trimmed paragraphs with the offsets of what is left."""
    return _spans(r"[^\n]+(?:\n[^\n]+)*", trimmed=True)(text)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n{2,}"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def ngrams(text: Column, n: int = 3) -> Column:
    """The set of character n-grams; a shorter text is its own only one."""
    size = F.length(text)
    return F.when(size < n, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))))


def jaccard(a: Column, b: Column) -> Column:
    """Over two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def detect_format(text: Column) -> Column:
    """json, html, latex, code, table, markdown or text: the first that fits."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    json = (t.startswith("{") | t.startswith("[")) & t.endswith("}") & F.try_parse_json(t).isNotNull()
    html = t.rlike(r"(?i)<!doctype html>") | t.rlike(HTML_TAG)
    latex = t.rlike(LATEX)
    piped = t.rlike(r"\n\|.+\|\n") & t.rlike(r"\|\s*-{2,}\s*\|")
    marks = t.rlike(r"(?m)^#{1,6}\s+") | t.rlike(r"(?m)^(\*|-|\+|\d+\.)\s+") | t.rlike(r"(?m)^>\s") | t.rlike(r"\[.+?\]\(.+?\)")
    out = F.when(F.coalesce(t, F.lit("")) == "", "text").when(json, "json").when(html, "html").when(latex, "latex")
    return out.when(t.contains("```"), "code").when(piped, "table").when(marks, "markdown").otherwise("text")


def title(text: Column) -> Column:
    return F.trim(F.get(F.split(text, "\n"), F.lit(0)))


def summary(text: Column, pieces: int = 2) -> Column:
    """The first pieces between full stops."""
    return F.array_join(F.slice(F.filter(F.transform(F.split(text, r"\."), lambda x: F.trim(x)), lambda s: s != ""), 1, pieces), ". ")


def questions(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=\?)"), lambda x: F.trim(x)), lambda s: s.endswith("?"))


def line_and_column(text: Column, offset: Column) -> Column:
    """1-based position of a 0-based offset."""
    before = F.substring(text, F.lit(1), offset)
    line = F.regexp_count(before, F.lit("\n")) + 1
    return F.struct(line.alias("line"), (F.length(F.substring_index(before, "\n", -1)) + 1).alias("column"))


def tagged(text: Column, tag: str) -> Column:
    return strip(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1))


def with_context(context: Column, body: Column) -> Column:
    """A chunk's context, a blank line, and the chunk."""
    return F.when(F.coalesce(context, F.lit("")) == "", body).otherwise(F.concat_ws("\n\n", context, body))


def snippet(text: Column, term: str, n_tokens: int = 40, before: str = ">>>", after: str = "<<<") -> Column:
    """At most ``n_tokens`` tokens around the first match of a term, each match marked; the head where there is none."""
    place = F.locate(term.lower(), F.lower(text))
    at = F.greatest(token_count(F.substring(text, F.lit(1), place)), F.lit(1))
    first = F.greatest(F.lit(1), F.least(at - n_tokens // 2, token_count(text) - (n_tokens - 1)))
    return highlighted(F.array_join(F.slice(tokens(text), first, n_tokens), " "), term, before, after)


def highlighted(text: Column, term: str, before: str = ">>>", after: str = "<<<") -> Column:
    import re

    return F.regexp_replace(text, rf"(?i)({re.escape(term)})", f"{before}$1{after}")


def commit(subject: Column) -> Column:
    """Parts of a conventional commit subject, and whether it is one."""
    pattern = COMMIT
    valid = subject.rlike(pattern)
    return F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), F.regexp_extract(subject, pattern, 1).alias("type"), F.regexp_extract(subject, pattern, 2).alias("scope"), (F.regexp_extract(subject, pattern, 3) == "!").alias("breaking"), F.regexp_extract(subject, pattern, 4).alias("subject"))


#: Patterns of code constructs by language.
CODE_PATTERNS = {
    "c": {"imports": r"(?m)^\s*#\s*include\b", "functions": r"(?m)^[A-Za-z_][\w\s\*&:<>,~]*\([^;{}]*\)\s*(?:const\s*)?\{", "classes": r"\b(?:class|struct|enum)\s+\w+", "branches": r"\b(?:if|for|while|case|catch)\b|\?|&&|\|\|"},
    "python": {"imports": r"(?m)^\s*(?:import|from)\s+\w", "functions": r"(?m)^\s*(?:async\s+)?def\s+\w+", "classes": r"(?m)^\s*class\s+\w+", "branches": r"\b(?:if|elif|for|while|except|and|or)\b"},
    "scala": {"imports": r"(?m)^\s*import\s+\S", "functions": r"\bdef\s+\w+", "classes": r"\b(?:class|object|trait)\s+\w+", "branches": r"\b(?:if|for|while|case|catch)\b|&&|\|\|"},
}


def code_counts(source: Column, language: str) -> dict[str, Column]:
    return {name: F.regexp_count(source, F.lit(p)) for name, p in CODE_PATTERNS[language].items()}


def code_channels(source: Column, language: str = "python") -> dict[str, Column]:
    """Halstead-like volume and effort from distinct words, bugs, and import density of a source text."""
    c = code_counts(source, language)
    words = F.regexp_extract_all(source, F.lit(r"([A-Za-z_]\w*|[^\sA-Za-z_]+)"), F.lit(1))
    volume = F.size(words) * F.log2(F.greatest(F.size(F.array_distinct(words)), F.lit(2)))
    effort = volume * (c["branches"] + 1)
    lines = F.filter(F.transform(F.split(source, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return {
        "effort": effort * 0.01, "bugs": volume / 3000, "complexity": c["branches"] + 1,
        "import_density": F.coalesce(F.try_divide(c["imports"].cast("double"), c["functions"] * 2), F.lit(0.0)),
        "repeated_lines": F.size(lines) - F.size(F.array_distinct(lines)),
    }


@F.pandas_udf(StringType())
def unescaped_bytes(s: pd.Series) -> pd.Series:
    """Text of tokens written with ``\\xNN`` bytes."""
    import re

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        raw = re.sub(rb"\\x([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]), text.encode())
        return raw.decode("utf-8", "replace")

    return s.map(one)
