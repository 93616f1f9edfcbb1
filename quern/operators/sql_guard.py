"""A gate ahead of ``spark.sql``: one SELECT or WITH statement, and nothing that looks like an injection."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

MAX_CHARS = 10_000
_LITERAL = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"")
_COMMENT = re.compile(r"--|/\*|//")
_TAUTOLOGY = re.compile(r"\bor\s+(\d+|'')\s*==?\s*\1(?!\w)", re.IGNORECASE)
_COMMAND = re.compile(r"(?:^|;)\s*\.|\b(insert|update|delete|merge|drop|create|alter|truncate|grant|revoke|set|reset|load|export|refresh|cache|uncache|add|call)\b(?!\s*\()", re.IGNORECASE)


class UnsafeQuery(ValueError):
    """The text is not one plain read-only query."""


def ensure_read_only(sql: str) -> str:
    """The query without a closing semicolon, or UnsafeQuery."""
    if not sql or not sql.strip():
        raise UnsafeQuery("the query is empty")
    if len(sql) > MAX_CHARS:
        raise UnsafeQuery(f"the query has more than {MAX_CHARS} characters")
    text = sql.strip().removesuffix(";").rstrip()
    bare = _LITERAL.sub("''", text)
    if ";" in bare:
        raise UnsafeQuery("more than one statement")
    if _COMMENT.search(bare):
        raise UnsafeQuery("comments are not accepted")
    if _TAUTOLOGY.search(bare):
        raise UnsafeQuery("a condition that is always true")
    if not re.match(r"(?is)\(*\s*(select|with)\b", bare):
        raise UnsafeQuery("only SELECT and WITH are accepted")
    if m := _COMMAND.search(bare):
        raise UnsafeQuery(f"not read-only: {m[0].strip()}")
    return text


def run_read_only(spark: SparkSession, sql: str, args: dict | None = None, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a checked query; values come in as parameters, tables as DataFrames."""
    text = ensure_read_only(sql)
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args or {})


def extract_tagged(text: str, tag: str = "sql") -> str:
    """What stands between the first pair of tags, stripped; '' if there is none."""
    m = re.search(rf"<{tag}>(.*?)</{tag}>", text, re.DOTALL)
    return m[1].strip() if m else ""
