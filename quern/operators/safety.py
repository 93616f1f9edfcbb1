"""Secrets, personal data, redaction and anonymising as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key patterns with their severity.
SECRET_PATTERNS = [
    ("critical", "openai_key", r"\bsk-[A-Za-z0-9]{20,}\b"),
    ("critical", "github_pat", r"\bghp_[A-Za-z0-9]{20,}\b"),
    ("critical", "aws_access_key_id", r"\bAKIA[0-9A-Z]{16}\b"),
    ("high", "slack_token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("high", "private_key_block", r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("high", "generic_secret_assignment", r"(?i)\b(secret|token|password|passwd|api[_-]?key)\b\s*[:=]\s*['\"]?[A-Za-z0-9_\-\/.+=]{8,}"),
    ("medium", "jwt_like", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
]
SEVERITIES = ["critical", "high", "medium", "low"]

#: Personal data, patterns of our own.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "phone_number": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}",
    "credit_card": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b",
    "date_of_birth": r"(?i)\b(?:date of birth|birth ?date|dob)\b",
    "health_data": r"(?i)\b(?:patient|diagnosis|medical record|prescription|symptoms)\b",
    "biometric": r"(?i)\b(?:fingerprint|face ?print|retina|iris scan|biometric)\b",
    "religion": r"(?i)\b(?:religion|religious)\b",
}

#: Words that a guardrail may mask; our own short list, to be replaced by one's own.
PROFANITY = ["damn", "darn", "hell", "crap", "bastard"]

#: Personal data that is masked in text.
REDACTIONS = [("[EMAIL]", PII_PATTERNS["email"]), ("[CARD]", PII_PATTERNS["credit_card"]), ("[PHONE]", PII_PATTERNS["phone_number"]), ("[IP]", PII_PATTERNS["ip_address"])]


def scan_lines(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One finding for each line and pattern: ``line_no`` from 1, severity, pattern, the first 180 characters."""
    rows = df.select(*keep, F.posexplode(F.split(text, "\n", -1)).alias("_n", "_line"))
    found = F.filter(F.array(*[F.when(F.col("_line").rlike(p), F.struct(F.lit(s).alias("severity"), F.lit(n).alias("pattern"))) for s, n, p in SECRET_PATTERNS]), lambda x: x.isNotNull())
    return rows.select(*keep, (F.col("_n") + 1).alias("line_no"), F.substring(F.trim("_line"), 1, 180).alias("snippet"), F.inline(found))


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Findings of each severity, those without any as 0."""
    return findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES], F.count("*").alias("total"))


def pii_counts(text: Column) -> dict[str, Column]:
    return {name: F.regexp_count(text, F.lit(p)) for name, p in PII_PATTERNS.items()}


def compliance_score(critical: Column, high: Column, medium: Column) -> Column:
    """100 without findings; our own weights 20, 10 and 5 a finding, 0 at least."""
    return F.greatest(F.lit(0), 100 - 20 * critical - 10 * high - 5 * medium)


def redact_pii(text: Column) -> Column:
    for mark, pattern in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def redact_numbers(text: Column) -> Column:
    return F.regexp_replace(text, r"\d+", "[#]")


def redact_money(text: Column) -> Column:
    return F.regexp_replace(text, r"\$\d[\d.,]*", "[redacted]")


def redact_words(text: Column, words: list[str], mark: str = "***") -> Column:
    import re

    return F.regexp_replace(text, rf"(?i)\b(?:{'|'.join(map(re.escape, words))})\b", mark)


def looks_injected(text: Column) -> Column:
    """Prompts that try to override what was said before; phrases of our own choice."""
    return text.rlike(r"(?i)\b(?:ignore|disregard|forget)\b.{0,40}\b(?:previous|above|prior|all)\b.{0,40}\b(?:instructions?|rules?|prompts?)\b|\breveal\b.{0,30}\bsystem prompt\b")


def guard(df: DataFrame, column: str, max_length: int | None = None, blocked: str | None = None, abort: str | None = None) -> DataFrame:
    """Rows with a blocked word go, long ones are cut, and a forbidden pattern ends the query."""
    t = F.col(column)
    if blocked is not None:
        df = df.filter(t.isNull() | ~t.contains(blocked))
    out = t if max_length is None else F.substring(t, 1, max_length)
    if abort is not None:
        out = F.when(t.rlike(abort), F.raise_error(F.lit("forbidden text"))).otherwise(out)
    return df.withColumn(column, out)


def pseudonym(value: Column, salt: str) -> Column:
    """The same value gives the same name everywhere, so keys still join."""
    return F.substring(F.sha2(F.concat(F.lit(salt), value.cast("string")), 256), 1, 16)


def masked(value: Column, shown: int = 4) -> Column:
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(value) - shown, F.lit(0))), F.right(value, F.lit(shown)))


def generalized(value: Column, width: int) -> Column:
    low = F.floor(value / width) * width
    return F.concat_ws("-", low.cast("string"), (low + (width - 1)).cast("string"))
