"""Text functions shared by operators: excerpts and the two redactors, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered replacements of the evidence redactor.
REDACT_SECRETS = [
    (r"\b(sk|pk|rk)_(live|test)_[A-Za-z0-9]{24,}", "$1_$2_***REDACTED***"),
    (r"\beyJ[A-Za-z0-9_-]{30,}\.[A-Za-z0-9_-]{30,}\.[A-Za-z0-9_-]{30,}", "eyJ***REDACTED***"),
    (r"\bAKIA[0-9A-Z]{16}\b", "AKIA***REDACTED***"),
    (r"(?i)(password|secret|token|apikey|api_key)(\s*[:=]\s*)([\"'])(?!.*\*\*\*REDACTED\*\*\*)([^\"']+?)\3", "$1$2$3***REDACTED***$3"),
    (r"(?i)(password|secret|token|apikey|api_key)(\s*[:=]\s*)(?!.*\*\*\*REDACTED\*\*\*)([^\s\"',;)]+)", "$1$2***REDACTED***"),
]
# Names whose values the line redactor hides, in order.
SECRET_KEYS = ["token", "secret", "password", "api[_-]?key", "private[_-]?key", "access[_-]?key", "auth[_-]?token"]
_COMMENT_STARTS = ("//", "/*", "*", "#")


def redact_secrets(text: Column) -> Column:
    """Secrets of evidence text replaced by a mark; null stays null."""
    for pattern, mark in REDACT_SECRETS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def redact_line(line: Column) -> Column:
    """Values given to secret names, forge tokens, and long encoded strings replaced by marks."""
    out = F.regexp_replace(line, r"(ghp_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9_]+)", "<redacted-github-token>")
    for key in SECRET_KEYS:
        out = F.regexp_replace(out, rf"(?i)({key})\s*=\s*['\"]?([^'\"\s}}<]+)['\"]?", "$1=<redacted>")
        out = F.regexp_replace(out, rf"(?i)({key})\s*:\s*['\"]?([^'\"\s,}}<]+)['\"]?", "$1: <redacted>")
    untouched = ~out.contains("<redacted") & ~out.contains("hash") & ~out.contains("checksum")
    return F.when(untouched, F.regexp_replace(out, r"\b[a-zA-Z0-9+/=]{32,}\b", "<redacted-value>")).otherwise(out)


def truncate(text: Column, limit: int = 200) -> Column:
    """At most limit characters, the last three being dots if the text is longer."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def representative_excerpt(lines: Column, limit: int = 200) -> Column:
    """The first line that is neither empty nor a comment, else the first; trimmed, cut, empty for no lines."""
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    is_comment = lambda x: F.coalesce(*[F.when(x.startswith(s), F.lit(True)) for s in _COMMENT_STARTS], F.lit(False))
    good = F.filter(trimmed, lambda x: (x != "") & ~is_comment(x))
    return F.when(F.size(lines) == 0, "").otherwise(truncate(F.coalesce(F.get(good, F.lit(0)), F.get(trimmed, F.lit(0))), limit))
