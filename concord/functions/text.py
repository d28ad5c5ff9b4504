"""Column expressions over response texts: reasoning, fences, JSON answers, table reads, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.canon import WHITESPACE

# Words that mark an error message as a passing network failure.
TRANSIENT_WORDS = (
    "connection", "timeout", "network", "socket", "dns",
    "unreachable", "refused", "reset", "broken pipe",
    "ssl", "certificate", "handshake", "read timeout",
    "connection reset", "connection aborted", "tls",
    "eof", "connection error", "connect error",
)

# Exception classes that mark a passing network failure, with their subclasses.
TRANSIENT_CLASSES = (
    "ConnectionError", "TimeoutError", "OSError",
    "APIConnectionError", "APITimeoutError", "RateLimitError",
    "InternalServerError", "BadGatewayError", "ServiceUnavailableError",
)

def strip(c: Column) -> Column:
    """Remove leading and trailing white space of every kind."""
    return F.trim(c, F.lit(WHITESPACE))


UNCLASSIFIED = "Unclassified"

_FENCE = r"(?s)```(.*?)(?:```|\z)"
_SQL_FENCE = r"(?is)```sql(?:ite)?(.*?)(?:```|\z)"
_PYTHON_FENCE = r"(?is)```python(.*?)(?:```|\z)"
_SQL_START = r"(?is)((?:\bwith\s+(?:recursive\s+)?\w+\s*(?:\([^)]*\)\s*)?as\s*\(|select).*)"


def strip_reasoning(c: Column) -> Column:
    """Text after the last closing think tag; the text itself where there is none."""
    return F.when(c.contains("</think>"), strip(F.substring_index(c, "</think>", -1))).otherwise(c)


def _fenced(c: Column, pattern: str) -> Column:
    return strip(F.regexp_extract(c, pattern, 1))


def extract_sql(c: Column) -> Column:
    """SQL text of a response.

    The first SQL fence, else the first fence, else the text from its first SELECT (or WITH) on,
    without blank and comment lines, on one line. One trailing semicolon is dropped.
    """
    body = strip_reasoning(c)
    text = strip(body)
    found = F.regexp_extract(text, _SQL_START, 1)
    cut = F.when(found != "", found).otherwise(text)
    lines = F.filter(
        F.transform(F.split(cut, "\n"), strip),
        lambda line: (line != "") & ~line.startswith("--") & ~line.startswith("#"),
    )
    joined = F.when(F.size(lines) > 0, F.array_join(lines, " ")).otherwise(cut)
    sql = strip(
        F.when(body.rlike("(?i)```sql"), F.regexp_extract(body, _SQL_FENCE, 1))
        .when(body.contains("```"), F.regexp_extract(body, _FENCE, 1))
        .otherwise(joined)
    )
    return strip(F.regexp_replace(sql, r";\z", ""))


def extract_code(c: Column) -> Column:
    """Python code of a response: the first Python fence, else the first fence, else all of it."""
    body = strip_reasoning(c)
    return strip(
        F.when(body.rlike("(?i)```python"), F.regexp_extract(body, _PYTHON_FENCE, 1))
        .when(body.contains("```"), F.regexp_extract(body, _FENCE, 1))
        .otherwise(body)
    )


def _json_object(c: Column) -> Column:
    """A response as a variant object, its fences removed; null where it is no JSON object."""
    text = strip(c)
    for fence in (r"\A```json", r"\A```", r"```\z"):
        text = F.regexp_replace(text, fence, "")
    text = strip(text)
    return F.when(text.rlike(r"(?s)\A\{.*\}\z"), F.try_parse_json(text))


def extract_answer(c: Column) -> Column:
    """The ``answer`` field of a JSON response; the whole response where there is none."""
    return F.coalesce(F.try_variant_get(_json_object(c), "$.answer", "string"), c)


def extract_categories(c: Column) -> Column:
    """Categories a response names: its ``classification`` field, else bracketed and labelled words.

    Words of three characters or fewer do not count; the result of the word search is distinct and
    sorted, and holds one placeholder where nothing is found.
    """
    parsed = _json_object(c)
    listed = F.try_variant_get(parsed, "$.classification", "array<string>")
    single = F.try_variant_get(parsed, "$.classification", "string")
    words = F.concat(
        F.regexp_extract_all(c, F.lit(r"\[([^\]]+)\]"), F.lit(1)),
        F.regexp_extract_all(c, F.lit(r"([A-Za-z &]+):\s"), F.lit(1)),
    )
    words = F.array_sort(F.array_distinct(F.filter(F.transform(words, strip), lambda w: F.length(w) > 3)))
    found = F.when(F.size(words) > 0, words).otherwise(F.array(F.lit(UNCLASSIFIED)))
    return F.when(c.isNotNull(), F.coalesce(listed, F.when(single.isNotNull(), F.array(single)), found))


def _quoted(name: str) -> str:
    return "".join(ch if ch.isalnum() or ch == "_" else "\\" + ch for ch in name)


def table_refs(code: Column, tables: Sequence[str]) -> Column:
    """Known tables that a program reads from CSV files, in the order of ``tables``."""
    pattern = r"(?i)(?:pd|pandas)\.read_csv\s*\(\s*['\"](?:[^'\"]*[/\\])?([^'\"/\\]+)\.csv['\"]"
    seen = F.transform(F.regexp_extract_all(code, F.lit(pattern), F.lit(1)), F.lower)
    return F.filter(F.array(*[F.lit(t) for t in tables]), lambda t: F.array_contains(seen, F.lower(t)))


def rewrite_table_reads(code: Column, tables: Sequence[str]) -> Column:
    """Replace each CSV read of a known table by the name ``<table>_df``."""
    for table in tables:
        pattern = (
            r"(?i)(?:pd|pandas)\.read_csv\s*\(\s*['\"](?:[^'\"]*[/\\])?"
            + _quoted(table)
            + r"\.csv['\"]\s*(?:,[^)]*)?\)"
        )
        code = F.regexp_replace(code, pattern, f"{table}_df".replace("$", "\\$"))
    return code


def judge_verdict(c: Column) -> Column:
    """1 where a judge's text says Correct and not Incorrect, else 0; an absent text counts as 0."""
    return F.coalesce((c.contains("Correct") & ~c.contains("Incorrect")).cast("int"), F.lit(0))


def classify_failure(error: Column, error_type: Column | None = None) -> Column:
    """``transient`` for network failures, ``permanent`` for other errors, null without an error.

    ``error_type`` may hold the class names of the exception and its bases.
    """
    passing = F.lower(error).rlike("|".join(TRANSIENT_WORDS))
    if error_type is not None:
        names = "|".join(TRANSIENT_CLASSES)
        passing = passing | F.coalesce(error_type.rlike(rf"\b(?:{names})\b"), F.lit(False))
    return F.when(error.isNotNull(), F.when(passing, "transient").otherwise("permanent"))
