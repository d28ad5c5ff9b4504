"""Canonical cell values, as SQL expression texts.

A canonical cell is ``struct<num: double, txt: string>``: a number, a text, or neither (null).
Its *code* is one tagged string used as a comparison key: ``n<units>`` for a number counted in
units of ``10**-digits``, ``t<text>`` for text, ``z`` for null. Number-like text is always a number,
so two cells are equal under the rules exactly when their codes are equal.

Every function takes and returns SQL text, for use in ``expr``: the expressions are applied to many
columns and inside lambdas, and one parsed text is far cheaper to plan than a tree built call by
call.
"""

from __future__ import annotations

from pyspark.sql import types as T

CELL_TYPE = "struct<num: double, txt: string>"

# Characters treated as white space when a text is stripped.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 "
    "           "
    "    　"
)

# Words the lenient rules read as booleans and as null.
TRUE_WORDS = ("true", "yes", "y")
FALSE_WORDS = ("false", "no", "n")
NULL_WORDS = ("nan", "none", "null", "nat")

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
LONG_INTEGER = r"^[+-]?[0-9]{16,38}$"
ISO_DAY = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}([ T].*)?$"
SLASH_DAY = r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"
CLOCK = r"^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$"
PERCENT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*%$"

PROFILES = ("strict", "lenient")

# From this many units on, a double has no fractional digits left to round.
_EXACT_UNITS = 2**53


def _words(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def strip(x: str) -> str:
    """Remove leading and trailing white space of every kind (plain ``trim`` knows spaces only)."""
    return f"trim(BOTH '{WHITESPACE}' FROM {x})"


def rounded_units(x: str, digits: int = 2) -> str:
    """A double in units of ``10**-digits``, as a whole double, rounded half to even on its exact binary value.

    The product ``x * scale`` can only mislead where it lands on a half; there its rounding error,
    recovered exactly by splitting ``x`` into two 26-bit halves, tells on which side the value lies,
    as a decimal rounding of the stored value would.
    """
    s = f"{10**digits}D"
    p = f"({x} * {s})"
    hi = f"({x} * 134217729D - ({x} * 134217729D - {x}))"
    err = f"({hi} * {s} - {p}) + ({x} - {hi}) * {s}"
    return f"rint({p} + CASE WHEN abs({p} - rint({p})) = 0.5D THEN signum({err}) * 0.5D ELSE 0D END)"


def exact_units(u: str) -> str:
    """Whole units as an integer; null beyond the range in which a double has a fraction to round."""
    return f"CASE WHEN abs({u}) < {_EXACT_UNITS}D THEN CAST({u} AS BIGINT) END"


def round_units(x: str, digits: int = 2) -> str:
    return exact_units(rounded_units(x, digits))


def round_number(x: str, digits: int = 2) -> str:
    """A double rounded half to even at ``digits`` places."""
    return f"coalesce({round_units(x, digits)} / {10**digits}D, {x})"


def units_code(u: str, x: str) -> str:
    """Code of a double ``x`` whose rounded units are ``u``: the units, or for a number too large to
    have a fraction its integer digits as text."""
    return (
        f"CASE WHEN abs({u}) < {_EXACT_UNITS}D THEN concat('n', CAST(CAST({u} AS BIGINT) AS STRING)) "
        f"WHEN abs({x}) < 9.2E18D THEN concat('t', CAST(CAST({x} AS BIGINT) AS STRING)) ELSE concat('n~', CAST({x} AS STRING)) END"
    )


def number_code(x: str, digits: int = 2) -> str:
    return units_code(rounded_units(x, digits), x)


def day_text(t: str) -> str:
    """Day of a date-like text as ``yyyy-MM-dd``; null when it is not a date.

    Accepted: year-month-day with dashes or slashes and an optional time part, and
    month/day/year (day/month/year where the first number cannot be a month).
    """
    iso = f"replace(regexp_extract({t}, r'^[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}', 0), '/', '-')"
    swap = lambda order: f"try_cast(regexp_replace({t}, r'^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}})$', '{order}') AS DATE)"
    return (
        f"CAST(CASE WHEN {t} RLIKE r'{ISO_DAY}' THEN try_cast({iso} AS DATE) "
        f"WHEN {t} RLIKE r'{SLASH_DAY}' THEN coalesce({swap('$3-$1-$2')}, {swap('$3-$2-$1')}) END AS STRING)"
    )


def clock_text(t: str) -> str:
    """``7:05`` and ``07:05:00`` in one form."""
    return f"lpad(CASE WHEN length({t}) <= 5 THEN concat({t}, ':00') ELSE {t} END, 8, '0')"


def _inexact(t: str) -> str:
    """Whether a text is an integer that no double holds exactly.

    Such integers (long identifiers, mostly) stay text, so that two neighbours never merge.
    """
    exact = f"try_cast({t} AS DECIMAL(38,0))"
    return f"length({t}) >= 16 AND {t} RLIKE r'{LONG_INTEGER}' AND {exact} <> try_cast(try_cast({t} AS DOUBLE) AS DECIMAL(38,0))"


def _long_text(c: str) -> str:
    """The digits of an integer column's value that no double holds exactly, else null."""
    return f"CASE WHEN CAST(CAST({c} AS DOUBLE) AS DECIMAL(38,0)) <> {c} THEN CAST({c} AS STRING) END"


def text_number(t: str, profile: str = "strict") -> str:
    """The number a stripped text stands for, or null.

    ``strict`` is the coded normalisation: numbers, days, stripped text. ``lenient`` adds boolean
    words here, and null words and clock times to the text part.
    """
    words = ""
    if _checked(profile) == "lenient":
        words = f"WHEN lower({t}) IN ({_words(TRUE_WORDS)}) THEN 1D WHEN lower({t}) IN ({_words(FALSE_WORDS)}) THEN 0D "
    return f"CASE WHEN {_inexact(t)} THEN NULL WHEN {t} RLIKE r'{NUMBER}' THEN try_cast({t} AS DOUBLE) {words}END"


def text_text(t: str, x: str, profile: str = "strict") -> str:
    """The text part of a stripped text whose number is ``x``; null where it is a number or a null word."""
    words = ""
    if _checked(profile) == "lenient":
        words = (
            f"WHEN lower({t}) IN ({_words(NULL_WORDS)}) THEN NULL "
            f"WHEN {t} RLIKE r'{CLOCK}' THEN {clock_text(t)} "
        )
    return (
        f"CASE WHEN {x} IS NOT NULL THEN NULL {words}"
        f"WHEN length({t}) >= 16 AND {t} RLIKE r'{LONG_INTEGER}' THEN CAST(try_cast({t} AS DECIMAL(38,0)) AS STRING) "
        f"WHEN contains({t}, '-') OR contains({t}, '/') THEN coalesce({day_text(t)}, {t}) ELSE {t} END"
    )


def _checked(profile: str) -> str:
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}")
    return profile


def _cell(num: str, txt: str) -> str:
    return f"named_struct('num', {num}, 'txt', {txt})"


def _no_nan(x: str) -> str:
    return f"nanvl({x}, NULL)"


def cell_number(t: str, kind: str, profile: str = "strict") -> str:
    """The number of a value given as stripped text with its kind, or null.

    Kinds are ``number``, ``string``, ``bool``, ``date``, ``timestamp`` and ``null``.
    """
    number = f"CASE WHEN {_inexact(t)} THEN NULL ELSE {_no_nan(f'try_cast({t} AS DOUBLE)')} END"
    return (
        f"CASE {kind} WHEN 'number' THEN {number} WHEN 'string' THEN {text_number(t, profile)} "
        f"WHEN 'bool' THEN CAST(lower({t}) = 'true' AS DOUBLE) END"
    )


def cell_text(t: str, kind: str, x: str, profile: str = "strict") -> str:
    """The text part of such a value whose number is ``x``."""
    return (
        f"CASE WHEN {x} IS NOT NULL THEN NULL WHEN {kind} IN ('string', 'date', 'timestamp') THEN {text_text(t, x, profile)} "
        f"WHEN {kind} = 'number' AND {_inexact(t)} THEN CAST(try_cast({t} AS DECIMAL(38,0)) AS STRING) END"
    )


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


_NO_NUM, _NO_TXT = "CAST(NULL AS DOUBLE)", "CAST(NULL AS STRING)"
_TIMES = (T.TimestampType, T.TimestampNTZType)


def is_plain(dtype: T.DataType) -> bool:
    """Whether a type needs no reading as text: numbers, booleans, dates, timestamps."""
    return isinstance(dtype, (T.NumericType, T.BooleanType, T.DateType, *_TIMES))


def plain_cell(c: str, dtype: T.DataType) -> str:
    """Canonical cell of a column of a plain type."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return _cell(_no_nan(f"CAST({c} AS DOUBLE)"), _NO_TXT)
    if isinstance(dtype, T.LongType):
        exact = _long_text(c)
        return _cell(f"CASE WHEN ({exact}) IS NULL THEN CAST({c} AS DOUBLE) END", exact)
    if isinstance(dtype, (T.DateType, *_TIMES)):
        return _cell(_NO_NUM, f"CAST(CAST({c} AS DATE) AS STRING)")
    return _cell(f"CAST({c} AS DOUBLE)", _NO_TXT)


def plain_code(c: str, dtype: T.DataType, digits: int = 2) -> str:
    """Code of a column of a plain type (fractional ones as doubles), null for null."""
    unit = 10**digits
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)):
        return f"concat('n', CAST(CAST({c} AS BIGINT) * {unit} AS STRING))"
    if isinstance(dtype, T.LongType):
        top = (_EXACT_UNITS - 1) // unit
        return f"CASE WHEN {c} BETWEEN {-top} AND {top} THEN concat('n', CAST({c} * {unit} AS STRING)) ELSE concat('t', CAST({c} AS STRING)) END"
    if isinstance(dtype, (T.DateType, *_TIMES)):
        return f"concat('t', CAST(CAST({c} AS DATE) AS STRING))"
    # A value that cannot be null needs no null checks in the generated arithmetic.
    return f"CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) THEN {number_code(f'coalesce({c}, 0D)', digits)} END"


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType))


def text_cell(t: str, x: str, profile: str = "strict") -> str:
    """Canonical cell of a stripped text whose number is ``x``."""
    return _cell(x, text_text(t, x, profile))


def text_code(t: str, x: str, u: str, profile: str = "strict") -> str:
    """Code of a stripped text whose number is ``x``, in units ``u``; null for null."""
    return f"CASE WHEN {x} IS NOT NULL THEN {units_code(u, x)} ELSE concat('t', {text_text(t, x, profile)}) END"


def to_text(field: T.StructField) -> str:
    """Text of any value; nested values as JSON."""
    c = quote(field.name)
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return f"to_json({c})"
    return f"CAST({c} AS STRING)"


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.NumericType):
        return "number"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, _TIMES):
        return "timestamp"
    return "string"


def cell_code(cell: str, digits: int = 2) -> str:
    """The comparison key of a canonical cell."""
    num, txt = f"{cell}.num", f"{cell}.txt"
    return f"CASE WHEN {num} IS NOT NULL THEN {number_code(num, digits)} ELSE coalesce(concat('t', {txt}), 'z') END"


# --- texts that hold collections -----------------------------------------------------------

_STRINGS = r"\x27(?:[^\x27\\]|\\.)*\x27|\x22(?:[^\x22\\]|\\.)*\x22"


def _json_string(k: str) -> str:
    """A single-quoted string as JSON: its own quote freed, the other one escaped."""
    inner = f"substring({k}, 2, length({k}) - 2)"
    return rf"concat('\"', regexp_replace(replace({inner}, '\\\'', '\''), r'(?<!\\)(\x22)', r'\\$1'), '\"')"


def parse_collection(x: str) -> str:
    """Variant value of a text that looks like a list, tuple or dict; null where it is not one.

    Tried as JSON first. Then the text is cut into quoted strings and what is between them: strings take
    JSON's quotes, and only between strings parentheses, a last comma and the words None, True and False
    take their JSON forms. A quote that is never closed makes the text no collection.
    """
    t = strip(x)
    cut = f"regexp_extract_all({t}, r'((?s){_STRINGS}|[^\\x27\\x22]+)', 1)"
    plain = r"regexp_replace(translate(k, '()', '[]'), r',\s*\]', ']')"
    for word, json_word in (("None", "null"), ("True", "true"), ("False", "false")):
        plain = rf"regexp_replace({plain}, r'\b{word}\b', '{json_word}')"
    token = f"CASE left(k, 1) WHEN '\\'' THEN {_json_string('k')} WHEN '\"' THEN k ELSE {plain} END"
    whole = f"array_join({cut}, '') = {t}"
    rewritten = f"array_join(transform({cut}, k -> {token}), '')"
    looks = rf"{t} RLIKE r'(?s)^(\[.*\]|\{{.*\}}|\(.*\))$'"
    return f"CASE WHEN {looks} THEN coalesce(try_parse_json({t}), CASE WHEN {whole} THEN try_parse_json({rewritten}) END) END"
