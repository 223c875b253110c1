"""Scalar column functions (C1-C20), built only from Catalyst expressions.

Every function takes and returns ``Column`` so a rule stays inside whole-stage
codegen; none of them is a Python UDF.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profiles import NA_TOKENS

# Characters Python's ``str.strip()`` removes (``str.isspace()``), derived
# from that rule rather than listed.  Spark's ``trim`` alone drops U+0020 only.
UNICODE_SPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())

# Text that ``pandas.to_numeric`` reads as a finite number.  Used as a guard
# because Spark's ``try_cast`` also accepts suffixes such as ``5d``.
NUMERIC_TEXT = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# A character that isn't such whitespace; printable ASCII stands first, as most texts begin with it.
_SPACE_CLASS = "".join(f"\\u{ord(ch):04x}" for ch in UNICODE_SPACE)
NOT_SPACE = f"[!-~]|[^{_SPACE_CLASS}]"

# ``NUMERIC_TEXT`` with such whitespace around it; group 1 is the number.
SPACED_NUMBER = rf"^[{_SPACE_CLASS}]*+({NUMERIC_TEXT[1:-1]})[{_SPACE_CLASS}]*+\z"

# Whole-number text (ZIP numeric test).
DIGITS = r"^[0-9]+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Strip leading/trailing Unicode whitespace."""
    return F.trim(_c(c), F.lit(UNICODE_SPACE))


def clean_text(c) -> Column:
    """Stripped text, blank -> null."""
    return F.nullif(ustrip(c), F.lit(""))


def is_blank(c) -> Column:
    """Null, or nothing but whitespace (C18): no text is stripped for it, the first other character ends the search."""
    return F.coalesce(~_c(c).rlike(NOT_SPACE), F.lit(True))


def spelled_out(pattern: str) -> str | None:
    """A negated character class (``[^a-z0-9\\s]``) with its characters written one by one; None for any other pattern.

    It matches the same characters.  Java looks single characters up in a table, but tries ranges and ``\\s`` one
    after the other, for each character of a text.
    """
    if not pattern.isascii() or "&&" in pattern or not re.fullmatch(r"\[\^(?:[^\[\]\\]|\\[swd]|\\[^A-Za-z0-9])+\]", pattern):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            found = re.compile(pattern, re.ASCII)
    except re.error:
        return None
    kept = [ch for ch in map(chr, range(128)) if not found.match(ch)]
    return f"[^{''.join(f'\\x{ord(ch):02x}' for ch in kept)}]"


def na_to_null(c) -> Column:
    """Map the NA tokens of the CSV reader to null (A2)."""
    col = _c(c)
    return F.when(~col.isin(*NA_TOKENS), col)


def bound(c, made) -> Column:
    """``made`` of a value that is computed once.

    A plain expression that names its input several times is copied for each of them, and again wherever a
    filter on it is pushed down; a one-element array holds the value instead.
    """
    return F.transform(F.array(_c(c)), made).getItem(0)


def to_double(c) -> Column:
    """Text -> double, anything that is not a plain number -> null."""
    # one look at the text; no number leaves an empty text, which casts to null
    return F.regexp_extract(_c(c), SPACED_NUMBER, 1).try_cast("double")


def clean_zip(c, pad5: bool = True) -> Column:
    """Strip, drop a trailing ``.0``, blank -> null, left-pad to 5.

    Padding never truncates: values of 5 or more characters are kept as is.
    """
    def cleaned(s: Column) -> Column:
        # Drop one trailing ".0" (no regex: this runs on every row of a snapshot).
        z = F.nullif(F.when(s.endswith(".0"), s.substr(F.lit(1), F.length(s) - 2)).otherwise(s), F.lit(""))
        return bound(z, lambda x: F.when(F.length(x) < 5, F.lpad(x, 5, "0")).otherwise(x)) if pad5 else z

    return bound(ustrip(c), cleaned)


def first_token(c) -> Column:
    """First whitespace-separated token of a date-time text (C11)."""
    return F.element_at(F.split(ustrip(c), r"\s+"), 1)


def round4(c) -> Column:
    return F.round(_c(c), 4)


def month_start(c) -> Column:
    return F.trunc(_c(c), "MM")
