"""Scalar Column functions: text cleaning, number parsing, header rules."""

from .headers import normalize_header, normalize_header_col
from .text import (
    DIGITS, NUMERIC_TEXT, UNICODE_SPACE, clean_text, clean_zip, first_token,
    is_blank, month_start, na_to_null, round4, to_double, ustrip,
)

__all__ = [
    "DIGITS", "NUMERIC_TEXT", "UNICODE_SPACE", "clean_text", "clean_zip",
    "first_token", "is_blank", "month_start", "na_to_null", "normalize_header",
    "normalize_header_col", "round4", "to_double", "ustrip",
]
