"""Header normalisation (B1), as a driver-side string op and as a Column op."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NOT_ALNUM = r"[^a-z0-9]"


def normalize_header(name: str) -> str:
    """Lower-case, keep only ``[a-z0-9]`` (for ``df.columns`` at plan time)."""
    return re.sub(_NOT_ALNUM, "", name.lower())


def normalize_header_col(c) -> Column:
    """The same rule over a column of header text (headers held as data)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(col), _NOT_ALNUM, "")
