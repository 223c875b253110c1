"""Header operators (B1-B4): normalise, canonicalise, find missing columns.

Two forms of each:

* on a DataFrame's own header (``df.columns``), resolved at plan time — the
  usual case, one rename ``select``;
* on header lines held as *data* (one row per file, e.g. the first line of
  every file in a landing folder), as per-row array expressions, so thousands
  of files are checked in one distributed pass with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headers import normalize_header, normalize_header_col
from ..functions.text import ustrip
from ..profiles import Profile

# --------------------------------------------------------------------------
# Plan-time: a DataFrame's own columns
# --------------------------------------------------------------------------


def canonical_name(header: str, profile: Profile) -> str:
    """Alias of the normalised header, else the header stripped."""
    return profile.aliases.get(normalize_header(header), header.strip())


def canonical_names(headers, profile: Profile):
    """Canonical names of a header and its ``(header, canonical, new_name)`` collisions.

    When two headers map to one canonical name (upper and lower case alike, as Spark
    resolves columns) the first keeps it and later ones get ``<name>__<position>``.
    """
    seen: set = set()
    names, collisions = [], []
    for i, h in enumerate(headers):
        c = canonical_name(h, profile)
        if c.lower() in seen:
            new = f"{c}__{i}"
            collisions.append((h, c, new))
            c = new
        seen.add(c.lower())
        names.append(c)
    return names, collisions


def standardize_columns(df: DataFrame, profile: Profile):
    """Rename columns to canonical names; returns ``(df, collisions)`` for the report."""
    names, collisions = canonical_names(df.columns, profile)
    return df.toDF(*names), collisions


def missing_columns(df: DataFrame, required) -> list:
    """Required columns absent from ``df`` (plan-time set difference, B4)."""
    have = set(df.columns)
    return [c for c in required if c not in have]


# --------------------------------------------------------------------------
# Data form: header lines held as rows
# --------------------------------------------------------------------------


def first_line(text: Column) -> Column:
    """Text up to the first line feed (the header line of a file)."""
    return F.substring_index(text, "\n", 1)


def delimiter_of(line: Column) -> Column:
    """A1: ``|`` wins over tab wins over comma."""
    return (F.when(F.instr(line, "|") > 0, F.lit("|"))
             .when(F.instr(line, "\t") > 0, F.lit("\t"))
             .otherwise(F.lit(",")))


def split_header(line: Column) -> Column:
    """Header fields of a line, split on its own delimiter (empty fields kept)."""
    d = delimiter_of(line)
    return (F.when(d == "|", F.split(line, r"\|", -1))
             .when(d == "\t", F.split(line, "\t", -1))
             .otherwise(F.split(line, ",", -1)))


def _alias_map(profile: Profile) -> Column:
    pairs = []
    for k, v in profile.aliases.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)


def canonical_col(token: Column, profile: Profile) -> Column:
    return F.coalesce(F.try_element_at(_alias_map(profile), normalize_header_col(token)), ustrip(token))


def detect_delimiters(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A1 for many files: (id, delimiter of the first line)."""
    return files.select(F.col(id_col), delimiter_of(first_line(F.col(text_col))).alias("delimiter"))


def header_fields(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, position, raw field) for every field of every file's header line."""
    fields = split_header(first_line(F.col(text_col)))
    return files.select(F.col(id_col), F.posexplode(fields).alias("pos", "field")).select(
        id_col, (F.col("pos") + 1).cast("bigint").alias("position"), "field")


def normalize_headers(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """B1 per header field: (id, position, header, normalized)."""
    h = header_fields(files, id_col, text_col)
    return h.select(id_col, "position", ustrip(F.col("field")).alias("header"),
                    normalize_header_col(F.col("field")).alias("normalized"))


def standardize_headers(files: DataFrame, id_col: str, text_col: str, profile: Profile) -> DataFrame:
    """B2/B3 per header field: (id, position, header, canonical)."""
    h = header_fields(files, id_col, text_col)
    return h.select(id_col, "position", ustrip(F.col("field")).alias("header"),
                    canonical_col(F.col("field"), profile).alias("canonical"))


def missing_header_columns(files: DataFrame, id_col: str, text_col: str, profile: Profile,
                           required=None) -> DataFrame:
    """B4 per file: (id, required column its header lacks).

    Per row: the canonical header set is an array, the required set a literal
    array, and ``array_except`` gives the gap — no join and no shuffle.
    """
    required = profile.null_columns if required is None else required
    fields = split_header(first_line(F.col(text_col)))
    canon = F.coalesce(F.transform(fields, lambda t: canonical_col(t, profile)),
                       F.array().cast("array<string>"))
    need = F.array(*[F.lit(c) for c in required])
    return files.select(F.col(id_col), F.explode(F.array_except(need, canon)).alias("column_name"))
