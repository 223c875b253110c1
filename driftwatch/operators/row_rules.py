"""Row-level rules.

Each rule reads a *cleaned* snapshot (see ``clean.py``) and returns its natural
relational result.  All predicates are built-in expressions, so Catalyst can
push them into the scan and keep them in whole-stage codegen.

``fused_row_findings`` evaluates every row rule of a profile in ONE pass over
the snapshot: rows are combined in the map tasks by store and the values that
break a rule, so that a fault in every row of a store is one row in the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DIGITS, is_blank, month_start, spelled_out, ustrip
from ..profiles import (
    ALASKA_BOX, CA_POSTAL_NO_SPACE, CA_POSTAL_WITH_SPACE, SEVERITY, TEXT_SYMBOL_FIELDS,
    TEXT_SYMBOL_PATTERNS, USA_LOWER48_BOX, Profile,
)
from .ledger import row_weight

# --------------------------------------------------------------------------
# Coordinates and postal codes
# --------------------------------------------------------------------------


def invalid_latitude(c: DataFrame, profile: Profile) -> DataFrame:
    """Distinct (store, latitude) outside the country's latitude range."""
    lo, hi, _, _ = profile.box
    return (c.where((F.col("lat_num") < lo) | (F.col("lat_num") > hi))
             .select(F.col("sid").alias("store_id"), F.col("lat_num").alias("value"))
             .distinct())


def invalid_longitude(c: DataFrame, profile: Profile) -> DataFrame:
    """Distinct (store, longitude) outside the country's longitude range."""
    _, _, lo, hi = profile.box
    return (c.where((F.col("lon_num") < lo) | (F.col("lon_num") > hi))
             .select(F.col("sid").alias("store_id"), F.col("lon_num").alias("value"))
             .distinct())


def inside_box(box) -> Column:
    lat_lo, lat_hi, lon_lo, lon_hi = box
    return (F.col("lat_num").between(lat_lo, lat_hi)
            & F.col("lon_num").between(lon_lo, lon_hi))


def outside_boxes(c: DataFrame, boxes=(USA_LOWER48_BOX,)) -> DataFrame:
    """Distinct (store, lat, lon) outside every box.

    Three-valued logic is kept: a row with a null coordinate is not reported.
    """
    inside = inside_box(boxes[0])
    for b in boxes[1:]:
        inside = inside | inside_box(b)
    return (c.where(~inside)
             .select(F.col("sid").alias("store_id"), F.col("lat_num").alias("latitude"),
                     F.col("lon_num").alias("longitude"))
             .distinct())


def outside_geo_box(c: DataFrame) -> DataFrame:
    return outside_boxes(c, (USA_LOWER48_BOX,))


def outside_any_geo_box(c: DataFrame) -> DataFrame:
    return outside_boxes(c, (USA_LOWER48_BOX, ALASKA_BOX))


def zip_invalid_condition(profile: Profile) -> Column:
    z = F.col("zip_clean")
    return z.isNull() | ~z.rlike(profile.zip_pattern)


def invalid_zip(c: DataFrame, profile: Profile) -> DataFrame:
    """Distinct (store, cleaned ZIP) not matching the country format; null is invalid."""
    return (c.where(zip_invalid_condition(profile))
             .select(F.col("sid").alias("store_id"), F.col("zip_clean").alias("zip_code"))
             .distinct())


def zip_non_numeric(c: DataFrame, zip_col: str = "zip_code") -> DataFrame:
    """Distinct raw ZIPs that are not all digits (null in neither bucket)."""
    z = F.col(zip_col)
    return c.where(~z.rlike(DIGITS)).select(z.alias("zip_code")).distinct()


def zip_numeric_count(c: DataFrame, zip_col: str = "zip_code") -> DataFrame:
    """Number of rows whose raw ZIP is all digits."""
    return c.agg(F.count_if(F.col(zip_col).rlike(DIGITS)).cast("bigint").alias("n"))


def zip_bad_length(c: DataFrame, zip_col: str = "zip_code") -> DataFrame:
    """Distinct raw ZIPs whose length is not 5."""
    z = F.col(zip_col)
    return c.where(F.length(z) != 5).select(z.alias("zip_code")).distinct()


def postal_format(col: str) -> Column:
    p = F.col(col)
    with_space = (F.length(p) == 7) & p.rlike(CA_POSTAL_WITH_SPACE)
    no_space = (F.length(p) == 6) & p.rlike(CA_POSTAL_NO_SPACE)
    return (F.when(with_space, F.lit("with_space"))
             .when(no_space, F.lit("no_space"))
             .otherwise(F.lit("invalid")))


def postal_format_mix(c: DataFrame, col: str = "postal_ca") -> DataFrame:
    """Rows per Canadian postal format (with space / no space / invalid); a null
    code is no code and is not counted."""
    return (c.where(F.col(col).isNotNull()).groupBy(postal_format(col).alias("postal_format"))
             .agg(F.count(F.lit(1)).alias("n")))


# --------------------------------------------------------------------------
# Empty values, zero price, disallowed characters
# --------------------------------------------------------------------------


def blank_condition(column: str) -> Column:
    """The value a null check reads for each column (see SURVEY 2A, S1/S3)."""
    if column == "latitude":
        return F.col("lat_num").isNull()
    if column == "longitude":
        return F.col("lon_num").isNull()
    if column == "zip_code" or column == "zipcode":
        return F.col("zip_clean").isNull()
    return is_blank(F.col(column).cast("string"))


def present(c: DataFrame, columns) -> list:
    cols = set(c.columns)
    return [x for x in columns if x in cols]


def _some_row(condition: Column) -> Column:
    """Aggregate: a row of the group meets the condition (null doesn't)."""
    return F.bool_or(F.coalesce(condition, F.lit(False)))


def _flagged_stores(c: DataFrame, flags: list) -> DataFrame:
    """(column_name, store_id) for every rule column and store that has a row whose flag holds.

    Each flag is looked at once a row and combined by store in the map tasks.
    """
    stores = c.where(F.col("sid").isNotNull()).groupBy("sid")
    found = stores.agg(*[_some_row(cond).alias(f"_f{i}") for i, (_, cond) in enumerate(flags)]) if flags else stores.agg({"sid": "max"})
    arr = F.array(*[F.when(F.col(f"_f{i}"), F.lit(name)) for i, (name, _) in enumerate(flags)]).cast("array<string>")
    return found.select(F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("column_name"), F.col("sid").alias("store_id"))


def null_violations(c: DataFrame, profile: Profile) -> DataFrame:
    """Distinct (column, store) with an empty value; null store dropped."""
    flags = [(name, blank_condition(name)) for name in present(c, profile.null_columns)]
    return _flagged_stores(c, flags)


def symbol_condition(column: str, pattern: str) -> Column:
    """Stripped raw text contains a disallowed character (null never does).

    A class is searched in the text as it is; only where that finds something, the text is stripped.
    """
    raw, cls = F.col(column).cast("string"), spelled_out(pattern)
    found = ustrip(raw).rlike(pattern) if cls is None else raw.rlike(cls) & ustrip(raw).rlike(cls)
    return F.coalesce(found, F.lit(False))


def symbol_violations(c: DataFrame, profile: Profile, patterns: dict | None = None) -> DataFrame:
    """Distinct (column, store) whose raw value has a disallowed character."""
    patterns = profile.symbol_patterns if patterns is None else patterns
    flags = [(name, symbol_condition(name, patterns[name])) for name in present(c, patterns)]
    return _flagged_stores(c, flags)


def zero_price(c: DataFrame) -> DataFrame:
    """Distinct stores with a price that parses to zero."""
    return (c.where((F.col("price_num") == 0) & F.col("sid").isNotNull())
             .select(F.col("sid").alias("store_id")).distinct())


# --------------------------------------------------------------------------
# Stray symbols in free text
# --------------------------------------------------------------------------


def _pattern_char(pattern: str) -> str:
    # Every symbol pattern is a one-character class such as ``[*]``.
    return pattern[1:-1]


def text_symbol_flags(columns) -> list:
    """(pattern, any column contains the symbol) for each symbol pattern.

    For one-character patterns, matching the concatenation of the fields is
    the same as matching any field, so no string is built.
    """
    out = []
    for pat in TEXT_SYMBOL_PATTERNS:
        ch = _pattern_char(pat)
        hit = F.lit(False)
        for col in columns:
            hit = hit | F.coalesce(F.col(col).contains(ch), F.lit(False))
        out.append((pat, hit))
    return out


def text_symbol_counts(df: DataFrame, columns=None, source: str = "listing") -> DataFrame:
    """Rows containing each symbol, one aggregate pass for all symbols."""
    columns = present(df, TEXT_SYMBOL_FIELDS) if columns is None else columns
    flags = text_symbol_flags(columns)
    agg = df.agg(*[F.count_if(hit).cast("bigint").alias(f"n{i}") for i, (_, hit) in enumerate(flags)])
    stack = ", ".join(f"'{pat}', n{i}" for i, (pat, _) in enumerate(flags))
    return agg.select(F.lit(source).alias("source"),
                      F.expr(f"stack({len(flags)}, {stack}) as (symbol, n)"))


def text_symbol_rows(df: DataFrame, id_col: str, columns) -> DataFrame:
    """(row id, symbol) for every row and symbol it contains."""
    flags = text_symbol_flags(columns)
    arr = F.array(*[F.when(hit, F.lit(pat)) for pat, hit in flags])
    return df.select(F.col(id_col), F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("symbol"))


# --------------------------------------------------------------------------
# Price text
# --------------------------------------------------------------------------


def long_price(c: DataFrame, price_col: str = "price") -> DataFrame:
    """Distinct raw price texts longer than 5 characters."""
    p = F.col(price_col)
    return c.where(F.length(p) > 5).select(p.alias("price")).distinct()


def price_dollar_sign(c: DataFrame, price_col: str = "price") -> DataFrame:
    """Distinct raw prices containing ``$``."""
    p = F.col(price_col)
    return c.where(p.contains("$")).select(p.alias("price")).distinct()


def price_comma(c: DataFrame, price_col: str = "price") -> DataFrame:
    """Distinct raw prices containing ``,``."""
    p = F.col(price_col)
    return c.where(p.contains(",")).select(p.alias("price")).distinct()


# --------------------------------------------------------------------------
# Dates and ids
# --------------------------------------------------------------------------


def as_date(c: Column) -> Column:
    return F.try_to_date(c.cast("string"))


def date_month_mismatch(c: DataFrame, as_of, date_col: str = "date_extracted") -> DataFrame:
    """Rows per scrape date whose year-month differs from ``as_of``'s."""
    d = as_date(F.col(date_col))
    return (c.where(month_start(d) != month_start(F.lit(as_of).cast("date")))
             .groupBy(d.alias("date_extracted"))
             .agg(F.count(F.lit(1)).alias("n")))


def empty_entity_id(c: DataFrame, entity_col: str = "store_id") -> DataFrame:
    """Number of rows with an empty entity id."""
    n = F.sum(F.when(is_blank(F.col(entity_col)), row_weight(c)))
    return c.agg(F.coalesce(n, F.lit(0)).cast("bigint").alias("n"))


# --------------------------------------------------------------------------
# The fused row pass used by the suite
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class RowRule:
    check_id: str
    severity: str
    column_name: str
    condition: Column
    value: Column | None    # None: the finding has no value, only the store
    entity_required: bool   # drop rows whose entity is null


def row_rules(c: DataFrame, profile: Profile) -> list:
    """Every row rule of a profile whose input columns exist."""
    rules = []
    cols = set(c.columns)
    if profile.box is not None:
        lat_lo, lat_hi, lon_lo, lon_hi = profile.box
        if "latitude" in cols:
            rules.append(RowRule("invalid_latitude", SEVERITY["invalid_latitude"], "latitude",
                                 (F.col("lat_num") < lat_lo) | (F.col("lat_num") > lat_hi),
                                 F.col("lat_num").cast("string"), False))
        if "longitude" in cols:
            rules.append(RowRule("invalid_longitude", SEVERITY["invalid_longitude"], "longitude",
                                 (F.col("lon_num") < lon_lo) | (F.col("lon_num") > lon_hi),
                                 F.col("lon_num").cast("string"), False))
    if profile.zip_pattern is not None and profile.zip_col in cols:
        rules.append(RowRule("invalid_zip", SEVERITY["invalid_zip"], profile.zip_col,
                             zip_invalid_condition(profile), F.col("zip_clean"), False))
    for name in present(c, profile.null_columns):
        rules.append(RowRule("null_violations", SEVERITY["null_violations"], name, blank_condition(name),
                             None, True))
    for name in present(c, profile.symbol_patterns):
        rules.append(RowRule("symbol_violations", SEVERITY["symbol_violations"], name,
                             symbol_condition(name, profile.symbol_patterns[name]),
                             None, True))
    if profile.price_col in cols:
        rules.append(RowRule("zero_price", SEVERITY["zero_price"], profile.price_col,
                             F.col("price_num") == 0, F.lit(None).cast("string"), True))
    return rules


def fused_row_findings(c: DataFrame, profile: Profile, extra_keys=(), only=None) -> DataFrame:
    """All row rules (or those with a check id in ``only``) in one scan -> distinct (check_id, severity, column, entity, value).

    ``extra_keys`` are columns of ``c`` kept in the finding key (e.g. the
    source file of a streamed snapshot).
    """
    rules = [r for r in row_rules(c, profile) if only is None or r.check_id in only]
    keys = list(extra_keys)
    if not rules:
        return c.sparkSession.createDataFrame(
            [], ", ".join([f"{k} string" for k in keys] + [
                "check_id string", "severity string", "column_name string", "entity_id string",
                "value string", "detail string"]))
    sid = F.col("sid")
    # A value that breaks its rule is part of the group (null: none does), a rule without values is a flag of the group.
    broken = {i: F.when(F.coalesce(r.condition, F.lit(False)), F.struct(r.value.cast("string").alias("value"))).alias(f"_v{i}")
              for i, r in enumerate(rules) if r.value is not None}
    flags = [_some_row(r.condition).alias(f"_f{i}") for i, r in enumerate(rules) if r.value is None]
    groups = c.groupBy(*[F.col(k) for k in keys], sid, *broken.values())
    found = groups.agg(*flags) if flags else groups.agg(F.count(F.lit(1)).alias("_f"))
    hits = []
    for i, r in enumerate(rules):
        hit = F.col(f"_v{i}").isNotNull() if i in broken else F.col(f"_f{i}")
        value = F.col(f"_v{i}.value") if i in broken else F.lit(None).cast("string")
        hits.append(F.when(hit & sid.isNotNull() if r.entity_required else hit, F.struct(
            F.lit(r.check_id).alias("check_id"), F.lit(r.severity).alias("severity"),
            F.lit(r.column_name).alias("column_name"), value.alias("value"))))
    exploded = found.select(*keys, sid.alias("entity_id"),
                            F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("f"))
    return (exploded.select(*keys, "f.check_id", "f.severity", "f.column_name", "entity_id", "f.value")
                    .distinct()
                    .withColumn("detail", F.lit(None).cast("string")))
