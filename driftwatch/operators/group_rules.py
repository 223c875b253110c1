"""Group rules (E, F, H): counts, consistency, uniqueness, duplicates, top-k.

Every rule is a ``groupBy`` with partial (map-side) aggregation, so a store or
value holding a third of all rows is pre-combined in each task before the
shuffle.  Scalar results come from one aggregate pass over a tagged union of
the snapshots instead of joining 1-row aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_token, round4
from .ledger import row_weight


def _tagged(cur: DataFrame, prev: DataFrame, *cols) -> DataFrame:
    """``cur`` and ``prev`` projected to ``cols`` with an ``is_cur`` flag."""
    sel = [F.col(c) if isinstance(c, str) else c for c in cols]
    return (cur.select(*sel, F.lit(True).alias("is_cur"))
               .unionByName(prev.select(*sel, F.lit(False).alias("is_cur"))))


# --------------------------------------------------------------------------
# Snapshot sizes
# --------------------------------------------------------------------------


def snapshot_counts(cur: DataFrame, prev: DataFrame, column_count: int,
                    previous_column_count: int | None = None) -> DataFrame:
    """Rows, columns and distinct stores per snapshot (both of one width unless told)."""
    if previous_column_count is None:
        previous_column_count = column_count
    t = (cur.select("sid", row_weight(cur).alias("w"), F.lit(True).alias("is_cur"))
            .unionByName(prev.select("sid", row_weight(prev).alias("w"), F.lit(False).alias("is_cur"))))
    return (t.groupBy(F.when(F.col("is_cur"), F.lit("current")).otherwise(F.lit("previous")).alias("snapshot"))
             .agg(F.sum("w").cast("bigint").alias("row_count"),
                  F.max(F.when(F.col("is_cur"), F.lit(column_count)).otherwise(F.lit(previous_column_count)))
                   .cast("bigint").alias("column_count"),
                  F.countDistinct("sid").alias("store_count")))


def _row_totals(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """Rows of both snapshots (or of the snapshots that ledgers stand for)."""
    t = (cur.select(row_weight(cur).alias("w"), F.lit(True).alias("is_cur"))
            .unionByName(prev.select(row_weight(prev).alias("w"), F.lit(False).alias("is_cur"))))
    return t.agg(F.coalesce(F.sum(F.when(F.col("is_cur"), F.col("w"))), F.lit(0)).cast("bigint").alias("current_count"),
                 F.coalesce(F.sum(F.when(~F.col("is_cur"), F.col("w"))), F.lit(0)).cast("bigint").alias("previous_count"))


def size_change_pct(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """(c - p) / (c + p) * 100 with increased / decreased / unchanged."""
    c, p = F.col("current_count"), F.col("previous_count")
    pct = F.when(c + p > 0, (c - p) / (c + p) * 100.0)
    status = (F.when(pct.isNull(), F.lit("empty")).when(pct > 0, F.lit("increased"))
               .when(pct < 0, F.lit("decreased")).otherwise(F.lit("unchanged")))
    return _row_totals(cur, prev).select(c, p, pct.alias("pct"), status.alias("status"))


def count_margin(cur: DataFrame, prev: DataFrame, threshold_pct: float) -> DataFrame:
    """|c - p| / max(c, p) * 100, flagged above the threshold."""
    c, p = F.col("current_count"), F.col("previous_count")
    pct = F.try_divide(F.abs(c - p).cast("double"), F.greatest(c, p).cast("double")) * 100.0
    status = F.when(pct.isNull(), F.lit("empty")).when(pct > threshold_pct, F.lit("flag")).otherwise(F.lit("ok"))
    return _row_totals(cur, prev).select(c, p, pct.alias("pct"), status.alias("status"))


def feed_id_counts(cur: DataFrame, prev: DataFrame, id_col: str) -> DataFrame:
    """E5: distinct feed ids per snapshot."""
    t = _tagged(cur, prev, id_col)
    return (t.groupBy(F.when(F.col("is_cur"), F.lit("current")).otherwise(F.lit("previous")).alias("snapshot"))
             .agg(F.countDistinct(id_col).alias("id_count")))


def group_counts(cur: DataFrame, prev: DataFrame, group_col: str) -> DataFrame:
    """Rows and distinct stores per group value, current vs previous.

    Groups of the current snapshot only; a group absent from the previous one
    has zero there.  Both sides are aggregates with one row per group, so the
    join is small.
    """
    def agg(df, prefix):
        return (df.where(F.col(group_col).isNotNull())
                  .groupBy(group_col)
                  .agg(F.sum(row_weight(df)).cast("bigint").alias(f"{prefix}_rows"),
                       F.countDistinct("sid").alias(f"{prefix}_stores")))

    out = agg(cur, "current").join(agg(prev, "previous"), group_col, "left")
    return out.select(
        F.col(group_col), "current_rows", "current_stores",
        F.coalesce("previous_rows", F.lit(0)).cast("bigint").alias("previous_rows"),
        F.coalesce("previous_stores", F.lit(0)).cast("bigint").alias("previous_stores"))


# --------------------------------------------------------------------------
# Single-value consistency
# --------------------------------------------------------------------------


def single_value_check(cur: DataFrame, prev: DataFrame, col: str) -> DataFrame:
    """Exactly one non-null value in each snapshot, and the same one."""
    t = _tagged(cur, prev, col)
    v = F.col(col)
    a = t.agg(
        F.countDistinct(F.when(F.col("is_cur"), v)).alias("current_values"),
        F.countDistinct(F.when(~F.col("is_cur"), v)).alias("previous_values"),
        F.min(F.when(F.col("is_cur"), v)).alias("_c"),
        F.min(F.when(~F.col("is_cur"), v)).alias("_p"))
    ok = (F.col("current_values") == 1) & (F.col("previous_values") == 1) & (F.col("_c") == F.col("_p"))
    return a.select("current_values", "previous_values",
                    F.when(ok, F.lit("ok")).otherwise(F.lit("mismatch")).alias("status"))


def distinct_values(c: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column, null counting as a value."""
    return c.select(col).distinct()


def exactly_one_value(c: DataFrame, col: str) -> DataFrame:
    """E9 as a check: one value in all rows, null being a value; an empty snapshot has none."""
    n = (F.countDistinct(col) + F.max(F.col(col).isNull().cast("bigint"))).alias("value_count")
    return c.agg(n).select(F.coalesce("value_count", F.lit(0)).cast("bigint").alias("value_count")).select(
        "value_count", F.when(F.col("value_count") == 1, F.lit("ok")).otherwise(F.lit("mismatch")).alias("status"))


def cardinality(c: DataFrame, col: str, out: str) -> DataFrame:
    """Distinct non-null values, flagged when more than one."""
    n = F.countDistinct(col)
    return c.agg(n.alias(out)).select(
        out, F.when(F.col(out) > 1, F.lit("multiple")).otherwise(F.lit("ok")).alias("status"))


# --------------------------------------------------------------------------
# Geography
# --------------------------------------------------------------------------


def store_multi_location(c: DataFrame) -> DataFrame:
    """Stores with more than one rounded (lat, lon); null pairs ignored."""
    return (c.groupBy(F.col("sid").alias("store_id"))
             .agg(F.countDistinct(round4("lat_num"), round4("lon_num")).alias("unique_locations"))
             .where(F.col("unique_locations") > 1))


def location_multi_store(c: DataFrame) -> DataFrame:
    """Rounded locations shared by more than one store (null location is a group)."""
    return (c.groupBy(round4("lat_num").alias("lat4"), round4("lon_num").alias("lon4"))
             .agg(F.countDistinct("sid").alias("store_count"))
             .where(F.col("store_count") > 1))


# --------------------------------------------------------------------------
# Uniqueness and duplicates
# --------------------------------------------------------------------------


def store_metadata_conflicts(c: DataFrame, columns=("store_name", "store_address", "city", "state")) -> DataFrame:
    """Stores with more than one name / address / city / state."""
    names = {"store_name": "name_count", "store_address": "address_count",
             "city": "city_count", "state": "state_count"}
    aggs = [F.countDistinct(col).alias(names.get(col, f"{col}_count")) for col in columns]
    cond = None
    for col in columns:
        x = F.col(names.get(col, f"{col}_count")) > 1
        cond = x if cond is None else cond | x
    return c.groupBy(F.col("sid").alias("store_id")).agg(*aggs).where(cond)


def _key_cols(keys) -> list:
    return [F.col("sid").alias("store_id") if k == "store_id" else F.col(k) for k in keys]


def duplicate_groups(c: DataFrame, keys) -> DataFrame:
    """Key groups with more than one row (null keys form groups)."""
    return (c.groupBy(*_key_cols(keys)).agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > 1))


def duplicate_entities(c: DataFrame, keys) -> DataFrame:
    """Distinct non-null stores having a duplicated key group."""
    g = duplicate_groups(c, keys)
    return g.where(F.col("store_id").isNotNull()).select("store_id").distinct()


def duplicate_entities_without_copies(c: DataFrame, keys, land) -> DataFrame:
    """E19 on a snapshot whose copies count once: distinct non-null stores having a key group with rows that differ.

    Only keys and a hash of the other columns are shuffled, not whole rows.  Rows whose hashes differ are different; a
    store with groups of several rows, but none whose hashes differ (copies, or equal hashes of different rows), is
    judged by its whole rows.  ``land(frame, name)`` writes one row for each store with such groups.
    """
    others = [F.col(f"`{x}`") for x in c.columns if x not in keys and x != "sid"] + [F.col("store_id")]
    row = F.xxhash64(*others)
    groups = (c.where(F.col("sid").isNotNull()).groupBy(*_key_cols(keys))
               .agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("lo"), F.max(row).alias("hi")).where(F.col("n") > 1))
    stores = land(groups.groupBy("store_id").agg(F.bool_or(F.col("lo") != F.col("hi")).alias("differ")), "duplicate-stores")
    doubtful = stores.where(~F.col("differ")).select(F.col("store_id").alias("sid"))
    rest = duplicate_entities(c.join(doubtful, "sid", "left_semi").dropDuplicates(), keys)
    return stores.where("differ").select("store_id").unionByName(rest)


def uniform_groups(c: DataFrame, keys, value: str = "price_num") -> DataFrame:
    """Key groups with exactly one distinct non-null value."""
    return (c.groupBy(*keys).agg(F.countDistinct(value).alias("distinct_prices"))
             .where(F.col("distinct_prices") == 1))


def categories_per_product_store(c: DataFrame) -> DataFrame:
    """Distinct categories per (product, store)."""
    return (c.groupBy("product", F.col("sid").alias("store_id"))
             .agg(F.countDistinct("category").alias("category_count")))


def scrape_dates(c: DataFrame, date_col: str = "date_extracted") -> DataFrame:
    """Distinct first tokens of the scrape date (nulls dropped)."""
    d = first_token(F.col(date_col).cast("string"))
    return c.select(d.alias("date_extracted")).where(F.col("date_extracted").isNotNull()).distinct()


def distinct_field_values(cur: DataFrame, prev: DataFrame, fields) -> DataFrame:
    """Distinct values of chosen fields in both snapshots."""
    out = None
    for f in fields:
        part = _tagged(cur, prev, F.col(f).cast("string").alias("value")).select(
            F.when(F.col("is_cur"), F.lit("current")).otherwise(F.lit("previous")).alias("snapshot"),
            F.lit(f).alias("field"), "value")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def distinct_with_copies(df: DataFrame, cols) -> DataFrame:
    """Distinct rows of ``cols`` with ``_copies`` = how often each occurs.

    One scan and one exchange, however many copies there are: copies are
    combined in the map tasks before rows are shuffled.
    """
    return df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias("_copies"))


def duplicate_row_groups(df: DataFrame) -> DataFrame:
    """full-row groups with copies; ``surplus`` = copies beyond the first."""
    return (distinct_with_copies(df, df.columns).where(F.col("_copies") > 1)
            .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_copies") - 1).alias("surplus")))


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """number of surplus full-row duplicates (null equals null)."""
    return duplicate_row_groups(df).agg(
        F.coalesce(F.sum("surplus"), F.lit(0)).cast("bigint").alias("surplus"))


def dedupe_rows(df: DataFrame) -> DataFrame:
    """drop full-row duplicates."""
    return distinct_with_copies(df, df.columns).drop("_copies")


# --------------------------------------------------------------------------
# Top-k (H1)
# --------------------------------------------------------------------------


def top_values(c: DataFrame, col: str, k: int) -> DataFrame:
    """H1: the k highest distinct non-null values (the limit is the feature)."""
    v = F.col(col)
    return c.where(v.isNotNull()).select(v).distinct().orderBy(v.desc()).limit(k)
