"""Current-vs-previous comparison rules.

Set differences are written as one aggregation over a tagged union where
possible: ``groupBy`` treats null as a group, which is exactly the
null-safe ``EXCEPT`` semantics, and partial aggregation keeps hot keys cheap.
Only G1 keeps the anti join of the reference (a null previous id is always
reported, as a null never matches in a join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ledger import row_weight


def stores_not_in_current(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """G1: distinct previous stores with no match in current (null kept)."""
    p = prev.select(F.col("sid").alias("store_id")).distinct()
    c = cur.select(F.col("sid").alias("store_id")).where(F.col("store_id").isNotNull()).distinct()
    return p.join(c, "store_id", "left_anti")


def _presence(cur: DataFrame, prev: DataFrame, keys) -> DataFrame:
    """Per key (null-safe): present in previous / in current."""
    sel = [F.col(k) for k in keys]
    t = (prev.select(*sel, F.lit(1).alias("p"), F.lit(0).alias("c"))
             .unionByName(cur.select(*sel, F.lit(0).alias("p"), F.lit(1).alias("c"))))
    return t.groupBy(*keys).agg(F.max("p").alias("in_prev"), F.max("c").alias("in_cur"))


def missing_store_pct(cur: DataFrame, prev: DataFrame, threshold_pct: float) -> DataFrame:
    """Distinct previous stores missing from current, count and percent."""
    pres = _presence(cur.select(F.col("sid").alias("store_id")),
                     prev.select(F.col("sid").alias("store_id")), ["store_id"])
    a = pres.agg(F.count_if((F.col("in_prev") == 1) & (F.col("in_cur") == 0)).cast("bigint").alias("missing_count"),
                 F.count_if(F.col("in_prev") == 1).cast("bigint").alias("previous_total"))
    pct = F.when(F.col("previous_total") > 0,
                 F.col("missing_count") / F.col("previous_total") * 100.0).otherwise(F.lit(0.0))
    return a.select("missing_count", "previous_total", pct.alias("pct_missing"),
                    F.when(pct > threshold_pct, F.lit("flag")).otherwise(F.lit("ok")).alias("status"))


def stores_with_fewer_rows(cur: DataFrame, prev: DataFrame) -> DataFrame:
    """``prev EXCEPT ALL cur`` on the store column, then distinct.

    A store is in the multiset difference exactly when it has more rows in
    previous than in current, so one signed count per store is enough.
    """
    t = (prev.select(F.col("sid").alias("store_id"), row_weight(prev).alias("d"))
             .unionByName(cur.select(F.col("sid").alias("store_id"), (-row_weight(cur)).alias("d"))))
    return t.groupBy("store_id").agg(F.sum("d").alias("d")).where(F.col("d") > 0).select("store_id")


def categories_not_in_current(cur: DataFrame, prev: DataFrame, category_col: str = "category") -> DataFrame:
    """(store, category) pairs lost since previous, for stores in both.

    Pairs are compared null-safely.  After the first aggregate each row is a
    distinct pair, so the per-store window holds one row per category.
    """
    c = cur.where(F.col("sid").isNotNull()).select(F.col("sid").alias("store_id"), F.col(category_col).alias("category"))
    p = prev.where(F.col("sid").isNotNull()).select(F.col("sid").alias("store_id"), F.col(category_col).alias("category"))
    pres = _presence(c, p, ["store_id", "category"])
    store_in_cur = F.max("in_cur").over(Window.partitionBy("store_id"))
    return (pres.withColumn("store_in_cur", store_in_cur)
                .where((F.col("in_prev") == 1) & (F.col("in_cur") == 0) & (F.col("store_in_cur") == 1))
                .select("store_id", "category"))


def price_change(snapshots: DataFrame, keys, current: str, last: str, last2: str,
                 snapshot_col: str = "snap", price_col: str = "price_num") -> DataFrame:
    """Listing keys whose current price differs from either earlier one.

    ``snapshots`` holds all three snapshots with a ``snapshot_col`` tag.  One
    ``groupBy`` on the key pivots the three minimum prices side by side (one
    shuffle instead of a three-way join); keys must be present, with a price,
    in all three.
    """
    s = F.col(snapshot_col)
    price = F.col(price_col)

    def at(tag):
        return F.min(F.when(s == tag, price))

    sel = [F.col("sid").alias("store_id") if k == "store_id" else F.col(k) for k in keys]
    g = (snapshots.select(*sel, s, price)
                  .groupBy(*keys)
                  .agg(at(current).alias("current_price"), at(last).alias("last_price"),
                       at(last2).alias("last2_price")))
    present = F.lit(True)
    for k in keys:
        present = present & F.col(k).isNotNull()
    return g.where(present
                   & F.col("current_price").isNotNull() & F.col("last_price").isNotNull()
                   & F.col("last2_price").isNotNull()
                   & ((F.col("current_price") != F.col("last_price"))
                      | (F.col("current_price") != F.col("last2_price"))))
