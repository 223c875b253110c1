"""Distribution statistics (E12-E14): exact quartiles and IQR outliers.

``exact_quantiles`` computes ``percentile_disc`` exactly without ever holding a
whole group in one task:

1. histogram ``(value, count)`` by ``groupBy`` (map-side combine, so a value
   held by a third of all rows is one row after the partial aggregate);
2. approximate quantiles of the *distinct* values split the histogram into
   ``buckets`` ranges of similar size (a scalar subquery, no join);
3. per-bucket totals (at most ``buckets`` rows) give each bucket's offset;
4. a running sum inside each bucket gives every value's cumulative count;
5. the answer for ``p`` is the least value whose cumulative count reaches
   ``ceil(p * n)`` (the ``percentile_disc`` definition).

The histogram (one row per distinct value) is checkpointed once; the rest
reads it, never the input again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .ledger import row_weight

DEFAULT_BUCKETS = 64


def exact_quantiles(df: DataFrame, col: str | Column, probs, names,
                    buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """One row with the exact ``percentile_disc`` of ``col`` for each p."""
    v = F.col(col) if isinstance(col, str) else col
    hist = (df.select(v.cast("double").alias("v")).where(F.col("v").isNotNull())
              .groupBy("v").agg(F.count(F.lit(1)).alias("c")))
    # The histogram feeds four branches; a reliable checkpoint in the shared
    # checkpoint folder computes it once and cuts the lineage to the input.
    ensure_checkpoint_dir(df.sparkSession)
    hist = hist.checkpoint(eager=True)
    cuts = [i / buckets for i in range(1, buckets)]
    # One scalar subquery (a single row: the cut points and the row total);
    # it is evaluated once and inlined, so no join attaches it.
    stats = hist.agg(F.struct(F.percentile_approx("v", cuts, 10000).alias("b"),
                              F.sum("c").alias("total")).alias("s")).scalar()
    # Bind the subquery once per row; the comparisons read the bound column.
    hs = hist.withColumns({"_b": stats.getField("b"), "total": stats.getField("total")})
    bucket = sum((F.when(F.col("v") > F.element_at("_b", i), 1).otherwise(0) for i in range(1, buckets)),
                 F.lit(0))
    hb = hs.withColumn("bucket", bucket).drop("_b")
    per_bucket = hb.groupBy("bucket").agg(F.sum("c").alias("bc"))
    # At most ``buckets`` rows: the global window and the broadcast below are bounded.
    offsets = per_bucket.select(
        "bucket",
        F.coalesce(F.sum("bc").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("off"))
    w = Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cum = (hb.join(F.broadcast(offsets), "bucket")
             .withColumn("cum", F.col("off") + F.sum("c").over(w)))
    aggs = []
    for p, name in zip(probs, names):
        rank = F.ceil(F.lit(float(p)) * F.col("total"))
        aggs.append(F.min(F.when(F.col("cum") >= rank, F.col("v"))).alias(name))
    return cum.agg(*aggs)


def quartiles(df: DataFrame, col: str | Column) -> DataFrame:
    """Exact first and third quartile (nulls excluded)."""
    return exact_quantiles(df, col, (0.25, 0.75), ("q1", "q3"))


def iqr_bounds(df: DataFrame, col: str | Column, factor: float, q: DataFrame | None = None) -> DataFrame:
    """One row (lower, upper) = (q1 - f*IQR, q3 + f*IQR); ``q`` reuses known quartiles."""
    q = quartiles(df, col) if q is None else q
    iqr = F.col("q3") - F.col("q1")
    return q.select((F.col("q1") - factor * iqr).alias("lower"),
                    (F.col("q3") + factor * iqr).alias("upper"))


def outside_iqr(df: DataFrame, col: str, factor: float, q: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` whose ``col`` is strictly outside the IQR fences.

    The fences are scalar subqueries of the same plan: no join, no driver
    round trip.  Nulls are never flagged.
    """
    fences = iqr_bounds(df, col, factor, q).select(F.struct("lower", "upper")).scalar()
    x = F.col(col)
    flagged = df.withColumn("_fence", fences)
    return (flagged.where((x < F.col("_fence.lower")) | (x > F.col("_fence.upper")))
                   .drop("_fence"))


def store_row_counts(c: DataFrame) -> DataFrame:
    """Rows per store (a null store is a group)."""
    return c.groupBy(F.col("sid").alias("store_id")).agg(F.sum(row_weight(c)).alias("n"))


def store_count_outliers(c: DataFrame, factor: float) -> DataFrame:
    """Stores whose row count is outside the IQR fences of all counts."""
    return outside_iqr(store_row_counts(c), "n", factor)


def price_outliers(c: DataFrame, factor: float, q: DataFrame | None = None) -> DataFrame:
    """(store, price) rows whose price is outside the IQR fences."""
    return outside_iqr(c, "price_num", factor, q).select(F.col("sid").alias("store_id"), "price_num")


def price_quartiles(c: DataFrame) -> DataFrame:
    return quartiles(c, "price_num")
