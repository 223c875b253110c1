"""Connected components of a distributed edge list (alternating large and small stars).

Edges stay in Spark; each step is a grouped minimum (with partial aggregation) and an
equi-join, and is written to the checkpoint folder.  Steps end when the edges no longer
change, which is after about the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_landed, land


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges (u, v).  Large star: neighbours above u go to u's least neighbour (or u); small star:
    u and its neighbours below u do."""
    if small:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = around.groupBy("u").agg(F.min("v").alias("m"))
        moved = around.join(least, "u").select(F.col("v").alias("a"), "m").unionAll(least.select(F.col("u").alias("a"), "m"))
    else:
        around = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = around.where("v > u").join(least, "u").select(F.col("v").alias("a"), "m")
    return moved.where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def _print_of(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v); root is the least node reachable."""
    now = land(edges.where("u <> v").select("u", "v").distinct(), name)
    seen = _print_of(now)
    while seen[0]:
        nxt = land(_star(_star(now, small=False), small=True), name)
        drop_landed(now)
        now, before, seen = nxt, seen, _print_of(nxt)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
