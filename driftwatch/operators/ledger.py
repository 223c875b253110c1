"""Store ledger: what a snapshot says about each store, with the number of rows that say it.

One pass over the snapshot groups it by store id, description and place.  A store has few of these, so the ledger
holds about as many rows as there are stores, and a store with a third of all rows is combined in the map tasks.
Rules on stores read the ledger in place of the snapshot: distinct counts are the same on it, and row counts are sums of
``ROWS`` (``row_weight``).  Should every row differ, the ledger is as long as the snapshot and the results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "_rows"


def store_ledger(c: DataFrame, columns) -> DataFrame:
    """One row for each combination of ``sid`` and those of ``columns`` that ``c`` has (nulls form groups), and its ``ROWS``."""
    keys = list(dict.fromkeys(["sid", *[x for x in columns if x in c.columns]]))
    return c.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias(ROWS))


def row_weight(df: DataFrame) -> Column:
    """How many rows of the snapshot a row of ``df`` stands for: ``ROWS`` of a ledger, 1 otherwise."""
    return F.col(ROWS) if ROWS in df.columns else F.lit(1).cast("bigint")
