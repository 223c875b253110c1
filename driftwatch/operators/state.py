"""Snapshot state: what the next comparison asks of a snapshot, so that the snapshot is not read again.

A state is a table of facts ``(field, sid, value, _rows)``:

* field ``store``: rows of each store (a null store is one);
* a store field (category, competitor, retailer, feed id): rows of each (store, value);
* a value field (scrape date, long price text): rows of each value, ``sid`` null.

Fields are kept apart, so a state is as long as the sum of what the fields hold, never their product; with stores that
list a few categories each it is thousands of times shorter than the snapshot.  All counts are exact and add up:
the states of a snapshot's parts, united and summed, are the state of the snapshot (``merged``).  The operators of
``compare`` and ``group_rules`` read its frames as they read a ledger, see ``ledger.row_weight``.

On disk a state is a folder.  Facts are written first, to a folder of their own; then ``meta``, which names it.  A
state whose writing was cut short has no new ``meta`` and the one before it stays in force.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_token
from ..profiles import Profile
from .clean import CLEAN_COLUMNS, clean_snapshot
from .ledger import ROWS, store_ledger

VERSION = 1
STORE = "store"
FACTS_SCHEMA = f"sid string, value string, {ROWS} bigint, field string"
META_SCHEMA = "version int, facts string, profile string, columns array<string>, fields array<string>, deduplicated boolean"


def store_fields(columns, profile: Profile) -> list[str]:
    """Columns whose values are kept for each store, of those that the snapshot has."""
    wanted = (profile.category_col, profile.consistency_col, profile.group_col, profile.feed_id_col)
    return [x for x in dict.fromkeys(wanted) if x and x in columns]


def value_fields(columns, profile: Profile) -> dict[str, Column]:
    """Columns of which single values are kept: the day of the scrape, and price texts that ``long_price`` reports."""
    out = {}
    if profile.date_col in columns:
        out[profile.date_col] = first_token(F.col(profile.date_col).cast("string"))
    if profile.price_col in columns:
        price = F.col(profile.price_col)
        out[profile.price_col] = F.when(F.length(price) > 5, price)
    return out


def _long(df: DataFrame, facts: list[Column]) -> DataFrame:
    rows = F.col(ROWS) if ROWS in df.columns else F.lit(1).cast("bigint")
    long = df.select(F.explode(F.array(*facts)).alias("f"), rows.alias(ROWS))
    return long.select("f.field", "f.sid", "f.value", ROWS)


def _fact(field: str, sid: Column, value: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), sid.cast("string").alias("sid"), value.cast("string").alias("value"))


def state_facts(c: DataFrame, profile: Profile) -> DataFrame:
    """Facts of a cleaned snapshot: one grouping of its rows by store and store fields, one by the single values.

    Rows are combined in the map tasks, so a store with a third of all rows is a few rows in the shuffle.
    """
    none = F.lit(None)
    pairs = store_fields(c.columns, profile)
    ledger = store_ledger(c, pairs)
    out = _long(ledger, [_fact(STORE, F.col("sid"), none), *[_fact(x, F.col("sid"), F.col(x)) for x in pairs]])
    singles = value_fields(c.columns, profile)
    if singles:
        values = _long(c, [_fact(x, none, v) for x, v in singles.items()])
        out = out.unionByName(values.where(F.col("value").isNotNull()))
    return _summed(out)


def _summed(facts: DataFrame) -> DataFrame:
    return facts.groupBy("field", "sid", "value").agg(F.sum(ROWS).cast("bigint").alias(ROWS))


@dataclass(frozen=True)
class SnapshotState:
    """Facts of a snapshot, its columns, and whether copies of rows were dropped before they were counted."""

    facts: DataFrame
    columns: tuple[str, ...]
    fields: tuple[str, ...]
    deduplicated: bool = False

    def _of(self, field: str) -> DataFrame:
        if field not in self.fields:
            raise ValueError(f"the state holds no field {field!r}; it has {self.fields}")
        return self.facts.where(F.col("field") == field)

    def stores(self) -> DataFrame:
        """(sid, _rows)."""
        return self._of(STORE).select("sid", ROWS)

    def pairs(self, column: str) -> DataFrame:
        """(sid, column, _rows) of a store field."""
        return self._of(column).select("sid", F.col("value").alias(column), ROWS)

    def values(self, column: str) -> DataFrame:
        """(column, _rows) of any field."""
        return self._of(column).select(F.col("value").alias(column), ROWS)


def state_of(snapshot: DataFrame, profile: Profile, cleaned: bool = False, deduplicated: bool = False) -> SnapshotState:
    """State of a raw snapshot (or a ``cleaned`` one, with copies dropped or not as ``deduplicated`` says), not yet computed.

    Of a raw snapshot copies are dropped if the profile's ``dedupe_previous`` says so.
    """
    columns = tuple(x for x in snapshot.columns if not (cleaned and x in CLEAN_COLUMNS))
    if not cleaned:
        deduplicated = profile.dedupe_previous
        snapshot = clean_snapshot(snapshot.dropDuplicates() if deduplicated else snapshot, profile)
    fields = (STORE, *store_fields(columns, profile), *value_fields(columns, profile))
    return SnapshotState(state_facts(snapshot, profile), columns, fields, deduplicated)


def merged(states: Iterable[SnapshotState]) -> SnapshotState:
    """State of a snapshot delivered in parts; parts whose copies were dropped can't be added up (a copy may lie in another)."""
    states = list(states)
    if not states:
        raise ValueError("no states to merge")
    first = states[0]
    if any(s.deduplicated for s in states):
        raise ValueError("states without copies can't be merged: a row may have copies in several parts")
    if any((set(s.columns), set(s.fields)) != (set(first.columns), set(first.fields)) for s in states):
        raise ValueError("the parts of a snapshot have different columns")
    facts = first.facts
    for s in states[1:]:
        facts = facts.unionByName(s.facts)
    return SnapshotState(_summed(facts), first.columns, first.fields)


def write_state(state: SnapshotState, path: str, profile: Profile) -> str:
    """Write a state to the folder ``path``, in place of any earlier one; returns the path."""
    spark = state.facts.sparkSession
    base = path.rstrip("/")
    name = f"facts-{uuid.uuid4().hex}"
    state.facts.write.mode("overwrite").partitionBy("field").parquet(f"{base}/{name}")
    meta = [(VERSION, name, profile.name, list(state.columns), list(state.fields), state.deduplicated)]
    spark.createDataFrame(meta, META_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{base}/meta")
    return path


def read_state(spark: SparkSession, path: str, profile: Profile) -> SnapshotState:
    """The state that ``write_state`` wrote for this profile; one of another format or treatment of copies is refused."""
    base = path.rstrip("/")
    meta = spark.read.schema(META_SCHEMA).parquet(f"{base}/meta").first()
    if meta is None or meta["version"] != VERSION:
        raise ValueError(f"{path} holds no snapshot state of version {VERSION}")
    if meta["profile"] != profile.name or meta["deduplicated"] != profile.dedupe_previous:
        raise ValueError(f"the state in {path} is of profile {meta['profile']!r}, copies dropped: {meta['deduplicated']}; "
                         f"asked for {profile.name!r}, {profile.dedupe_previous}")
    facts = spark.read.schema(FACTS_SCHEMA).parquet(f"{base}/{meta['facts']}")
    return SnapshotState(facts, tuple(meta["columns"]), tuple(meta["fields"]), meta["deduplicated"])
