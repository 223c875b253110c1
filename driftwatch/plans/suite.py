"""Suite runners (M1-M6): one findings table and one metrics table per run.

* ``listing_suite``  — the two-snapshot price-listing suite (M1, M3 with
  ``prev=None``, feed types via the profile, M5);
* ``review_suite``   — the same for store-review feeds (M2);
* ``stat_suite``     — the statistical two-snapshot suite (M4).

Plan shape: the cleaned snapshot and the store ledgers that comparisons read are
landed once (``materialize``); every row rule then runs in ONE fused pass; group and comparison rules are aggregates
over the landed tables; all outputs are unioned lazily.  Columns a check needs
but the snapshot lacks are resolved at plan time into ``missing_column``
findings and the check is skipped.  Bad data doesn't throw, because every parse is a
``try_*``/guarded expression; what throws all the same costs only its own check
(M6): a suite is a list of parts, see ``isolation``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare as cmp
from ..operators import group_rules as gr
from ..operators import row_rules as rr
from ..operators import stats as st
from ..operators.clean import CLEAN_COLUMNS, clean_snapshot
from ..operators.ledger import store_ledger
from ..operators.schema import missing_columns
from ..operators.state import SnapshotState, state_of, store_fields
from ..profiles import (
    SEVERITY, DUPLICATE_LISTING_KEYS, DUPLICATE_PRODUCT_KEYS, STORE_METADATA_COLUMNS, TEXT_SYMBOL_FIELDS,
    UNIFORM_PRICE_KEYS, Profile,
)
from ..sources.csv import CORRUPT_COL
from ..sources.landing import land
from . import isolation as iso
from .findings import plan_findings
from .isolation import Part, finding as _f, metric as _m, once


@dataclass
class SuiteResult:
    """Lazy findings and metrics of all checks, and the parts they are made of (to run each by itself)."""

    findings: DataFrame
    metrics: DataFrame
    parts: list[iso.Part] = field(default_factory=list)

    @classmethod
    def of(cls, spark, parts: list[iso.Part]) -> "SuiteResult":
        return cls(*iso.planned(spark, parts), parts)


def _prepare(df: DataFrame, profile: Profile, name: str, materialize: bool) -> DataFrame:
    c = clean_snapshot(df, profile)
    return land(c, name) if materialize else c


def _zero_without_sign(c: DataFrame) -> DataFrame:
    """Numbers as grouping leaves them: -0.0 is 0.0."""
    return c.withColumns({x: F.when(F.col(x) == 0, F.lit(0.0)).otherwise(F.col(x)) for x in ("price_num", "lat_num", "lon_num")})


def _missing(spark, df: DataFrame, required, snapshot: str | None = None) -> list[Part]:
    miss = missing_columns(df, list(dict.fromkeys(required)))
    if not miss:
        return []
    return [iso.ready(plan_findings(spark, [("missing_column", SEVERITY["missing_column"], m, None, None, snapshot)
                                            for m in miss]), "missing_column")]


def _have(df: DataFrame, *cols) -> bool:
    return all(c in df.columns for c in cols if c)


def _row_part(c: DataFrame, profile: Profile) -> Part:
    """All row rules in one pass; should that fail, one pass for each rule."""
    ids = list(dict.fromkeys(r.check_id for r in rr.row_rules(c, profile)))
    each = tuple(Part("findings", i, lambda i=i: rr.fused_row_findings(c, profile, only={i})) for i in ids)
    return Part("findings", "row_rules", lambda: rr.fused_row_findings(c, profile), each)


def _same_treatment(state: SnapshotState, profile: Profile) -> SnapshotState:
    if state.deduplicated != profile.dedupe_previous:
        raise ValueError("the previous snapshot's state and the profile treat copies of rows differently")
    return state


def _two_snapshot_suite(cur: DataFrame, prev: DataFrame | SnapshotState | None, profile: Profile, materialize: bool,
                        consistency_check: str, extra):
    """(result, cleaned current, previous, sides).

    ``sides(column)`` gives what a comparison reads of both snapshots: their store ledgers, or with a state in place of the
    previous one the (store, column) counts of both states.
    """
    spark = cur.sparkSession
    raw_cols = cur.columns
    f: list[Part] = []

    # The distinct rows with their copy counts are landed once and give both
    # the duplicate groups and the de-duplicated snapshot.
    if profile.dedupe_current:
        # What cleaning adds follows from the raw columns: it is neither shuffled nor done for copies.
        raw, g = None, _zero_without_sign(clean_snapshot(gr.distinct_with_copies(cur, [
            x for x in raw_cols if x.lower() not in CLEAN_COLUMNS]), profile))
    else:
        raw = clean_snapshot(cur, profile)
        raw = land(raw, "current") if materialize else raw
        g = gr.distinct_with_copies(raw, raw.columns)
    g = land(g, "current-distinct") if materialize else g
    dup = g.where(F.col("_copies") > 1).select(*[F.col(f"`{x}`") for x in raw_cols], (F.col("_copies") - 1).alias("surplus"))
    f.append(_f(dup, "duplicate_rows", value="surplus"))
    f.append(_m(dup.agg(F.coalesce(F.sum("surplus"), F.lit(0)).alias("surplus")),
                         "duplicate_rows", "surplus_rows", measured="surplus"))
    c = g.drop("_copies") if profile.dedupe_current else raw
    p = None
    if isinstance(prev, SnapshotState):
        p = _same_treatment(prev, profile)
    elif prev is not None:
        pv = prev.dropDuplicates() if profile.dedupe_previous else prev
        p = clean_snapshot(pv, profile)

    # What comparisons ask of a snapshot: its stores with their values of the compared columns, and how many rows say so.
    about = store_fields(raw_cols, profile)
    both = [store_ledger(x, about) for x in (c, p)] if p is not None and not isinstance(p, SnapshotState) else []
    if materialize:
        both = [land(x, f"{name}-stores") for x, name in zip(both, ("current", "previous"))]

    def own_state() -> SnapshotState:
        s = state_of(c, profile, cleaned=True, deduplicated=profile.dedupe_current)
        return replace(s, facts=land(s.facts, "current-state")) if materialize else s

    current_state = once(own_state)

    def sides(column: str | None = None) -> tuple[DataFrame, DataFrame]:
        if not isinstance(p, SnapshotState):
            return tuple(both)
        return tuple(s.pairs(column) if column else s.stores() for s in (current_state(), p))

    required = list(profile.null_columns) + list(profile.symbol_patterns) + [
        profile.entity_col, profile.consistency_col, profile.date_col]
    if profile.category_col:
        required += list(DUPLICATE_PRODUCT_KEYS)
    if profile.box is not None:
        required += ["latitude", "longitude", profile.zip_col]
    f.extend(_missing(spark, c, [x for x in required if x]))
    if p is not None:
        # What only the previous snapshot lacks: comparisons on it are skipped.
        f.extend(_missing(spark, p, [x for x in required if x in c.columns], "previous"))
    if CORRUPT_COL in c.columns:
        f.append(_f(lambda: c.where(F.col(CORRUPT_COL).isNotNull()), "malformed_rows", entity="sid",
                    value=CORRUPT_COL))
    if profile.box is None:
        # Unknown country: coordinate and postal-code rules are skipped, once.
        f.append(iso.ready(plan_findings(spark, [("unknown_country", SEVERITY["unknown_country"], "country", None,
                                                  profile.country, "coordinate and postal rules skipped")]), "unknown_country"))

    # Consistency of the competitor / retailer column.
    col = profile.consistency_col
    if p is not None and _have(c, col) and _have(p, col):
        chk = once(lambda: gr.single_value_check(*sides(col), col))
        f.append(_f(lambda: chk().where(F.col("status") == "mismatch"), consistency_check, column_name=col,
                    detail=F.format_string("current=%d previous=%d", "current_values", "previous_values")))
        f.append(_m(chk, consistency_check, "distinct_values", current="current_values",
                             previous="previous_values", status="status"))

    # One snapshot alone: it must have exactly one value, null being one.
    if p is None and _have(c, col):
        f.append(_f(lambda: gr.exactly_one_value(c, col).where(F.col("status") == "mismatch"), consistency_check,
                    column_name=col, value="value_count"))

    # Counts and size change.
    if p is not None:
        width = lambda df: len([x for x in df.columns if x != CORRUPT_COL])
        sc = once(lambda: gr.snapshot_counts(*sides(), width(cur), width(prev)))
        f.append(_m(sc, "snapshot_counts", F.concat(F.col("snapshot"), F.lit("_rows")),
                             measured="row_count"))
        f.append(_m(sc, "snapshot_counts", F.concat(F.col("snapshot"), F.lit("_stores")),
                             measured="store_count"))
        f.append(_m(sc, "snapshot_counts", F.concat(F.col("snapshot"), F.lit("_columns")),
                             measured="column_count"))
        f.append(_m(lambda: gr.size_change_pct(*sides()), "size_change_pct", "pct",
                             current="current_count", previous="previous_count", measured="pct",
                             status="status"))
        if profile.feed_id_col and _have(c, profile.feed_id_col) and _have(p, profile.feed_id_col):
            fc = once(lambda: gr.feed_id_counts(*sides(profile.feed_id_col), profile.feed_id_col))
            f.append(_m(fc, "feed_id_counts", F.col("snapshot"), measured="id_count"))

    # Country cardinality.
    if _have(c, "country"):
        cc = once(lambda: gr.cardinality(c, "country", "country_count"))
        f.append(_f(lambda: cc().where(F.col("status") == "multiple"), "country_cardinality",
                    column_name="country", value="country_count"))

    # Every row rule in one pass.
    f.append(_row_part(c, profile))

    f.extend(extra(c, p, sides))

    # Drift against the previous snapshot.
    if p is not None:
        f.append(_f(lambda: cmp.stores_not_in_current(*sides()), "stores_not_in_current", entity="store_id"))

    # Scrape dates.
    if profile.date_col and _have(c, profile.date_col):
        f.append(_f(lambda: gr.scrape_dates(c, profile.date_col), "scrape_dates", value="date_extracted"))

    return SuiteResult.of(spark, f), c, p, sides


def listing_suite(cur: DataFrame, prev: DataFrame | SnapshotState | None, profile: Profile,
                  materialize: bool = True) -> SuiteResult:
    """M1/M3: the price-listing suite (``prev=None`` gives the single-snapshot form; a ``SnapshotState`` stands for a
    previous snapshot that is not read again)."""
    def extra(c, p, sides):
        out = []
        if _have(c, *DUPLICATE_PRODUCT_KEYS):
            out.append(_f(lambda: gr.duplicate_entities(c, DUPLICATE_PRODUCT_KEYS), "duplicate_products",
                          entity="store_id"))
        if p is not None and _have(c, profile.category_col) and _have(p, profile.category_col):
            out.append(_f(lambda: cmp.categories_not_in_current(*sides(profile.category_col), profile.category_col),
                          "categories_not_in_current", column_name=profile.category_col,
                          entity="store_id", value="category"))
        return out

    return _two_snapshot_suite(cur, prev, profile, materialize, "competitor_check", extra)[0]


def review_suite(cur: DataFrame, prev: DataFrame | SnapshotState | None, profile: Profile,
                 materialize: bool = True) -> SuiteResult:
    """M2: the store-review suite; a retailer mismatch adds per-retailer counts."""
    res, c, p, sides = _two_snapshot_suite(cur, prev, profile, materialize, "retailer_check", lambda c, p, sides: [])
    col = profile.group_col
    if p is None or not col or col not in c.columns or (isinstance(p, SnapshotState) and col not in p.columns):
        return res
    gc = once(lambda: gr.group_counts(*sides(col), col))
    more = [_m(gc, "retailer_counts", F.concat(F.col(col), F.lit("_rows")), current="current_rows", previous="previous_rows"),
            _m(gc, "retailer_counts", F.concat(F.col(col), F.lit("_stores")), current="current_stores",
               previous="previous_stores")]
    return SuiteResult.of(cur.sparkSession, res.parts + more)


def stat_suite(cur: DataFrame, prev: DataFrame | SnapshotState, profile: Profile, as_of,
               materialize: bool = True) -> SuiteResult:
    """M4: the statistical suite (no de-duplication, thresholds from the profile)."""
    spark = cur.sparkSession
    c = _prepare(cur, profile, "stat-current", materialize)
    kept = isinstance(prev, SnapshotState)
    p = _same_treatment(prev, profile) if kept else _prepare(prev, profile, "stat-previous", materialize)
    # Rules on stores read one ledger of each snapshot, not the snapshots.
    about = [profile.entity_col, profile.consistency_col, *STORE_METADATA_COLUMNS, "lat_num", "lon_num"]
    cl = store_ledger(c, about)
    if kept:
        pl = p.pairs(profile.consistency_col) if _have(p, profile.consistency_col) else p.stores()
    else:
        pl = store_ledger(p, [profile.consistency_col])
    if materialize:
        cl, pl = land(cl, "stat-current-stores"), pl if kept else land(pl, "stat-previous-stores")
    previous = p.values if kept else lambda column: p
    f: list[Part] = []

    text_fields = [x for x in TEXT_SYMBOL_FIELDS if x in c.columns]
    need = ([profile.entity_col, profile.price_col, profile.zip_col, profile.date_col, "latitude",
             "longitude", profile.consistency_col] + list(STORE_METADATA_COLUMNS)
            + list(DUPLICATE_LISTING_KEYS) + list(UNIFORM_PRICE_KEYS) + list(TEXT_SYMBOL_FIELDS))
    f.extend(_missing(spark, c, [x for x in need if x]))
    f.extend(_missing(spark, p, [x for x in need if x in c.columns], "previous"))

    if _have(c, profile.date_col):
        d = once(lambda: rr.date_month_mismatch(c, as_of, profile.date_col))
        f.append(_f(d, "date_month_mismatch", column_name=profile.date_col,
                    value="date_extracted", detail="n"))
        f.append(_f(lambda: gr.scrape_dates(c, profile.date_col), "scrape_dates", value="date_extracted"))
    if _have(p, profile.date_col):
        f.append(_f(lambda: gr.scrape_dates(previous(profile.date_col), profile.date_col), "scrape_dates_previous", value="date_extracted"))
    if _have(c, profile.consistency_col) and _have(p, profile.consistency_col):
        f.append(_f(lambda: gr.distinct_field_values(cl, pl, [profile.consistency_col]), "distinct_field_values",
                    column_name=F.col("field"), value="value", detail="snapshot"))

    cm = once(lambda: gr.count_margin(cl, pl, profile.count_margin_pct))
    f.append(_f(lambda: cm().where(F.col("status") == "flag"), "count_margin", value="pct"))
    f.append(_m(cm, "count_margin", "pct", current="current_count", previous="previous_count",
                         measured="pct", threshold=profile.count_margin_pct, status="status"))

    f.append(_f(lambda: st.store_count_outliers(cl, profile.iqr_factor), "store_count_outliers",
                entity="store_id", value="n"))

    if _have(c, profile.price_col):
        q = once(lambda: st.price_quartiles(c))
        f.append(_m(q, "price_quartiles", "q1", measured="q1"))
        f.append(_m(q, "price_quartiles", "q3", measured="q3"))
        f.append(_m(lambda: gr.top_values(c, "price_num", 5), "top_prices", "price", measured="price_num"))
        f.append(_f(lambda: st.price_outliers(c, profile.iqr_factor, q()), "price_outliers",
                    entity="store_id", value="price_num"))
        f.append(_f(lambda: rr.long_price(c, profile.price_col), "long_price", column_name=profile.price_col, value="price"))
        if _have(p, profile.price_col):
            f.append(_f(lambda: rr.long_price(previous(profile.price_col), profile.price_col), "long_price_previous",
                        column_name=profile.price_col, value="price"))
        f.append(_f(lambda: rr.price_dollar_sign(c, profile.price_col), "price_dollar_sign",
                    column_name=profile.price_col, value="price"))
        f.append(_f(lambda: rr.price_comma(c, profile.price_col), "price_comma",
                    column_name=profile.price_col, value="price"))

    if _have(c, profile.zip_col):
        f.append(_f(lambda: rr.zip_non_numeric(c, profile.zip_col), "zip_non_numeric",
                    column_name=profile.zip_col, value="zip_code"))
        f.append(_f(lambda: rr.zip_bad_length(c, profile.zip_col), "zip_bad_length",
                    column_name=profile.zip_col, value="zip_code"))
        f.append(_m(lambda: rr.zip_numeric_count(c, profile.zip_col), "zip_numeric_count", "rows",
                             measured="n"))

    if _have(c, "latitude", "longitude"):
        f.append(_f(lambda: gr.store_multi_location(cl), "store_multi_location", entity="store_id",
                    value="unique_locations"))
        f.append(_f(lambda: gr.location_multi_store(cl), "location_multi_store",
                    value=F.format_string("%s,%s", "lat4", "lon4"), detail="store_count"))
        f.append(_f(lambda: rr.outside_boxes(c, profile.geo_boxes), "outside_geo_box", entity="store_id",
                    value=F.format_string("%s,%s", "latitude", "longitude")))

    ms = once(lambda: cmp.missing_store_pct(cl, pl, profile.missing_store_pct))
    f.append(_f(lambda: ms().where(F.col("status") == "flag"), "missing_store_pct", value="pct_missing",
                detail="missing_count"))
    f.append(_m(ms, "missing_store_pct", "pct", current="missing_count", previous="previous_total",
                         measured="pct_missing", threshold=profile.missing_store_pct, status="status"))
    f.append(_f(lambda: cmp.stores_with_fewer_rows(cl, pl), "stores_with_fewer_rows", entity="store_id"))

    ee = once(lambda: rr.empty_entity_id(cl, profile.entity_col))
    f.append(_f(lambda: ee().where(F.col("n") > 0), "empty_entity_id", column_name=profile.entity_col, value="n"))

    meta = [x for x in STORE_METADATA_COLUMNS if x in c.columns]
    if meta:
        f.append(_f(lambda: gr.store_metadata_conflicts(cl, meta), "store_metadata_conflicts", entity="store_id"))
    if _have(c, *[k for k in DUPLICATE_LISTING_KEYS if k != "store_id"]):
        f.append(_f(lambda: gr.duplicate_groups(c, DUPLICATE_LISTING_KEYS), "duplicate_listing_groups",
                    entity="store_id", value="n"))
    if _have(c, *UNIFORM_PRICE_KEYS):
        f.append(_f(lambda: gr.uniform_groups(c, UNIFORM_PRICE_KEYS), "uniform_pricing",
                    value=F.concat_ws("|", *UNIFORM_PRICE_KEYS)))
    if text_fields:
        ts = once(lambda: rr.text_symbol_counts(c, text_fields))
        f.append(_f(lambda: ts().where(F.col("n") > 0), "text_symbol_counts", value="symbol", detail="n"))

    return SuiteResult.of(spark, f)
