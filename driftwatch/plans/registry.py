"""

Each callable takes ``(spark, sf_dir)``, builds the fixture snapshot(s) from
the given tables and applies one operator.  Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as cmp
from ..operators import group_rules as gr
from ..operators import row_rules as rr
from ..operators import schema as sch
from ..operators import stats as st
from ..operators import state as sst
from ..operators.clean import clean_listing, clean_snapshot
from ..profiles import (
    DUPLICATE_LISTING_KEYS, DUPLICATE_PRODUCT_KEYS, LISTING, REVIEW, UNIFORM_PRICE_KEYS,
    listing_profile,
)
from ..sources import fixtures as fx
from ..sources.csv import csv_round_trip, read_delimited
from ..sources.landing import land, land_delimited, landing_folder
from . import findings as fnd
from . import suite as su
from .isolation import check_ids

Query = Callable[[SparkSession, str], DataFrame]

TMAD = listing_profile(feed_type="TMAD")


def cur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole listing, cleaned, as one snapshot."""
    return clean_snapshot(fx.whole_listing(spark, sf_dir), LISTING)


def cur_prev(spark: SparkSession, sf_dir: str):
    c, p = fx.listing_snapshots(spark, sf_dir)
    return clean_snapshot(c, LISTING), clean_snapshot(p, LISTING)


def review_cur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_snapshot(fx.whole_review(spark, sf_dir), REVIEW)


ROW_QUERIES: dict[str, Query] = {
    "clean_listing": lambda s, d: clean_listing(fx.whole_listing(s, d), LISTING),
    "invalid_latitude": lambda s, d: rr.invalid_latitude(cur(s, d), LISTING),
    "invalid_longitude": lambda s, d: rr.invalid_longitude(cur(s, d), LISTING),
    "outside_geo_box": lambda s, d: rr.outside_geo_box(cur(s, d)),
    "outside_any_geo_box": lambda s, d: rr.outside_any_geo_box(cur(s, d)),
    "invalid_zip": lambda s, d: rr.invalid_zip(cur(s, d), LISTING),
    "zip_non_numeric": lambda s, d: rr.zip_non_numeric(fx.whole_listing(s, d)),
    "zip_numeric_count": lambda s, d: rr.zip_numeric_count(fx.whole_listing(s, d)),
    "zip_bad_length": lambda s, d: rr.zip_bad_length(fx.whole_listing(s, d)),
    "postal_format_mix": lambda s, d: rr.postal_format_mix(fx.whole_listing(s, d)),
    "null_violations": lambda s, d: rr.null_violations(cur(s, d), LISTING),
    "null_violations_feed": lambda s, d: rr.null_violations(clean_snapshot(fx.whole_listing(s, d), TMAD), TMAD),
    "review_null_violations": lambda s, d: rr.null_violations(review_cur(s, d), REVIEW),
    "zero_price": lambda s, d: rr.zero_price(cur(s, d)),
    "symbol_violations": lambda s, d: rr.symbol_violations(cur(s, d), LISTING),
    "feed_symbol_violations": lambda s, d: rr.symbol_violations(
        clean_snapshot(fx.whole_listing(s, d), TMAD), TMAD),
    "review_symbol_violations": lambda s, d: rr.symbol_violations(review_cur(s, d), REVIEW),
    "text_symbol_counts": lambda s, d: rr.text_symbol_counts(fx.whole_listing(s, d)).unionByName(
        rr.text_symbol_counts(fx.documents(s, d), ["text"], source="documents")),
    "text_symbol_rows": lambda s, d: rr.text_symbol_rows(fx.documents(s, d), "doc_id", ["text"]),
    "long_price": lambda s, d: rr.long_price(fx.whole_listing(s, d)),
    "price_dollar_sign": lambda s, d: rr.price_dollar_sign(fx.whole_listing(s, d)),
    "price_comma": lambda s, d: rr.price_comma(fx.whole_listing(s, d)),
    "date_month_mismatch": lambda s, d: rr.date_month_mismatch(fx.whole_listing(s, d), fx.AS_OF),
    "empty_entity_id": lambda s, d: rr.empty_entity_id(fx.whole_listing(s, d)),
}


def cur_prev_dedup(spark: SparkSession, sf_dir: str):
    """Current de-duplicated on full rows (as the two-snapshot suites do), previous as is."""
    c, p = fx.listing_snapshots(spark, sf_dir)
    return clean_snapshot(c.dropDuplicates(), LISTING), clean_snapshot(p, LISTING)


def review_cur_prev(spark: SparkSession, sf_dir: str, dedupe_current: bool = True):
    c, p = fx.review_snapshots(spark, sf_dir)
    if dedupe_current:
        c = c.dropDuplicates()
    return clean_snapshot(c, REVIEW), clean_snapshot(p, REVIEW)


def three_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_snapshot(fx.listing_history(spark, sf_dir), LISTING)


def _docs_text(s, d):
    return fx.documents(s, d, columns=("text",))


def listing_column_count(spark: SparkSession, sf_dir: str) -> int:
    """Columns of a raw listing snapshot (schema only, no job)."""
    return len(fx.whole_listing(spark, sf_dir).columns)


PRICE_KEYS_WITH_ID = ("store_id", "product_id")
PRICE_KEYS_WITHOUT_ID = ("store_id", "category", "product", "type", "subtype_size", "addition")


def _price_change(keys):
    return lambda s, d: cmp.price_change(three_snapshots(s, d), keys, fx.CURRENT, fx.PREVIOUS, fx.BEFORE_PREVIOUS)


GROUP_QUERIES: dict[str, Query] = {
    "snapshot_counts": lambda s, d: gr.snapshot_counts(*cur_prev_dedup(s, d), listing_column_count(s, d)),
    "size_change_pct": lambda s, d: gr.size_change_pct(*cur_prev_dedup(s, d)),
    "count_margin": lambda s, d: gr.count_margin(*cur_prev(s, d), LISTING.count_margin_pct),
    "feed_id_counts": lambda s, d: gr.feed_id_counts(*cur_prev(s, d), "tmad_id"),
    "retailer_counts": lambda s, d: gr.group_counts(*review_cur_prev(s, d), "retailer"),
    "competitor_check": lambda s, d: gr.single_value_check(*cur_prev(s, d), "competitor"),
    "competitor_values": lambda s, d: gr.distinct_values(cur(s, d), "competitor"),
    "country_cardinality": lambda s, d: gr.cardinality(cur(s, d), "country", "country_count"),
    "store_row_counts": lambda s, d: st.store_row_counts(cur(s, d)),
    "price_quartiles": lambda s, d: st.price_quartiles(cur(s, d)),
    "store_count_outliers": lambda s, d: st.store_count_outliers(cur(s, d), LISTING.iqr_factor),
    "price_outliers": lambda s, d: st.price_outliers(cur(s, d), LISTING.iqr_factor),
    "store_multi_location": lambda s, d: gr.store_multi_location(cur(s, d)),
    "location_multi_store": lambda s, d: gr.location_multi_store(cur(s, d)),
    "store_metadata_conflicts": lambda s, d: gr.store_metadata_conflicts(cur(s, d)),
    "duplicate_listing_groups": lambda s, d: gr.duplicate_groups(cur(s, d), DUPLICATE_LISTING_KEYS),
    # the parsed columns follow from the raw ones: rows that differ in them differ in those
    "duplicate_products": lambda s, d: gr.duplicate_entities_without_copies(
        cur(s, d).drop("price_num", "zip_clean", "lat_num", "lon_num"), DUPLICATE_PRODUCT_KEYS, land),
    "uniform_pricing": lambda s, d: gr.uniform_groups(cur(s, d), UNIFORM_PRICE_KEYS),
    "categories_per_product_store": lambda s, d: gr.categories_per_product_store(cur(s, d)),
    "scrape_dates": lambda s, d: gr.scrape_dates(cur(s, d)),
    "distinct_field_values": lambda s, d: gr.distinct_field_values(*cur_prev(s, d), ["competitor"]),
    "duplicate_row_count": lambda s, d: gr.duplicate_row_count(_docs_text(s, d)),
    "duplicate_rows": lambda s, d: gr.duplicate_row_groups(_docs_text(s, d)),
    "dedupe_rows": lambda s, d: gr.dedupe_rows(_docs_text(s, d)),
    "stores_not_in_current": lambda s, d: cmp.stores_not_in_current(*cur_prev(s, d)),
    "missing_store_pct": lambda s, d: cmp.missing_store_pct(*cur_prev(s, d), LISTING.missing_store_pct),
    "stores_with_fewer_rows": lambda s, d: cmp.stores_with_fewer_rows(*cur_prev(s, d)),
    "categories_not_in_current": lambda s, d: cmp.categories_not_in_current(*cur_prev(s, d)),
    "price_change_with_product_id": _price_change(PRICE_KEYS_WITH_ID),
    "price_change_without_product_id": _price_change(PRICE_KEYS_WITHOUT_ID),
    "top_prices": lambda s, d: gr.top_values(cur(s, d), "price_num", 5),
}


def read_quoted_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents delivered as delimited files (texts with line breaks) and read back by the splitting reader."""
    path = land_delimited(fx.documents(spark, sf_dir).select("doc_id", "text"), "documents-csv")
    rows = read_delimited(spark, path, ",", multiline=True)
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


HEADER_QUERIES: dict[str, Query] = {
    "detect_delimiter": lambda s, d: sch.detect_delimiters(fx.delivered_files(s, d), "file_id", "text"),
    "normalize_headers": lambda s, d: sch.normalize_headers(fx.delivered_files(s, d), "file_id", "text"),
    "standardize_listing": lambda s, d: sch.standardize_headers(fx.delivered_files(s, d), "file_id", "text", LISTING),
    "standardize_review": lambda s, d: sch.standardize_headers(fx.delivered_files(s, d), "file_id", "text", REVIEW),
    "missing_columns": lambda s, d: sch.missing_header_columns(fx.delivered_files(s, d), "file_id", "text", LISTING),
    "read_listing_csv": lambda s, d: csv_round_trip(
        fx.whole_listing(s, d), ["store_id", "product_id", "price", "zip_code"]),
    "read_quoted_csv": read_quoted_csv,
}


def listing_suite(spark: SparkSession, sf_dir: str) -> su.SuiteResult:
    c, p = fx.listing_snapshots(spark, sf_dir)
    return su.listing_suite(c, p, LISTING)


def review_suite(spark: SparkSession, sf_dir: str) -> su.SuiteResult:
    c, p = fx.review_snapshots(spark, sf_dir)
    return su.review_suite(c, p, REVIEW)


def stat_suite(spark: SparkSession, sf_dir: str) -> su.SuiteResult:
    c, p = fx.listing_snapshots(spark, sf_dir)
    return su.stat_suite(c, p, LISTING, fx.AS_OF)


def kept_state(spark: SparkSession, snapshot: DataFrame, profile) -> sst.SnapshotState:
    """A snapshot's state, written to a folder and read back as the next run would."""
    path = landing_folder(spark, "snapshot-state")
    return sst.read_state(spark, sst.write_state(sst.state_of(snapshot, profile), path, profile), profile)


def snapshot_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts kept of the whole listing, as read back."""
    facts = kept_state(spark, fx.whole_listing(spark, sf_dir), TMAD).facts
    return facts.select("field", F.col("sid").alias("store_id"), "value", F.col("_rows").alias("n"))


def listing_suite_from_state(spark: SparkSession, sf_dir: str) -> su.SuiteResult:
    c, p = fx.listing_snapshots(spark, sf_dir)
    return su.listing_suite(c, kept_state(spark, p, LISTING), LISTING)


def stat_suite_from_state(spark: SparkSession, sf_dir: str) -> su.SuiteResult:
    c, p = fx.listing_snapshots(spark, sf_dir)
    return su.stat_suite(c, kept_state(spark, p, LISTING), LISTING, fx.AS_OF)


def listing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing suite's report: sections, metrics, findings and pass lines."""
    res = listing_suite(spark, sf_dir)
    # the report reads both several times: the checks are run once, for what is written
    findings, metrics = land(res.findings, "findings"), land(res.metrics, "metrics")
    return fnd.report(findings, metrics, check_ids(res.parts))


SUITE_QUERIES: dict[str, Query] = {
    "listing_suite_summary": lambda s, d: fnd.summary(listing_suite(s, d).findings),
    "review_suite_summary": lambda s, d: fnd.summary(review_suite(s, d).findings),
    "stat_suite_summary": lambda s, d: fnd.summary(stat_suite(s, d).findings),
    "findings_by_severity": lambda s, d: fnd.findings_by_severity(listing_suite(s, d).findings),
    "findings_sample": lambda s, d: fnd.findings_sample(listing_suite(s, d).findings, 5),
    "report_lines": lambda s, d: fnd.report_lines(listing_suite(s, d).findings),
    "listing_report": listing_report,
    "snapshot_state": snapshot_state,
    "listing_suite_from_state": lambda s, d: fnd.summary(listing_suite_from_state(s, d).findings),
    "stat_suite_from_state": lambda s, d: fnd.summary(stat_suite_from_state(s, d).findings),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(SUITE_QUERIES)
    out.update(ROW_QUERIES)
    out.update(GROUP_QUERIES)
    out.update(HEADER_QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    from . import oracle_sql as o

    out: dict[str, str] = {}
    out.update(o.ROW_SQL)
    out.update(o.GROUP_SQL)
    out.update(o.HEADER_SQL)
    out.update(o.SUITE_SQL)
    return out
