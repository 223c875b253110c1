"""Rules that meet a fault in every row of a large snapshot: same findings, combined by store before the shuffle."""

import re
from dataclasses import replace

from pyspark.sql import functions as F

from driftwatch.functions.text import NOT_SPACE, UNICODE_SPACE, is_blank, spelled_out
from driftwatch.operators import group_rules as gr
from driftwatch.operators import row_rules as rr
from driftwatch.operators.clean import clean_snapshot
from driftwatch.plans import registry
from driftwatch.plans import suite as su
from driftwatch.profiles import (
    DUPLICATE_PRODUCT_KEYS, FEED_SYMBOL_PATTERNS, LISTING, LISTING_SYMBOL_PATTERNS, REVIEW_SYMBOL_PATTERNS,
)
from driftwatch.sources.landing import land
from test_rules import row, snap

SF = "/root/testdata/sf0.001"
CHARS = [chr(i) for i in range(1, 256)] + ["ſ", "K", " ", "　", "é", "😀"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spelled_out_class_matches_the_same_characters(spark):
    patterns = {*LISTING_SYMBOL_PATTERNS.values(), *REVIEW_SYMBOL_PATTERNS.values(),
                *(p for x in FEED_SYMBOL_PATTERNS.values() for p in x.values())}
    texts = spark.createDataFrame([(ch,) for ch in CHARS], "x string")
    for p in patterns:
        assert texts.where(F.col("x").rlike(p) != F.col("x").rlike(spelled_out(p))).count() == 0, p
    assert [spelled_out(p) for p in ("[*]", "^a", "[^a&&[b]]", r"[^\p{L}]", "[^é]", "x[^a]")] == [None] * 6


def test_blank_is_stripped_to_nothing(spark):
    texts = ["", UNICODE_SPACE, "\x00", "a", "  a", "　 ", " é", "​", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").select("i", is_blank(F.col("x"))).collect()
    assert [b for _, b in sorted(map(tuple, got))] == [t is None or not t.strip() for t in texts]
    assert re.match(NOT_SPACE, "a")


def test_symbols_are_judged_on_the_stripped_text(spark):
    c = clean_snapshot(snap(spark, [row(sid="S1", price=" 5\t"), row(sid="S2", price=" 5 5 "), row(sid="S3", name="N#")] * 3
                            + [row(sid=None, name="N#"), row(sid="S3", name="N", product="*")]), LISTING)
    assert sorted(map(tuple, rr.symbol_violations(c, LISTING).collect())) == [("price", "S2"), ("product", "S3"), ("store_name", "S3")]


def test_row_findings_keep_null_values_and_null_stores_apart(spark):
    c = clean_snapshot(snap(spark, [row(sid="S1", zip_code=None, lat="99.5"), row(sid="S1", zip_code="ABCDE", lat="99.5"),
                                    row(sid=None, zip_code="ABCDE", price="0"), row(sid="S1", price="0")] * 2), LISTING)
    got = sorted((r.check_id, r.column_name, r.entity_id or "", r.value or "") for r in rr.fused_row_findings(c, LISTING).collect())
    assert got == [("invalid_latitude", "latitude", "S1", "99.5"), ("invalid_zip", "zip_code", "", "ABCDE"),
                   ("invalid_zip", "zip_code", "S1", ""), ("invalid_zip", "zip_code", "S1", "ABCDE"),
                   ("null_violations", "zip_code", "S1", ""), ("zero_price", "price", "S1", "")]


def test_violations_are_combined_by_store_before_they_are_listed(spark):
    for name in ("feed_symbol_violations", "symbol_violations", "null_violations"):
        p = plan(registry.queries()[name](spark, SF))
        assert p.index("Generate explode") < p.index("Exchange hashpartitioning"), name


# --------------------------------------------------------------------------
# The listing suite's landings and report
# --------------------------------------------------------------------------


def test_previous_snapshot_is_read_into_its_store_ledger(spark, monkeypatch):
    landed = {}
    monkeypatch.setattr(su, "land", lambda df, name: (landed.update({name: df}), land(df, name))[1])
    cur = snap(spark, [row(sid="S1"), row(sid="S1"), row(sid="S2", competitor="C2"), row(sid="S3", lat="-0.0")])
    prev = snap(spark, [row(sid="S1", category="B")] * 3 + [row(sid="S9"), row(sid=None)])
    res = su.listing_suite(cur, prev, LISTING)
    assert set(landed["previous-stores"].columns) == {"sid", "category", "competitor", "_rows"}
    assert not any(x in line for line in plan(landed["current-distinct"]).splitlines() if "Exchange hash" in line
                   for x in ("price_num", "lat_num", "zip_clean"))
    got = {(r.check_id, r.entity_id, r.value) for r in res.findings.collect()}
    assert {("stores_not_in_current", "S9", None), ("stores_not_in_current", None, None), ("categories_not_in_current", "S1", "B"),
            ("competitor_check", None, None), ("duplicate_rows", None, "1"), ("invalid_latitude", "S3", "0.0")} <= got
    size = {(r.check_id, r.metric): r.measured for r in res.metrics.collect()}
    assert size["snapshot_counts", "current_rows"] == 3 and size["snapshot_counts", "previous_rows"] == 5
    assert size["snapshot_counts", "previous_stores"] == 2

    once = su.listing_suite(cur, prev, replace(LISTING, dedupe_previous=True))
    assert {r.metric: r.measured for r in once.metrics.where("check_id = 'snapshot_counts'").collect()}["previous_rows"] == 3


def test_report_reads_checks_that_were_run_once(spark):
    files = registry.listing_report(spark, SF).inputFiles()
    assert any("/findings-" in f for f in files) and any("/metrics-" in f for f in files)
    assert not any("/current-" in f or "/previous-" in f for f in files)


def test_duplicate_entities_do_not_count_copies(spark, monkeypatch):
    rows = ([row(sid="S1")] * 3 + [row(sid="S2"), row(sid="S2", price="6.0")] + [row(sid="S3"), row(sid="S3", category="B")]
            + [row(sid="S4", addr=None), row(sid="S4", addr="1 Main")] + [row(sid=None), row(sid=None, price="7")]
            + [row(sid="S5")] * 2 + [row(sid="S5", price=None), row(sid=" S6"), row(sid="S6")])
    c = clean_snapshot(snap(spark, rows), LISTING)
    want = sorted(r[0] for r in gr.duplicate_entities(c.dropDuplicates(), DUPLICATE_PRODUCT_KEYS).collect())
    assert want == ["S2", "S4", "S5", "S6"]
    find = lambda: sorted(r[0] for r in gr.duplicate_entities_without_copies(c, DUPLICATE_PRODUCT_KEYS, land).collect())
    assert find() == want
    monkeypatch.setattr(F, "xxhash64", lambda *cols: F.length(F.concat_ws("", *cols)).cast("bigint") % 1)     # all hashes alike
    assert find() == want


def test_duplicate_products_shuffles_no_whole_rows(spark, monkeypatch):
    landed = []
    monkeypatch.setattr(registry, "land", lambda df, name: (landed.append(df), land(df, name))[1])
    registry.queries()["duplicate_products"](spark, SF)
    assert landed and all("store_address" not in line and "latitude" not in line for line in plan(landed[0]).splitlines()
                          if "Exchange hash" in line)
