"""Edge cases of the semantics decided in SURVEY 2A, on tiny in-memory frames,
plus brute-force checks of the operators Spark has no single built-in for."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from driftwatch.operators import compare as cmp
from driftwatch.operators import group_rules as gr
from driftwatch.operators import row_rules as rr
from driftwatch.operators import stats as st
from driftwatch.operators.clean import clean_snapshot
from driftwatch.plans import suite as su
from driftwatch.plans.findings import findings_sample, summary
from driftwatch.profiles import LISTING, REVIEW

COLS = ("store_id string, store_name string, store_address string, city string, state string, "
        "country string, category string, product string, type string, subtype_size string, "
        "addition string, product_id string, competitor string, price string, zip_code string, "
        "latitude string, longitude string, date_extracted string")


def row(sid="S1", price="5.0", zip_code="02108", lat="40.1", lon="-75.2", category="A",
        product="P", competitor="C1", name="N", addr="1 Main", date="2000-07-02 10:00:00"):
    return (sid, name, addr, "City", "ST", "USA", category, product, "T", "1", "base", "11",
            competitor, price, zip_code, lat, lon, date)


def snap(spark, rows):
    return spark.createDataFrame(rows, COLS)


def cl(spark, rows):
    return clean_snapshot(snap(spark, rows), LISTING)


def test_null_zip_is_invalid_and_empty(spark):                      # S3
    c = cl(spark, [row(zip_code=None), row(sid="S2", zip_code="  ")])
    assert {tuple(r) for r in rr.invalid_zip(c, LISTING).collect()} == {("S1", None), ("S2", None)}
    nv = {tuple(r) for r in rr.null_violations(c, LISTING).collect()}
    assert ("zip_code", "S1") in nv and ("zip_code", "S2") in nv


def test_unparsable_coordinate_is_empty_not_invalid(spark):         # S1, S28
    c = cl(spark, [row(lat="n/a"), row(sid="S2", lat="NaN"), row(sid="S3", lat="99.5")])
    assert [r["store_id"] for r in rr.invalid_latitude(c, LISTING).collect()] == ["S3"]
    nv = {tuple(r) for r in rr.null_violations(c, LISTING).collect()}
    assert {("latitude", "S1"), ("latitude", "S2")} <= nv


def test_symbol_rule_reads_raw_text(spark):                          # S2
    c = cl(spark, [row(price="$5"), row(sid="S2", lon="-75.2")])
    sv = {tuple(r) for r in rr.symbol_violations(c, LISTING).collect()}
    assert ("price", "S1") in sv
    assert ("longitude", "S2") not in sv


def test_null_coordinate_not_outside_box(spark):                     # S18
    c = cl(spark, [row(lat=None), row(sid="S2", lat="10.0")])
    assert [r["store_id"] for r in rr.outside_geo_box(c).collect()] == ["S2"]


def test_zero_price_and_blank_store_dropped(spark):                  # D13, S9
    c = cl(spark, [row(price="0.00"), row(sid=" ", price="0")])
    assert [r[0] for r in rr.zero_price(c).collect()] == ["S1"]
    assert rr.empty_entity_id(snap(spark, [row(sid=" "), row(sid=None), row()])).first()["n"] == 2


def test_null_previous_store_always_missing(spark):                  # S7
    c = cl(spark, [row(sid="S1")])
    p = cl(spark, [row(sid="S1"), row(sid=None), row(sid="S9")])
    assert {r[0] for r in cmp.stores_not_in_current(c, p).collect()} == {None, "S9"}


def test_missing_store_pct_is_null_safe(spark):                      # G2, S7
    c = cl(spark, [row(sid=None), row(sid="S1")])
    p = cl(spark, [row(sid=None), row(sid="S1"), row(sid="S2")])
    r = cmp.missing_store_pct(c, p, 1.0).first()
    assert (r["missing_count"], r["previous_total"], r["status"]) == (1, 3, "flag")


def test_fewer_rows_equals_except_all(spark):                        # G3
    rnd = random.Random(7)
    cur = [row(sid=rnd.choice(["S1", "S2", "S3", None])) for _ in range(40)]
    prev = [row(sid=rnd.choice(["S1", "S2", "S3", "S4", None])) for _ in range(40)]
    c, p = cl(spark, cur), cl(spark, prev)
    got = {r[0] for r in cmp.stores_with_fewer_rows(c, p).collect()}
    exp = {r[0] for r in p.select("sid").exceptAll(c.select("sid")).distinct().collect()}
    assert got == exp


def test_lost_categories_null_safe(spark):                           # S8, G4
    c = cl(spark, [row(category=None), row(category="B")])
    p = cl(spark, [row(category=None), row(category="A"), row(sid="S7", category="Z")])
    assert {tuple(r) for r in cmp.categories_not_in_current(c, p).collect()} == {("S1", "A")}


def test_multi_location_ignores_null_pairs(spark):                   # E15
    c = cl(spark, [row(lat="40.1"), row(lat="40.2"), row(sid="S2", lat="40.1"), row(sid="S2", lat=None)])
    assert {tuple(r) for r in gr.store_multi_location(c).collect()} == {("S1", 2)}


def test_single_value_check(spark):                                  # E7
    c = cl(spark, [row(competitor="X"), row(competitor=None)])
    p = cl(spark, [row(competitor="X")])
    assert gr.single_value_check(c, p, "competitor").first()["status"] == "ok"
    p2 = cl(spark, [row(competitor="Y")])
    assert gr.single_value_check(c, p2, "competitor").first()["status"] == "mismatch"


def test_size_change_status(spark):                                  # S11, S12
    a = cl(spark, [row(), row(sid="S2")])
    b = cl(spark, [row()])
    assert gr.size_change_pct(a, b).first()["status"] == "increased"
    assert gr.size_change_pct(a, a).first()["status"] == "unchanged"
    e = a.where("false")
    r = gr.count_margin(e, e, 2.0).first()
    assert r["pct"] is None and r["status"] == "empty"


def _disc(values, p):
    v = sorted(values)
    return float(v[max(1, math.ceil(p * len(v))) - 1])


@settings(max_examples=15, deadline=None)
@given(hs.lists(hs.integers(min_value=-50, max_value=50), min_size=1, max_size=60),
       hs.sampled_from([0.1, 0.25, 0.5, 0.75, 0.9]))
def test_exact_quantile_matches_brute_force(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = st.exact_quantiles(df, "x", [p], ["q"], buckets=4).first()["q"]
    assert got == _disc(values, p)


def test_exact_quantile_with_hot_value_and_nulls(spark):
    vals = [7.0] * 3000 + [float(i) for i in range(6000)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(8)
    r = st.quartiles(df, "x").first()
    real = [v for v in vals if v is not None]
    assert (r["q1"], r["q3"]) == (_disc(real, 0.25), _disc(real, 0.75))


def test_price_outliers_brute_force(spark):
    prices = [10, 11, 12, 12, 13, 14, 15, 100, -40, None]
    c = cl(spark, [row(sid=f"S{i}", price=None if v is None else str(v)) for i, v in enumerate(prices)])
    real = [float(v) for v in prices if v is not None]
    q1, q3 = _disc(real, 0.25), _disc(real, 0.75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    exp = {f"S{i}" for i, v in enumerate(prices) if v is not None and (v < lo or v > hi)}
    assert {r["store_id"] for r in st.price_outliers(c, 1.5).collect()} == exp


def test_price_change_brute_force(spark):
    y = [("S1", "11", "5.0", 2000), ("S1", "11", "5.0", 1999), ("S1", "11", "6.0", 1998),
         ("S2", "22", "7.0", 2000), ("S2", "22", "7.0", 1999), ("S2", "22", "7.0", 1998),
         ("S3", "33", "1.0", 2000), ("S3", "33", "2.0", 1999)]
    df = spark.createDataFrame(y, "store_id string, product_id string, price string, yr int")
    out = cmp.price_change(clean_snapshot(df, LISTING), ("store_id", "product_id"), 2000, 1999, 1998, "yr")
    assert [tuple(r) for r in out.collect()] == [("S1", "11", 5.0, 5.0, 6.0)]


def test_suite_no_drift_when_current_equals_previous(spark):         # metamorphic
    rows = [row(), row(sid="S2", category="B")]
    res = su.listing_suite(snap(spark, rows), snap(spark, rows), LISTING, materialize=False)
    ids = {r["check_id"] for r in res.findings.collect()}
    assert not ids & {"stores_not_in_current", "categories_not_in_current", "competitor_check"}


def test_suite_invariant_under_repartition_and_bad_row(spark):       # metamorphic
    rows = [row(sid=f"S{i % 5}", price=str(i)) for i in range(30)]
    a = su.listing_suite(snap(spark, rows), snap(spark, rows), LISTING, materialize=False)
    b = su.listing_suite(snap(spark, rows).repartition(7), snap(spark, rows).repartition(3), LISTING,
                         materialize=True)
    def counts(res):
        return {r["check_id"]: r["n"] for r in summary(res.findings).collect()}
    assert counts(a) == counts(b)
    bad = rows + [row(sid="S9", zip_code="ABCDE")]
    c = counts(su.listing_suite(snap(spark, bad), snap(spark, rows), LISTING, materialize=False))
    assert c["invalid_zip"] == counts(a).get("invalid_zip", 0) + 1


def test_findings_sample_bounded(spark):
    rows = [row(sid=f"S{i}", zip_code="bad") for i in range(20)]
    res = su.listing_suite(snap(spark, rows), None, LISTING, materialize=False)
    per = {r["check_id"]: r["n"] for r in summary(findings_sample(res.findings, 5)).collect()}
    assert per["invalid_zip"] == 5 and max(per.values()) <= 5


def test_review_suite_runs_with_missing_columns(spark):
    df = spark.createDataFrame([("R1", "A", "p1", "u", "4.5", "2024-01-20")],
                               "store_id string, retailer string, post_id string, post_url string, "
                               "store_rating string, date_extracted string")
    res = su.review_suite(df, df, REVIEW, materialize=False)
    miss = {r["column_name"] for r in res.findings.where(F.col("check_id") == "missing_column").collect()}
    assert "latitude" in miss and "store_id" not in miss


def test_unknown_country_skips_geo_rules(spark):                   # D4, S26
    rows = [row(lat="99", zip_code="bad")]
    res = su.listing_suite(snap(spark, rows), None, LISTING.with_country("Mars"), materialize=False)
    ids = {r["check_id"] for r in res.findings.collect()}
    assert "unknown_country" in ids and "invalid_latitude" not in ids and "invalid_zip" not in ids


def test_distinct_with_copies_is_exact_in_one_exchange(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "x string, y int")
    exp = {(r["x"], r["y"], r["count"]) for r in df.groupBy("x", "y").count().collect()}
    got = gr.distinct_with_copies(df, ["x", "y"])
    plan = got._jdf.queryExecution().executedPlan().toString()   # before it runs: the one plan
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert {tuple(r) for r in got.collect()} == exp

