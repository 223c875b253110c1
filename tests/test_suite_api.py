"""Suite API: report sink, feed profiles, review metrics, per-file delimiters."""

import os

import pytest
from pyspark.sql import functions as F

from driftwatch.operators.schema import standardize_headers
from driftwatch.plans import suite as su
from driftwatch.plans.findings import FINDINGS_SCHEMA, METRICS_SCHEMA, plan_findings, report, report_lines, write_report
from driftwatch.plans.isolation import check_ids
from driftwatch.profiles import LISTING, REVIEW, listing_profile
from driftwatch.sources.csv import read_snapshots

from test_rules import row, snap


def test_unknown_feed_type_rejected():
    with pytest.raises(ValueError):
        listing_profile(feed_type="NOPE")


def test_feed_profile_extends_rules():
    p = listing_profile(feed_type="POLLO_CAMPERO")
    assert p.null_columns[-2:] == ("pc_id", "pc_address")
    assert "pc_address" in p.symbol_patterns and p.feed_id_col == "pc_id"
    assert listing_profile(feed_type="RMS").feed_id_col is None


def test_feed_id_counts_metric(spark):
    prof = listing_profile(feed_type="TMAD")
    cur = snap(spark, [row(), row(sid="S2")]).withColumn("tmad_id", F.col("store_id")).withColumn("currency", F.lit("US$"))
    prev = cur.withColumn("tmad_id", F.lit("T1"))
    res = su.listing_suite(cur, prev, prof, materialize=False)
    m = {(r["metric"], r["measured"]) for r in res.metrics.where("check_id = 'feed_id_counts'").collect()}
    assert m == {("current", 2.0), ("previous", 1.0)}
    sv = {(r["column_name"], r["entity_id"]) for r in res.findings.where("check_id = 'symbol_violations'").collect()}
    assert ("currency", "S1") in sv


def test_report_sink_writes_three_outputs(spark, tmpdir_path):
    res = su.listing_suite(snap(spark, [row(zip_code="bad")]), None, LISTING, materialize=False)
    base = write_report(res.findings, res.metrics, os.path.join(tmpdir_path, "rep"))
    lines = _report_text(base)
    assert any(line.startswith("[ERROR] invalid_zip") and "value=00bad" in line for line in lines)   # zfill pads short ZIPs
    found = spark.read.parquet(os.path.join(base, "findings")).count()
    assert report_lines(res.findings).count() == found
    at = [i for i, x in enumerate(lines) if x.startswith(("[ERROR] ", "[WARNING] ", "[INFO] ")) and not x.endswith(" found")]
    assert len(at) == found


def _report_text(base):
    """The report's part files one after the other."""
    folder = os.path.join(base, "report")
    out = []
    for name in sorted(n for n in os.listdir(folder) if n.startswith("part-")):
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            out += f.read().splitlines()
    return out


def test_report_reads_from_first_line_to_last(spark, tmpdir_path):
    rows = [row(sid=f"S{i:03d}", zip_code="bad") for i in range(300)]
    res = su.listing_suite(snap(spark, rows), snap(spark, rows[:200]), LISTING, materialize=False)
    checks = check_ids(res.parts)
    base = write_report(res.findings.repartition(7), res.metrics, os.path.join(tmpdir_path, "long"), checks)
    lines = _report_text(base)
    assert lines[0] == "===== STARTING VALIDATION =====" and lines[-1] == "===== VALIDATION COMPLETE ====="
    starts = [x[len("----- Start: "):-len(" -----")] for x in lines if x.startswith("----- Start: ")]
    ends = [x[len("----- End: "):-len(" -----")] for x in lines if x.startswith("----- End: ")]
    assert starts == ends == checks
    i, j = lines.index("----- Start: invalid_zip -----"), lines.index("----- End: invalid_zip -----")
    assert lines[i + 1] == "[ERROR] invalid_zip: 300 found"
    assert lines[i + 2:j] == sorted(lines[i + 2:j]) and len(lines[i + 2:j]) == 300
    i = lines.index("----- Start: size_change_pct -----")
    assert lines[i + 1:i + 3] == ["[PASS] size_change_pct: nothing found",
                                  "[METRIC] pct current=300.00 previous=200.00 measured=20.00 status=increased"]
    assert "[PASS] invalid_latitude: nothing found" in lines


def test_report_gives_unlisted_checks_a_section(spark):
    found = plan_findings(spark, [("check_failed", "error", None, None, "zero_price", "Boom"), ("zero_price", "error", "price", "S1", None, None)])
    none = spark.createDataFrame([], METRICS_SCHEMA)
    got = [tuple(r) for r in report(found, none, ["zero_price", "invalid_zip"]).orderBy("section", "part", "line").collect()]
    assert [x[2] for x in got] == [
        "===== STARTING VALIDATION =====",
        "----- Start: zero_price -----", "[ERROR] zero_price: 1 found", "[ERROR] zero_price column=price entity=S1", "----- End: zero_price -----",
        "----- Start: invalid_zip -----", "[PASS] invalid_zip: nothing found", "----- End: invalid_zip -----",
        "----- Start: check_failed -----", "[ERROR] check_failed: 1 found", "[ERROR] check_failed value=zero_price Boom",
        "----- End: check_failed -----", "===== VALIDATION COMPLETE ====="]
    assert report(spark.createDataFrame([], FINDINGS_SCHEMA), none, []).count() == 2


def test_review_suite_retailer_metrics(spark):
    cols = "store_id string, retailer string, post_id string, post_url string, store_rating string, date_extracted string"
    cur = spark.createDataFrame([("R1", "A", "1", "u", "4", "2024-01-20"), ("R2", "B", "2", "u", "4", "2024-01-20")], cols)
    prev = spark.createDataFrame([("R1", "A", "3", "u", "4", "2024-01-02")], cols)
    res = su.review_suite(cur, prev, REVIEW, materialize=False)
    ids = {r["check_id"] for r in res.findings.collect()}
    assert "retailer_check" in ids and "stores_not_in_current" not in ids
    m = {(r["metric"], r["current_value"], r["previous_value"])
         for r in res.metrics.where("check_id = 'retailer_counts'").collect()}
    assert ("A_rows", 1.0, 1.0) in m and ("B_rows", 1.0, 0.0) in m


def test_per_file_delimiter(spark, tmpdir_path):
    cur = os.path.join(tmpdir_path, "c.txt")
    prev = os.path.join(tmpdir_path, "p.txt")
    open(cur, "w").write("Store ID|Price\nS1|5\n")
    open(prev, "w").write("Store ID,Price\nS1,6\n")
    _, p, _ = read_snapshots(spark, cur, prev, LISTING, per_file_delimiter=True)
    assert p.columns == ["store_id", "price"]


def test_standardize_headers_as_data(spark):
    df = spark.createDataFrame([(1, "Store ID|ZIP| Price |Unknown\nrow"), (2, None)], "id long, text string")
    got = [tuple(r) for r in standardize_headers(df, "id", "text", LISTING).orderBy("position").collect()]
    assert got == [(1, 1, "Store ID", "store_id"), (1, 2, "ZIP", "zip_code"), (1, 3, "Price", "price"),
                   (1, 4, "Unknown", "Unknown")]


def test_run_validation_paths(spark, tmpdir_path):
    from driftwatch.plans.run import run_validation, validate_data

    cur = os.path.join(tmpdir_path, "2025_08.txt")
    prev = os.path.join(tmpdir_path, "2025_07.txt")
    open(cur, "w").write("Store ID|Zip|Price|Competitor|Store ID Number\nS1|ABCDE|0|X|S1\nS2|02108|5|X|S2\n")
    open(prev, "w").write("Store ID|Zip|Price|Competitor|Store ID Number\nS1|02108|5|X|S1\nS9|02108|5|X|S9\n")
    out = run_validation(spark, cur, prev, "USA", os.path.join(tmpdir_path, "rep"), "FRG")
    f = {(r["check_id"], r["entity_id"]) for r in spark.read.parquet(os.path.join(out, "findings")).collect()}
    assert {("invalid_zip", "S1"), ("zero_price", "S1"), ("stores_not_in_current", "S9")} <= f
    assert ("header_collision", None) in f
    out1 = validate_data(spark, cur, os.path.join(tmpdir_path, "rep1"), "USA")
    assert spark.read.text(os.path.join(out1, "report")).count() > 0


def test_snapshot_shape_metrics(spark):
    rows = [row(), row(), row(sid="S2")]
    res = su.listing_suite(snap(spark, rows), snap(spark, rows[:1]), LISTING, materialize=False)
    m = {r["metric"]: r["measured"] for r in res.metrics.where("check_id = 'snapshot_counts'").collect()}
    assert m["current_rows"] == 2.0 and m["previous_rows"] == 1.0          # current de-duplicated
    assert m["current_columns"] == 18.0 and m["current_stores"] == 2.0


def test_columns_only_the_previous_snapshot_lacks_are_reported(spark):
    cur = snap(spark, [row(), row(sid="S2")])
    res = su.listing_suite(cur, cur.drop("category"), LISTING, materialize=False)
    found = res.findings.where("check_id = 'missing_column' and column_name = 'category'").collect()
    assert [r["detail"] for r in found] == ["previous"]
