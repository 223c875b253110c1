"""A check that fails, in planning or at run time, costs its own findings and no others."""

import os

import pytest
from pyspark.sql import functions as F

from driftwatch.operators import group_rules as gr
from driftwatch.operators import row_rules as rr
from driftwatch.operators.clean import clean_snapshot
from driftwatch.plans import isolation as iso
from driftwatch.plans import run
from driftwatch.plans import suite as su
from driftwatch.profiles import LISTING
from test_rules import row, snap


def key(df):
    return sorted((r.check_id, r.column_name or "", r.entity_id or "", r.value or "") for r in df.collect())


def frames(spark):
    rows = [row(sid=f"S{i % 7}", price=str(i % 3), zip_code="ABCDE" if i % 5 == 0 else "02108") for i in range(40)]
    return snap(spark, rows), snap(spark, rows[:20] + [row(sid="S99")])


def test_parts_written_one_by_one_give_the_suite(spark, tmpdir_path):
    res = su.listing_suite(*frames(spark), LISTING)
    assert iso.write_parts(spark, res.parts, tmpdir_path) == []
    findings, metrics = iso.written(spark, res.parts, tmpdir_path)
    assert key(findings) == key(res.findings)
    assert sorted(map(str, metrics.collect())) == sorted(map(str, res.metrics.collect()))


def test_failures_cost_their_own_check_only(spark, tmpdir_path, monkeypatch):
    """One check divides by zero in a task, one reads a file that isn't there, one can't be planned, one UDF raises."""
    cur, prev = frames(spark)
    want = key(su.listing_suite(cur, prev, LISTING).findings)

    @F.udf("string")
    def broken(x):
        raise RuntimeError("bad row " + str(x))

    def missing_file(c, p):
        path = os.path.join(tmpdir_path, "gone")
        spark.range(3).selectExpr("cast(id as string) as store_id").write.parquet(path)
        df = spark.read.parquet(path)
        for name in os.listdir(path):
            if name.startswith("part-"):
                os.remove(os.path.join(path, name))
        return df

    monkeypatch.setattr("driftwatch.operators.compare.stores_not_in_current", missing_file)
    monkeypatch.setattr(gr, "duplicate_entities", lambda c, keys: c.select(broken("sid").alias("store_id")))
    monkeypatch.setattr(gr, "scrape_dates", lambda c, col: c.select("no_such_column"))
    monkeypatch.setattr(gr, "size_change_pct", lambda c, p: c.select(
        F.lit(1).alias("current_count"), F.lit(1).alias("previous_count"), F.raise_error(F.lit("no pct")).cast("double").alias("pct"),
        F.lit("ok").alias("status")))
    res = su.listing_suite(cur, prev, LISTING)
    out = os.path.join(tmpdir_path, "out")
    broken_ids = iso.write_parts(spark, res.parts, out)
    assert sorted(broken_ids) == ["duplicate_products", "scrape_dates", "size_change_pct", "stores_not_in_current"]
    findings, metrics = iso.written(spark, res.parts, out)
    got = key(findings)
    failed = {r.value: r.detail for r in findings.where("check_id = 'check_failed'").collect()}
    assert set(failed) == set(broken_ids)
    assert "bad row" in failed["duplicate_products"] and "no pct" in failed["size_change_pct"] and "no_such_column" in failed["scrape_dates"]
    gone = set(broken_ids)
    assert [x for x in got if x[0] != "check_failed"] == [x for x in want if x[0] not in gone]
    assert "snapshot_counts" in {r.check_id for r in metrics.collect()}


def test_a_failed_check_can_be_run_again(spark, tmpdir_path, monkeypatch):
    cur, prev = frames(spark)
    want = key(su.listing_suite(cur, prev, LISTING).findings)
    with monkeypatch.context() as m:
        m.setattr(gr, "duplicate_entities", lambda c, keys: c.select(F.raise_error(F.lit("later")).alias("store_id")))
        parts = su.listing_suite(cur, prev, LISTING).parts
        assert iso.write_parts(spark, parts, tmpdir_path) == ["duplicate_products"]
    parts = su.listing_suite(cur, prev, LISTING).parts
    assert iso.write_parts(spark, parts, tmpdir_path, only={"duplicate_products"}) == []
    assert key(iso.written(spark, parts, tmpdir_path)[0]) == want


def test_a_row_rule_that_fails_leaves_the_others(spark, tmpdir_path, monkeypatch):
    cur, prev = frames(spark)
    whole = rr.row_rules

    def with_a_bad_rule(c, profile):
        return whole(c, profile) + [rr.RowRule("malformed_rows", "error", "price", F.raise_error(F.lit("bad rule")).cast("boolean"),
                                               F.lit("x"), False)]

    want = {x for x in key(su.listing_suite(cur, prev, LISTING).findings)}
    monkeypatch.setattr(rr, "row_rules", with_a_bad_rule)
    parts = su.listing_suite(cur, prev, LISTING).parts
    assert iso.write_parts(spark, parts, tmpdir_path) == ["malformed_rows"]
    got = key(iso.written(spark, parts, tmpdir_path)[0])
    assert {x for x in got if x[0] != "check_failed"} == want and sum(x[0] == "check_failed" for x in got) == 1


def test_entry_points_report_a_failed_check(spark, tmpdir_path, monkeypatch):
    cur, prev = os.path.join(tmpdir_path, "c.txt"), os.path.join(tmpdir_path, "p.txt")
    open(cur, "w").write("Store ID|Zip|Price|Competitor\nS1|ABCDE|0|X\nS2|02108|5|X\n")
    open(prev, "w").write("Store ID|Zip|Price|Competitor\nS1|02108|5|X\nS9|02108|5|X\n")
    monkeypatch.setattr("driftwatch.operators.compare.stores_not_in_current",
                        lambda c, p: c.select(F.raise_error(F.lit("lost")).alias("store_id")))
    out = run.run_validation(spark, cur, prev, "USA", os.path.join(tmpdir_path, "rep"))
    lines = [r.value for r in spark.read.text(f"{out}/report").collect()]
    assert any("check_failed" in x and "stores_not_in_current" in x for x in lines) and any("invalid_zip" in x for x in lines)


def test_a_stopped_session_is_not_a_check_error(spark, monkeypatch, tmpdir_path):
    monkeypatch.setattr(iso, "_alive", lambda s: False)
    bad = iso.Part("findings", "x", lambda: spark.range(1).select("gone"))
    with pytest.raises(Exception):
        iso.write_parts(spark, [bad], tmpdir_path)


@pytest.mark.parametrize("values,count", [(["X", "X"], 1), (["X", "Y"], 2), (["X", None], 2), ([None, None], 1), ([], 0)])
def test_single_snapshot_competitor(spark, values, count):
    df = spark.createDataFrame([(f"S{k}", v) for k, v in enumerate(values)], "store_id string, competitor string")
    r = gr.exactly_one_value(clean_snapshot(df, LISTING), "competitor").collect()
    assert [(x.value_count, x.status) for x in r] == [(count, "ok" if count == 1 else "mismatch")]
