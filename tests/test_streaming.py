"""Row rules over a folder of landing files, driven to completion with availableNow."""

import os

from driftwatch.operators.clean import clean_snapshot
from driftwatch.operators.row_rules import fused_row_findings
from driftwatch.profiles import LISTING
from driftwatch.sources.csv import read_snapshot
from driftwatch.streaming import start_row_checks
from driftwatch.streaming.landing_watch import snapshot_stream

HEADERS = ["Store ID", "Price", "Zip Code", "Latitude", "Longitude", "Category", "Product"]


def test_stream_matches_batch(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write(",".join(HEADERS) + "\nS1,0,ABCDE,40.1,-75.1,Cat,P*\nS2,5,02108,99.5,-75.1,,P\n")
    with open(os.path.join(src, "b.csv"), "w") as f:
        f.write(",".join(HEADERS) + "\nS3,$5,123.0,n/a,-200,Cat,P\n")
    sink = os.path.join(tmpdir_path, "out")
    q = start_row_checks(spark, src, HEADERS, LISTING, sink, os.path.join(tmpdir_path, "ck"),
                         available_now=True)
    q.awaitTermination(120)
    got = {(r["check_id"], r["column_name"], r["entity_id"], r["value"])
           for r in spark.read.parquet(sink).collect()}
    batch, _ = read_snapshot(spark, src, LISTING)
    exp = {(r["check_id"], r["column_name"], r["entity_id"], r["value"])
           for r in fused_row_findings(clean_snapshot(batch, LISTING), LISTING).collect()}
    assert got == exp and ("invalid_zip", "zip_code", "S1", "ABCDE") in got


def test_headers_that_share_a_name_are_kept_apart(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("Store ID,store id,Note,NOTE,Note\nS1,S2,a,b,c\n")
    rows = snapshot_stream(spark, src, ["Store ID", "store id", "Note", "NOTE", "Note"], LISTING)
    q = rows.writeStream.format("parquet").option("path", os.path.join(tmpdir_path, "out")).option(
        "checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(tmpdir_path, "out")).drop("source_file")
    assert out.columns == ["store_id", "store_id__1", "Note", "NOTE__3", "Note__4"]
    assert [tuple(r) for r in out.collect()] == [("S1", "S2", "a", "b", "c")]
