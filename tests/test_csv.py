"""Reader tests on CSV text written to a temp dir."""

import os

from driftwatch.profiles import LISTING
from driftwatch.sources.csv import detect_delimiter, read_delimited, read_snapshot, read_snapshots


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_delimiter_detection(spark, tmpdir_path):
    assert detect_delimiter(spark, write(os.path.join(tmpdir_path, "a.txt"), "a|b,c\n1|2\n")) == "|"
    assert detect_delimiter(spark, write(os.path.join(tmpdir_path, "b.txt"), "a\tb,c\n1\t2\n")) == "\t"
    assert detect_delimiter(spark, write(os.path.join(tmpdir_path, "c.txt"), "a,b\n1,2\n")) == ","


def test_quoting_na_tokens_and_strings(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "q.csv"),
              'Store ID,Price,Zip Code,Note\n'
              '"S1","1,299.00",02108,"said ""hi"""\n'
              'S2,NA,n/a,\n'
              'S3,#N/A,00501,""\n')
    rows = {r["Store ID"]: r for r in read_delimited(spark, p).collect()}
    assert rows["S1"]["Price"] == "1,299.00"
    assert rows["S1"]["Zip Code"] == "02108"          # no inference: leading zero kept
    assert rows["S1"]["Note"] == 'said "hi"'
    assert rows["S2"]["Price"] is None and rows["S2"]["Zip Code"] is None and rows["S2"]["Note"] is None
    assert rows["S3"]["Price"] is None and rows["S3"]["Note"] is None


def test_embedded_newline_multiline(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "m.csv"), 'Store ID|Store Address\nS1|"1 Main\nSt"\nS2|2 Elm\n')
    df = read_delimited(spark, p, multiline=True, partitions=4)
    got = {r[0]: r[1] for r in df.collect()}
    assert got == {"S1": "1 Main\nSt", "S2": "2 Elm"}


def test_header_aliases_and_collision(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "h.csv"),
              "StoreID,Zip,SubType / Size,PRICE,Mystery Col ,store id number\nS1,1,2,3,4,S1x\n")
    df, collisions = read_snapshot(spark, p, LISTING)
    assert df.columns == ["store_id", "zip_code", "subtype_size", "price", "Mystery Col", "store_id__5"]
    assert collisions == [("store id number", "store_id", "store_id__5")]


def test_read_two_snapshots_current_delimiter(spark, tmpdir_path):
    cur = write(os.path.join(tmpdir_path, "cur.txt"), "Store ID|Price\nS1|5\n")
    prev = write(os.path.join(tmpdir_path, "prev.txt"), "Store ID|Price\nS1|6\n")
    c, p, coll = read_snapshots(spark, cur, prev, LISTING)
    assert c.columns == ["store_id", "price"] and p.collect()[0]["price"] == "6" and coll == []


def test_repeated_header_keeps_first_alias(spark, tmpdir_path):
    p = write(os.path.join(tmpdir_path, "d.csv"), "Store ID|Zip|Store ID\nS1|1|S1b\n")
    df, collisions = read_snapshot(spark, p, LISTING)
    assert df.columns == ["store_id", "zip_code", "Store ID.1"] and collisions == []
    assert df.first()["store_id"] == "S1"


def test_malformed_rows_kept_and_reported(spark, tmpdir_path):
    from driftwatch.plans.suite import listing_suite

    p = write(os.path.join(tmpdir_path, "bad.csv"), "Store ID,Price,Zip Code\nS1,5,02108\nS2,6,02108,EXTRA\n")
    df, _ = read_snapshot(spark, p, LISTING, keep_malformed=True)
    rows = {r["store_id"]: r for r in df.collect()}
    assert rows["S1"]["_corrupt_record"] is None
    assert rows["S2"]["_corrupt_record"] == "S2,6,02108,EXTRA"
    res = listing_suite(df, None, LISTING, materialize=False)
    bad = [r for r in res.findings.collect() if r["check_id"] == "malformed_rows"]
    assert [(r["entity_id"], r["value"]) for r in bad] == [("S2", "S2,6,02108,EXTRA")]


def test_delimiter_rule_same_on_driver_and_column(spark):
    from pyspark.sql import functions as F

    from driftwatch.operators.schema import delimiter_of
    from driftwatch.sources.csv import delimiter_from_line

    lines = ["a|b,c", "a\tb,c", "a,b", "", "plain", "x\t|y"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    col = [r[0] for r in df.select(delimiter_of(F.col("line"))).collect()]
    assert col == [delimiter_from_line(x) for x in lines]
