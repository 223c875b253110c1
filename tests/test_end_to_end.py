"""The user path end to end: CSV files with original headers -> reader -> suite.

The sf0.001 listing snapshots are written as pipe-delimited files with the
reference's header spellings, read back through the reader and alias map,
and the suite summary is compared with the suite run on the fixture itself.
"""

import os

from pyspark.sql import functions as F

from driftwatch.plans.findings import summary
from driftwatch.plans.suite import listing_suite
from driftwatch.profiles import LISTING
from driftwatch.sources import fixtures as fx
from driftwatch.sources.csv import read_snapshots

SF = "/root/testdata/sf0.001"
ORIGINAL = {
    "store_id": "Store ID", "store_name": "Store Name", "store_address": "Store Address",
    "city": "City", "state": "State", "country": "Country", "category": "Category",
    "product": "Product", "type": "Type", "subtype_size": "SubType / Size", "addition": "Addition",
    "product_id": "Product Id", "tmad_id": "TMAD_ID", "currency": "Currency", "competitor": "Competitor",
    "price": "Price", "zip_code": "Zip Code", "postal_ca": "postal_ca", "latitude": "Latitude",
    "longitude": "Longitude", "date_extracted": "DateExtracted",
}


def test_csv_files_through_reader_and_suite(spark, tmpdir_path):
    cur, prev = fx.listing_snapshots(spark, SF)
    paths = []
    for name, df in (("cur", cur), ("prev", prev)):
        path = os.path.join(tmpdir_path, name)
        (df.select(*[F.col(c).cast("string").alias(ORIGINAL[c]) for c in df.columns])
           .coalesce(1).write.option("header", "true").option("sep", "|").csv(path))
        paths.append(path)
    c, p, collisions = read_snapshots(spark, paths[0], paths[1], LISTING)
    assert collisions == [] and c.columns == cur.columns

    from_csv = {r["check_id"]: r["n"] for r in summary(listing_suite(c, p, LISTING).findings).collect()}
    direct = {r["check_id"]: r["n"] for r in summary(listing_suite(cur, prev, LISTING).findings).collect()}

    # The reader maps "n/a" and "" to null (as pandas does), so a latitude of
    # "n/a" is no longer a raw-text symbol violation.  Everything else agrees.
    na_lat = {r[0] for r in cur.where((F.col("latitude") == "n/a") & F.col("store_id").isNotNull())
              .select("store_id").distinct().collect()}
    assert from_csv.pop("symbol_violations") == direct.pop("symbol_violations") - len(na_lat)
    assert from_csv == direct


def test_entry_point_keeps_line_breaks_and_reports_surplus_fields(spark, tmpdir_path):
    """Quoted line breaks stay in one row, a ragged row and odd headers reach the findings."""
    from driftwatch.plans.run import run_validation, validate_data

    cur, prev = os.path.join(tmpdir_path, "cur.txt"), os.path.join(tmpdir_path, "prev.txt")
    with open(cur, "w", encoding="utf-8") as f:
        f.write('Store ID,Price,Zip Code,Competitor,St. Note,Foo,foo\n'
                'S1,5,02108,A,"line one\nline two",x,y\nS2,6,02108,B,ok,x,y,EXTRA\n')
    with open(prev, "w", encoding="utf-8") as f:
        f.write("Store ID,Price\nS1,5\n")
    out = run_validation(spark, cur, prev, "USA", os.path.join(tmpdir_path, "two"))
    found = spark.read.parquet(f"{out}/findings")
    assert "EXTRA" in found.where("check_id = 'malformed_rows'").first()["value"]
    sizes = {r["name"]: r for r in spark.read.parquet(f"{out}/metrics").where("check_id = 'snapshot_counts'").collect()} \
        if "name" in spark.read.parquet(f"{out}/metrics").columns else None
    if sizes is not None:
        assert sizes["current_rows"]["measured"] == 2
    single = validate_data(spark, cur, os.path.join(tmpdir_path, "one"), "USA")
    assert spark.read.parquet(f"{single}/findings").where("check_id = 'malformed_rows'").count() == 1
