"""Snapshot views over the driver's test tables (see FIXTURES.md).

No given table is a retail scrape, so the checks run on deterministic views
that reshape ``lineitem``/``part``/``supplier`` into price listings and
``events`` into store reviews, with faults injected at fixed key residues.
The residues only decide *which* rows carry a fault; every view covers the
whole table.

Checks of one snapshot read the whole view.  Comparisons split all rows into
snapshots by ship date (listing: current from 2000 on, previous 1998 and 1999,
before-previous all earlier ones); the dates of the snapshots asked for reach
the parquet scan as a pushed ``l_shipdate`` range.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

CURRENT, PREVIOUS, BEFORE_PREVIOUS = "cur", "prev", "prev2"
CURRENT_FROM = "2000-01-01 00:00:00"
PREVIOUS_FROM = "1998-01-01 00:00:00"
REVIEW_CUTOFF = "2024-01-16 00:00:00"


def _ts(s: str) -> Column:
    return F.lit(s).cast("timestamp_ntz")


def _s(c) -> Column:
    return c.cast("string")


def listing(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """The ``listing`` view: every lineitem row, tagged with its snapshot (``snap``).

    ``where`` is a predicate on the ``lineitem`` columns, applied before the
    joins so it reaches the parquet scan.
    """
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    if where is not None:
        li = li.where(where)
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")

    snap = (F.when(F.col("l_shipdate") >= _ts(CURRENT_FROM), F.lit(CURRENT))
             .when(F.col("l_shipdate") >= _ts(PREVIOUS_FROM), F.lit(PREVIOUS))
             .otherwise(F.lit(BEFORE_PREVIOUS)))
    j = (li.join(part, li.l_partkey == part.p_partkey)
           .join(supp, li.l_suppkey == supp.s_suppkey))

    ok = F.col("l_orderkey")
    sk = F.col("l_suppkey")
    sks = _s(sk)
    # Suppliers 25m+1 share the coordinates of supplier 25m.
    k = sk - F.when(sk % 25 == 1, 1).otherwise(0)

    store_id = F.when(ok % 211 == 0, None).otherwise(F.concat(F.lit("S"), F.lpad(sks, 4, "0")))
    store_name = F.when(ok % 199 == 0, F.concat("s_name", F.lit(" Annex"))).otherwise(F.col("s_name"))
    store_address = F.when(ok % 197 == 0, F.lit("")).otherwise(F.concat(sks, F.lit(" Main St")))
    city = (F.when((sk % 10 == 3) & (ok % 193 == 0), F.lit("Othertown"))
             .otherwise(F.concat(F.lit("City"), _s(sk % 20))))
    product = (F.when(ok % 181 == 0, F.concat("p_name", F.lit("*")))
                .when(ok % 179 == 0, F.concat("p_name", F.lit("®")))
                .otherwise(F.col("p_name")))
    price = (F.when(ok % 97 == 0, F.concat(F.lit("$"), _s(F.col("p_retailprice"))))
              .when(ok % 89 == 0, F.lit("0.00"))
              .when(ok % 83 == 0, F.lit("1,299.00"))
              .when(ok % 79 == 0, F.lit(None).cast("string"))
              .when(ok % 151 == 0, F.lit("9999.5"))
              .when(F.col("p_partkey") % 5 == 0, _s(F.col("p_retailprice") + F.when(snap == CURRENT, 2).when(snap == PREVIOUS, 1).otherwise(0)))
              .otherwise(_s(F.col("p_retailprice"))))
    zip_code = (F.when(ok % 73 == 0, F.lit(None).cast("string"))
                 .when(ok % 71 == 0, F.concat(sks, F.lit(".0")))
                 .when(ok % 67 == 0, F.lit("ABCDE"))
                 .when(ok % 61 == 0, F.lit("12345-6789"))
                 .otherwise(F.lpad(sks, 5, "0")))
    postal_ca = (F.when(ok % 3 == 0, F.lit("K1A 0B1"))
                  .when(ok % 13 == 0, F.lit("K1A-0B"))
                  .otherwise(F.lit("K1A0B1")))
    latitude = (F.when(ok % 59 == 0, F.lit("n/a"))
                 .when(ok % 53 == 0, F.lit("99.5"))
                 .otherwise(F.concat(_s(25 + k % 24), F.lit("."), F.lpad(_s((k * 37) % 10000), 4, "0"))))
    longitude = (F.when(ok % 47 == 0, F.lit("-200.25"))
                  .otherwise(F.concat(F.lit("-"), _s(67 + k % 57), F.lit("."),
                                      F.lpad(_s((k * 53) % 10000), 4, "0"))))

    return j.select(
        store_id.alias("store_id"),
        store_name.alias("store_name"),
        store_address.alias("store_address"),
        city.alias("city"),
        F.concat(F.lit("ST"), _s(sk % 7)).alias("state"),
        F.lit("USA").alias("country"),
        F.col("p_type").alias("category"),
        product.alias("product"),
        F.col("p_brand").alias("type"),
        _s(F.col("p_size")).alias("subtype_size"),
        F.when(F.col("l_linenumber") % 5 == 0, F.lit("extra")).otherwise(F.lit("base")).alias("addition"),
        _s(F.col("p_partkey")).alias("product_id"),
        F.concat(F.lit("T"), _s(sk % 40)).alias("tmad_id"),
        F.when(ok % 173 == 0, F.lit("US$")).otherwise(F.lit("USD")).alias("currency"),
        F.when(ok % 7 == 0, F.lit("RetailB")).otherwise(F.lit("RetailA")).alias("competitor"),
        price.alias("price"),
        zip_code.alias("zip_code"),
        postal_ca.alias("postal_ca"),
        latitude.alias("latitude"),
        longitude.alias("longitude"),
        F.to_date("l_shipdate").alias("date_extracted"),
        snap.alias("snap"),
        # Faults of the comparisons: stores, and categories of a store, that the current snapshot lacks.
        ((snap == CURRENT) & ((sk % 25 == 4) | ((sk % 10 == 6) & (F.col("p_type") == "PROMO")))).alias("lost"),
    )


def listing_history(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """The listing split into snapshots, without the stores and categories the current one lacks."""
    return listing(spark, sf_dir, where).where(~F.coalesce("lost", F.lit(False))).drop("lost")


def listing_snapshots(spark: SparkSession, sf_dir: str):
    """(current, previous) listing snapshots; the previous one is all that was shipped before."""
    cut = _ts(CURRENT_FROM)
    return (listing_history(spark, sf_dir, F.col("l_shipdate") >= cut).drop("snap"),
            listing_history(spark, sf_dir, F.col("l_shipdate") < cut).drop("snap"))


def whole_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the listing as one snapshot."""
    return listing(spark, sf_dir).drop("snap", "lost")


def review(spark: SparkSession, sf_dir: str, where: Column | None = None) -> DataFrame:
    """The ``review`` view: one row per event, tagged with its snapshot.

    ``where`` is a predicate on the ``events`` columns, applied before the
    projection so it reaches the parquet scan.
    """
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    if where is not None:
        ev = ev.where(where)
    eid = F.col("event_id")
    return ev.select(
        F.concat(F.lit("R"), _s(F.col("user_id"))).alias("store_id"),
        F.when(eid % 41 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("retailer"),
        _s(eid).alias("post_id"),
        F.when(eid % 43 == 0, F.lit("")).otherwise(
            F.concat(F.lit("https://r.example/"), _s(eid))).alias("post_url"),
        F.when(eid % 37 == 0, F.concat(_s(F.col("value")), F.lit("*"))).otherwise(
            _s(F.col("value"))).alias("store_rating"),
        F.to_date("ts").alias("date_extracted"),
        F.when(F.col("ts") < _ts(REVIEW_CUTOFF), F.lit("prev")).otherwise(F.lit("cur")).alias("snap"),
    )


def whole_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the reviews as one snapshot."""
    return review(spark, sf_dir).drop("snap")


def review_snapshots(spark: SparkSession, sf_dir: str):
    """(current, previous) review snapshots; the cut-off reaches the scan."""
    cut = _ts(REVIEW_CUTOFF)
    return (review(spark, sf_dir, F.col("ts") >= cut).drop("snap"),
            review(spark, sf_dir, F.col("ts") < cut).drop("snap"))


#: Spellings of the columns of a delivered file, in the order of its header; the last two are in no alias map.
HEADER_SPELLINGS = (
    ("Store ID", "store_id", " STOREID Number"), ("Store Name", "store name"), ("Store Address", "STORE_ADDRESS"),
    ("City", "CITY "), ("State", "state"), ("Zip Code", "ZIP", "zipcode"), ("Country",), ("Latitude", "latitude "),
    ("Longitude", "LONGITUDE"), ("Category", "category"), ("Product", "Product "), ("Product ID", "product-id"),
    ("Product URL", "Location URL"), ("Type",), ("Sub Type Size", "Subtype"), ("Price", "PRICE"), ("Currency",),
    ("Competitor", "Retailer"), ("Date Extracted", "date_extracted"), ("Internal Note", "Remarks (old)"), ("Extra #1", ""),
)
DELIMITERS = ("|", "\t", ",")


def delivered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delimited file for each order: file_id and its text, a header line and one record.

    The order's key decides delimiter, spellings and left-out columns (the last spelled column may have an empty name).
    """
    k = F.col("o_orderkey")
    names, values = [], []
    for i, spelled in enumerate(HEADER_SPELLINGS):
        there = (k * (i + 3) + i) % 13 != 0
        name = F.element_at(F.array(*[F.lit(x) for x in spelled]), (F.floor(k / 7) % len(spelled)).cast("int") + 1)
        names.append(F.when(there, name))
        values.append(F.when(there, _s(k + i)))
    sep = F.element_at(F.array(*[F.lit(x) for x in DELIMITERS]), (k % len(DELIMITERS)).cast("int") + 1)
    line = lambda cells: F.concat_ws("\x01", F.array_compact(F.array(*cells)))
    body = F.concat(line(names), F.lit("\n"), line(values))
    return read_table(spark, sf_dir, "orders").select(k.alias("file_id"), F.replace(body, F.lit("\x01"), sep).alias("text"))


def documents(spark: SparkSession, sf_dir: str, columns=("doc_id", "text")) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select(*columns)


AS_OF = dt.date(2000, 7, 15)
