"""Headers of delivered files: keys against SQL, and a folder of files with headers of their own."""

import collections
import os

import duckdb
import pytest

from driftwatch.plans import registry
from driftwatch.profiles import LISTING
from driftwatch.sources import fixtures as fx
from driftwatch.sources.csv import file_headers, read_folder

SF = "/root/testdata/sf0.001"
KEYS = ["detect_delimiter", "normalize_headers", "standardize_listing", "standardize_review", "missing_columns"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"create view orders as select * from '{SF}/orders.parquet'")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_header_keys_equal_sql(spark, con, key):
    res = con.execute(registry.oracle_sql()[key])
    names = [c[0] for c in res.description]
    want = collections.Counter(res.fetchall())
    assert collections.Counter(tuple(r) for r in registry.queries()[key](spark, SF).select(*names).collect()) == want and want


def test_headers_hit_aliases_and_have_partial_gaps(spark):
    files = spark.read.parquet(f"{SF}/orders.parquet").count()
    canon = registry.queries()["standardize_listing"](spark, SF)
    known = canon.where(canon.canonical.isin(*LISTING.canonical_columns)).count()
    assert known > 0.8 * canon.count()
    gaps = registry.queries()["missing_columns"](spark, SF).groupBy("file_id").count().collect()
    assert 0 < len(gaps) <= files and max(r["count"] for r in gaps) < len(LISTING.null_columns)
    assert {r.delimiter for r in registry.queries()["detect_delimiter"](spark, SF).distinct().collect()} == {"|", "\t", ","}


def test_folder_of_files_with_their_own_headers(spark, tmpdir_path):
    """Delimiters, spellings, order and left-out columns differ; every row lands under its canonical names."""
    rows, want = fx.delivered_files(spark, SF).limit(60).collect(), collections.Counter()
    for n, r in enumerate(rows):
        folder = os.path.join(tmpdir_path, f"part{n % 3}")
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, f"{r.file_id}.txt"), "w") as f:
            f.write(r.text + "\n")
    heads = {os.path.basename(r.file): r.line for r in file_headers(spark, tmpdir_path).collect()}
    assert heads == {f"{r.file_id}.txt": r.text.split("\n")[0] for r in rows}
    df, _ = read_folder(spark, tmpdir_path, LISTING)
    got = {int(os.path.basename(r.source_file)[:-4]): r for r in df.collect()}
    assert set(got) == {r.file_id for r in rows}
    for r in rows:
        k = r.file_id
        for column, i in (("store_id", 0), ("zip_code", 5), ("latitude", 7), ("product_id", 11), ("price", 15)):
            assert got[k][column] == (str(k + i) if (k * (i + 3) + i) % 13 else None)


def test_folder_without_files(spark, tmpdir_path):
    with pytest.raises(ValueError):
        read_folder(spark, tmpdir_path, LISTING)


def test_headers_of_long_files(spark, tmpdir_path):
    """The header is taken from the file's first block, however many tasks read it."""
    with open(os.path.join(tmpdir_path, "long.csv"), "w") as f:
        f.write("Store ID,Price\n" + "".join(f"S{k},{k}\n" for k in range(200_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        assert [r.line for r in file_headers(spark, tmpdir_path).collect()] == ["Store ID,Price"]
        df, _ = read_folder(spark, tmpdir_path, LISTING)
        assert df.count() == 200_000 and df.columns == ["store_id", "price", "source_file"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
