"""Plan checks: no Python UDF anywhere, pushdown reaches the scan, one scan for the row pass."""

from driftwatch.operators import row_rules as rr
from driftwatch.operators.clean import clean_snapshot
from driftwatch.plans import registry
from driftwatch.profiles import LISTING
from driftwatch.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udf_in_any_query(spark):
    for name, q in registry.queries().items():
        p = plan(q(spark, SF))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p, name


def test_snapshot_dates_reach_parquet_scan(spark):
    p = plan(fx.listing_snapshots(spark, SF)[0])
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p


def test_fused_row_pass_is_one_scan(spark):
    c = clean_snapshot(fx.whole_listing(spark, SF), LISTING)
    p = plan(rr.fused_row_findings(c, LISTING))
    assert p.count("lineitem.parquet") == 1


def test_landing_uses_configured_checkpoint_dir(spark):
    from driftwatch.session import ensure_checkpoint_dir
    from driftwatch.sources.landing import land

    base = spark.conf.get("spark.checkpoint.dir")
    assert ensure_checkpoint_dir(spark) == base
    landed = land(spark.range(10), "probe")
    from urllib.parse import urlparse

    assert all(urlparse(f).path.startswith(base) for f in landed.inputFiles())
    assert landed.count() == 10
