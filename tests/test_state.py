"""Comparisons from a kept state equal those from the raw snapshot, and the previous snapshot is not scanned."""

import dataclasses
import random

import pytest

from driftwatch.operators import compare as cmp
from driftwatch.operators import group_rules as gr
from driftwatch.operators import state as sst
from driftwatch.operators.clean import clean_snapshot
from driftwatch.plans import suite as su
from driftwatch.plans.run import run_validation
from driftwatch.profiles import LISTING, REVIEW, listing_profile
from driftwatch.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
TMAD = listing_profile(feed_type="TMAD")
SCHEMA = "store_id string, category string, competitor string, tmad_id string, price string, date_extracted string"


def snapshot(spark, seed, n):
    rng = random.Random(seed)
    rows = [("S0" if rng.random() < 0.35 else rng.choice(["S1", "S2", " S3 ", "S4", " ", None]), rng.choice(["a", "b", "c", None]),
             rng.choice(["K", "L", None]), rng.choice(["T1", "T2", None]), rng.choice(["1.50", "1,299.00", "9999.5", None]),
             rng.choice(["2025-08-01 10:00", "2025-08-02", None])) for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(str, df.collect()))


def kept(spark, snap, path, profile=TMAD):
    return sst.read_state(spark, sst.write_state(sst.state_of(snap, profile), str(path), profile), profile)


@pytest.mark.parametrize("seed,n,m", [(1, 400, 300), (2, 30, 90), (3, 0, 20), (4, 20, 0)])
def test_comparisons_from_states(spark, tmp_path, seed, n, m):
    cur, prev = snapshot(spark, seed, n), snapshot(spark, seed + 50, m)
    a, b = clean_snapshot(cur, TMAD), clean_snapshot(prev, TMAD)
    c, p = kept(spark, cur, tmp_path / "c"), kept(spark, prev, tmp_path / "p")
    whole = [lambda x, y: gr.snapshot_counts(x, y, 6), gr.size_change_pct, lambda x, y: gr.count_margin(x, y, 2.0),
             cmp.stores_not_in_current, lambda x, y: cmp.missing_store_pct(x, y, 1.0), cmp.stores_with_fewer_rows]
    for rule in whole:
        assert rows(rule(a, b)) == rows(rule(c.stores(), p.stores()))
    by = {"competitor": lambda x, y: gr.single_value_check(x, y, "competitor"), "tmad_id": lambda x, y: gr.feed_id_counts(x, y, "tmad_id"),
          "category": cmp.categories_not_in_current}
    for column, rule in by.items():
        assert rows(rule(a, b)) == rows(rule(c.pairs(column), p.pairs(column)))
    assert rows(gr.group_counts(a, b, "competitor")) == rows(gr.group_counts(c.pairs("competitor"), p.pairs("competitor"), "competitor"))
    assert rows(gr.scrape_dates(b)) == rows(gr.scrape_dates(p.values("date_extracted")))
    assert p.columns == tuple(prev.columns)


def test_states_of_parts_add_up(spark):
    parts = [snapshot(spark, s, 60) for s in (7, 8, 9)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert rows(sst.merged(sst.state_of(x, TMAD) for x in parts).facts) == rows(
        sst.state_of(whole, TMAD).facts.select("field", "sid", "value", "_rows"))
    with pytest.raises(ValueError):
        sst.merged([sst.state_of(parts[0], dataclasses.replace(TMAD, dedupe_previous=True))])
    with pytest.raises(ValueError):
        sst.merged([sst.state_of(parts[0], TMAD), sst.state_of(parts[1].drop("category"), TMAD)])


def test_state_is_replaced_as_a_whole_and_checked(spark, tmp_path):
    first, second = snapshot(spark, 1, 50), snapshot(spark, 2, 70)
    kept(spark, first, tmp_path)
    assert kept(spark, second, tmp_path).stores().agg({"_rows": "sum"}).first()[0] == 70
    with pytest.raises(ValueError):
        sst.read_state(spark, str(tmp_path), REVIEW)
    with pytest.raises(ValueError):
        sst.read_state(spark, str(tmp_path), dataclasses.replace(TMAD, dedupe_previous=True))
    with pytest.raises(ValueError):
        sst.state_of(first.drop("tmad_id"), TMAD).pairs("tmad_id")


def test_listing_suite_from_state(spark, tmp_path):
    """Same findings and metrics as from the raw rows; the previous snapshot's files are in no plan."""
    c, p = fx.listing_snapshots(spark, SF)
    raw = su.listing_suite(c, p, TMAD)
    res = su.listing_suite(c, kept(spark, p, tmp_path / "state"), TMAD)
    assert rows(raw.findings) == rows(res.findings)
    assert rows(raw.metrics) == rows(res.metrics)
    for frame in (res.findings, res.metrics):
        files = frame.inputFiles()
        assert not any("lineitem" in f or "previous" in f for f in files)
    assert any("facts-" in f for f in res.findings.inputFiles())


def test_review_suite_from_state(spark, tmp_path):
    c, p = fx.review_snapshots(spark, SF)
    raw = su.review_suite(c, p, REVIEW)
    res = su.review_suite(c, kept(spark, p, tmp_path / "state", REVIEW), REVIEW)
    assert rows(raw.findings) == rows(res.findings)
    assert rows(raw.metrics) == rows(res.metrics)


def test_run_keeps_and_reads_states(spark, tmp_path):
    def deliver(name, lines):
        path = tmp_path / name
        path.write_text("\n".join(["Store ID,Category,Product,Price,Competitor", *lines]) + "\n")
        return str(path)

    old = deliver("july.txt", ["S1,a,x,1.00,K", "S2,b,y,2.00,K", "S2,c,y,2.00,K"])
    new = deliver("august.txt", ["S2,b,y,2.00,K", "S4,b,y,3.00,K"])
    state = str(tmp_path / "july-state")
    run_validation(spark, old, old, "USA", str(tmp_path / "july"), state_out=state)
    plain = run_validation(spark, new, old, "USA", str(tmp_path / "plain"))
    from_state = run_validation(spark, new, None, "USA", str(tmp_path / "state"), previous_state=state)
    for table in ("findings", "metrics"):
        assert rows(spark.read.parquet(f"{plain}/{table}")) == rows(spark.read.parquet(f"{from_state}/{table}"))
    with pytest.raises(ValueError):
        run_validation(spark, new, None, "USA", str(tmp_path / "none"))
