"""Store rules give the same rows on the ledger as on the snapshot, nulls and a hot store included."""

import random

from driftwatch.operators import compare as cmp
from driftwatch.operators import group_rules as gr
from driftwatch.operators import row_rules as rr
from driftwatch.operators import stats as st
from driftwatch.operators.ledger import ROWS, store_ledger

ABOUT = ["store_id", "store_name", "store_address", "city", "state", "lat_num", "lon_num", "competitor"]
SCHEMA = ("store_id string, sid string, store_name string, store_address string, city string, state string, "
          "lat_num double, lon_num double, competitor string")


def snapshot(spark, seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        s = "S0" if rng.random() < 0.35 else rng.choice(["S1", "S2", "S3", "S4", "S5", " ", None])
        sid = s.strip() if s else None
        rows.append((s, sid, rng.choice(["A", "A", "B", None]), "x", rng.choice(["c", None]), "st",
                     rng.choice([1.00001, 1.00002, 2.5, None, float("nan")]), rng.choice([3.0, 4.0]), rng.choice(["K", None])))
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(map(str, df.collect()))


def test_ledger_gives_the_same_results(spark):
    for seed, n, m in [(1, 600, 500), (2, 40, 90), (3, 0, 20), (4, 20, 0), (5, 0, 0)]:
        c, p = snapshot(spark, seed, n), snapshot(spark, seed + 50, m)
        cl, pl = store_ledger(c, ABOUT), store_ledger(p, ABOUT)
        for rule in (gr.store_multi_location, gr.location_multi_store, gr.store_metadata_conflicts, st.store_row_counts, rr.empty_entity_id):
            assert rows(rule(c)) == rows(rule(cl)), (seed, rule.__name__)
        for rule in (cmp.stores_with_fewer_rows, lambda a, b: cmp.missing_store_pct(a, b, 1.0), lambda a, b: gr.count_margin(a, b, 2.0),
                     lambda a, b: gr.distinct_field_values(a, b, ["competitor"])):
            assert rows(rule(c, p)) == rows(rule(cl, pl)), seed


def test_ledger_holds_every_row_once(spark):
    c = snapshot(spark, 9, 300)
    led = store_ledger(c, [*ABOUT, "no_such_column"])
    assert led.agg({ROWS: "sum"}).first()[0] == 300
    assert rows(led.drop(ROWS)) == rows(c.select(led.drop(ROWS).columns).distinct())
