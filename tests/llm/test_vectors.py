"""The operators on embeddings against brute force."""

import collections

import duckdb
import numpy as np
import pytest

from driftwatch.llm import ann_tree, hard_negatives

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
EXTRA = ", score int, rank string, v int, length string, slab int, cell int, id string, h int"
CLASH = (1, "r", 2, "l", 3, 4, "i", 5)


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def frame(spark, rows):
    rows = [(i, v and [c if c is None else float(c) for c in v], label) for i, v, label in rows]
    return spark.createDataFrame([(*r, *CLASH) for r in rows], "vec_id bigint, embedding array<float>, label int" + EXTRA)


def odd_vectors():
    """A common vector (a third of the rows), ties, rows that take no part, extra columns."""
    rng = np.random.default_rng(5)
    some = [(k, rng.normal(size=6).astype(np.float32).tolist(), int(rng.integers(0, 10))) for k in range(240)]
    common = [(1000 + k, [0.5, -0.25, 1.0, 0.0, 0.125, 0.75], k % 3) for k in range(120)]
    none = [(2000, None, 1), (2020, [], 1), (2100, [0.0] * 6, 1), (2200, [1.0, NAN, 0, 0, 0, 0], 2), (2300, [1.0, INF, 0, 0, 0, 0], 2),
            (2400, [1.0, None, 0, 0, 0, 0], 2), (2500, [1.0, 2.0], 2), (None, [1.0] * 6, 1), (2600, [2.0] * 6, None)]
    return some + common + none + some[:20]      # repeated rows


def nearest(rows, every=20, k=20):
    """query -> [(vec_id, score)] by brute force."""
    x = {}
    for i, v, _ in rows:
        if i is not None and v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x[i] = np.asarray(v, dtype=np.float64)
    out = {}
    for q in x:
        if q % every == 0:
            s = []
            for i, v in x.items():
                if i != q:
                    total = 0.0
                    for a, b in zip(x[q].tolist(), v.tolist()):
                        total += a * b
                    s.append((-total, i))
            out[q] = [(i, -t) for t, i in sorted(s)[:k]]
    return out


def test_neighbours_of_odd_rows(spark):
    rows = odd_vectors()
    got = collections.defaultdict(list)
    for r in ann_tree.search(frame(spark, rows), recall=1.0).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = nearest(rows)
    assert set(got) == set(want)
    exact = sum(got[q] == want[q] for q in want)
    held = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert held >= 0.99 and exact >= 0.95 * len(want)


def test_neighbours_recall(spark, embeddings):
    rows = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    x = np.stack([v for _, v in rows]).astype(np.float64)
    ids = np.array([i for i, _ in rows])
    got = collections.defaultdict(dict)
    for r in ann_tree.query(embeddings).collect():
        got[r.query_id][r.vec_id] = r.score
    hit = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        mine = got[ids[k]]
        hit += len(set(ids[np.lexsort((ids, -s))[:20]].tolist()) & set(mine))
        at = [int(np.flatnonzero(ids == i)[0]) for i in mine]
        assert len(mine) == 20 and np.allclose(s[at], list(mine.values()), rtol=0, atol=1e-12)
    assert hit >= 0.9 * 20 * (ids % 20 == 0).sum()


def test_neighbours_over_many_cells(spark, monkeypatch):
    """Small leaves, cells and parts: a leaf over several cells, a cell copied for parts of its queries."""
    for name, value in (("LEAF_ROWS", 8), ("PART_QUERIES", 3), ("CELL_ROWS", 16), ("SCORES", 64)):
        monkeypatch.setattr(ann_tree, name, value)
    first, many = ann_tree.cells_of({0: 10, 1: 5, 2: 50, 3: 1}, 5, 16)
    assert first.tolist() == [0, 0, 1, 5, 5] and many.tolist() == [1, 1, 4, 1, 1]
    rows = odd_vectors()
    want = nearest(rows)
    got = collections.defaultdict(set)
    for r in ann_tree.search(frame(spark, rows), recall=1.0).collect():
        got[r.query_id].add((r.vec_id, r.score))
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.98 * sum(map(len, want.values()))


def test_neighbours_of_few_rows(spark):
    one = frame(spark, [(20, [1.0, 2.0], 1)])
    assert ann_tree.query(one).count() == 0
    two = frame(spark, [(20, [1.0, 2.0], 1), (3, [3.0, -1.0], 1)])
    assert [tuple(r) for r in ann_tree.query(two).collect()] == [(20, 1, 3, 1.0)]


def test_tree_reaches_every_leaf():
    x = np.random.default_rng(1).normal(size=(3000, 12))
    tree = ann_tree.Tree(ann_tree.lifted(x, 9.0), 100)
    assert sorted(tree.visits(x[0], tree.leaves)) == list(range(tree.leaves))
    assert 50 <= tree.leaves <= 200 and set(tree.assign(ann_tree.lifted(x, 9.0))) == set(range(tree.leaves))


def negatives_by_hand(rows):
    """Counter of (anchor, positive, rank, negative, positive score, negative score)."""
    x = {}
    for i, v, label in sorted((r for r in rows if r[0] is not None and r[2] is not None), key=lambda r: r[0]):
        if v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v) and i not in x:
            x[i] = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(c)))) for c in v])
    out = collections.Counter()
    for a, (label, v) in x.items():
        if a % 100:
            continue
        s = sorted((-sum(p * q for p, q in zip(v, w)), i, own == label) for i, (own, w) in x.items() if i != a)
        for ps, p, _ in [t for t in s if t[2]][:5]:
            fits = [t for t in s if not t[2] and 30 * -ps <= 100 * -t[0] <= 90 * -ps]
            for rank, (ns, n, _) in enumerate(fits[:10], 1):
                out[a, p, rank, n, -ps, -ns] += 1
    return out


def test_hard_negatives_of_odd_rows(spark):
    rows = odd_vectors()
    rows += [(300 + k, (10 * np.eye(6)[k % 6]).tolist(), 4 + k % 2) for k in range(100)]
    rows += [(5000, [1e30] * 6, 3), (5100, [-3.0] * 6, 3)]
    got = collections.Counter(tuple(r) for r in hard_negatives.query(frame(spark, rows)).collect())
    assert got == negatives_by_hand([r for r in rows if r[0] != 5000])        # 5000: too long for a long score


def test_hard_negatives_equal_sql(spark, embeddings, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SLAB_BYTES", 1 << 14)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    res = con.execute(hard_negatives.oracle_sql())
    names = [c[0] for c in res.description]
    want = collections.Counter(res.fetchall())
    assert collections.Counter(tuple(r) for r in hard_negatives.query(embeddings).select(*names).collect()) == want


def test_intervals_hold_the_score():
    rng = np.random.default_rng(3)
    for dim in (1, 5, 64, 100):
        turn = hard_negatives.rotations(dim)
        v = rng.integers(-300, 300, (200, dim)).astype(np.int32)
        v[:3] = 0
        slab = hard_negatives.Slab(np.arange(200), np.zeros(200, int), v, *hard_negatives.encode(v, turn), turn)
        width = 0
        for q in v[:20].astype(np.int64):
            low, high = slab.interval(q)
            score = v.astype(np.int64) @ q
            assert (low <= score).all() and (score <= high).all()
            width = max(width, float(np.median((high - low) / (1 + np.linalg.norm(q) * np.linalg.norm(v, axis=1)))))
        assert dim < 64 or width < 0.9
