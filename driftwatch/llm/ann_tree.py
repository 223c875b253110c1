"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The greatest inner product becomes the least distance by one more component: ``sqrt(M ** 2 - |x| ** 2)``
for a row x, where M is the greatest length of all rows, and zero for a query.

1. The tree is fitted on the driver on at most ``SAMPLE`` rows (those of least hash of the id): each node is split by
   k-means into at most ``BRANCH`` children, down to about ``LEAF_ROWS`` rows of the table a leaf, ``LEAVES`` at
   most.  The tree, bounded by that, is broadcast.
2. Every row is indexed: it goes down the tree to the nearest child each time.
3. A query goes through the tree with a priority queue of nodes, the most promising first: inner
   product with the centre plus ``REACH`` times the spread of the node's rows.  The leaves come out in the order of visits.
4. How many leaves to visit is calibrated: for ``PROBES`` queries the exact neighbours are found over all rows, and the
   visits are widened, one leaf at a time, until the visited leaves hold ``RECALL`` of them.
5. Neighbouring leaves form cells of bounded rows.  A query is sent once to each cell with leaves it visits, scored there
   against just those, and its best of all cells are merged.

A leaf with more rows than a cell (equal or almost equal vectors) is split by a hash of the id over several cells, and a
cell to which very many queries go is copied for parts of them, so neither a common vector nor a common query
meets in one task.  Candidates are found by matrix products and then scored in double precision with components
summed in order; all candidates within rounding of the last place are scored so, and equal vectors get equal scores.

Defined results: rows with a null id, a null or zero vector, or any null or non-finite component take no part, nor do
vectors of another length than most rows have.  Of rows that share a vec_id the one of the least vector takes part.  Ties go to
the smaller vec_id; a query without candidates has no rows; an empty table gives none; extra columns are ignored.
Lengths beyond 1e150, whose square is no double, are not supported.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_landed, land, shuffle_partitions
from .vectors import dimension, distinct_ids, finite, inner, matrix, packed, unpacked

SAMPLE, LEAVES, LEAF_ROWS, BRANCH, ROUNDS = 16_384, 1024, 128, 16, 10
#: How much of a node's spread counts towards its promise.
REACH = 0.5
#: Queries whose exact neighbours are found, and the share of these that the visited leaves must hold.
PROBES, RECALL = 200, 0.95
#: Rows of a cell (a part of it holds them all), and queries of a part.
CELL_ROWS, PART_QUERIES = 65_536, 16_384
#: Scores computed at a time.
SCORES = 1 << 22


# ---------------------------------------------------------------- tree

def _clusters(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Cluster of each row (k-means from distant random rows); clusters that stay empty are left out."""
    centres = [x[rng.integers(len(x))]]
    near = ((x - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k and near.sum() > 0:
        centres.append(x[rng.choice(len(x), p=near / near.sum())])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(axis=1))
    c = np.stack(centres)
    for _ in range(ROUNDS):
        at = (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        used = np.unique(at)
        c = np.stack([x[at == j].mean(axis=0) for j in used])
        at = np.searchsorted(used, at)
    return at


class Tree:
    """Nodes in breadth-first order: centre, spread, children (first, end) or leaf number."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        centres, spread, self.children, self.leaf = [sample.mean(axis=0)], [0.0], [], []
        todo, at, self.leaves = [(sample, leaves)], 0, 0
        while at < len(todo):
            rows, quota = todo[at]
            todo[at] = None
            at += 1
            cluster = _clusters(rows, min(BRANCH, quota), rng) if quota > 1 and len(rows) > 1 else np.zeros(len(rows), int)
            if not cluster.max(initial=0):
                self.children.append((0, 0))
                self.leaf.append(self.leaves)
                self.leaves += 1
                continue
            self.leaf.append(-1)
            self.children.append((len(todo), len(todo) + cluster.max() + 1))
            for j in range(cluster.max() + 1):
                mine = rows[cluster == j]
                centres.append(mine.mean(axis=0))
                spread.append(np.sqrt(((mine - centres[-1]) ** 2).sum(axis=1).mean()))
                todo.append((mine, max(1, round(quota * len(mine) / len(rows)))))
        self.centres, self.spread = np.stack(centres), np.array(spread)
        self.half = (self.centres ** 2).sum(axis=1) / 2
        self._number()

    def _number(self) -> None:
        """Numbers the leaves in depth-first order, so that neighbours have near numbers."""
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            first, end = self.children[node]
            if first == end:
                order.append(node)
            stack.extend(range(end - 1, first - 1, -1))
        for number, node in enumerate(order):
            self.leaf[node] = number

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each (lifted) row."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            first, end = self.children[node]
            if first == end:
                out[rows] = self.leaf[node]
                continue
            nearest = (x[rows] @ self.centres[first:end].T - self.half[first:end]).argmax(axis=1)
            todo += [(first + j, rows[nearest == j]) for j in np.unique(nearest).tolist()]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        length, out, queue = np.sqrt(q @ q), [], [(0.0, 0)]
        while queue and len(out) < most:
            node = heapq.heappop(queue)[1]
            first, end = self.children[node]
            if first == end:
                out.append(self.leaf[node])
                continue
            promise = self.centres[first:end, :-1] @ q + REACH * length * self.spread[first:end]
            for j, p in enumerate(promise.tolist()):
                heapq.heappush(queue, (-p, first + j))
        return out


def received(shared) -> Tree:
    """The tree of a broadcast dictionary of its parts (workers may not have the library to import)."""
    tree = object.__new__(Tree)
    vars(tree).update(shared.value)
    return tree


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the component that gives all of them one length."""
    return np.concatenate([x, np.sqrt(np.maximum(longest ** 2 - (x * x).sum(axis=1), 0))[:, None]], axis=1)


# ---------------------------------------------------------------- scoring

def first_of_each(key: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each key, by falling score, then id."""
    order = np.lexsort((ids, -score, key))
    if not len(order):
        return order
    own = key[order]
    start = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]


def best_of(q: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the first ``k`` rows of each query.  All rows within rounding of the last place are scored exactly."""
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    size = np.sqrt((x * x).sum(axis=1)).max(initial=0)
    for at in range(0, len(q), step := max(1, SCORES // max(1, len(x)))):
        part = q[at:at + step]
        s = part @ x.T
        s[own[at:at + step, None] == ids[None, :]] = -np.inf
        least = np.full(len(part), -np.inf)
        if len(x) > k:
            least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
        room = 1e-12 * x.shape[1] * size * np.sqrt((part * part).sum(axis=1))
        i, j = np.nonzero((s >= (least - room)[:, None]) & (s > -np.inf))
        score = np.concatenate([np.empty(0), *(inner(part[i[n:n + 65536]], x[j[n:n + 65536]]) for n in range(0, len(i), 65536))])
        first = first_of_each(i, score, ids[j], k)
        out.append((i[first] + at, j[first], score[first]))
    return tuple(np.concatenate(c) for c in zip(*out))


# ---------------------------------------------------------------- index and search

def usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, v (doubles), length of the rows that take part; and the dimension."""
    dim = dimension(rows)
    fine = rows.where(finite(dim) & F.lit(dim > 0)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(1), dim)
            length = np.sqrt((v * v).sum(axis=1))
            some = length > 0
            yield pa.record_batch([b.column(0).filter(pa.array(some)), packed(v[some]), pa.array(length[some])],
                                  names=["vec_id", "v", "length"])

    return distinct_ids(fine).mapInArrow(run, "vec_id bigint, v binary, length double"), dim


def sample_rows(rows: DataFrame, n: int, most: int) -> list[tuple[int, bytes]]:
    """(vec_id, vector) of at most ``most`` of ``n`` rows, those of least hash; little more than that reaches the driver."""
    share = min(1.0, (most + 4 * most ** 0.5) / max(n, 1))
    own = F.xxhash64("vec_id")
    few = rows if share == 1.0 else rows.where(own <= F.lit(int(-2 ** 63 + share * (2 ** 64 - 1))).cast("bigint"))
    got = sorted((r["h"], r["vec_id"], bytes(r["v"])) for r in few.select(own.alias("h"), "vec_id", "v").collect())
    return [(i, v) for _, i, v in got[:most]]


def _doubles(column: pa.Array) -> np.ndarray:
    return unpacked(column, np.float64)


def indexed(rows: DataFrame, tree, longest: float) -> DataFrame:
    """vec_id, v, leaf of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = received(tree)
        for b in batches:
            leaf = known.assign(lifted(_doubles(b.column(1)), longest)) if b.num_rows else np.empty(0, np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(leaf.astype(np.int32))], names=["vec_id", "v", "leaf"])

    return rows.select("vec_id", "v").mapInArrow(run, "vec_id bigint, v binary, leaf int")


def calibrated_visits(index: DataFrame, probes: list, tree: Tree, k: int, recall: float) -> int:
    """Leaves to visit so that they hold ``recall`` of the exact neighbours of the probes."""
    ids, q = np.array([i for i, _ in probes]), np.stack([np.frombuffer(v) for _, v in probes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            mine, leaf = b.column(0).to_numpy(), b.column(2).to_numpy()
            i, j, s = best_of(q, ids, _doubles(b.column(1)), mine, k)
            new = (i, mine[j], s, leaf[j])
            held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
            first = first_of_each(held[0], held[2], held[1], k)
            held = tuple(x[first] for x in held)
        if held is not None:
            yield pa.record_batch([pa.array(held[0]), pa.array(held[1]), pa.array(held[2]), pa.array(held[3])],
                                  names=["probe", "vec_id", "score", "leaf"])

    best = Window.partitionBy("probe").orderBy(F.col("score").desc(), "vec_id")
    exact = (index.mapInArrow(run, "probe bigint, vec_id bigint, score double, leaf int")
             .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("probe", "leaf").collect())
    place = [{leaf: n for n, leaf in enumerate(tree.visits(v, tree.leaves))} for v in q]
    needed = np.sort([place[r["probe"]][r["leaf"]] + 1 for r in exact])
    if not len(needed):
        return 1
    # widen the visits until so many of the neighbours lie in visited leaves
    return int(needed[int(np.ceil(recall * len(needed))) - 1])


def cells_of(counts: dict[int, int], leaves: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First cell and number of cells of each leaf: neighbouring leaves share a cell of at most ``most`` rows; a leaf
    of more rows has cells of its own."""
    first, many, cell, held = np.zeros(leaves, np.int64), np.ones(leaves, np.int64), 0, 0
    for leaf in range(leaves):
        n = counts.get(leaf, 0)
        if held and held + n > most:
            cell, held = cell + 1, 0
        first[leaf], many[leaf] = cell, max(1, -(-n // most))
        held += n
        if many[leaf] > 1:
            cell, held = cell + many[leaf], 0
    return first, many


def _visiting(tree, visits: int, first, many):
    """Over queries (vec_id, v): a row for each cell they go to, with the leaves they visit there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = received(tree)
        for b in batches:
            at, cell, leaves = [], [], []
            for n, q in enumerate(_doubles(b.column(1)) if b.num_rows else ()):
                by_cell = {}
                for leaf in known.visits(q, visits):
                    for c in range(first[leaf], first[leaf] + many[leaf]):
                        by_cell.setdefault(c, []).append(leaf)
                for c, visited in by_cell.items():
                    at.append(n)
                    cell.append(c)
                    leaves.append(visited)
            yield pa.record_batch([pa.array(cell, pa.int64()), b.column(0).take(pa.array(at, pa.int64())),
                                   b.column(1).take(pa.array(at, pa.int64())), pa.array(leaves, pa.list_(pa.int32()))],
                                  names=["cell", "vec_id", "v", "leaves"])

    return run


def _searched(k: int):
    """Over (cell, part, tag, vec_id, v, leaves) by cell and part, rows before queries: each query's best rows there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, rows = None, [], None
        for b in batches:
            cell, part, tag = (b.column(c).to_numpy() for c in range(3))
            change = (np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(tag) != 0)
            edges = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
            for at, to in zip(edges, edges[1:]):
                if at == to:
                    continue
                if (cell[at], part[at]) != now:
                    now, parts, rows = (cell[at], part[at]), [], None
                piece = b.slice(at, to - at)
                ids, v, leaves = piece.column(3).to_numpy(), _doubles(piece.column(4)), piece.column(5)
                sizes = np.diff(np.asarray(leaves.offsets))
                flat = leaves.flatten().to_numpy()
                if tag[at] == 0:
                    parts.append((ids, v, flat))
                    continue
                if rows is None and parts:
                    ids_, v_, leaf_ = (np.concatenate(x) for x in zip(*parts))
                    rows, parts = {leaf: (ids_[leaf_ == leaf], v_[leaf_ == leaf]) for leaf in np.unique(leaf_).tolist()}, []
                if rows is None:
                    continue
                of = np.repeat(np.arange(len(ids)), sizes)
                found = []
                for leaf in np.unique(flat).tolist():
                    if leaf in rows:
                        mine = of[flat == leaf]
                        i, j, s = best_of(v[mine], ids[mine], rows[leaf][1], rows[leaf][0], k)
                        found.append((mine[i], rows[leaf][0][j], s))
                if found:
                    i, row, s = (np.concatenate(x) for x in zip(*found))
                    first = first_of_each(i, s, row, k)
                    yield pa.record_batch([pa.array(ids[i[first]]), pa.array(row[first]), pa.array(s[first])],
                                          names=["query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose vec_id is divisible by ``every``."""
    spark = rows.sparkSession
    parts = shuffle_partitions(spark)
    fine, dim = usable(rows)
    fine = land(fine, "vectors")
    n, longest = fine.agg(F.count("*"), F.max("length")).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sample = np.stack([np.frombuffer(v) for _, v in sample_rows(fine, n, SAMPLE)])
    tree = Tree(lifted(sample, longest), max(1, min(LEAVES, n // LEAF_ROWS)))
    shared = spark.sparkContext.broadcast(vars(tree))
    index = land(indexed(fine, shared, longest), "index")
    drop_landed(fine)
    queries = index.where(F.col("vec_id") % every == 0)
    asked = queries.count()
    probes = sample_rows(queries, asked, PROBES)
    visits = calibrated_visits(index, probes, tree, k, recall) if probes else 1

    counts = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}
    first, many = cells_of(counts, tree.leaves, max(1024, min(CELL_ROWS, -(-n // (2 * parts)))))
    going = land(queries.select("vec_id", "v").mapInArrow(
        _visiting(shared, visits, first, many), "cell bigint, vec_id bigint, v binary, leaves array<int>"), "visits")
    # cells to which many queries go are copied, a copy for each part of these
    copies = {r["cell"]: -(-r["count"] // PART_QUERIES) for r in going.groupBy("cell").count().collect()}
    cell_rows = np.array([copies.get(c, 0) for c in range(int((first + many).max()))])
    places = spark.sparkContext.broadcast((first, many, cell_rows))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, spread, parts_of = places.value
        for b in batches:
            leaf = b.column(2).to_numpy()
            cell = start[leaf] + b.column(3).to_numpy() % spread[leaf]
            times = parts_of[cell]
            at = np.repeat(np.arange(b.num_rows), times)
            part = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            take = pa.array(at, pa.int64())
            one = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1), pa.int32()), b.column(2).take(take))
            yield pa.record_batch([pa.array(cell[at]), pa.array(part.astype(np.int32)), b.column(0).take(take),
                                   b.column(1).take(take), one], names=["cell", "part", "vec_id", "v", "leaves"])

    schema = "cell bigint, part int, vec_id bigint, v binary, leaves array<int>"
    own = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    held = index.select("vec_id", "v", "leaf", own.alias("own")).mapInArrow(dealt, schema)
    busy = [(c, m) for c, m in copies.items() if m > 1]
    part_of = F.lit(0)
    if busy:                                     # one entry a cell at most
        table = F.create_map(*[F.lit(x).cast("bigint") for pair in busy for x in pair])
        part_of = F.pmod(F.xxhash64("vec_id"), F.coalesce(F.try_element_at(table, F.col("cell")), F.lit(1)))
    asking = going.select("cell", part_of.cast("int").alias("part"), "vec_id", "v", "leaves")
    both = (held.withColumn("tag", F.lit(0)).unionByName(asking.withColumn("tag", F.lit(1)))
            .select("cell", "part", "tag", "vec_id", "v", "leaves")
            .repartition(2 * parts, "cell", "part").sortWithinPartitions("cell", "part", "tag", "vec_id"))
    found = both.mapInArrow(_searched(k), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = land(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
               .select("query_id", "rank", "vec_id", "score"), "neighbours")
    drop_landed(index)
    drop_landed(going)
    return out


def query(rows: DataFrame) -> DataFrame:
    return search(rows)
