"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set is its distinct word shingles (64-bit hashes).  Documents with equal sets
are one class, represented by its least document; only representatives go on.  Each
of ``TREES`` signature orders sorts them by ``DEPTH`` MinHash values.  A region is a stretch of
one order whose rows share their first values (the least depth).

Candidates first are neighbours: rounds over a few and then all orders link what stands close together, which
shrinks large groups of near copies to a component.  The rounds only save work.  After them all pairs
of rows of different components that share a region at the least depth are compared, however many rows
the region has: its rows are dealt into blocks, and every two blocks that can hold such a pair meet in a task.

A pair is confirmed on the full sets if the whole signatures agree as much as those of a pair at the
threshold do (but for 3 in 100,000).

The least depth is the largest at which a pair at the threshold shares a region of some order with
probability 1 - 2e-5 or more.  Work grows with the square of the rows of different components in a region.

Orders are range-partitioned on (order, signature, doc_id), so a region of any size is
split over tasks.  Components, candidates and links stay in Spark.

Defined results: documents without words (null, empty or blank text) have an empty
set, are linked with nothing and are their own component; ties go to the least doc_id, then the
least hash of the text; rows that share a doc_id (or have none) but not the text are documents of their own, told
apart by a 64-bit hash of the text, so components that start at one id share a component_id; an empty table
gives no rows; extra columns are ignored; texts of any length are handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, id_key, land, shuffle_partitions, worker_cache
from .components import components

TREES = 16
DEPTH = 8
#: Rounds of neighbours: orders used, rows ahead that a row is compared with.
ROUNDS = [(4, 1), (TREES, 2)]
#: Rows and shingles of a block of a region, whose rows meet those of another block in one task.
BLOCK_ROWS, BLOCK_WORDS = 1000, 4_000_000
#: Bytes of words whose hash a worker remembers.
CACHE = 64 << 20

_M = np.uint64(0x9E3779B97F4A7C15)


def least_depth(threshold: float) -> int:
    fits = [d for d in range(1, DEPTH + 1) if (1 - threshold ** d) ** TREES <= 2e-5]
    return max(fits, default=1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    def __init__(self, size: int):
        from xxhash import xxh3_64_intdigest

        self.size, self.digest, self.known = size, xxh3_64_intdigest, Remembered(CACHE)
        rng = np.random.default_rng(20240229)
        self.a = rng.integers(0, 2 ** 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2 ** 63, TREES * DEPTH, dtype=np.uint64)

    def _learn(self, word: bytes) -> int:
        h = self.known.table.get(word)
        if h is None:
            h = self.digest(word)
            self.known.keep(word, h)
        return h

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the word shingles of a text, ASCII letters lower-cased."""
        words = (text or "").encode().lower().split()       # ASCII white space, as bytes
        if not words:
            return np.empty(0, np.uint64)
        w = np.fromiter(map(self._learn, words), dtype=np.uint64, count=len(words))
        k = min(self.size, len(w))
        h = w[:len(w) - k + 1].copy()
        for j in range(1, k):
            h = h * _M + w[j:len(w) - k + 1 + j]
        return np.unique(_mixed(h + np.uint64(k)))

    def signature(self, s: np.ndarray) -> bytes:
        """TREES * DEPTH MinHash values, big-endian 32 bits each, in order."""
        least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(s), 2048):
            h = np.multiply.outer(self.a, s[at:at + 2048])
            h += self.b[:, None]
            np.minimum(least, h.min(axis=1), out=least)
        return (least >> np.uint64(32)).astype(">u4").tobytes()


def _shingler(size: int) -> Shingler:
    return worker_cache(("shingles", size), lambda: Shingler(size))


def _document() -> list:
    """d, u: a document's id and the hash of its text, as texts may share an id."""
    return [id_key().cast("bigint").alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("u")]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, d, u (hash of the text), n (set size), s1, s2 (hash of the set), sig (null for an empty set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("d", pa.int64()), ("u", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()),
                        ("s2", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        sh = _shingler(size)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n, s1, s2, sig = [], [], [], []
                for text in part.column(3):
                    s = sh.shingles(text.as_py())
                    both = np.frombuffer(xxh3_128_digest(s.tobytes()), dtype=np.int64)
                    n.append(len(s))
                    s1.append(int(both[0]))
                    s2.append(int(both[1]))
                    sig.append(sh.signature(s) if len(s) else None)
                yield pa.record_batch([*part.columns[:3], pa.array(n, pa.int64()), pa.array(s1, pa.int64()),
                                       pa.array(s2, pa.int64()), pa.array(sig, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_document(), "text").mapInArrow(
        run, "doc_id bigint, d bigint, u bigint, n bigint, s1 bigint, s2 bigint, sig binary")


def orders(reps: DataFrame) -> DataFrame:
    """A row per representative and order: tree, key (its DEPTH values), d, n."""
    width = 4 * DEPTH
    each = F.expr(f"transform(sequence(0, {TREES - 1}), t -> named_struct('tree', t, "
                  f"'key', substring(sig, t * {width} + 1, {width})))")
    return reps.select("d", "n", F.explode(each).alias("o")).select("o.tree", "o.key", "d", "n")


def _matrix(keys: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), dtype=">u4").reshape(-1, DEPTH)


def in_regions(rows: DataFrame, depth: int) -> DataFrame:
    """The rows of ``orders`` that share a region with another (a task's first and last row always)."""
    by = ["tree", "key", "d"]
    ordered = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(b, before, after):
            tree, key = b.column(0).to_numpy(), _matrix(b.column(1))[:, :depth]
            same = np.ones(len(tree) + 1, bool)
            same[1:-1] = (tree[1:] == tree[:-1]) & (key[1:] == key[:-1]).all(axis=1)
            same[0] = before is None or before == (tree[0], key[0].tobytes())
            same[-1] = after is None or after == (tree[-1], key[-1].tobytes())
            return b.filter(pa.array(same[:-1] | same[1:]))

        def at(b, k):
            one = b.slice(k, 1)
            return one.column(0)[0].as_py(), _matrix(one.column(1))[0, :depth].tobytes()

        last = before = None
        for b in batches:
            if b.num_rows:
                if last is not None:
                    yield judged(last, before, at(b, 0))
                    before = at(last, last.num_rows - 1)
                last = b
        if last is not None:
            yield judged(last, before, None)

    return ordered.select("tree", "key", "d", "n").mapInArrow(run, "tree int, key binary, d bigint, n bigint")


def least_agreement(threshold: float) -> int:
    """Equal MinHash values that a pair at the threshold has but for 3 in 100,000 (4 standard deviations)."""
    size = TREES * DEPTH
    return int(np.floor(size * threshold - 4 * np.sqrt(size * threshold * (1 - threshold))))


def _neighbours(depth: int, window: int, threshold: int):
    """Over rows (tree, key, d, n, c, sig) in order: pairs of neighbours of different components
    whose whole signatures agree enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enough = least_agreement(threshold / 100)
        carry = None
        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(0).to_numpy(), _matrix(b.column(1)), *(b.column(k).to_numpy() for k in (2, 3, 4)),
                   np.frombuffer(b"".join(b.column(5).to_pylist()), dtype=">u4").reshape(-1, TREES * DEPTH)]
            x = new if carry is None else [np.concatenate([p, q]) for p, q in zip(carry, new)]
            held = 0 if carry is None else len(carry[0])
            tree, key, d, n, c, sig = x
            for step in range(1, window + 1):
                i = np.arange(max(0, held - step), len(d) - step)
                j = i + step
                i, j = i[j >= held], j[j >= held]
                alike = ((tree[i] == tree[j]) & (key[i, :depth] == key[j, :depth]).all(axis=1) & (c[i] != c[j])
                         & (100 * np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])))
                i, j = i[alike], j[alike]
                near = np.fromiter(((sig[p] == sig[q]).sum() for p, q in zip(i, j)), dtype=np.int64, count=len(i)) >= enough
                yield pa.record_batch([pa.array(f(d[i[near]], d[j[near]]), pa.int64()) for f in (np.minimum, np.maximum)],
                                      names=["a", "b"])
            carry = [p[-window:] for p in x]

    return run


def candidates(active: DataFrame, comp: DataFrame, trees: int, window: int, depth: int, threshold: int) -> DataFrame:
    """Distinct pairs a < b of neighbours."""
    by = ["tree", "key", "d"]
    rows = active.where(F.col("tree") < trees).join(comp, "d").select("tree", "key", "d", "n", "c", "sig")
    return (rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
            .mapInArrow(_neighbours(depth, window, threshold), "a bigint, b bigint").distinct())


def full_sets(docs: DataFrame, ids: DataFrame, size: int, repeated: bool) -> DataFrame:
    """d, s: the sorted shingle hashes (packed 64-bit) of the documents in ``ids`` (d, u, node), by node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = _shingler(size)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.record_batch([part.column(0), pa.array([sh.shingles(t.as_py()).tobytes() for t in part.column(1)], pa.binary())],
                                      names=["d", "s"])

    mine = docs.select(*_document(), "text").join(ids, ["d", "u"])
    if repeated:
        mine = mine.dropDuplicates(["d", "u"])
    return mine.select("node", "text").mapInArrow(run, "d bigint, s binary")


def _region(depth: int):
    return F.expr(f"substring(key, 1, {4 * depth})").alias("region")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (tree, region, d, n, c, ...) of regions with more than one component, once for each pair of
    blocks (i, j) they belong to, so that any two rows of different components meet.

    The largest component of a region need not meet itself, so it has blocks of its own (negative).
    Blocks have about ``BLOCK_ROWS`` rows and ``BLOCK_WORDS`` shingles.
    """
    by = ["tree", "region"]
    sizes = rows.groupBy(*by, "c").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    whole = sizes.groupBy(*by).agg(F.max(F.struct("k", "c", "w")).alias("m"), F.sum("k").alias("k"), F.sum("w").alias("w"))

    def blocks(k, w):
        return F.ceil(F.greatest(k / BLOCK_ROWS, w / BLOCK_WORDS)).cast("int")

    whole = (whole.where("k > m.k")
             .select(*by, F.col("m.c").alias("most"), blocks(F.col("m.k"), F.col("m.w")).alias("n_most"),
                     blocks(F.col("k") - F.col("m.k"), F.col("w") - F.col("m.w")).alias("n_rest")))
    own = F.xxhash64("d")
    mine = F.when(F.col("c") == F.col("most"), -1 - F.pmod(own, "n_most")).otherwise(F.pmod(own, "n_rest")).cast("int")
    # rest meets rest and the largest component; that meets the rest only
    others = F.expr("if(mine < 0, sequence(0, n_rest - 1), sequence(-n_most, n_rest - 1))")
    at = rows.join(whole, by).withColumn("mine", mine).withColumn("other", F.explode(others))
    return (at.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
            .drop("most", "n_most", "n_rest", "mine", "other"))


def _meet(depth: int, threshold: int, exact: bool):
    """Over rows (tree, region, i, j, d, n, c, sig[, s]) sorted by the first four: all pairs of different components
    in a group whose whole signatures agree enough, each in the first order in which it shares a region.

    Not exact: the rows with such a pair.  Exact: the links (a, b) by the full sets that join components.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enough = least_agreement(threshold / 100)

        def judged(rows):
            tree, region, i, j = rows.column(0)[0], rows.column(1)[0], rows.column(2)[0].as_py(), rows.column(3)[0].as_py()
            d, n, c = (rows.column(k).to_numpy() for k in (4, 5, 6))
            sig = np.frombuffer(b"".join(rows.column(7).to_pylist()), dtype=">u4").astype(np.uint32).reshape(-1, TREES * DEPTH)
            starts = sig.reshape(-1, TREES, DEPTH)[:, :, :depth]
            own, root = tree.as_py(), {int(x): int(x) for x in c}
            sets = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in rows.column(8)] if exact else None
            hit, links = np.zeros(len(d), bool), []

            def find(x):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for p in range(len(d) - 1):
                q = p + 1 + np.flatnonzero((c[p + 1:] != c[p]) & (100 * np.minimum(n[p + 1:], n[p])
                                                                  >= threshold * np.maximum(n[p + 1:], n[p])))
                q = q[np.count_nonzero(sig[q] == sig[p], axis=1) >= enough]
                if len(q):
                    q = q[(starts[q] == starts[p]).all(axis=2).argmax(axis=1) == own]
                if not len(q):
                    continue
                hit[p] = hit[q] = True
                for k in q.tolist() if exact else ():
                    x, y = find(int(c[p])), find(int(c[k]))
                    if x != y:
                        both = len(np.intersect1d(sets[p], sets[k], assume_unique=True))
                        if 100 * both >= threshold * (len(sets[p]) + len(sets[k]) - both):
                            root[x] = y
                            links.append((int(d[p]), int(d[k])))
            if exact:
                return pa.record_batch([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())],
                                       names=["a", "b"])
            at = np.flatnonzero(hit)
            return pa.record_batch([pa.array([own] * len(at), pa.int32()), pa.array([region.as_py()] * len(at), pa.binary()),
                                    pa.array(d[at])], names=["tree", "region", "d"])

        held, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            tree, i, j = (b.column(k).to_numpy() for k in (0, 2, 3))
            region = np.array(b.column(1).to_pylist(), dtype=object)
            new = np.flatnonzero((tree[1:] != tree[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (region[1:] != region[:-1])) + 1
            for at, to in zip([0, *new.tolist()], [*new.tolist(), b.num_rows]):
                group = (tree[at], region[at], i[at], j[at])
                if group != now and held:
                    yield judged(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                now = group
                held.append(b.slice(at, to - at))
        if held:
            yield judged(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def remaining_links(active: DataFrame, comp: DataFrame, sets: DataFrame, depth: int, threshold: int) -> DataFrame:
    """Links (a, b) between components among all pairs of rows that share a region at ``depth``.

    Nothing is windowed: a first pass compares the signatures of every such pair and keeps the rows that have a
    candidate, a second one confirms the candidates on the full sets where they meet.
    """
    by = ["tree", "region", "i", "j"]
    parts = shuffle_partitions(active.sparkSession)
    rows = active.join(comp, "d").select("tree", _region(depth), "d", "n", "c", "sig")

    def met(x, schema, exact):
        cols = [*by, "d", "n", "c", "sig", *(["s"] if exact else [])]
        return _dealt(x).select(*cols).repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(
            _meet(depth, threshold, exact), schema)

    hit = land(met(rows, "tree int, region binary, d bigint", False).distinct(), "open")
    return land(met(rows.join(hit, ["tree", "region", "d"], "left_semi").join(sets, "d"), "a bigint, b bigint", True).distinct(),
                "links")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs with 100 * intersection >= threshold * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for s, t in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (s, t))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    full = (pairs.join(sets.withColumnRenamed("d", "a").withColumnRenamed("s", "sa"), "a")
            .join(sets.withColumnRenamed("d", "b").withColumnRenamed("s", "sb"), "b"))
    return full.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components (d, c) after the links (a, b)."""
    of = lambda x, y: comp.select(F.col("d").alias(x), F.col("c").alias(y))
    roots = components(links.join(of("a", "u"), "a").join(of("b", "v"), "b").select("u", "v"))
    return land(comp.join(roots, F.col("c") == F.col("node"), "left").select("d", F.coalesce("root", "c").alias("c")),
                "component")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, d, u, n_shingles, component_id, kept per row; threshold in hundredths."""
    sk = land(sketches(docs, size), "sketches")
    words = sk.where("n > 0")
    classes = words.groupBy("s1", "s2").agg(F.min(F.struct("d", "u")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # nodes are numbered in the order of their representatives, so the least node of a component has the least
    classes = land(classes.select("s1", "s2", "rep.d", "rep.u", "n", "sig")
                   .repartitionByRange(shuffle_partitions(docs.sparkSession), "d", "u").sortWithinPartitions("d", "u")
                   .withColumn("node", F.monotonically_increasing_id()), "classes")
    least = least_depth(threshold / 100)
    reps = classes.select(F.col("node").alias("d"), "n", "sig")
    active = land(in_regions(orders(reps), least).join(reps.select("d", "sig"), "d"), "regions")
    ids = classes.select("d", "u", "node").join(active.select(F.col("d").alias("node")).distinct(), "node", "left_semi")
    repeated = words.groupBy("d", "u").count().where("count > 1").limit(1).count() > 0
    sets = land(full_sets(docs, ids, size, repeated), "sets")
    comp = land(active.select("d", F.col("d").alias("c")).distinct(), "component")
    for trees, window in ROUNDS:
        pairs = land(candidates(active, comp, trees, window, least, threshold), "pairs")
        comp = _merged(comp, land(confirmed(pairs, sets, threshold), "links"))
    comp = _merged(comp, remaining_links(active, comp, sets, least, threshold))
    root = (classes.select("s1", "s2", "node").join(comp.withColumnRenamed("d", "node"), "node", "left")
            .select("s1", "s2", F.coalesce("c", "node").alias("node"))
            .join(classes.select("node", F.col("d").alias("rd"), F.col("u").alias("ru")), "node").drop("node"))
    alone = F.col("n") == 0
    return (sk.join(root, ["s1", "s2"], "left")
            .select("doc_id", "d", "u", F.col("n").alias("n_shingles"),
                    F.when(alone, F.col("d")).otherwise(F.col("rd")).alias("component_id"),
                    (alone | ((F.col("d") == F.col("rd")) & (F.col("u") == F.col("ru")))).alias("kept")))


def query(docs: DataFrame) -> DataFrame:
    """Three-word shingles at 0.85."""
    return near_duplicates(docs, 3, 85).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` (all columns): one document of each group of near duplicates."""
    from pyspark.sql import Window

    out = near_duplicates(docs, size, threshold)
    kept = out.where("kept").select(F.col("d").alias("__d"), F.col("u").alias("__u")).distinct()
    d, u = _document()
    rows = docs.withColumn("__d", d).withColumn("__u", u)
    once = (rows.join(kept, ["__d", "__u"], "left_semi")
            .withColumn("__k", F.row_number().over(Window.partitionBy("__d", "__u").orderBy("__u"))))
    return once.where("__k = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
