"""Hard-negative mining with rotated one-bit codes and exact interval bounds.

Each component becomes ``floor(256 * x)``; a score is the integer inner product with the anchor.
A vector is stored with ``CODES`` one-bit codes.  Code m is the signs of the rotated remainder of
the vector after the codes before it, and stands for the unit vector ``s_m`` with components
``+-1 / sqrt(dim)`` in rotated space.  Stored beside it is its alignment ``a_m``, the inner
product of the remainder with ``s_m``; after the last code only the length ``r`` of the remainder is.

An anchor is rotated alike and quantised to ``BITS`` bits a component, so that its inner product with
every ``s_m`` comes from popcounts of the code with its bit planes.  The sum over m of ``a_m`` times that
estimates the score.  By Cauchy-Schwarz the estimate is off by at most the anchor's length
times ``r``, plus ``a_m`` times the length of each quantisation error.  This gives an interval that holds the
score for certain (rounding is covered by ``SLACK``).

Only rows whose interval can reach the result are scored, in integers: for positives, those whose upper
end reaches the fifth best lower end; for negatives, those whose interval meets the band, and reaches the tenth
best lower end among those certainly in the band.  So the result is exact.

Work is dealt in slabs of at most ``SLAB_BYTES`` of rows, chosen by a hash of the id; the anchors (a stated
query set) stream past each slab, once for positives and once for negatives.  A slab gives the best few of an anchor, and these
are merged by a ranked window over the anchor.  No label or value decides where a row goes, so no
label is hot.

Defined results: rows with a null id or label, a null vector, or any null or non-finite component take no
part, nor do vectors of another length than most rows have, or so long that a score would not fit a
long (squared length of the integers 2 ** 62 or more).  Zero vectors score 0.  Of rows that share a vec_id the one of
least label, then least vector, takes part.  Equal scores go by vec_id.  An anchor without
positives or negatives has no rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_landed, land
from .vectors import dimension, distinct_ids, finite, matrix, packed, unpacked

SCALE = 256
#: One-bit codes a vector, and bits of a component of an anchor.
CODES, BITS = 3, 6
#: Bytes of rows that a task holds while the anchors stream past.
SLAB_BYTES = 128 << 20
#: Relative allowance for rounding of the intervals' ends.
SLACK = 1e-9
POSITIVES, NEGATIVES = 5, 10
#: Band of a negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90


def rotations(dim: int, codes: int = CODES, seed: int = 29) -> np.ndarray:
    """Random orthogonal matrices, one a code."""
    rng = np.random.default_rng(seed)
    return np.stack([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(codes)])


def bit_words(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    n, dim = bits.shape
    whole = np.zeros((n, -(-dim // 64) * 64), bool)
    whole[:, :dim] = bits
    return np.packbits(whole, axis=1).view(np.uint64)


def encode(v: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes as words, one row a vector, code after code; alignments and the remainder's length)."""
    rest, dim = v.astype(np.float64), v.shape[1]
    words, stored = [], []
    for p in turn:
        y = rest @ p.T
        bits = y >= 0
        a = np.abs(y).sum(axis=1) / np.sqrt(dim)
        rest = rest - (a / np.sqrt(dim))[:, None] * (np.where(bits, 1.0, -1.0) @ p)
        words.append(bit_words(bits))
        stored.append(a)
    stored.append(np.sqrt((rest * rest).sum(axis=1)))
    return np.concatenate(words, axis=1), np.stack(stored, axis=1)


class Slab:
    """Rows held by a task, and the interval of their scores with an anchor."""

    def __init__(self, ids, labels, v, words, stored, turn):
        codes = len(turn)
        self.ids, self.labels, self.v, self.turn = ids, labels, v, turn
        self.words = np.ascontiguousarray(words.reshape(len(ids), codes, -1).transpose(1, 2, 0))
        self.ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        self.align, self.rest = np.ascontiguousarray(stored[:, :codes].T), stored[:, codes]

    def interval(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper ends of every row's score with the integer vector ``q``."""
        dim, length = len(q), np.sqrt(float((q.astype(np.float64) ** 2).sum()))
        estimate, half = np.zeros(len(self.ids)), length * self.rest
        for m, p in enumerate(self.turn):
            g = p @ q.astype(np.float64)
            low, step = g.min(), (g.max() - g.min()) / ((1 << BITS) - 1) or 1.0
            u = np.rint((g - low) / step).astype(np.int64)
            hit = np.zeros(len(self.ids), np.int64)
            for k in range(BITS):
                plane = bit_words((u >> k & 1).astype(bool)[None, :])[0]
                for w, word in enumerate(plane):
                    hit += np.bitwise_count(self.words[m, w] & word).astype(np.int64) << k
            along = (low * (2 * self.ones[m] - dim) + step * (2 * hit - u.sum())) / np.sqrt(dim)
            estimate += self.align[m] * along
            half = half + self.align[m] * np.sqrt(((g - low - step * u) ** 2).sum())
        half += SLACK * (1 + length * (self.align.sum(axis=0) + self.rest))
        return np.ceil(estimate - half), np.floor(estimate + half)

    def scored(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.v[at].astype(np.int64) @ q

    def positives(self, own: int, label: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best rows of the label."""
        mine = np.flatnonzero((self.labels == label) & (self.ids != own))
        if len(mine) > POSITIVES:
            low, high = (x[mine] for x in self.interval(q))
            mine = mine[high >= np.partition(low, -POSITIVES)[-POSITIVES]]
        return self._best(mine, self.scored(mine, q), POSITIVES)

    def negatives(self, label: int, q: np.ndarray, positive: int, ends=None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the best rows of other labels in the band below a positive's score."""
        least, most = -(-LOW * positive // 100), HIGH * positive // 100
        if least > most:
            return self.ids[:0], self.ids[:0]
        low, high = ends or self.interval(q)
        other = self.labels != label
        sure = low[other & (low >= least) & (high <= most)]
        if len(sure) > NEGATIVES:
            floor = np.partition(sure, -NEGATIVES)[-NEGATIVES]
        else:
            floor = least
        mine = np.flatnonzero(other & (high >= floor) & (low <= most))
        score = self.scored(mine, q)
        fits = (score >= least) & (score <= most)
        return self._best(mine[fits], score[fits], NEGATIVES)

    def _best(self, at, score, n):
        order = np.lexsort((self.ids[at], -score))[:n]
        return self.ids[at[order]], score[order]


def prepared(rows: DataFrame) -> tuple[DataFrame, int]:
    """id, label, v (32-bit integers), words, stored; and the dimension."""
    dim = dimension(rows)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    usable = rows.where(finite(dim) & F.col("label").isNotNull() & F.lit(dim > 0)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"))
    turn = rows.sparkSession.sparkContext.broadcast(rotations(dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with np.errstate(over="ignore"):
                v = np.floor(SCALE * matrix(b.column(2), dim))
                fits = (v * v).sum(axis=1) < 2.0 ** 62
            b, v = b.filter(pa.array(fits)), v[fits].astype(np.int32)
            words, stored = encode(v, turn.value)
            yield pa.record_batch([b.column(0), b.column(1), packed(v), packed(words), packed(stored)],
                                  names=["id", "label", "v", "words", "stored"])

    return distinct_ids(usable).mapInArrow(run, "id bigint, label bigint, v binary, words binary, stored binary"), dim


def _past(rows: DataFrame, anchors: DataFrame, slabs: int, dim: int, answer, schema: str) -> DataFrame:
    """``answer(slab, anchor id, label, vector, scores)`` for every slab and anchor: record batches of ``schema``.

    anchors: id, label, v, scores (array of long)."""
    turn = rows.sparkSession.sparkContext.broadcast(rotations(dim))
    held = rows.select(F.pmod(F.xxhash64("id"), F.lit(slabs)).cast("int").alias("slab"), F.lit(0).alias("tag"), "*",
                       F.lit(None).cast("array<bigint>").alias("scores"))
    each = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(slabs - 1))).alias("slab"), F.lit(1).alias("tag"), "id", "label",
                          "v", F.lit(None).cast("binary").alias("words"), F.lit(None).cast("binary").alias("stored"), "scores")
    both = held.unionByName(each).repartition(2 * slabs, "slab").sortWithinPartitions("slab", "tag", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, slab, now = [], None, None
        for b in batches:
            number, tag = b.column(0).to_numpy(), b.column(1).to_numpy()
            key = number.astype(np.int64) * 2 + tag
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), b.num_rows]
            for at, to in zip(edges, edges[1:]):
                if at == to:
                    continue
                if number[at] != now:
                    parts, slab, now = [], None, number[at]
                part = b.slice(at, to - at)
                ids, labels = part.column(2).to_numpy(), part.column(3).to_numpy()
                v = unpacked(part.column(4), np.int32)
                if tag[at] == 0:
                    parts.append((ids, labels, v, unpacked(part.column(5), np.uint64), unpacked(part.column(6), np.float64)))
                    continue
                if slab is None and parts:
                    slab, parts = Slab(*(np.concatenate(x) for x in zip(*parts)), turn.value), []
                if slab is not None:
                    yield answer(slab, ids, labels, v.astype(np.int64), part.column(7).to_pylist())

    return both.mapInArrow(run, schema)


def _positives(slab, ids, labels, v, _):
    out = [[], [], []]
    for own, label, q in zip(ids.tolist(), labels.tolist(), v):
        found, score = slab.positives(own, label, q)
        for column, values in zip(out, ([own] * len(found), found.tolist(), score.tolist())):
            column += values
    return pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["anchor_id", "positive_id", "positive_score"])


def _negatives(slab, ids, labels, v, scores):
    out = [[], [], [], []]
    for own, label, q, known in zip(ids.tolist(), labels.tolist(), v, scores):
        ends = slab.interval(q)
        for positive in known:
            found, score = slab.negatives(label, q, positive, ends)
            for column, values in zip(out, ([own] * len(found), [positive] * len(found), found.tolist(), score.tolist())):
                column += values
    return pa.record_batch([pa.array(x, pa.int64()) for x in out],
                           names=["anchor_id", "positive_score", "negative_id", "negative_score"])


def mine(rows: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the rows whose vec_id
    is divisible by ``every``."""
    spark = rows.sparkSession
    stored, dim = prepared(rows)
    stored = land(stored, "codes")
    # as few as memory and cores ask for: each slab gives its best rows of every anchor
    slabs = max(-(-stored.count() * (4 * dim + 64 + CODES * (dim // 8 + 16)) // SLAB_BYTES),
                2 * spark.sparkContext.defaultParallelism)
    anchors = stored.where(F.col("id") % every == 0).select("id", "label", "v")
    near = _past(stored, anchors.withColumn("scores", F.array().cast("array<bigint>")), slabs, dim, _positives,
                 "anchor_id bigint, positive_id bigint, positive_score bigint")
    best = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    positives = land(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= POSITIVES).drop("rank"),
                     "positives")
    bands = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("scores"))
    far = _past(stored, anchors.join(bands, "id").select("id", "label", "v", "scores"), slabs, dim, _negatives,
                "anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    best = Window.partitionBy("anchor_id", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    far = land(far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= NEGATIVES), "negatives")
    drop_landed(stored)                          # both tables below are landed
    return positives.join(far, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(rows: DataFrame) -> DataFrame:
    return mine(rows)


def oracle_sql() -> str:
    """DuckDB statement for ``query`` over ``embeddings``."""
    return f"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v
           from embeddings
           where vec_id is not null and label is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
a as (select vec_id, label, unnest(v) as x, generate_subscripts(v, 1) as k from e where vec_id % 100 = 0),
s as (select a.vec_id as anchor_id, e.vec_id, a.label = e.label as same, sum(a.x * e.v[a.k])::bigint as score
      from a join e on e.vec_id <> a.vec_id group by all),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES})
select p.anchor_id, p.positive_id, row_number() over w as rank, s.vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and not same
     and 100 * score between {LOW} * positive_score and {HIGH} * positive_score
window w as (partition by p.anchor_id, p.positive_id order by score desc, s.vec_id)
qualify row_number() over w <= {NEGATIVES}"""
