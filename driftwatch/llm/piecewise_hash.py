"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last ``WINDOW`` bytes ends a chunk wherever it is -1 modulo the
block size; each chunk gives one character of a signature.  The block size is the
least power of two that leaves ``TARGET`` chunks or fewer on average, so texts of like length have
equal or neighbouring block sizes; it is halved while a (repetitive) text gives fewer than
``FEWEST`` chunks, and doubled while one gives more than ``LONGEST`` and keeps ``FEWEST``.  Where a repetitive text
still gives more than ``MOST`` chunks, as the next block size finds next to none, so many neighbouring chunks are taken
together, a power of two, that ``MOST`` or fewer are left.  A fingerprint holds the signatures at the block
size and at twice it: ``block:signature:signature``.

Two fingerprints are compared by the edit distance of the signatures at a block size that both have:
1 - distance / length of the longer one; the best of the compatible sizes counts, and 0 if
there is none.  Equal texts have equal fingerprints, whose likeness is 1.

``edited_pairs`` needs each document's successor by doc_id.  Documents are range-partitioned and
sorted by id; a task reads its rows as a stream, holding one document back, and writes out the
first and last documents of its range, which are then paired in a second small step (two
rows a partition).

Defined results: null text counts as empty, and the empty text has the fingerprint of no chunks;
with equal doc_ids the order is by a hash of the text; a single document is its own successor; an
empty table gives no rows; extra columns are ignored; texts of any length are handled
whole, and a signature has a character for every chunk or group of chunks: more than ``LONGEST`` only for repetitive
texts that the next block size would leave with fewer than ``FEWEST``, and never more than ``MOST``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_key, land, shuffle_partitions

WINDOW = 8
TARGET = 48
FEWEST = 12
LEAST_BLOCK = 4
LONGEST = 160
#: Characters of a signature, whatever the text: an edit distance costs their square.
MOST = 2048
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes handled at a time.
BLOCK = 1 << 20


def rolling(b: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the WINDOW bytes up to each position (fewer at the start), by doubling."""
    h = np.concatenate([np.zeros(WINDOW - 1, np.uint32), b.astype(np.uint32) + np.uint32(1)])
    h = h * np.uint32(2654435761)
    size = 1
    while size < WINDOW:
        h = h[:-size] * np.uint32(0x01000193) + h[size:]
        h ^= h >> np.uint32(15)
        size *= 2
    return h * np.uint32(0x85EBCA6B) >> np.uint32(8)


def signature(b: np.ndarray, roll: np.ndarray, block: int) -> str:
    """A character for each chunk that ends where roll is -1 modulo block, and for the rest."""
    ends = np.flatnonzero((roll & np.uint32(block - 1)) == np.uint32(block - 1)) + 1
    if not len(ends) or ends[-1] < len(b):
        ends = np.append(ends, len(b))
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros(len(ends), np.uint64)
    for at in range(0, len(b), BLOCK):
        to = min(at + BLOCK, len(b))
        i, j = np.searchsorted(ends, at, "right"), np.searchsorted(starts, to, "left")
        first = np.maximum(starts[i:j], at)
        # bytes weighed by their place in the chunk, which may have begun in an earlier piece
        weights = np.arange(at, to, dtype=np.uint64)
        weights -= np.repeat(starts[i:j], np.minimum(ends[i:j], to) - first).astype(np.uint64)
        term = (b[at:to].astype(np.uint64) + np.uint64(1)) * ((weights * _A) ^ _B)
        term ^= term >> np.uint64(31)
        out[i:j] += np.add.reduceat(term * _B, first - at)
    times = 1
    while len(out) > MOST * times:
        times *= 2
    if times > 1:
        place = np.arange(len(out), dtype=np.uint64) & np.uint64(times - 1)
        out = np.add.reduceat(out * (place * _B | np.uint64(1)), np.arange(0, len(out), times))
    return ALPHABET[(out >> np.uint64(40) & np.uint64(63)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str | None) -> str:
    raw = (text or "").encode()
    block = LEAST_BLOCK
    while block * TARGET < len(raw):
        block *= 2
    if not raw:
        return f"{block}::"
    b = np.frombuffer(raw, dtype=np.uint8)
    roll = rolling(b)

    def chunks(size: int) -> int:
        return np.count_nonzero((roll & np.uint32(size - 1)) == np.uint32(size - 1))

    while block > LEAST_BLOCK and chunks(block) < FEWEST:
        block //= 2
    while chunks(block) >= LONGEST and chunks(2 * block) >= FEWEST:
        block *= 2
    return f"{block}:{signature(b, roll, block)}:{signature(b, roll, 2 * block)}"


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and replacements, with a column of the table held in the bits of an integer."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)              # vertical steps of +1 and -1
    for c in b:
        eq = places.get(c, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(diag | up) & full, up & diag
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = right << 1 | 1
        left <<= 1
        up = (left | ~(diag | right)) & full
        down = right & diag & full
    return score


def likeness(x: str, y: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if x == y:
        return 1.0
    bx, sx, sx2 = x.split(":")
    by, sy, sy2 = y.split(":")
    of_x, of_y = {int(bx): sx, 2 * int(bx): sx2}, {int(by): sy, 2 * int(by): sy2}
    best = 0.0
    for block in of_x.keys() & of_y.keys():
        a, b = of_x[block], of_y[block]
        if a and b:
            best = max(best, 1 - edit_distance(a, b) / max(len(a), len(b)))
    return best


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.string())],
                                  names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, fingerprint string")


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                     ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                     ("near_edited", pa.float64()), ("near_next", pa.float64())])
_RESULT_SQL = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _row(doc_id, text: str, own: str, following: str, next_own: str) -> tuple:
    other = edited(text, following)
    theirs = fingerprint(other)
    return (doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), own, theirs,
            likeness(own, theirs), likeness(own, next_own))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """For each document: fingerprints of it and of its edited text, and their likeness."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), id_key().alias("d"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("u"), F.coalesce("text", F.lit("")).alias("text"))
    by = ["d", "u"]
    ordered = rows.repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by)
    ends = pa.schema([*_RESULT, ("part", pa.int32()), ("is_last", pa.bool_()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, done = None, []
        def end(row, last):
            return (row[0], None, None, row[2], None, None, None, part, last, row[1])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                now = (doc_id, text, fingerprint(text))
                if held is None:
                    done.append(end(now, False))
                else:
                    done.append((*_row(*held, now[1], now[2]), None, None, None))
                held = now
            yield _batch(done, ends)
            done = []
        if held is not None:
            yield _batch([end(held, True)], ends)

    found = land(ordered.select("doc_id", "text").mapInArrow(run, _RESULT_SQL + ", part int, is_last boolean, text string"),
                 "fingerprints")
    # The last document of a range meets the first of the next one that has rows; the very last meets the first.
    border = found.where("part is not null")
    heads = border.where("not is_last").select("part", F.col("text").alias("head"), F.col("fingerprint").alias("head_print"))
    parts = heads.select("part").withColumn("after", F.lead("part").over(Window.orderBy("part")))
    parts = parts.select("part", F.coalesce("after", F.min("part").over(Window.partitionBy())).alias("after"))
    met = (border.where("is_last").join(parts, "part").join(heads.withColumnRenamed("part", "after"), "after")
           .select("doc_id", "text", "fingerprint", "head", "head_print"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _batch([_row(*r) for r in zip(*(c.to_pylist() for c in b.columns))], _RESULT)

    return (found.where("part is null").select(*_RESULT.names)
            .unionAll(met.mapInArrow(join, _RESULT_SQL)))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def query(docs: DataFrame) -> DataFrame:
    return edited_pairs(docs)
