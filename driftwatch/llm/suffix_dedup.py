"""Suffix-array de-duplication by a depth-limited radix sort over the suffixes' bytes.

Suffixes are ordered through their first ``LENGTH`` bytes only, by passes from the most
significant digit on; what is still equal after the last digit is exactly the repeated
``LENGTH``-byte windows.  Groups of one suffix leave after each pass.

Digit 1 is a gram of ``GRAM`` bytes that the window itself selects: the one with the
smallest hash among its ``LENGTH - GRAM + 1`` grams (the leftmost of equal ones).  Equal
windows select the same gram at the same place, and neighbouring windows mostly share
theirs, so pass 1 moves one row for about ``(LENGTH - GRAM + 2) / 2`` suffixes: the gram's
hash, the stretch of windows that select it, and a hash of the bytes of the whole stretch.

Pass 1 sorts those rows by (gram, stretch, doc_id, start), range-partitioned over all four, so
a gram or passage that a third of all documents share is split over many tasks.
A row whose gram occurs once is done.  A row equal to an earlier one in its whole stretch is
repeated from end to end.  What is left, the first of each stretch with a shared gram, goes on.

Pass 2 compares those by the ``HALF`` bytes on either side of the gram: a window has that many on one
side, so only windows with a partner on that side go on.  Pass 3 compares the
whole windows by a 128-bit hash; all but the earliest of each group are repeated.  Each task
of pass 3 first settles what repeats within a batch, so that of a window that very many
documents share only one row a batch is moved.  A task's first and last stretches in pass 1 always
go on to pass 2, so no neighbour is missed at a border between tasks.

Texts are read as UTF-8 and matches never cross documents; the earliest copy (smaller
doc_id, then smaller start) stays.  Repeats are judged on the input, and overlaps count.
Grams and stretches are compared by 64-bit hashes each (128 bits together), windows by 128 bits.

A row holds its place packed into one number, ``x``: start, length and gram of the stretch.  Its document,
``d``, is the doc_id; where texts share an id (or have none) it is the document's number in the
order of id and 64-bit hash of the text.

Defined results: null counts as empty; texts below ``LENGTH`` bytes keep all; equal
rows (doc_id and text) are one document and get equal results; an empty table gives no rows;
extra columns are ignored; a text of any length is handled whole, in blocks that
overlap by ``LENGTH - 1`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST_ID, drop_landed, id_key, land, release, shuffle_partitions

LENGTH = 100
GRAM = 24
#: One side of the gram has at least so many of a window's other bytes.
HALF = (LENGTH - GRAM) // 2
#: Positions handled at a time; a power of two, as places are packed into the low bits.
BLOCK = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all grams of GRAM = 16 + 8 bytes, by doubling."""
    def mixed(h):
        h = h ^ (h >> np.uint64(29))
        h *= _ODD2
        h ^= h >> np.uint64(32)
        return h

    h = mixed((b.astype(np.uint64) + np.uint64(1)) * _ODD)
    size = 1
    by_size = {1: h}
    while size * 2 <= GRAM:
        h = h[:-size] * _ODD + h[size:]
        size *= 2
        by_size[size] = h
    at, out = size, by_size[size]
    rest = GRAM - size
    for s in sorted(by_size, reverse=True):
        if s <= rest:
            n = len(b) - at - s + 1
            out = out[:n] * _ODD2 + by_size[s][at:at + n]
            at, rest = at + s, rest - s
    return mixed(out)


def stretches(b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(gram hash, gram place, first window, last window) of every stretch of windows that
    select one gram; block by block."""
    n_windows = len(b) - LENGTH + 1
    span = LENGTH - GRAM + 1
    low = np.uint64(2 * BLOCK - 1)
    for at in range(0, n_windows, BLOCK):
        n = min(BLOCK, n_windows - at)
        g = gram_hashes(b[at:at + n + LENGTH - 1])
        v = (g & ~low) | np.arange(len(g), dtype=np.uint64)
        done = 1
        while done * 2 <= span:
            v = np.minimum(v[:-done], v[done:])
            done *= 2
        if done < span:
            v = np.minimum(v[:len(v) - (span - done)], v[span - done:])
        place = (v & low).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        last = np.append(first[1:] - 1, n - 1)
        yield g[place[first]], place[first] + at, first + at, last + at


def pack(lo, hi, p):
    """Stretch of windows lo..hi (at most 127 apart) that select the gram at p."""
    return lo << 30 | (hi - lo) << 23 | (p - lo) << 16


def unpack(x):
    lo = x >> 30
    return lo, lo + (x >> 23 & 127), lo + (x >> 16 & 127)


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, d, text of all rows, k the id; d, text with equal rows once).

    The texts are only shuffled if rows share an id.
    """
    keyed = docs.select(id_key().cast("bigint").alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("u"), "text")
    if not keyed.groupBy("k").count().where("count > 1").limit(1).count():
        rows = keyed.select("k", F.col("k").alias("d"), "text")
        return rows, rows.select("d", "text")
    documents = keyed.select("k", "u").distinct()
    if documents.groupBy("k").count().where("count > 1").limit(1).count():
        by = ["k", "u"]
        numbers = land(documents.repartitionByRange(shuffle_partitions(docs.sparkSession), *by).sortWithinPartitions(*by)
                       .withColumn("d", F.monotonically_increasing_id()), "numbers")
        rows = keyed.join(numbers, by).select("k", "d", "text")
    else:
        rows = keyed.select("k", F.col("k").alias("d"), "text")
    return rows, rows.select("d", "text").dropDuplicates(["d"])


def _utf8(column: pa.Array) -> Iterator[bytes]:
    return ((t.as_py() or "").encode() for t in column)


def digit_rows(texts: DataFrame) -> DataFrame:
    """Pass 1's rows: g, c (stretch hash), d, x."""
    schema = pa.schema([(c, pa.int64()) for c in "gcdx"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        held, size = [], 0
        def flush():
            return pa.record_batch([pa.array(np.concatenate([h[k] for h in held])) for k in range(4)], schema=schema)

        for b in batches:
            for d, raw in zip(b.column(0).to_pylist(), _utf8(b.column(1))):
                if len(raw) < LENGTH:
                    continue
                for g, p, lo, hi in stretches(np.frombuffer(raw, dtype=np.uint8)):
                    c = np.fromiter((xxh3_64_intdigest(raw[i:j]) for i, j in zip(lo.tolist(), (hi + LENGTH).tolist())),
                                    dtype=np.uint64, count=len(lo))
                    held.append((g.view(np.int64), c.view(np.int64), np.full(len(g), d), pack(lo, hi, p)))
                    size += len(g)
                if size > 200_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return texts.select("d", "text").mapInArrow(run, "g bigint, c bigint, d bigint, x bigint")


def pass_one(rows: DataFrame) -> DataFrame:
    """Of sorted digit rows, those not alone: whole = repeated from end to end, else to go on."""
    order = ["g", "c", "d", "x"]
    sorted_rows = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(b, before, after):
            g, c = (b.column(k).to_numpy() for k in (0, 1))
            # before and after are the rows beyond the batch; none at a task's border, where a neighbour is assumed
            same = np.empty(len(g) + 1, bool)
            same[1:-1] = g[1:] == g[:-1]
            same[0] = before is None or before[0] == g[0]
            same[-1] = after is None or after[0] == g[-1]
            # nothing is known to be earlier than a task's first row
            whole = np.empty(len(g), bool)
            whole[1:] = same[1:-1] & (c[1:] == c[:-1])
            whole[0] = before is not None and before == (g[0], c[0])
            kept = np.flatnonzero(same[:-1] | same[1:])
            return pa.record_batch([b.column(2).take(pa.array(kept)), b.column(3).take(pa.array(kept)), pa.array(whole[kept])],
                                   names=["d", "x", "whole"])

        def at(b, k):
            return b.column(0)[k].as_py(), b.column(1)[k].as_py()

        last = before = None
        for b in batches:
            if b.num_rows:
                if last is not None:
                    yield judged(last, before, at(b, 0))
                    before = at(last, last.num_rows - 1)
                last = b
        if last is not None:
            yield judged(last, before, None)

    return sorted_rows.select("g", "c", "d", "x").mapInArrow(run, "d bigint, x bigint, whole boolean")


def _with_texts(texts: DataFrame, places: DataFrame) -> DataFrame:
    """d, xs, text: a document's places in an array (their number is bounded by its text's length)."""
    mine = places.groupBy("d").agg(F.collect_list("x").alias("xs"))
    return packed(texts, ["d"]).join(mine, "d").select("d", "xs", "z")


def packed(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` (longs) and z, the text compressed, as it moves through a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield pa.record_batch([*b.columns[:-1], pa.array([squeeze(t) for t in _utf8(b.columns[-1])], pa.binary())],
                                  names=[*keys, "z"])

    return texts.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} bigint" for k in keys) + ", z binary")


def unpacked(column: pa.Array) -> Iterator[bytes]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    return (expand(z.as_py()) for z in column)


def _hashes(values: list[int]) -> list[pa.Array]:
    """Two columns of 128-bit hashes."""
    raw = b"".join(v.to_bytes(16, "little") for v in values)
    both = np.frombuffer(raw, dtype=np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def half_digits(texts: DataFrame, left: DataFrame) -> DataFrame:
    """Pass 2's rows: h1, h2 (hash of gram and one side), d, x (the windows with that side)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for b in batches:
            hs, ds, out = [], [], []
            for d, xs, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), unpacked(b.column(2))):
                for x in xs:
                    lo, hi, p = unpack(x)
                    # windows up to p - HALF have HALF bytes before the gram, the others after it
                    if lo <= p - HALF:
                        hs.append(xxh3_128_intdigest(raw[p - HALF:p + GRAM], 1))
                        out.append(pack(lo, min(hi, p - HALF), p))
                        ds.append(d)
                    if hi > p - HALF:
                        hs.append(xxh3_128_intdigest(raw[p:p + GRAM + HALF], 2))
                        out.append(pack(max(lo, p - HALF + 1), hi, p))
                        ds.append(d)
            yield pa.record_batch([*_hashes(hs), pa.array(ds, pa.int64()), pa.array(out, pa.int64())], names=["h1", "h2", "d", "x"])

    return _with_texts(texts, left).mapInArrow(run, "h1 bigint, h2 bigint, d bigint, x bigint")


def windows(texts: DataFrame, left: DataFrame) -> DataFrame:
    """Pass 3's rows: h1, h2 (hash of a window), d, x (the window), and whether it is already known
    to repeat an earlier one of the batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        def settled(held):
            raw = np.frombuffer(b"".join(h for h, _, _ in held), dtype=np.int64).reshape(-1, 2)
            ds = np.concatenate([np.full(len(x), d) for _, d, x in held])
            xs = np.concatenate([x for _, _, x in held])
            order = np.lexsort((xs, ds, raw[:, 1], raw[:, 0]))
            raw, ds, xs = raw[order], ds[order], xs[order]
            known = np.concatenate([[False], (raw[1:] == raw[:-1]).all(axis=1)])
            # known repeats go on as stretches: nothing needs to meet them, so they may go to any task
            kd, ks = ds[known], xs[known] >> 30
            order = np.lexsort((ks, kd))
            kd, ks = kd[order], ks[order]
            new = np.ones(len(kd), bool)
            new[1:] = (kd[1:] != kd[:-1]) | (ks[1:] != ks[:-1] + 1) | (ks[1:] % 100 == 0)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(kd))[:len(first)] - 1
            kx = pack(ks[first], ks[last], ks[first])
            fresh = ~known
            cols = [np.concatenate(c) for c in ((raw[fresh, 0], kx), (raw[fresh, 1], kd[first]), (ds[fresh], kd[first]),
                                                (xs[fresh], kx))]
            flag = np.repeat([False, True], [int(fresh.sum()), len(first)])
            return pa.record_batch([*map(pa.array, cols), pa.array(flag)], names=["h1", "h2", "d", "x", "known"])

        held, size = [], 0
        for b in batches:
            for d, xs, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), unpacked(b.column(2))):
                starts = [s for x in xs for s in range(unpack(x)[0], unpack(x)[1] + 1)]
                held.append((b"".join([xxh3_128_digest(raw[s:s + LENGTH]) for s in starts]), d,
                             np.asarray(starts, dtype=np.int64) << 30))
                size += len(starts)
                if size > 500_000:
                    yield settled(held)
                    held, size = [], 0
        if held:
            yield settled(held)

    return _with_texts(texts, left).mapInArrow(run, "h1 bigint, h2 bigint, d bigint, x bigint, known boolean")


def pass_three(wins: DataFrame) -> DataFrame:
    """d, x of the windows that repeat an earlier one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            if not b.num_rows:
                continue
            known = b.column(4).to_numpy(zero_copy_only=False)
            h1, h2 = (b.column(k).to_numpy() for k in (0, 1))
            same = np.empty(len(h1), bool)
            same[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1]) & ~known[:-1]
            same[0] = before == (h1[0], h2[0])
            # known repeats sort behind the windows proper
            before = None if known[-1] else (h1[-1], h2[-1])
            kept = pa.array(known | same)
            yield pa.record_batch([b.column(2).filter(kept), b.column(3).filter(kept)], names=["d", "x"])

    parts = shuffle_partitions(wins.sparkSession)
    return (wins.repartition(parts, "h1", "h2").sortWithinPartitions("known", "h1", "h2", "d", "x")
            .select("h1", "h2", "d", "x", "known").mapInArrow(run, "d bigint, x bigint"))


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """d, x of stretches of repeated windows in the texts (d, text)."""
    spark = texts.sparkSession
    rows = land(digit_rows(texts), "digit-1")
    one = land(pass_one(rows), "pass-1")
    drop_landed(rows)
    release(spark)
    halves = land(half_digits(texts, one.where("not whole")), "digit-2")
    shared = halves.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    two = land(halves.join(shared, ["h1", "h2"], "left_semi").select("d", "x").distinct(), "pass-2")
    drop_landed(halves)
    release(spark)
    three = land(pass_three(windows(texts, two)), "pass-3")
    release(spark)
    return one.where("whole").select("d", "x").unionAll(three)


def removed_runs(xs) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the windows of the stretches xs (start, end)."""
    if xs is None or not len(xs):
        return []
    lo, hi, _ = unpack(np.asarray(xs, dtype=np.int64))
    order = np.argsort(lo)
    start = np.asarray(lo, dtype=np.int64)[order]
    end = np.maximum.accumulate(np.asarray(hi, dtype=np.int64)[order] + LENGTH)
    new = np.flatnonzero(start[1:] > end[:-1]) + 1
    return list(zip(start[np.concatenate([[0], new])].tolist(), end[np.append(new - 1, len(end) - 1)].tolist()))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (remaining bytes), n_bytes, n_removed, spans (start, end of removed runs)."""
    return _per_text(docs, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, "
                           "spans array<struct<start:bigint,end:bigint>>",
                     lambda kept, n, runs: (kept, n, n - len(kept), [{"start": a, "end": z} for a, z in runs]))


def query(docs: DataFrame) -> DataFrame:
    return _per_text(docs, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
                     lambda kept, n, runs: (n, n - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))


def _per_text(docs: DataFrame, schema: str, row) -> DataFrame:
    every, texts = numbered(docs)
    ranges = repeated_ranges(texts).groupBy("d").agg(F.collect_list("x").alias("xs"))
    names = ["doc_id", *[c.split()[0] for c in schema.split(", ")[1:]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw, xs in zip(unpacked(b.column(1)), b.column(2)):
                runs = removed_runs(xs.values.to_numpy() if xs.is_valid else None)
                parts, at = [], 0
                for a, z in runs:
                    parts.append(raw[at:a])
                    at = z
                rows.append(row(b"".join([*parts, raw[at:]]), len(raw), runs))
            cols = list(zip(*rows)) if rows else [()] * (len(names) - 1)
            ids = b.column(0)
            ids = pc.if_else(pc.equal(ids, LEAST_ID), pa.scalar(None, pa.int64()), ids)
            yield pa.record_batch([ids, *[pa.array(c, types[n]) for n, c in zip(names[1:], cols)]], names=names)

    types = {"kept": pa.binary(), "kept_sha256": pa.string(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(),
             "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
    joined = packed(every, ["k", "d"]).join(ranges, "d", "left").select("k", "z", "xs")
    return joined.mapInArrow(run, schema)
