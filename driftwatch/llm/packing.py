"""Packing documents into token sequences: shortest-pack-first over the length histogram.

1. Each task tokenizes its documents, cuts a document longer than the window into
   full windows and a rest, and numbers the rests of each length within the task.
2. The rests are counted by length (at most ``WINDOW`` distinct lengths).  The driver
   packs that histogram: lengths longest first, each into the emptiest open packing
   pattern it fits; patterns are kept with counts, so the work depends on the number of
   distinct lengths and not on the number of documents.
3. Patterns are joined back to the rests by rank: the counts by (length, task) give each
   task the first rank of its rests of that length, and a rest's rank names its
   pattern, copy and place.  Rests never move, however many share one length.

Sequences are padded to ``WINDOW`` unless their length is a power of two.  The table of
places that is broadcast has a row per pattern and distinct length in it: at most about
2 * WINDOW patterns of sqrt(2 * WINDOW) distinct lengths, whatever the input.

Defined results: null or empty text is the single end id; a repeated row is packed again;
ties of length are ordered by task and place in the task; an empty table gives no
rows; extra columns are ignored; a text of any length is handled whole.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Remembered, byte_groups, joined_values, land, worker_cache

WINDOW = 4096
END_ID = 2
#: Bytes of words and ids that a worker remembers (tested before each step), words of a step, and new words encoded as one line.
CACHE, STEP, LINE = 192 << 20, 200_000, 500
#: A letter or digit and the punctuation after it: never in one word of the tokenizer's.
AFTER_WORD = r"([0-9a-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~])"
#: Texts that aren't lower-cased or cut beforehand: a special token may be in them, or a capital and a mark that make one character.
AS_IT_IS = r"<\||[A-Z]\pM"
#: Rows of the (length, task) table from which on it is joined by a shuffle, whatever its size in bytes.
SHUFFLED = 200_000


class WordTokenizer:
    """ids of whole texts, remembering those of each word.

    The tokenizer lower-cases, and cuts at white space and after letters and digits before it
    merges, so a text's ids are the ids of its words one after the other (tested against whole texts).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs a worker per core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # lower-case words of Latin letters are as the normalizer leaves them, and white space alone parts them
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.last = np.zeros(self.tok.get_vocab_size(), dtype=bool)      # ids that end a word
        self.last[[i for piece, i in self.tok.get_vocab().items() if piece.endswith("</w>")]] = True
        self.known = Remembered(CACHE)

    @staticmethod
    def _batch(tok, texts: list[str]) -> list:
        return getattr(tok, "encode_batch_fast", tok.encode_batch)(texts, add_special_tokens=False)

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        """ids of each of different words; plain ones are joined to lines, and cut where an id ends a word."""
        made = {}
        plain = [w for w in words if w.isalpha() and (w.isascii() or max(w) <= "ÿ")]
        if plain:
            low = [w.lower() for w in plain]
            lines = [" ".join(low[at:at + LINE]) for at in range(0, len(low), LINE)]
            ids = np.concatenate([np.asarray(got.ids, dtype="<u4") for got in self._batch(self.plain, lines)])
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) == len(plain):
                packed = ids.tobytes()
                made = {w: packed[start:end] for w, start, end in zip(plain, [0, *ends], ends)}
        rest = [w for w in words if w not in made]
        return made | {w: array("I", got.ids).tobytes() for w, got in zip(rest, self._batch(self.tok, rest))}

    def _learn(self, words: list[str]) -> list[bytes]:
        """ids of each of different words; short ones are remembered."""
        if self.known.held > self.known.limit:
            self.known.clear()
        found = list(map(self.known.table.get, words))
        if None not in found:
            return found
        made = self._encode_words([w for w, ids in zip(words, found) if ids is None])
        kept = {w: ids for w, ids in made.items() if len(w) <= self.known.longest}
        self.known.table.update(kept)
        self.known.held += sum(map(len, kept)) + sum(map(len, kept.values())) + self.known.ENTRY * len(kept)
        return [made[w] if ids is None else ids for w, ids in zip(words, found)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: none)."""
        # first what makes an array of its own: ascii_lower of a slice gives wrong offsets (pyarrow 23)
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        low = pc.replace_substring_regex(pc.ascii_lower(texts), AFTER_WORD, r"\1 \2")
        words = pc.split_pattern(pc.if_else(pc.match_substring_regex(texts, AS_IT_IS), texts, low), " ")
        coded = words.flatten().dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [i for at in range(0, len(different), STEP) for i in self._learn(different[at:at + STEP])]
        # Arrow puts the words' ids one after the other; a text's are those of its words
        return joined_values(pa.array(ids, pa.large_binary()), coded.indices, words.offsets.to_numpy())

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return self.encode(pa.array(texts, pa.large_string()))


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, task, nth (among the
    task's pieces of that length); with ``keep_ids`` also ids (packed little-endian)."""
    schema = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, nth bigint"
              + ", ids binary" * keep_ids)
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = worker_cache(("words", tokenizer), lambda: WordTokenizer(tokenizer))
        task, seen = TaskContext.get().partitionId(), {}
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for b in batches:
            at, rows, parts = [], [], []
            encoded = (e for g in byte_groups(b.column(1)) for e in tok.encode(g))
            for row, ids in enumerate(encoded):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start:4 * (start + window)]
                    length = len(part) // 4
                    nth = seen.get(length, 0)
                    seen[length] = nth + 1
                    at.append(row)
                    rows.append((start, length, zlib.crc32(part), n, task, nth))
                    if keep_ids:
                        parts.append(part)
            numbers = np.asarray(rows, dtype=np.int64).reshape(-1, 6).T
            columns = [b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c) for c in numbers[:4]),
                       pa.array(numbers[4].astype(np.int32)), pa.array(numbers[5])]
            yield pa.record_batch(columns + [pa.array(parts, pa.binary())] * keep_ids, names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(cut, schema)


def pack_histogram(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns (copies, [(length, times)]) for so many pieces of each length."""
    import heapq

    by_room: dict[int, list[list]] = {}           # free tokens -> [copies, lengths]
    heap: list[int] = []                          # of -free tokens
    def put(room: int, copies: int, lengths: tuple) -> None:
        if room not in by_room:
            by_room[room] = []
            heapq.heappush(heap, -room)
        by_room[room].append([copies, lengths])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = -heap[0] if heap else 0
            if room < length:
                # open new packs, each with one piece; shorter pieces fill them later
                put(window - length, left, ((length, 1),))
                left = 0
                continue
            group = by_room[room]
            copies, lengths = group.pop()
            if not group:
                del by_room[room]
                heapq.heappop(heap)
            used = min(copies, left)
            last = lengths[-1]
            longer = (*lengths[:-1], (length, last[1] + 1)) if last[0] == length else (*lengths, (length, 1))
            if copies > used:
                put(room, copies - used, lengths)
            put(room - length, used, longer)
            left -= used
    return [(copies, list(lengths)) for group in by_room.values() for copies, lengths in group]


def placements(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """length, first (rank), copies, sequence (of the first copy), offset: one entry per distinct
    length of a pattern, in order of length and first.  Rank first + j goes to copy j % copies, at its place j // copies."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for copies, lengths in patterns:
        offset = 0
        for length, times in lengths:
            rows.append((length, taken.get(length, 0), copies, sequence, offset))
            taken[length] = taken.get(length, 0) + copies * times
            offset += length * times
        sequence += copies
    table = np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 5).T
    return dict(zip(["length", "first", "copies", "sequence", "offset"], table))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = docs.sparkSession
    cut = land(pieces(docs, tokenizer, window, keep_ids), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = land(by_task.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0))), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = placements(pack_histogram(counts, window))
    # places of a length are contiguous and sorted by first rank
    table = spark.sparkContext.broadcast(place)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = t["length"] * (1 << 48) + t["first"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("base").to_numpy() + b.column("nth").to_numpy()
            at = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            j = rank - t["first"][at]
            sequence = t["sequence"][at] + j % t["copies"][at]
            offset = t["offset"][at] + j // t["copies"][at] * length
            yield pa.record_batch([*(b.column(c) for c in cols), pa.array(sequence), pa.array(offset)],
                                  names=[*cols, "sequence_id", "offset"])

    of_task = by_task.select("length", "task", "base")
    named = cut.join(of_task.hint("merge") if by_task.count() > SHUFFLED else of_task, ["length", "task"])
    cols = [c for c in cut.columns if c not in ("task", "nth")]
    types = dict(cut.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in cols) + ", sequence_id bigint, offset bigint"
    return named.select(*cut.columns, "base").mapInArrow(assign, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    return pack(docs, tokenizer or tokenizer_path())
