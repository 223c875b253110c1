"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton over all pieces is run once over a text; at every position its output
links give the pieces that end there, and a table over positions is relaxed with them
(a single-pass Viterbi).  What "best" means depends on the model:

* unigram models: the highest sum of piece scores, as in the library;
* BPE models: scores are merge ranks, and no sum of them gives the merged result.  Here a
  piece may end at a position only if it follows the last piece of the encoding of the
  prefix before it *validly*, that is, if merging the two pieces' text gives back just
  the two.  Exactly one piece ending at each position does, and the path through them is
  the library's result (tested against the library).

Where no piece of the model reaches over them (looked up when it is loaded), the text is cut
in front of each run of space markers and of the punctuation after a word.  Each different
chunk of a group of texts is looked up once, and each worker remembers the ids of the chunks
it has seen (``CACHE`` bytes at most).  Characters without a piece become byte
pieces or the unknown id.

Defined results: null or empty text has no pieces and decodes to the empty string;
repeated rows get equal rows; among equal unigram scores the longest last piece wins;
an empty table gives no rows; extra columns are ignored; texts of any length are
handled whole.  The space marker itself decodes to a space, as in the library.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, byte_groups, joined_values, worker_cache

MARK = "▁"
#: Bytes of chunks and ids that a worker remembers, and pairs of pieces whose order it has judged.
CACHE, PAIRS = 192 << 20, 500_000
#: Letters and digits after which punctuation is cut off.
WORD = "0-9A-Za-zÀ-ÖØ-öø-ÿ"


class Codec:
    def __init__(self, model_file: str, bpe: bool = True):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.bpe, self.unk = bpe, sp.unk_id()
        self.byte = {}
        self.piece: list[str | bytes | None] = [None] * n
        self.score = {}
        self.auto = ahocorasick.Automaton()
        for i in range(n):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(text[3:5], 16)
                self.byte[value], self.piece[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.piece[i], self.score[text] = text, (sp.get_score(i), i)
                self.auto.add_word(text, (i, len(text)))
        self.auto.make_automaton()
        self.alphabet = {t for t in self.score if len(t) == 1}
        self.known = Remembered(CACHE)
        self.valid: dict[int, bool] = {}
        self.edges: dict[int, tuple | None] = {}
        self.raw = [p if isinstance(p, bytes) else (p or " ⁇ ").encode() for p in self.piece]
        self.raw_pieces = pa.array(self.raw, pa.large_binary())
        # cut in front of each run of markers, and between a word and punctuation, where no piece reaches over
        pairs = {p for t in self.score for p in zip(t, t[1:])}
        self.cut_marks = not any(b == MARK != a for a, b in pairs)
        held = {b for a, b in pairs if re.match(f"[{WORD}]", a)}
        after = "".join(re.escape(c) for c in string.punctuation if c not in held)
        self.after_word = f"([{WORD}])([{after}])" if after else None

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging: best score first, leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s[0] > best):
                    best, at = s[0], k
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _edges(self, i: int):
        """How piece i comes about by merging: its pieces at the right and the left edge, each
        with the score of the merge that uses it up; None if it isn't merged in falling score."""
        got = self.edges.get(i, 0)
        if got == 0:
            parts, right, left, lowest = list(self.piece[i]), [], [], float("inf")
            while len(parts) > 1:
                options = [(self.score[m][0], -k) for k in range(len(parts) - 1)
                           if (m := parts[k] + parts[k + 1]) in self.score]
                if not options or max(options)[0] >= lowest:
                    break
                lowest, k = max(options)[0], -max(options)[1]
                if k == 0:
                    left.append((parts[0], lowest))
                if k == len(parts) - 2:
                    right.append((parts[-1], lowest))
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            never = (self.piece[i], float("-inf"))
            got = self.edges[i] = ([*right, never], [*left, never]) if len(parts) == 1 else None
        return got

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b can stand right after piece a (a < 0: at the start)."""
        key = (a + 1) << 32 | b
        got = self.valid.get(key)
        if got is None:
            if len(self.valid) > PAIRS:
                self.valid.clear()
            one, two = a < 0 or self._edges(a), self._edges(b)
            if one and two:
                got = a < 0 or self._apart(one[0], two[1])
            else:
                want = [self.piece[b]] if a < 0 else [self.piece[a], self.piece[b]]
                got = self.merge("".join(want)) == want
            self.valid[key] = got
        return got

    def _apart(self, right: list, left: list) -> bool:
        """Whether no merge takes place over the border.  Merges run in falling score, so the
        pieces that meet at the border do so until the next merge inside uses one up."""
        i = j = 0
        while True:
            (r, r_end), (x, x_end) = right[i], left[j]
            s = self.score.get(r + x)
            if s is not None and s[0] > r_end and s[0] >= x_end:   # leftmost first among equals
                return False
            if i == len(right) - 1 and j == len(left) - 1:
                return True
            if r_end >= x_end:
                i += 1
            else:
                j += 1

    def _run(self, text: str) -> list[int]:
        """ids of a text all of whose characters have pieces."""
        n = len(text)
        last = [-2] * n                          # piece that ends the encoding of text[:i + 1]; -2: none
        if self.bpe:
            valid = self.valid.get
            # at each position the outputs come longest first, along the output links
            for end, (i, size) in self.auto.iter(text):
                if last[end] == -2:
                    before = last[end - size] if size <= end else -1
                    if before != -2:
                        ok = valid((before + 1) << 32 | i)
                        if ok is None:
                            ok = self.follows(before, i)
                        if ok:
                            last[end] = i
        else:
            best = [0.0] * n
            for end, (i, size) in self.auto.iter(text):
                before = last[end - size] if size <= end else -1
                if before != -2:
                    s = (best[end - size] if size <= end else 0.0) + self.score[self.piece[i]][0]
                    if last[end] == -2 or s > best[end]:
                        best[end], last[end] = s, i
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= len(self.piece[last[at]])
        return out[::-1]

    def _encode_chunk(self, chunk: str) -> bytes:
        if self.alphabet.issuperset(chunk):
            out = self._run(chunk)
        else:
            out = []
            for known, part in _stretches(chunk, self.alphabet):
                if known:
                    out += self._run(part)
                elif self.byte:
                    out += [self.byte[b] for b in part.encode()]
                else:
                    out.append(self.unk)
        return array("I", out).tobytes()

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """ids of each of different chunks; short ones are remembered."""
        found = list(map(self.known.table.get, chunks))
        for k, ids in enumerate(found):
            if ids is None:
                found[k] = self._encode_chunk(chunks[k])
                self.known.keep(chunks[k], found[k])
        return found

    def _chunks(self, texts: pa.Array) -> pa.Array:
        """A list of each text's chunks.  Spaces become markers, so that a space can show the cuts."""
        marked = pc.replace_substring(texts, " ", " " + MARK if self.cut_marks else MARK)
        marked = pc.replace_substring_regex(marked, r"\A(?s:(.))", MARK + r"\1")
        if self.cut_marks:
            for _ in range(2):                   # no cut in a run of markers; neighbours need a second pass
                marked = pc.replace_substring(marked, f"{MARK} {MARK}", MARK + MARK)
        if self.after_word:
            marked = pc.replace_substring_regex(marked, self.after_word, r"\1 \2")
        return pc.split_pattern(marked, " ")

    def encode_packed(self, texts: pa.Array) -> list[bytes]:
        """ids of each text (null: none) as little-endian unsigned 32-bit numbers."""
        chunks = self._chunks(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = chunks.flatten().dictionary_encode()
        ids = self._learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        return joined_values(pa.array(ids, pa.large_binary()), coded.indices, chunks.offsets.to_numpy())

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(pa.array([text]))[0], dtype="<u4").tolist()

    def decode_packed(self, packed: list[bytes]) -> list[str]:
        """Texts of ids, each of which the model has."""
        ids = np.frombuffer(b"".join(packed), dtype="<u4")
        ends = np.cumsum([0, *map(len, packed)]) // 4
        return [self._text(raw) for raw in joined_values(self.raw_pieces, pa.array(ids), ends)]

    @staticmethod
    def _text(raw: bytes) -> str:
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text

    def decode(self, ids) -> str:
        return self._text(b"".join([self.raw[i if i is not None and 0 <= i < len(self.raw) else self.unk] for i in ids]))


def _stretches(chunk: str, alphabet: set) -> list[tuple[bool, str]]:
    """Stretches of characters that have pieces, and of those that have none."""
    return [(known, "".join(part)) for known, part in itertools.groupby(chunk, alphabet.__contains__)]


def _of_texts(docs: DataFrame, made, schema: str) -> DataFrame:
    """doc_id as it is, and the columns that ``made`` gives for an array of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in byte_groups(b.column(1)):
                columns = made(texts)
                yield pa.record_batch([b.column(0).slice(at, len(texts)), *columns.values()], names=["doc_id", *columns])
                at += len(texts)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, " + schema)


def encode(docs: DataFrame, model_file: str, bpe: bool = True) -> DataFrame:
    """doc_id, ids (array of int) of every text."""
    def made(texts: pa.Array) -> dict[str, pa.Array]:
        codec = worker_cache(("sentencepiece", model_file, bpe), lambda: Codec(model_file, bpe))
        return {"ids": pa.array([np.frombuffer(p, dtype="<i4") for p in codec.encode_packed(texts)], pa.list_(pa.int32()))}

    return _of_texts(docs, made, "ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text of every ids array; an id that the model hasn't is read as the unknown one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_cache(("sentencepiece", model_file, True), lambda: Codec(model_file))
        for b in batches:
            text = [None if ids is None else codec.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        run, "doc_id bigint, text string")


def digest(docs: DataFrame, model_file: str, bpe: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256, round_trip."""
    def made(texts: pa.Array) -> dict[str, pa.Array]:
        codec = worker_cache(("sentencepiece", model_file, bpe), lambda: Codec(model_file, bpe))
        encoded = codec.encode_packed(texts)
        decoded = codec.decode_packed(encoded)
        n, crc = [len(packed) // 4 for packed in encoded], [zlib.crc32(packed) for packed in encoded]
        sha = [hashlib.sha256(back.encode()).hexdigest() for back in decoded]
        same = [back == (text.as_py() or "").replace(MARK, " ") for back, text in zip(decoded, texts)]
        return {"n_pieces": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                "decoded_sha256": pa.array(sha, pa.string()), "round_trip": pa.array(same, pa.bool_())}

    return _of_texts(docs, made, "n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, round_trip boolean")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    return digest(docs, model_file or model_path())
