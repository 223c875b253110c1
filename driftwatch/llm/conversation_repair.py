"""Conversation structure repair by dynamic programming over a grammar.

``damaged`` makes the rows to repair: the crc32 of ``conv_id:turn`` decides which are dropped, emptied,
stripped of sentence ends, doubled or given to the user.  A conversation's rows become a sequence of symbols: "must be deleted"
(blank or duplicate), or the role's initial and whether the text is truncated.

1. Equal rows are counted together, then put in order (conv_id, turn, role, text) by a range partitioning over all four, so
   that a very long conversation is spread over tasks.  Each task cuts its part into segments of at most ``SEGMENT``
   symbols.
2. Re-Pair: the most frequent pairs of neighbouring symbols over all distinct segments, weighted by how often these
   occur, become rules, ``RULES`` a round, for ``ROUNDS`` rounds.  The grammar is bounded by that and broadcast.
3. Each symbol has a min-plus transfer matrix between the states of the roles wanted, ``(s?(ua)+)?``: the cheapest
   cost of the edits from one state to another, and their audit.  A rule's matrix is the product of its two parts',
   evaluated bottom-up once and shared by all conversations.  Its audit is a rope: an entry only
   records the state in the middle, and its text is that of the left part's entry before that of the right part's.
4. A segment is the product over its grammar symbols; a conversation the product over its segments.

The audit of least cost, and among equal costs the least in ASCII, is kept at each step.  That is exact: audits without an insertion
between the same places have equal lengths, so their order doesn't change by what is added; and no
cheapest repair has an insertion.  (Take out an inserted turn and one beside it, and if only s is left that too: the
pattern still holds, at most 4 are paid for deletions, and 5 is saved.)

``repairs`` gives a row per conversation, ``repaired_rows`` the turns that result.  The digest of a conversation is a SHA-256 over all
its text, which only one task can compute; it streams the rows and holds none of them but one, and
the audit, which is one value of the result.

Defined results: a null role or text is one space, a null conv_id or turn is one space in the key; a null conv_id
is a conversation.  Rows of one turn are in the order of role, then of the text's MD5; equal rows stand side by
side, and all but the first are duplicates.  Texts are compared by their MD5.  A conversation without rows after
the damage has zeros and an empty audit; an empty table gives no rows; extra columns are ignored; texts and conversations of any
length are handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_landed, land, shuffle_partitions

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Symbols of a segment at most; rules a round; rounds.
SEGMENT, RULES, ROUNDS = 4096, 32, 12
#: Copies of the table of first places of repeated texts, so that one such text isn't joined in one task.
SALTS = 32
#: Evaluated segments that a task remembers.
KNOWN = 20_000

_SPACE = " \t\n\x0b\x0c\r"
_STATES = range(4)                  # nothing yet; after s; after u; after a
#: State after a role's initial, by state before.
_AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ENDS = (0, 3)
_ROLES = "sua"
_FULL = {"u": "user", "a": "assistant"}
#: Illegal are neighbours other than these.
_LEGAL = {"su", "ua", "au"}


# ---------------------------------------------------------------- symbols and matrices

def symbol(initial: str, cut: bool) -> int:
    """0 is a row that must be deleted."""
    k = _ROLES.find(initial) if initial else -1
    return 1 + 2 * (k if k >= 0 else 3) + cut


def _least(options):
    return min(options, default=None)


def insertions() -> list[list]:
    """Cheapest insertions from state to state: (cost, audit) or None."""
    out = [[(0, "") if i == j else None for j in _STATES] for i in _STATES]
    for _ in _STATES:
        for i in _STATES:
            for k in _STATES:
                for to in (_AFTER["u"].get(k), _AFTER["a"].get(k)):
                    if out[i][k] and to is not None:
                        new = (out[i][k][0] + INSERT, out[i][k][1] + "I")
                        out[i][to] = min(out[i][to], new) if out[i][to] else new
    return out


def edits(s: int) -> list[list]:
    """Cheapest edits of one row from state to state, insertions before it included."""
    own = [[[] for _ in _STATES] for _ in _STATES]
    for i in _STATES:
        own[i][i].append((DELETE, "D"))
        if s:
            role, cut = divmod(s - 1, 2)
            if role < 3 and i in _AFTER[_ROLES[role]]:
                own[i][_AFTER[_ROLES[role]][i]].append((KEEP + CUT * cut, "K"))
            for to in "ua":
                if i in _AFTER[to]:
                    own[i][_AFTER[to][i]].append((REROLE + CUT * cut, "R"))
    before = insertions()
    return [[_least((before[i][k][0] + c, before[i][k][1] + a) for k in _STATES if before[i][k] for c, a in own[k][j])
             for j in _STATES] for i in _STATES]


class Grammar:
    """Rules (left, right), in rounds, and the matrices of all symbols.

    An entry of a rule's matrix is (cost, middle state); its audit is the left part's audit up to that state, then
    the right part's from there, put together when it is asked for.
    """

    def __init__(self, rounds: list[list[tuple[int, int]]] = ()):
        self.first = symbol("", True) + 1
        self.matrices = [edits(s) for s in range(self.first)]
        self.rules: list[tuple[int, int]] = []
        self.rounds: list[dict[tuple[int, int], int]] = []
        self.texts: dict[tuple[int, int, int], str] = {}
        self.known: dict[bytes, list] = {}
        for pairs in rounds:
            self.add(pairs)

    def add(self, pairs: list[tuple[int, int]]) -> None:
        """A round of rules and their matrices."""
        self.rounds.append({})
        for pair in pairs:
            self.rounds[-1][tuple(pair)] = self.first + len(self.rules)
            self.rules.append(tuple(pair))
            left, right = (self.matrices[x] for x in pair)
            self.matrices.append([[self._middle(pair, left, right, i, j) for j in _STATES] for i in _STATES])

    def _middle(self, pair, left, right, i, j):
        costs = {k: left[i][k][0] + right[k][j][0] for k in _STATES if left[i][k] and right[k][j]}
        if not costs:
            return None
        least = min(costs.values())
        ties = [k for k, c in costs.items() if c == least]
        if len(ties) > 1:
            ties.sort(key=lambda k: self.audit(pair[0], i, k) + self.audit(pair[1], k, j))
        return least, ties[0]

    def audit(self, s: int, i: int, j: int) -> str:
        if s < self.first:
            return self.matrices[s][i][j][1]
        text = self.texts.get((s, i, j))
        if text is None:
            left, right = self.rules[s - self.first]
            k = self.matrices[s][i][j][1]
            text = self.texts[s, i, j] = self.audit(left, i, k) + self.audit(right, k, j)
        return text

    def compressed(self, sequence: bytes) -> list[int]:
        out = list(sequence)
        for rules in self.rounds:
            now, out = out, []
            for s in now:
                new = rules.get((out[-1], s)) if out else None
                if new is None:
                    out.append(s)
                else:
                    out[-1] = new
        return out

    def evaluated(self, sequence: bytes) -> list[list]:
        """(cost, audit) or None from state to state, for a segment."""
        got = self.known.get(sequence)
        if got is None:
            if len(self.known) >= KNOWN or len(sequence) > 64 and len(self.known) >= 200:
                self.known.clear()
            got = [[(0, "") if i == j else None for j in _STATES] for i in _STATES]
            for s in self.compressed(sequence):
                got = [self.step(row, s) for row in got]
            self.known[sequence] = got
        return got

    def step(self, row: list, s: int) -> list:
        """What a row (cost, audit by state) becomes after a symbol."""
        m, out = self.matrices[s], []
        for j in _STATES:
            options = [(row[k][0] + m[k][j][0], k) for k in _STATES if row[k] and m[k][j]]
            least = min(options, default=(0, 0))[0]
            out.append(_least((c, row[k][1] + self.audit(s, k, j)) for c, k in options if c == least))
        return out


def joined(row: list, matrix: list[list]) -> list:
    return [_least((row[k][0] + matrix[k][j][0], row[k][1] + matrix[k][j][1]) for k in _STATES if row[k] and matrix[k][j])
            for j in _STATES]


# ---------------------------------------------------------------- rows

def damaged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, times (0: dropped, 2: doubled) of every row."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


def _narrow(rows: DataFrame) -> DataFrame:
    """conv, turn, role, mark (MD5 of the text), blank, cut, n: equal rows once, without their texts; first: the turn of
    the first equal role and text, known (as ``first.turn``) where these occur at several turns."""
    bare = F.rtrim(F.col("text"), F.lit(_SPACE))
    each = (rows.where("times > 0").withColumn("bare", bare)
            .select("conv", "turn", "role", F.md5("text").alias("mark"), (F.col("bare") == "").alias("blank"),
                    (~F.right("bare", F.lit(1)).isin(".", "!", "?")).alias("cut"), "times")
            .groupBy("conv", "turn", "role", "mark", "blank", "cut").agg(F.sum("times").alias("n")))
    salt = F.pmod(F.xxhash64("turn"), F.lit(SALTS))
    again = (each.where("not blank").groupBy("conv", "role", "mark")
             .agg(F.count("*").alias("turns"), F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first"))
             .where("turns > 1")
             .select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("mark").alias("k"), "first",
                     F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")))
    return each.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                     & (F.col("mark") == F.col("k")) & (salt == F.col("s")), "left").drop("c", "r", "k", "s")


_SEGMENTS = ("conv bigint, ord bigint, sequence binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
             "head string, tail string, low bigint, high bigint, turns bigint")


class _Segment:
    def __init__(self, conv):
        self.conv, self.sequence = conv, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.head = self.tail = self.low = self.high = None

    def put(self, initial, turn, times, s) -> None:
        """``times`` equal rows, each of symbol ``s``."""
        if self.head is None:
            self.head = initial
            self.illegal += (times - 1) * (initial * 2 not in _LEGAL)
        else:
            self.illegal += (self.tail + initial not in _LEGAL) + (times - 1) * (initial * 2 not in _LEGAL)
        self.tail = initial
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self.sequence += bytes([s]) * times

    def values(self, ord_):
        return (self.conv, ord_, bytes(self.sequence), self.blank, self.duplicate, self.truncated, self.illegal,
                self.head, self.tail, self.low, self.high, self.turns)


def segments(rows: DataFrame) -> DataFrame:
    """The conversations in segments, each with its counts."""
    by = ["conv", "turn", "role", "mark"]
    ordered = (_narrow(rows).repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
               .select("conv", "turn", "role", "blank", "cut", "n", F.col("first").isNotNull().alias("again"),
                       F.col("first.turn").alias("first")))
    names = [c.split()[0] for c in _SEGMENTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ord_ = TaskContext.get().partitionId() << 32
        now, out = None, []

        def flushed():
            cols = list(zip(*out)) if out else [[] for _ in names]
            types = {"sequence": pa.binary(), "head": pa.string(), "tail": pa.string()}
            batch = pa.record_batch([pa.array(c, types.get(n, pa.int64())) for n, c in zip(names, cols)], names=names)
            out.clear()
            return batch

        for b in batches:
            for conv, turn, role, blank, cut, n, again, first in zip(*(c.to_pylist() for c in b.columns)):
                if now is not None and now.conv != conv:
                    out.append(now.values(ord_))
                    ord_, now = ord_ + 1, None
                later = blank or again and first != turn
                left = n
                while left:
                    if now is not None and len(now.sequence) >= SEGMENT:
                        out.append(now.values(ord_))
                        ord_, now = ord_ + 1, None
                    if now is None:
                        now = _Segment(conv)
                    if left == n and not later:
                        now.put(role[:1], turn, 1, symbol(role[:1], cut))
                        now.truncated += cut
                        left -= 1
                        continue
                    part = min(left, SEGMENT - len(now.sequence))
                    now.put(role[:1], turn, part, 0)
                    if blank:
                        now.blank += part
                    else:
                        now.duplicate += part
                    left -= part
                if len(out) >= 1000:
                    yield flushed()
        if now is not None:
            out.append(now.values(ord_))
        yield flushed()

    return ordered.mapInArrow(run, _SEGMENTS)


def _pair_counts(shapes: DataFrame, rounds: list) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, counts = Grammar(rounds), {}
        for b in batches:
            for sequence, n in zip(*(c.to_pylist() for c in b.columns)):
                last = None
                for at, pair in enumerate(pairwise(grammar.compressed(sequence))):
                    if pair[0] == pair[1] and last == (at - 1, pair):     # of three equal ones only one pair
                        continue
                    last = at, pair
                    counts[pair] = counts.get(pair, 0) + n
        yield pa.record_batch([pa.array([p[k] for p in counts], pa.int32()) for k in (0, 1)]
                              + [pa.array(list(counts.values()), pa.int64())], names=["l", "r", "n"])

    return shapes.select("sequence", "n").mapInArrow(run, "l int, r int, n bigint").groupBy("l", "r").agg(F.sum("n").alias("n"))


def grammar_rounds(cut: DataFrame, rules: int = RULES, rounds: int = ROUNDS) -> list[list[tuple[int, int]]]:
    """Re-Pair over all segments: the rules of each round.  Only the most frequent pairs reach the driver."""
    shapes = land(cut.groupBy("sequence").agg(F.count("*").alias("n")), "shapes")
    out: list[list[tuple[int, int]]] = []
    while len(out) < rounds:
        best = _pair_counts(shapes, out).where("n > 1").orderBy(F.col("n").desc(), "l", "r").limit(rules).collect()
        if not best:
            break
        out.append([(r["l"], r["r"]) for r in best])
    drop_landed(shapes)
    return out


_EVALUATED = "conv bigint, ord bigint, costs array<bigint>, audits array<string>"


def _evaluated(cut: DataFrame, rounds: list) -> DataFrame:
    """conv, ord, costs and audits from state to state (16 each, null where there is no way), and the counts."""
    counts = ["blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "turns"]
    types = {n: t for n, t in (c.split() for c in _SEGMENTS.split(", "))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rounds)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                flat = [[e for row in grammar.evaluated(s) for e in row] for s in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1),
                                       pa.array([[e and e[0] for e in f] for f in flat], pa.list_(pa.int64())),
                                       pa.array([[e and e[1] for e in f] for f in flat], pa.list_(pa.string())),
                                       *part.columns[3:]], names=["conv", "ord", "costs", "audits", *counts])

    return cut.select("conv", "ord", "sequence", *counts).mapInArrow(
        run, _EVALUATED + "".join(f", {n} {types[n]}" for n in counts))


# ---------------------------------------------------------------- conversations

class _Conversation:
    """Folds the segments of one conversation, then goes through its rows with the audit."""

    def __init__(self, conv):
        self.conv, self.row = conv, [(0, ""), None, None, None]
        self.counts = [0, 0, 0, 0]
        self.tail = self.low = self.high = None
        self.turns, self.audit, self.at, self.state = 0, None, 0, 0
        self.hash, self.some = hashlib.sha256(), False

    def segment(self, costs, audits, counts, head, tail, low, high, turns) -> None:
        matrix = [[(costs[4 * i + j], audits[4 * i + j]) if costs[4 * i + j] is not None else None for j in _STATES]
                  for i in _STATES]
        self.row = joined(self.row, matrix)
        self.counts = [x + y for x, y in zip(self.counts, counts)]
        self.counts[3] += self.tail is not None and self.tail + head not in _LEGAL
        self.tail = tail
        if turns:
            self.turns += turns - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high

    def settle(self) -> None:
        if self.audit is None:
            end = joined(self.row, insertions())
            self.cost, self.audit = min(end[j] for j in _ENDS if end[j])

    def _out(self, role, text):
        self.state = _AFTER[role[:1]][self.state]
        self.hash.update((("\n" if self.some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.some = True
        return role, text

    def _wanted(self):
        return "assistant" if self.state == 2 else "user"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._out(self._wanted(), "")

    def edited(self, role, text) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._out(role if edit == "K" else self._wanted(), text)

    def values(self):
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.counts, self.cost, self.audit, self.hash.hexdigest())


_RESULT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
           "audit string, repaired_sha256 string")
_TURNS = "conv_id bigint, place bigint, role string, text string"


def _streams(turns: bool):
    """Over rows by conv, its segments first: a row per conversation, or the turns that result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _TURNS if turns else _RESULT
        fields = [pa.field(n, pa.int64() if t == "bigint" else pa.string()) for n, t in (c.split() for c in schema.split(", "))]
        now, out, size, place = None, [], 0, 0

        def flushed():
            cols = list(zip(*out)) if out else [[] for _ in fields]
            batch = pa.record_batch([pa.array(c, f.type) for f, c in zip(fields, cols)], schema=pa.schema(fields))
            out.clear()
            return batch

        def ended():
            nonlocal size, place
            now.settle()
            for role, text in now.inserted():
                if turns:
                    out.append((now.conv, place, role, text))
                    place += 1
            if not turns:
                out.append(now.values())
                size += len(now.audit)
            place = 0

        for b in batches:
            for (conv, tag, role, text, times, costs, audits, blank, duplicate, truncated, illegal, head, tail, low, high,
                 n_turns) in zip(*(c.to_pylist() for c in b.columns)):
                if now is None or now.conv != conv:
                    if now is not None:
                        ended()
                    now = _Conversation(conv)
                if tag == 0:
                    now.segment(costs, audits, (blank, duplicate, truncated, illegal), head, tail, low, high, n_turns)
                    continue
                now.settle()
                for _ in range(times):
                    for made in now.edited(role, text):
                        if turns:
                            out.append((conv, place, *made))
                            place, size = place + 1, size + len(made[1])
                if len(out) >= 1000 or size > 1 << 24:
                    size = 0
                    yield flushed()
        if now is not None:
            ended()
        yield flushed()

    return run


def _repair(rows: DataFrame, turns: bool) -> DataFrame:
    made = damaged(rows)
    cut = land(segments(made), "segments")
    known = land(_evaluated(cut, grammar_rounds(cut)), "evaluated")
    drop_landed(cut)
    fields = [f for f in known.schema.fields if f.name not in ("conv", "ord")]
    both = (known.select("conv", F.lit(0).alias("tag"), "ord", F.lit(None).cast("bigint").alias("turn"),
                         *[F.lit(None).cast("string").alias(c) for c in ("role", "mark", "text")], F.lit(0).alias("times"),
                         *[f.name for f in fields])
            .unionByName(made.select("conv", F.lit(1).alias("tag"), F.lit(0).cast("bigint").alias("ord"), "turn", "role",
                                     F.md5("text").alias("mark"), "text", "times",
                                     *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])))
    ordered = (both.repartition(shuffle_partitions(rows.sparkSession), "conv")
               .sortWithinPartitions("conv", "tag", "ord", "turn", "role", "mark"))
    return ordered.select("conv", "tag", "role", "text", "times", *[f.name for f in fields]).mapInArrow(
        _streams(turns), _TURNS if turns else _RESULT)


def repairs(rows: DataFrame) -> DataFrame:
    """A row per conversation: faults, cost, audit, digest of the repaired turns."""
    return _repair(rows, False)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: the turns of the repaired conversations."""
    return _repair(rows, True)


def query(rows: DataFrame) -> DataFrame:
    return repairs(rows)


def oracle_sql() -> str:
    """DuckDB statement for ``query`` over ``conversations``: the states' best repairs, row by row.  Insertions are left out, as
    no cheapest repair has one."""
    def edit(state, cost, letter, line=None, when="true"):
        out = f"{state}.o" if line is None else f"case when {state}.o = '' then '' else {state}.o || chr(10) end || {line}"
        return f"case when {state} is not null and {when} then {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {out}}} end"

    def step(state, keeps, initial, reroles, full):
        options = [edit(state, DELETE, "D")]
        options += [edit(k, f"{CUT} * fault", "K", "role || ':' || text", f"fault < 2 and initial = '{initial}'") for k in keeps]
        options += [edit(k, f"{REROLE} + {CUT} * fault", "R", f"'{full}:' || text", "fault < 2") for k in reroles]
        return f"list_min([{', '.join(options)}]) as {state}"

    steps = ", ".join([step("s0", [], "", [], ""), step("s1", ["s0"], "s", [], ""),
                       step("s2", ["s0", "s1", "s3"], "u", ["s0", "s1", "s3"], "user"),
                       step("s3", ["s2"], "a", ["s2"], "assistant")])
    return f"""
with recursive crc as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
k as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
h as (select k.*, xor(4294967295, list_reduce(list_prepend(4294967295::bigint,
             list_transform(range(1, len(key) + 1), lambda j: ascii(substr(key, j, 1))::bigint)),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 as kind from k, crc),
d as (select conv_id, turn, case when kind = 4 then 'user' else coalesce(role, ' ') end as role,
             case when kind = 1 then '' when kind = 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g')
                  else coalesce(text, ' ') end as text,
             unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy from h),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as i from d),
f as (select *, left(role, 1) as initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare,
             row_number() over (partition by conv_id, role, text order by i) > 1 as again,
             lag(left(role, 1)) over (partition by conv_id order by i) as before from o),
r as (select *, case when bare = '' or again then 2 when right(bare, 1) in ('.', '!', '?') then 0 else 1 end as fault from f),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
             count(*) filter (bare = '') as blank, count(*) filter (bare <> '' and again) as duplicate,
             count(*) filter (fault = 1) as truncated,
             count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, max(i) as n
      from r group by conv_id),
p as (select conv_id, 0::bigint as done, {{'c': 0::bigint, 'a': '', 'o': ''}} as s0,
             null::struct(c bigint, a varchar, o varchar) as s1, null::struct(c bigint, a varchar, o varchar) as s2,
             null::struct(c bigint, a varchar, o varchar) as s3 from (select distinct conv_id from conversations)
      union all
      select p.conv_id, done + 1, {steps} from p join r on r.conv_id is not distinct from p.conv_id and r.i = done + 1),
e as (select conv_id, list_min([s0, s3]) as best from p
      qualify row_number() over (partition by conv_id order by done desc) = 1)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
       coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, best.c as cost, best.a as audit,
       sha256(best.o) as repaired_sha256
from e left join c on c.conv_id is not distinct from e.conv_id"""
