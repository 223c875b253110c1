"""Conversation repair against a plain dynamic programme, row by row, and against its SQL."""

import collections
import hashlib
import random
import re
import zlib

import duckdb

from driftwatch.llm import conversation_repair as repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def rows_after_damage(rows):
    """conv -> [(turn, role, text)] in order."""
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        mine += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, turns)."""
    def better(table, state, new):
        if state not in table or new[:2] < table[state][:2]:
            table[state] = new

    def with_insertions(table):
        for _ in range(3):
            for state, (cost, audit, turns) in list(table.items()):
                for role in ("user", "assistant"):
                    if state in AFTER[role[0]]:
                        better(table, AFTER[role[0]][state], (cost + 5, audit + "I", (*turns, (role, ""))))
        return table

    now = {0: (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, turns) in with_insertions(now).items():
            better(after, state, (cost + 2, audit + "D", turns))
            if fault in ("", "truncated"):
                more = cost + 5 * (fault == "truncated")
                if state in AFTER.get(role[:1], ()):
                    better(after, AFTER[role[0]][state], (more, audit + "K", (*turns, (role, text))))
                for new in ("user", "assistant"):
                    if state in AFTER[new[0]]:
                        better(after, AFTER[new[0]][state], (more + 1, audit + "R", (*turns, (new, text))))
        now = after
    now = with_insertions(now)
    return min(now[k] for k in (0, 3) if k in now)


def by_hand(rows):
    """conv -> (result row without its id, turns)."""
    out = {}
    for conv, mine in rows_after_damage(rows).items():
        faults = faults_of(mine)
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, made = cheapest(mine, faults)
        text = "\n".join(f"{r}:{t}" for r, t in made)
        out[conv] = ((gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                      hashlib.sha256(text.encode()).hexdigest()), made)
    return out


def odd_rows():
    rng = random.Random(1)
    rows = []
    for conv in [None, *range(300)]:
        for t in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([t, t, t, t, None, rng.randint(0, 12)]),
                         rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]),
                         rng.choice(["Hi.", "Hi", "a b!", " ", None, "", "x?", "long text", "é.", "\t\n", "line\nline."])))
    return rows


def test_repairs_match_brute_force(spark):
    rows = odd_rows()
    got = {r[0]: tuple(r)[1:] for r in repair.query(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {c: w for c, (w, _) in by_hand(rows).items()}


def test_repaired_turns(spark):
    rows = odd_rows()[:400]
    got = collections.defaultdict(list)
    for r in repair.repaired_rows(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "place").collect():
        assert r.place == len(got[r.conv_id])
        got[r.conv_id].append((r.role, r.text))
    assert got == {c: list(made) for c, (_, made) in by_hand(rows).items() if made}


def test_sql_matches_brute_force():
    rows = odd_rows()
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert {r[0]: r[1:] for r in con.execute(repair.oracle_sql()).fetchall()} == {c: w for c, (w, _) in by_hand(rows).items()}


def test_long_and_repetitive_conversations(spark, monkeypatch):
    """One conversation holds most rows and spans tasks and segments; one is a single row very many times; extra columns."""
    monkeypatch.setattr(repair, "SEGMENT", 64)
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Hi", "y", "z"]) + str(rng.randint(0, 2500))
             + rng.choice([".", "", "!"])) for t in range(4000)]
    rows += [(2, 3, "user", "same.")] * 3000 + [(3, t, "user", "again.") for t in range(3000)] + [(4, 0, "user", "Hi."), (4, 1, "assistant", "x " * 700_000 + ".")]
    df = spark.createDataFrame([(*r, "c", 1, 2, "s") for r in rows], SCHEMA + ", conv string, times int, ord int, tag string")
    got = {r[0]: tuple(r)[1:] for r in repair.query(df).collect()}
    assert got == {c: w for c, (w, _) in by_hand(rows).items()}


def test_grammar_gives_the_plain_product():
    rng = random.Random(4)
    plain = repair.Grammar()
    shapes = [bytes(rng.randint(0, 8) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    rounds = [[(3, 5), (5, 3), (1, 3)], [(9, 9), (9, 10), (0, 0)], [(12, 12), (9, 0)]]
    grammar = repair.Grammar(rounds)
    for s in shapes + [bytes([3, 5]) * 40, bytes(33)]:
        assert grammar.evaluated(s) == plain.evaluated(s)
    assert len(grammar.compressed(bytes([3, 5]) * 40)) <= 10


def test_rules_come_from_all_conversations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(200) for t in range(8)]
    cut = repair.segments(repair.damaged(spark.createDataFrame(rows, SCHEMA)))
    rounds = repair.grammar_rounds(cut)
    assert (repair.symbol("u", False), repair.symbol("a", False)) in rounds[0] and len(rounds) > 1
