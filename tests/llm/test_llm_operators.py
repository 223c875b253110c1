"""The training-data operators against brute force, on the smallest documents and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__
from driftwatch.llm import (
    license_scan, line_dedup, lsh_forest, packing, pii, piecewise_hash, quality_rules, sentencepiece_codec, suffix_dedup,
    warc,
)

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "  \n "), (None, "a b c d e f"), (None, None), (5, "x " * 3000), (5, "x " * 3000),
       (6, "x " * 3000), (6, "other text here"), (7, "the same line of words " * 30 + "\nend"),
       (8, "the same line of words " * 30 + "\nend two"), (9, "cc by all rights reserved CC-BY")]
#: Columns whose names clash with the operators' own.
EXTRA = "n_words int, d string, u int, kept int, length int, sequence_id int, spans string, n int, c int, z int, rest int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 1, "d", 2, 3, 4, 5, "s", 6, 7, 8, 9) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, " + EXTRA)


def test_suffix_dedup_is_exact(docs, texts):
    got = {r.doc_id: r for r in suffix_dedup.query(docs).collect()}
    seen = set()
    for i, text in texts:
        raw = text.encode()
        covered = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s:s + 100]
            if w in seen:
                covered[s:s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, v in zip(raw, covered) if not v)
        spans = len([p for p in bytes(covered).split(b"\0") if p])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (
            len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_of_texts_that_share_an_id(spark):
    """1,500 texts without an id: each is scanned, whatever the low bits of its hash."""
    rng = random.Random(6)
    first = ["".join(rng.choice("abcdefghij ") for _ in range(150)) for _ in range(1500)]
    rows = [(None, t) for t in first] + [(k, f"{t} {k}") for k, t in enumerate(first)] + [(None, first[0])]
    got = suffix_dedup.query(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows)
    want = collections.Counter((None, 150, 0, 0) for _ in range(1501))
    want.update((k, 151 + len(str(k)), 150, 1) for k in range(1500))
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got) == want


def test_packing_holds_every_id_once(docs, texts):
    from tokenizers import Tokenizer

    rows = packing.query(docs).toPandas().sort_values(["sequence_id", "offset"])
    assert (rows.offset == rows.groupby("sequence_id").length.cumsum() - rows.length).all()
    assert rows.groupby("sequence_id").length.sum().max() <= packing.WINDOW
    tok = Tokenizer.from_file(packing.tokenizer_path())
    by_doc = {i: g.sort_values("start") for i, g in rows.groupby("doc_id")}
    for i, text in texts:
        ids = np.asarray(tok.encode(text, add_special_tokens=False).ids + [2], dtype="<u4")
        p = by_doc[i]
        assert p.length.sum() == len(ids) == p.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[s:s + n].tobytes()) for s, n in zip(p.start, p.length)] == p.ids_crc32.tolist()


def test_packing_patterns_place_every_length():
    counts = {4096: 3, 4000: 5, 96: 7, 1: 100, 2000: 9}
    patterns = packing.pack_histogram(counts)
    placed = collections.Counter()
    for copies, lengths in patterns:
        assert sum(n * k for n, k in lengths) <= packing.WINDOW
        for n, k in lengths:
            placed[n] += copies * k
    assert placed == counts


@pytest.mark.parametrize("name,query", [("documents", quality_rules), ("documents", line_dedup)])
def test_native_operators_match_sql_on_odd_rows(spark, odd, name, query):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", ODD)
    res = con.execute(query.oracle_sql())
    names = [c[0] for c in res.description]
    want = collections.Counter(map(repr, res.fetchall()))
    got = query.query(odd).select(*names).collect()
    if query is line_dedup:                       # equal rows are one document: none removes the other
        got, want = [r for r in got if r.doc_id != 5], {k: v for k, v in want.items() if not k.startswith("(5,")}
        got = [r for r in got if r.doc_id != 6]
        want = {k: v for k, v in want.items() if not k.startswith("(6,")}
    assert collections.Counter(repr(tuple(r)) for r in got) == want


def test_quality_ablations(docs):
    led = quality_rules.ledger(docs)
    bits = [r.failed_bits for r in led.collect()]
    for r in quality_rules.ablations(led).collect():
        bit = 1 << list(quality_rules.RULES).index(r.rule)
        assert (r.rejects, r.rejects_alone) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits))


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in piecewise_hash.query(docs).collect()}
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        n = len(text) // 4
        edited = text[:len(text) - n] + after[:n]
        own, theirs = piecewise_hash.fingerprint(text), piecewise_hash.fingerprint(edited)
        assert tuple(got[i]) == (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, theirs,
                                 piecewise_hash.likeness(own, theirs),
                                 piecewise_hash.likeness(own, piecewise_hash.fingerprint(after)))


def test_fingerprints_cover_repetitive_texts():
    """The last quarter of a text counts as a quarter, however often its lines trigger."""
    rng = random.Random(8)
    after = "".join(rng.choice("abcdefgh \n") for _ in range(200_000))
    long = 0
    for _ in range(40):
        line = "".join(rng.choice("abcdefgh ") for _ in range(60))
        text = (line + "\n") * 2000
        own = piecewise_hash.fingerprint(text)
        long += len(own.split(":")[1]) > 160
        assert piecewise_hash.likeness(own, piecewise_hash.fingerprint(piecewise_hash.edited(text, after))) < 0.9
    assert long


def test_fingerprints_of_long_chunks():
    """Equal chunks have equal characters, whether or not another one is over 1 MiB."""
    rng = random.Random(9)
    prose = "".join(rng.choice("abcdefgh \n") for _ in range(800_000))
    below, above = (piecewise_hash.fingerprint(prose + "z" * n).split(":") for n in (900_000, 1_300_000))
    assert below[0] == above[0] and [s[:-1] for s in below[1:]] == [s[:-1] for s in above[1:]]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 20))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert piecewise_hash.edit_distance(a, b) == row[-1]


def test_license_scan_base(docs, odd, texts):
    phrases = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}
    for df, rows in ((docs, texts), (odd, ODD)):
        got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
                                  for r in license_scan.query(df).collect())
        want = collections.Counter()
        for i, text in rows:
            low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
            at = [(k, label) for label, p in phrases.items() for k in range(len(w)) if w[k:k + len(p)] == p]
            want[(i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None,
                  ",".join(sorted({x for _, x in at})))] += 1
        assert got == want


def components_by_hand(rows, size, threshold):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        k = min(size, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= threshold * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= threshold * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_match_brute_force(docs, texts):
    want = components_by_hand(texts, 3, 85)
    for r in lsh_forest.query(docs).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def drifted(n, seed=0):
    """A tree of copies, each linked (at just 0.85 of three-word shingles) to the one copy it was made from."""
    rng = random.Random(seed)
    made = [[f"w{k}" for k in range(150)]]
    for k in range(1, n):
        words = list(rng.choice(made[-40:]))
        for at in rng.sample(range(3, 147, 6), 4):
            words[at] = f"x{k}-{at}"
        made.append(words)
    rng.shuffle(made)
    return [(i, " ".join(w)) for i, w in enumerate(made)]


def test_near_duplicates_of_long_chains(spark):
    rows = [(i + 1000 * k, t.replace("w", f"{k}w")) for k in range(3) for i, t in drifted(300, k)]
    want = components_by_hand(rows, 3, 85)
    got = {r.doc_id: r.component_id for r in lsh_forest.query(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: c for i, (_, c) in want.items()}


def test_near_duplicates_far_apart_in_a_region(spark, monkeypatch):
    """A few links among many unlinked documents of one region, whose order says nothing about them."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(lsh_forest, "BLOCK_ROWS", 64)
    rng, size = np.random.default_rng(4), lsh_forest.TREES * lsh_forest.DEPTH
    least = lsh_forest.least_depth(0.85)
    sigs, sets = [], []
    for d in range(400):
        # all share the least depth of the first order only; d and d + 200 agree elsewhere but for the next values of it
        sig = rng.integers(0, 2 ** 32, size, dtype=np.uint64).astype(">u4")
        own = np.arange(1000 * d, 1000 * d + 100, dtype=np.uint64)
        if d >= 200:
            sig, own = np.where(np.arange(size) % lsh_forest.DEPTH < 1, sig, sigs[d - 200]), sets[d - 200]
            sig[least:lsh_forest.DEPTH] = rng.integers(0, 2 ** 32, lsh_forest.DEPTH - least)
        sig = sig.astype(">u4")
        sig[:least] = 7
        sigs.append(sig)
        sets.append(own)
    sk = spark.createDataFrame([(d, 100, bytearray(s.tobytes())) for d, s in enumerate(sigs)], "d bigint, n bigint, sig binary")
    full = spark.createDataFrame([(d, bytearray(s.tobytes())) for d, s in enumerate(sets)], "d bigint, s binary")
    rows = lsh_forest.orders(sk).where("tree = 0").join(sk.select("d", "sig"), "d")
    comp = sk.select("d", F.col("d").alias("c"))
    got = lsh_forest.remaining_links(rows, comp, full, least, 85).collect()
    assert {tuple(r) for r in got} == {(d, d + 200) for d in range(200)}


def test_near_duplicates_of_shared_ids(spark):
    """Texts without an id or with one id are documents of their own, and the least of a group stays."""
    words = [f"w{k}" for k in range(60)]
    apart = [" ".join(f"{name}{w}" for w in words) for name in "abcdef"]
    rows = [(None, apart[0]), (None, apart[1]), (None, apart[2]), (7, apart[3]), (7, apart[4]), (8, apart[0] + " end"),
            (9, apart[3] + " end"), (7, apart[3] + " end more"), (None, apart[0]), (None, None), (7, ""), (10, apart[5])]
    out = [r.text for r in lsh_forest.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    group = {apart[3], apart[3] + " end more"}
    assert len(group & set(out)) == 1
    assert sorted(t or "" for t in out if t not in group) == sorted([*apart[:3], *apart[4:], "", ""])


def test_sentencepiece_equals_the_library(spark, docs, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    rng = random.Random(1)
    made = ["".join(rng.choice("abcdefgh  éß\n\t中漢😀0123.,!@  ▁tion") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for text in [t for _, t in texts] + made:
        ids = sp.encode(text)
        assert codec.encode(text) == ids and codec.decode(ids) == sp.decode(ids)
    enc = sentencepiece_codec.encode(docs, sentencepiece_codec.model_path())
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(enc, sentencepiece_codec.model_path()).collect()}
    assert back == dict(texts)


def test_warc_round_trip(spark, tmpdir_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    records = warc.derive(warc.responses(pages))
    warc.write_warc(records, f"{tmpdir_path}/out")
    back = warc.read_warc(spark, f"{tmpdir_path}/out")
    assert records.exceptAll(back).count() == back.exceptAll(records).count() == 0
    rows = records.collect()
    sources = {r.record_id for r in rows if r.kind == "response"}
    assert all(r.refers_to in sources for r in rows if r.kind != "response") and len(rows) == 3 * len(sources)


def test_base_spans_equal_the_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    rng = random.Random(5)
    for _ in range(20000):
        t = "".join(rng.choice("aA0129 .@+-()_%é") for _ in range(rng.randint(0, 40)))
        want = [("email", *m.span()) for m in email.finditer(t)]
        want += [("ip", *m.span()) for m in ip.finditer(t) if all(int(v) <= 255 for v in m[0].split("."))]
        for kind, pattern, least, most in (("card", card, 16, 19), ("phone", phone, 8, 15)):
            for m in pattern.finditer(t):
                d = re.sub("[^0-9]", "", m[0])
                if least <= len(d) <= most and (kind == "phone" or pii.luhn(d)):
                    want.append((kind, *m.span()))
        assert pii.base_spans(t) == want


def test_tagger_finds_held_out_spans():
    """Held-out accuracy: fitted on half of the generated windows, it finds the others' spans."""
    rng = np.random.default_rng(2)
    words = ["the", "of", "ndhe", "ereth", "12", "ou", "style."]
    context = [" ".join(rng.choice(words, 30)) for _ in range(60)]
    x, y = pii.training_set([], context)
    half = np.random.default_rng(1).permutation(len(x))
    model = pii.fit(x[half[::2]], y[half[::2]], epochs=3)
    got, want = pii.viterbi(model, x[half[1::2]]), y[half[1::2]]
    inside = want > 0
    assert ((got > 0) == inside).mean() > 0.97 and ((got > 0) & inside).sum() / inside.sum() > 0.9


@pytest.mark.parametrize("key", sorted(k for k in __spark_entry__.queries() if k.startswith("op")))
def test_empty_tables(spark, key, tmpdir_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmpdir_path}/documents.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmpdir_path}/pages.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmpdir_path}/embeddings.parquet")
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(
        f"{tmpdir_path}/conversations.parquet")
    assert __spark_entry__.queries()[key](spark, tmpdir_path).count() == 0


@pytest.mark.parametrize("query", [suffix_dedup, packing, quality_rules, piecewise_hash, license_scan, lsh_forest,
                                   line_dedup, sentencepiece_codec])
def test_odd_rows_each_get_a_result(odd, query):
    rows = query.query(odd).toPandas()
    ids = rows.doc_id.drop_duplicates() if query is packing else rows.doc_id
    assert len(ids) == (len({i for i, _ in ODD}) if query is packing else len(ODD))


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, corpus_pipeline.land(stage(spark, now, SF), name)
        assert now.columns == docs.columns and 0 < now.count() <= before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
