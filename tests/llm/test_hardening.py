"""Ids beside nulls, very long texts, planted cases, and the pipeline's stages against plain versions."""

import base64
import collections
import gzip
import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from driftwatch.llm import (
    line_dedup, packing, pii, piecewise_hash, quality_rules, sentencepiece_codec, warc,
)
from driftwatch.llm.common import Remembered, byte_groups, drop_landed, land, worker_cache

SF = "/root/testdata/sf0.001"
BIG = [2 ** 53 + 1, 2 ** 53 + 3, -2 ** 53 - 1]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---------------------------------------------------------------- ids

def test_ids_beside_nulls(spark):
    rows = [(None, "a b"), *((i, f"mail me at x{k}@y.org {k}") for k, i in enumerate(BIG)), (None, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    want = collections.Counter(i for i, _ in rows)
    model = pii.fit(*pii.training_set([], ["some text"]), epochs=1)
    for out in (packing.query(df), sentencepiece_codec.query(df), pii.scan(df, model), pii.redact(df, model),
                sentencepiece_codec.decode(sentencepiece_codec.encode(df, sentencepiece_codec.model_path()),
                                           sentencepiece_codec.model_path())):
        assert collections.Counter(r.doc_id for r in out.collect()) == want
    pages = spark.createDataFrame([(i, "http://u", t) for i, t in rows], "page_id bigint, url string, html string").coalesce(1)
    got = collections.Counter(r.page_id for r in warc.query(pages).collect())
    assert got == collections.Counter({i: 3 * n for i, n in want.items()})


# ---------------------------------------------------------------- memory of a worker

def test_remembered_is_bounded_while_it_fills():
    held = Remembered(limit=10_000, longest=100)
    for k in range(1000):
        held.keep(f"key {k}", b"v" * 20)
        held.keep("l" * 200, b"")
        assert len(held.table) * held.ENTRY <= 10_000 and held.table[f"key {k}"] == b"v" * 20
    assert "l" * 200 not in held.table


def test_worker_holds_one_operators_cache():
    first = worker_cache(("a",), lambda: ["a"])
    assert worker_cache(("a",), lambda: ["other"]) is first
    worker_cache(("b",), lambda: ["b"])
    assert worker_cache(("a",), lambda: ["new"]) == ["new"]


def test_tokenizer_with_little_memory(docs, monkeypatch):
    """The same ids, however often what is remembered is emptied; long words are not kept."""
    texts = [r.text for r in docs.limit(40).collect()] + ["w" * 5000 + " end", ""]
    little, much = (packing.WordTokenizer(packing.tokenizer_path()) for _ in range(2))
    little.known.limit = 20_000
    assert little.encode_many(texts) == much.encode_many(texts) == little.encode_many(texts)
    assert "w" * 5000 not in much.known.table
    monkeypatch.setattr(packing, "STEP", 100)
    every = " ".join(texts)
    ids = np.asarray(much.tok.encode(every, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert little.encode_many([every]) == [ids] and len(little.known.table) * Remembered.ENTRY <= 20_000 + 200 * 2 * Remembered.ENTRY


def test_tokenizer_remembers_a_word_once(docs):
    """Case and the punctuation after a word cost no further entries: they are cut off before words are looked up."""
    words = sorted({w for r in docs.limit(40).collect() for w in r.text.lower().split() if w.isalpha()})
    tok = packing.WordTokenizer(packing.tokenizer_path())
    text = " ".join(f"{w} {w}, {w.capitalize()}. {w}!!,%%% {w}'s" for w in words)
    ids = np.asarray(tok.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert tok.encode_many([text]) == [ids] and len(words) > 500
    assert len(tok.known.table) < len(words) + sum(not w.isascii() for w in words) + 20


def test_tokenizer_on_odd_texts():
    """ids of whole texts by the library: special tokens, marks that compose, other scripts, spaces of all kinds; slices too."""
    import pyarrow as pa

    rng = random.Random(6)
    bits = [*"aZéÉßÿµª×÷0٣5.,'<|>_-`~“…漢字яЖΣςİıﬁ", "'s", "'T", "'ll", "J\u030c", "I\u0307", "e\u0301", "=\u0338", "T\u0323\u0308",
            "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", " ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u2028", "\x00", "\x1f", "the", "Tion"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(20000)] + ["", None, "x" * 3000]
    tok = packing.WordTokenizer(packing.tokenizer_path())
    want = [np.asarray(e.ids, dtype="<u4").tobytes() for e in tok.tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert tok.encode(pa.array(texts)) == want and tok.encode(pa.array(texts).slice(501, 7000)) == want[501:7501]
    assert [i for g in byte_groups(pa.array(texts).slice(3), 1000) for i in tok.encode(g)] == want[3:]
    assert tok.encode(pa.array([None, ""], pa.string())) == [b"", b""] and tok.encode_many([]) == []


def test_sentencepiece_remembers_a_word_once(docs):
    """The punctuation after a word costs no further entries, and a group's texts are looked up together."""
    import pyarrow as pa
    import sentencepiece

    words = sorted({w for r in docs.limit(40).collect() for w in r.text.split() if w.isalpha()})
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    texts = [" ".join(f"{w}{end}" for w in words) for end in ("", ",", ".", "!!,%%%", "_")]
    got = [np.frombuffer(p, dtype="<u4").tolist() for p in codec.encode_packed(pa.array(texts))]
    assert got == [sp.encode(t) for t in texts] and len(words) > 500
    assert len(codec.known.table) < len(words) + 20


def test_sentencepiece_on_odd_texts():
    """ids of whole texts by the library: runs of spaces, markers and newlines, pieces that reach over punctuation; slices too."""
    import pyarrow as pa
    import sentencepiece

    rng = random.Random(7)
    bits = [*"aZé²ß×_.,!({$'▁▁漢😀0\n\t\x00\x1f", " ", " ", "  ", "   ", "▁ ", " ▁", "the", "tion", "_{", "².", "->", "\u00a0", "e\u0301"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(10000)] + ["", None, " ", "   ", "▁", "x" * 3000]
    codec = sentencepiece_codec.Codec(sentencepiece_codec.model_path())
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    want = [sp.encode(t or "") for t in texts]
    of = lambda made: [np.frombuffer(p, dtype="<u4").tolist() for p in made]
    packed = codec.encode_packed(pa.array(texts))
    assert of(packed) == want and of(codec.encode_packed(pa.array(texts).slice(777, 3000))) == want[777:3777]
    assert [i for g in byte_groups(pa.array(texts).slice(3), 500) for i in of(codec.encode_packed(g))] == want[3:]
    assert codec.decode_packed(packed) == [sp.decode(ids) for ids in want] == [codec.decode(ids) for ids in want]
    codec.known.clear()
    codec.known.limit = 5000
    assert codec.encode_packed(pa.array(texts)) == packed and len(codec.known.table) * Remembered.ENTRY <= 5000
    assert codec.encode_packed(pa.array([], pa.string())) == codec.decode_packed([]) == []


def test_landed_tables_are_dropped(spark):
    import os

    df = land(spark.range(10), "t")
    assert df.count() == 10 and os.path.isdir(df.landed_in)
    drop_landed(df)
    assert not os.path.exists(df.landed_in)


def test_packing_by_a_shuffle_join(spark, docs, monkeypatch):
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    want = key(packing.query(docs))
    monkeypatch.setattr(packing, "SHUFFLED", 0)
    out = packing.query(docs)
    assert "Broadcast" not in out._jdf.queryExecution().optimizedPlan().toString() and key(out) == want


# ---------------------------------------------------------------- very long texts

def test_fingerprint_of_a_long_repetitive_text():
    text = "ab cd\n" * 3_500_000
    began = time.process_time()
    own = piecewise_hash.fingerprint(text)
    theirs = piecewise_hash.fingerprint(piecewise_hash.edited(text, "zq xw\n" * 1_000_000))
    near = piecewise_hash.likeness(own, theirs)
    assert time.process_time() - began < 60 and max(map(len, own.split(":"))) <= piecewise_hash.MOST
    assert 0 <= near < 0.95 and piecewise_hash.likeness(own, piecewise_hash.fingerprint(text)) == 1


def test_grouped_chunks_tell_texts_apart():
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(8)) + "\n" for _ in range(3)]
    text = "".join(lines[rng.randrange(3)] for _ in range(400_000))
    own = piecewise_hash.fingerprint(text)
    assert max(map(len, own.split(":"))) <= piecewise_hash.MOST
    assert piecewise_hash.likeness(own, piecewise_hash.fingerprint(piecewise_hash.edited(text, text[::-1]))) < 0.95


@pytest.mark.parametrize("part", ["<a ", "<!--", "<title>", "<script>", "<p ", "<a href", "<html ", "<a <a href=x ", "<head>", "</script "])
def test_pages_of_unclosed_parts_take_linear_time(part):
    page = part * (2_000_000 // len(part))
    began = time.process_time()
    warc.visible_text(page)
    warc.metadata_fields(page, ["h"])
    assert time.process_time() - began < 20


# ---------------------------------------------------------------- WARC against plain patterns

DROP = re.compile(r"(?is)<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<!doctype[^>]*>")
HEAD = re.compile(r"(?is)<head\b[^>]*>.*?</head\s*>")
TITLE = re.compile(r"(?is)<title[^>]*>(.*?)</title\s*>")
LANG = re.compile(r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([\w-]+)")
LINK = re.compile(r"(?is)<a\b[^>]*\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")


def plain_text(page):
    import html

    body = re.sub(r"</?[A-Za-z][^>]*>", "", warc._BLOCK.sub("\n", HEAD.sub(" ", DROP.sub(" ", page))))
    return re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f\v]+", " ", html.unescape(body))).strip()


def plain_fields(page):
    import html

    clean = lambda s: " ".join(html.unescape(s).split())
    title, lang = TITLE.search(page), LANG.search(page)
    return ([("title", clean(title[1]))] if title else []) + ([("language", lang[1])] if lang else []) + [
        ("outlink", clean(a or b or c)) for a, b, c in LINK.findall(DROP.sub(" ", page))]


def test_pages_match_plain_patterns(spark):
    rng = random.Random(1)
    parts = ["<a ", "<a href=", "<a href='x'>", "<a href=\"u>v\">", "href=\"q\"", ">", "<", "</a>", "text ", "<p>", "<p ", "<title>",
             "</title>", "<title x", "<!--", "-->", "<script>", "</script >", "<script ", "<head>", "</head>", "<html lang=de>",
             "<html ", "lang=fr ", "\n", "&amp;", "'", '"', "<!doctype html>", "é", "<style>a{}</style>", "/", "=", "  "]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(20_000)]
    pages += [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for page in pages:
        assert warc.visible_text(page) == plain_text(page)
        assert warc.metadata_fields(page, ["s"])[1:] == plain_fields(page)


def test_warc_query_against_plain_version(spark):
    """Every column of the result, also on nulls, repeats and clashing names."""
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    pages += [(None, None, None), (2 ** 53 + 1, "http://é", "<p>ä</p>"), (5, "", ""), (5, "", "")]
    df = spark.createDataFrame([(*p, "k", 1) for p in pages], "page_id bigint, url string, html string, kind string, block int")
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    want = collections.Counter()
    for i, url, page in pages:
        url, page = url or "", page or ""
        body = page.encode()
        block = b"\r\n".join([h.encode() for h in warc.HTTP] + [b"Content-Length: %d" % len(body), b"", body])
        source = warc.record_id(i, url, "response")
        fields = [("http-status", warc.HTTP[0])] + [("http-header", h) for h in (*warc.HTTP[1:], f"Content-Length: {len(body)}")]
        meta = "".join(f"{k}: {v}\r\n" for k, v in [*fields, *plain_fields(page), ("source-payload-digest", sha1(body))]).encode()
        text = plain_text(page).encode()
        for kind, ref, content_type, b, payload in (
                ("response", None, "application/http; msgtype=response", block, body),
                ("metadata", source, "application/warc-fields", meta, meta), ("conversion", source, "text/plain; charset=utf-8", text, text)):
            want[(i, kind, warc.record_id(i, url, kind), ref, url, content_type, sha1(b), sha1(payload), len(b),
                  hashlib.sha256(b).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in warc.query(df).collect()) == want


def test_foreign_warc_files(spark, tmpdir_path):
    """Binary blocks, one member or many, plain files, records without a length."""
    import os

    image = bytes(range(256)) * 9000
    def record(kind, block, length=True):
        return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{kind}>\r\n".encode()
                + (b"Content-Length: %d\r\n" % len(block) if length else b"") + b"\r\n" + block + b"\r\n\r\n")

    records = [record("warcinfo", b"software: x\r\n"), record("response", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n" + image),
               record("resource", b"no length\nsecond line", False), record("response", b"HTTP/1.1 200 OK\r\n\r\n<p>caf\xe9</p>")]
    want = [b"software: x\r\n", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n" + image, b"no length\nsecond line",
            b"HTTP/1.1 200 OK\r\n\r\n<p>caf\xe9</p>"]
    os.makedirs(f"{tmpdir_path}/in")
    for name, raw in (("one.warc.gz", gzip.compress(b"".join(records))), ("many.warc.gz", b"".join(map(gzip.compress, records))),
                      ("plain.warc", b"".join(records))):
        with open(f"{tmpdir_path}/in/{name}", "wb") as f:
            f.write(raw)
    back = warc.read_warc(spark, f"{tmpdir_path}/in")
    assert collections.Counter(bytes(r.block) for r in back.collect()) == collections.Counter(want * 3)
    assert back.where("kind = 'resource'").count() == 3
    texts = [bytes(r.block).decode() for r in warc.derive(back).where("kind = 'conversion'").collect()]
    assert texts.count("caf�") == 3


def test_written_records_are_members(spark, tmpdir_path):
    pages = spark.createDataFrame([(k, f"u{k}", f"<p>{k}</p>") for k in range(20)], "page_id bigint, url string, html string")
    records = warc.responses(pages.coalesce(2))
    warc.write_warc(records, f"{tmpdir_path}/out", records_per_file=7)
    import glob

    raw = [open(f, "rb").read() for f in glob.glob(f"{tmpdir_path}/out/*.warc.gz")]
    members = 0
    for data in raw:
        while data:
            member = zlib.decompressobj(31)
            out = member.decompress(data)
            assert not out or out.startswith(b"WARC/1.1\r\n") and out.endswith(b"\r\n\r\n")
            members += bool(out)
            data = member.unused_data
    assert members == 20 and len(raw) > 2
    assert records.exceptAll(warc.read_warc(spark, f"{tmpdir_path}/out")).count() == 0


# ---------------------------------------------------------------- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(v) <= 255 for v in m[0].split("."))
                    or kind == "card" and 16 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 8 <= len(d) <= 15):
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_query_against_plain_version(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, None), (5, ""), (5, ""), (2 ** 53 + 1, "a@b.cd, 10.0.0.1 é +49 170 1234567")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id bigint, text string, n_email int, rest string")
    listed = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    got = collections.defaultdict(list)
    for r in pii.query(df).collect():
        got[r.doc_id].append(r)
    order = list(PATTERNS)
    for i, text in rows:
        base = plain_spans(text or "")
        r = got[i].pop()
        if i == 5:
            continue                             # a text of the table shares this id
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in order)
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        every = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert every == sorted(every, key=lambda s: (order.index(s[0]), s[1], s[2])) and set(base) <= set(every)
        for _, a, b in set(every) - set(base):
            assert not any(a < y and b > x for _, x, y in base)
    assert not any(got.values())


def test_model_finds_spans_of_texts_it_has_not_seen(spark):
    """Held out: fitted on documents of even id, the model alone finds the spans in those of odd id."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.train(docs.where("doc_id % 2 = 0"))
    found = wanted = 0
    for r in docs.where("doc_id % 2 = 1").collect():
        base = plain_spans(r.text or "")
        x = pii.classes(r.text or "")
        tags = np.zeros(len(x), np.int8)
        starts = pii.window_starts(x)
        if not base or not len(starts):
            continue
        side = (pii.WINDOW - pii.STRIDE) // 2
        for s, t in zip(starts.tolist(), pii.viterbi(model, pii.cut(x, starts))):
            a, b = (0 if s == 0 else side), (pii.WINDOW if s + pii.WINDOW >= len(x) else pii.WINDOW - side)
            tags[s + a:s + b] = t[a:min(b, len(x) - s)]
        mine = {(a, b) for _, a, b in pii.spans_of_tags(r.text, tags)}
        wanted += len(base)
        found += sum((a, b) in mine for _, a, b in base)
    print(f"held out: {found} of {wanted}")
    assert wanted >= 20 and found >= 0.8 * wanted


def test_base_spans_keep_all_added_ones_out():
    base = [("email", 0, 72)] + [("ip", k, k + 7) for k in range(5, 65, 8)]
    assert pii._apart([("ip", 66, 72), ("ip", 71, 80), ("ip", 72, 80)], base) == [("ip", 72, 80)]


def test_windows_cover_whole_candidates():
    text = "x" * 100 + " " + "a" * 120 + "@" + "b" * 150 + ".org " + "plain words " * 20 + "+1 (" + " " * 200 + "2345678)"
    x = pii.classes(text)
    covered = np.zeros(len(x), bool)
    for s in pii.window_starts(x).tolist():
        covered[s:s + pii.WINDOW] = True
    at = text.index("@")
    assert covered[101:at + 155].all() and covered[text.index("+1 ("):].all() and not covered.all()


def test_windows_are_sampled_in_one_scan(spark, docs):
    having, without = pii.sample_windows(docs)
    assert 0 < len(having) <= pii.SAMPLE and 0 < len(without) <= pii.SAMPLE and not set(having) & set(without) - {""}
    again = pii.sample_windows(docs.repartition(7))
    assert (having, without) == again


# ---------------------------------------------------------------- pipeline, stage by stage

def as_rows(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=repr)


def sql_on(rows, statement):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    res = con.execute(statement)
    names = [c[0] for c in res.description]
    return [dict(zip(names, r)) for r in res.fetchall()]


def plain_components(rows, size, threshold):
    sets, root = {}, {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        k = min(size, len(w))
        sets[i], root[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set(), i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_pipeline_stages_against_plain_versions(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    made = [(10_000 + k, t) for k, t in enumerate([
        "", " ", "write to me: jo.doe@mail.example.org or +49 170 1234567 " + "words of a clean text go on here " * 20,
        "write to me: jo.doe@mail.example.org or +49 170 1234567 " + "words of a clean text go on here " * 20])]
    now = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(
        spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in made], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    rows = as_rows(now)

    after = land(stages["quality"](spark, now, SF), "t")
    kept = {r["doc_id"] for r in sql_on(rows, quality_rules.oracle_sql()) if r["kept"]}
    assert as_rows(after) == [r for r in rows if r[0] in kept]
    rows, now = as_rows(after), after

    after = land(stages["lines"](spark, now, SF), "t")
    want = {r["doc_id"]: r["kept_md5"] for r in sql_on(rows, line_dedup.oracle_sql())}
    assert {r.doc_id: hashlib.md5((r.text or "").encode()).hexdigest() for r in after.collect()} == want
    assert all(r.n_chars == len(r.text) for r in after.collect())
    rows, now = as_rows(after), after

    after = land(stages["near_duplicates"](spark, now, SF), "t")
    of = plain_components(rows, 5, 80)
    assert as_rows(after) == [r for r in rows if of[r[0]] == r[0]]
    rows, now = as_rows(after), after

    after = land(stages["personal_data"](spark, now, SF), "t")
    texts = dict(rows)
    assert {r.doc_id for r in after.collect()} == set(texts) and after.columns == now.columns
    for r in after.collect():
        assert not plain_spans(re.sub("<(email|ip|card|phone)>", "#", r.text)) or plain_spans(texts[r.doc_id])
        if not re.search("[0-9@]", texts[r.doc_id]):
            assert r.text == texts[r.doc_id]
        for kind, a, b in plain_spans(texts[r.doc_id]):
            assert kind != "email" or texts[r.doc_id][a:b] not in r.text
    rows, now = as_rows(after), after

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    got = collections.defaultdict(list)
    for r in stages["packing"](spark, now, SF).orderBy("doc_id", "start").collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for i, text in rows:
        ids = np.asarray(tok.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert [(s, n, zlib.crc32(ids[s:s + n].tobytes())) for s, n, _ in got[i]] == got[i] and sum(n for _, n, _ in got[i]) == len(ids)
    assert set(got) == {i for i, _ in rows}


def test_pipeline_on_odd_rows(spark, tmpdir_path):
    rows = [(1, None), (2, ""), (3, "  \n "), (None, "a b c d e f"), (None, None), (5, "x " * 3000), (5, "x " * 3000), (6, "other text here"),
            (2 ** 53 + 1, "a clean text of its own says this and that. " * 30), (None, "another clean text, with other words in it. " * 30)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                          "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmpdir_path}/documents.parquet")
    out = corpus_pipeline.run(spark, tmpdir_path).collect()
    assert {r.doc_id for r in out} <= {i for i, _ in rows}
