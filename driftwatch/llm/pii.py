"""Personal data: fixed patterns, and a character-level bidirectional LSTM with a CRF.

``base_spans`` finds emails, IP addresses, card and phone numbers by pattern and check
(each character of a text is looked at a bounded number of times, also in very long runs).
``train`` fits, in numpy, a bidirectional LSTM over character classes with CRF transitions
between BIO tags.  Its labelled spans are the base spans of a bounded sample of windows of the
corpus (``SAMPLE`` windows with a span and as many without) and of ``MADE`` generated
numbers and addresses set into windows of the corpus.

Texts are cut into overlapping windows, decoded by Viterbi in batches, and reconciled: each character takes
its tag from the window it is most central in, and spans are read off the whole text's
tags.  A model's span is added if it has the form of its kind and doesn't overlap a base span.  By these
forms a span lies in a run of characters other than white space that has an at sign, or in a run of digits and
``().+-`` and blanks that has a digit; a window that meets no such run isn't decoded.

Defined results: null or empty text has no spans; repeated rows get equal rows; where two
spans of the model touch, both stay; an empty table gives no rows (and trains on generated
examples alone); extra columns are ignored by ``query`` and kept by ``redact``; texts of
any length are handled whole.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_landed, land

KINDS = ["email", "ip", "card", "phone"]
#: Characters a window, and from one window's start to the next's.
WINDOW, STRIDE = 64, 32
#: Windows of the corpus with and without a span that the model is fitted on, and generated ones a kind.
SAMPLE, MADE = 1200, 250
HIDDEN, EMBED, EPOCHS, BATCH, RATE = 16, 12, 5, 64, 0.02
#: Windows decoded at a time.
CHUNK = 1024

# ---------------------------------------------------------------- patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        # the longest run of local characters before the sign, but not into the match before
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _HINT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if m.end() - m.start() <= 37 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            n = sum(m[0].count(c) for c in "0123456789")
            if 8 <= n <= 15:
                out.append(("phone", *m.span()))
    return out


# ---------------------------------------------------------------- characters, tags, windows

#: Classes: padding, digit, lower, upper, other letter, space, anything else, then these one by one.
_SINGLE = "@.+-()_%,:;/#=\"'<>|&$*!?"
_CLASS = np.full(0x110000, 6, dtype=np.uint8)
_CLASS[0x80:] = 4
for _lo, _hi, _k in (("0", "9", 1), ("a", "z", 2), ("A", "Z", 3)):
    _CLASS[ord(_lo):ord(_hi) + 1] = _k
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
_CLASS[[ord(c) for c in _SINGLE]] = np.arange(7, 7 + len(_SINGLE))
N_CLASSES = 7 + len(_SINGLE)
#: Classes of the characters of numbers: digits, blanks, ``().+-``.
_IN_NUMBER = np.zeros(N_CLASSES, bool)
_IN_NUMBER[[1, 5, *(7 + _SINGLE.index(c) for c in "().+-")]] = True
N_TAGS = 1 + 2 * len(KINDS)                       # outside, then begin and inside of each kind


def classes(text: str) -> np.ndarray:
    return _CLASS[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]


def tags_of(n: int, spans) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[a], out[a + 1:b] = k, k + 1
    return out


def _runs_with(member: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Marks the maximal runs of ``member`` that hold a ``wanted`` place."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], member, [False]]).astype(np.int8)))
    first, end = edge[::2], edge[1::2]
    seen = np.concatenate([[0], np.cumsum(wanted)])
    held = seen[end] > seen[first]
    steps = np.zeros(len(member) + 1, dtype=np.int64)
    np.add.at(steps, first[held], 1)
    np.add.at(steps, end[held], -1)
    return np.cumsum(steps[:-1]) > 0


def possible(x: np.ndarray) -> np.ndarray:
    """Places of a text (its classes) where a span of some kind's form can be."""
    return _runs_with((x != 5) & (x != 0), x == 7) | _runs_with(_IN_NUMBER[x], x == 1)


def window_starts(x: np.ndarray) -> np.ndarray:
    """Starts of the windows that meet a place where a span can be."""
    n = max(1, -(-max(0, len(x) - WINDOW) // STRIDE) + 1)
    hit = np.zeros(len(x) + 1, dtype=np.int64)
    np.cumsum(possible(x), out=hit[1:])
    starts = np.arange(n) * STRIDE
    return starts[hit[np.minimum(starts + WINDOW, len(x))] > hit[np.minimum(starts, len(x))]]


def cut(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Windows as rows, padded with class 0 (or tag 0)."""
    padded = np.concatenate([x, np.zeros(WINDOW, x.dtype)])
    return padded[starts[:, None] + np.arange(WINDOW)[None, :]]


# ---------------------------------------------------------------- model

def new_model(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"emb": rng.normal(0, 0.3, (N_CLASSES, EMBED))}
    for d in "fb":
        p[f"wx{d}"] = rng.normal(0, EMBED ** -0.5, (EMBED, 4 * HIDDEN))
        p[f"wh{d}"] = rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 4 * HIDDEN))
        bias = np.zeros(4 * HIDDEN)
        bias[HIDDEN:2 * HIDDEN] = 1.0             # forget gates start open
        p[f"b{d}"] = bias
    p["wo"] = rng.normal(0, (2 * HIDDEN) ** -0.5, (2 * HIDDEN, N_TAGS))
    p["bo"] = np.zeros(N_TAGS)
    p["trans"] = np.zeros((N_TAGS, N_TAGS))
    p["start"] = np.zeros(N_TAGS)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


def _lstm(p, d, e, keep):
    """Hidden states (N, T, H) of one direction; with keep also what the backward pass needs."""
    n, t, _ = e.shape
    zx = e @ p[f"wx{d}"] + p[f"b{d}"]
    h = c = np.zeros((n, HIDDEN), np.float32)
    hs, saved = np.empty((n, t, HIDDEN), np.float32), []
    for k in range(t) if d == "f" else range(t - 1, -1, -1):
        z = zx[:, k] + h @ p[f"wh{d}"]
        gates = _sigmoid(z[:, :3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
        g = np.tanh(z[:, 3 * HIDDEN:])
        c_before, h_before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[:, k] = h
        if keep:
            saved.append((k, i, f, o, g, c_before, h_before, tc))
    return hs, saved


def _lstm_back(p, d, e, saved, dhs, grads):
    """Adds the gradients of one direction; returns that of its input."""
    n = e.shape[0]
    dz_all = np.empty((n, e.shape[1], 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for k, i, f, o, g, c_before, h_before, tc in reversed(saved):
        dh = dh + dhs[:, k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o),
                             dc * i * (1 - g * g)], axis=1)
        dz_all[:, k] = dz
        grads[f"wh{d}"] += h_before.T @ dz
        dh, dc = dz @ p[f"wh{d}"].T, dc * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    grads[f"wx{d}"] += e.reshape(-1, EMBED).T @ flat
    grads[f"b{d}"] += flat.sum(axis=0)
    return dz_all @ p[f"wx{d}"].T


def _lse(z, axis):
    m = z.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(z - m).sum(axis=axis))


def emissions(p, x):
    e = p["emb"][x]
    h = np.concatenate([_lstm(p, "f", e, False)[0], _lstm(p, "b", e, False)[0]], axis=2)
    return h @ p["wo"] + p["bo"]


def loss_and_grads(p, x, y):
    """Mean negative log-likelihood of the tag sequences, and its gradients."""
    n, t = x.shape
    e = p["emb"][x]
    hf, sf = _lstm(p, "f", e, True)
    hb, sb = _lstm(p, "b", e, True)
    h = np.concatenate([hf, hb], axis=2)
    em = (h @ p["wo"] + p["bo"]).astype(np.float64)
    trans, start = p["trans"].astype(np.float64), p["start"].astype(np.float64)
    # forward and backward sums over all tag sequences
    alpha, beta = np.empty((t, n, N_TAGS)), np.zeros((t, n, N_TAGS))
    alpha[0] = start + em[:, 0]
    for k in range(1, t):
        alpha[k] = _lse(alpha[k - 1][:, :, None] + trans, 1) + em[:, k]
    for k in range(t - 2, -1, -1):
        beta[k] = _lse(trans + (em[:, k + 1] + beta[k + 1])[:, None, :], 2)
    log_z = _lse(alpha[-1], 1)
    rows = np.arange(n)
    gold = start[y[:, 0]] + em[rows, 0, y[:, 0]]
    for k in range(1, t):
        gold = gold + trans[y[:, k - 1], y[:, k]] + em[rows, k, y[:, k]]
    d_em = np.exp(alpha + beta - log_z[None, :, None]).transpose(1, 0, 2)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    d_start = d_em[:, 0].sum(axis=0)
    d_trans = np.zeros((N_TAGS, N_TAGS))
    for k in range(1, t):
        d_trans += np.exp(alpha[k - 1][:, :, None] + trans + (em[:, k] + beta[k])[:, None, :] - log_z[:, None, None]).sum(axis=0)
    np.subtract.at(d_trans, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    np.subtract.at(d_start, y[:, 0], 1)
    d_em[rows[:, None], np.arange(t)[None, :], y] -= 1
    grads["trans"] += d_trans.astype(np.float32)
    grads["start"] += d_start.astype(np.float32)
    d_em = d_em.astype(np.float32)
    flat = d_em.reshape(-1, N_TAGS)
    grads["wo"] += h.reshape(-1, 2 * HIDDEN).T @ flat
    grads["bo"] += flat.sum(axis=0)
    dh = d_em @ p["wo"].T
    de = _lstm_back(p, "f", e, sf, dh[:, :, :HIDDEN], grads) + _lstm_back(p, "b", e, sb, dh[:, :, HIDDEN:], grads)
    np.add.at(grads["emb"], x.ravel(), de.reshape(-1, EMBED))
    return float((log_z - gold).mean()), {k: g / n for k, g in grads.items()}


def viterbi(p, x):
    """Best tag sequence of each window."""
    em = emissions(p, x)
    n, t, _ = em.shape
    back = np.empty((t, n, N_TAGS), dtype=np.int8)
    score = p["start"] + em[:, 0]
    for k in range(1, t):
        s = score[:, :, None] + p["trans"]
        back[k] = s.argmax(axis=1)
        score = s.max(axis=1) + em[:, k]
    out = np.empty((n, t), dtype=np.int8)
    out[:, -1] = score.argmax(axis=1)
    rows = np.arange(n)
    for k in range(t - 1, 0, -1):
        out[:, k - 1] = back[k][rows, out[:, k]]
    return out


def fit(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over shuffled batches; the same input gives the same model."""
    rng = np.random.default_rng(seed)
    p = new_model(rng)
    m, v, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(x), BATCH):
            mine = order[at:at + BATCH]
            _, grads = loss_and_grads(p, x[mine], y[mine])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return p


# ---------------------------------------------------------------- training windows

def _made(rng: np.random.Generator) -> list[tuple[str, str]]:
    """(kind, text) of generated personal data."""
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))
    pick = lambda *a: a[rng.integers(0, len(a))]
    out = []
    for _ in range(MADE):
        out.append(("email", f"{word()}{pick('', '.', '_', '-')}{pick(word(), num(2))}@{word()}{pick('', num(1))}."
                             f"{pick('', word() + '.')}{pick('com', 'org', 'net', 'de')}"))
        out.append(("ip", ".".join(str(k) for k in rng.integers(0, 256, 4))))
        body = num(15)
        card = next(body + c for c in "0123456789" if luhn(body + c))
        sep = pick("", " ", "-")
        out.append(("card", sep.join(card[k:k + 4] for k in range(0, 16, 4))))
        out.append(("phone", pick(f"+{pick('1', '44', '49', '33')} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(3)} {num(4)}",
                                  f"+1-{num(3)}-{num(3)}-{num(4)}", f"+{num(11)}")))
    return out


def sample_windows(docs: DataFrame) -> tuple[list[str], list[str]]:
    """Texts of windows (with their surroundings) with and without a base span: ``SAMPLE`` of each at
    most, those of least hash.  The table is read once; a task gives no more than its own ``SAMPLE`` of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        least: list[dict[tuple[int, str], None]] = [{}, {}]
        most = [2 ** 64, 2 ** 64]
        for b in batches:
            for text in b.column(0).to_pylist():
                if not text or not _HINT.search(text):
                    continue
                found = sorted((a, z) for _, a, z in base_spans(text))
                ends = np.maximum.accumulate([z for _, z in found]) if found else []
                begins = [a for a, _ in found]
                for s in window_starts(classes(text)).tolist():
                    k = bisect.bisect_left(begins, s + WINDOW)
                    has = k > 0 and bool(ends[k - 1] > s)
                    piece = text[max(0, s - STRIDE):s + WINDOW + STRIDE]
                    h = xxh64_intdigest(piece.encode("utf-8", "surrogatepass"), 42)
                    if h < most[has]:
                        least[has][h, piece] = None
                        if len(least[has]) >= 2 * SAMPLE:
                            least[has] = dict.fromkeys(sorted(least[has])[:SAMPLE])
                            most[has] = max(least[has])[0] + 1
        rows = [(has, h - 2 ** 63, piece) for has in (False, True) for h, piece in sorted(least[has])[:SAMPLE]]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.int64()),
                               pa.array([r[2] for r in rows], pa.string())], names=["has", "h", "piece"])

    pieces = land(docs.select("text").mapInArrow(run, "has boolean, h bigint, piece string"), "windows")
    take = lambda has: [r["piece"] for r in pieces.where(F.col("has") == has).select("h", "piece").distinct().orderBy(
        "h", "piece").limit(SAMPLE).collect()]
    out = take(True), take(False)
    drop_landed(pieces)
    return out


def training_set(having: list[str], without: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    examples = []
    for text in having + without:
        examples.append((text, base_spans(text)))
    around = without + having or [""]
    for kind, value in _made(rng):
        context = around[rng.integers(0, len(around))] or ""
        at = int(rng.integers(0, len(context) + 1))
        left, right = context[:at], context[at:]
        # set in between spaces or marks, so the border is one a pattern would see
        left, right = left + " ", str(rng.choice([" ", ". ", ", ", "\n"])) + right
        text = left + value + right
        mine = (kind, len(left), len(left) + len(value))
        others = [s for s in base_spans(text) if s[2] <= mine[1] or s[1] >= mine[2]]
        examples.append((text, [*others, mine]))
    xs, ys = [], []
    for text, spans in examples:
        x = classes(text)
        starts = window_starts(x)
        xs.append(cut(x, starts))
        ys.append(cut(tags_of(len(x), spans), starts))
    return np.concatenate(xs), np.concatenate(ys)


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    x, y = training_set(*sample_windows(docs))
    if len(x) > 6 * SAMPLE:
        keep = np.random.default_rng(3).permutation(len(x))[:6 * SAMPLE]
        x, y = x[keep], y[keep]
    return fit(x, y)


# ---------------------------------------------------------------- spans of whole texts

_FORM = {
    "email": lambda s: s.count("@") == 1 and "." in s.split("@")[1].strip(".") and not re.search(r"\s", s),
    "ip": lambda s: re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", s) is not None,
    "card": lambda s: re.fullmatch(r"[0-9][0-9 -]+[0-9]", s) is not None and 13 <= len(_digits(s)) <= 19 and luhn(_digits(s)),
    "phone": lambda s: re.fullmatch(r"\+?[0-9(][0-9 ().-]+[0-9]", s) is not None and 8 <= len(_digits(s)) <= 15,
}


def spans_of_tags(text: str, tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of a kind's form in a whole text's tags."""
    out, at = [], np.flatnonzero(tags)
    if not len(at):
        return out
    kind = (tags[at] - 1) // 2
    begins = tags[at] % 2 == 1
    new = np.concatenate([[True], (np.diff(at) > 1) | (kind[1:] != kind[:-1]) | begins[1:]])
    edges = np.flatnonzero(new)
    for i, j in zip(edges, np.append(edges[1:], len(at))):
        a, b, name = int(at[i]), int(at[j - 1]) + 1, KINDS[kind[i]]
        while a < b and text[a] in " \t\n.,;:":
            a += 1
        while b > a and text[b - 1] in " \t\n.,;:":
            b -= 1
        if _FORM[name](text[a:b]):
            out.append((name, a, b))
    return out


def find(texts: list[str], model: dict[str, np.ndarray]) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    xs = [classes(t) if _HINT.search(t) else None for t in texts]
    starts = [window_starts(x) if x is not None else None for x in xs]
    tags = [np.zeros(len(x), dtype=np.int8) if x is not None else None for x in xs]
    todo = [(k, s) for k, ss in enumerate(starts) if ss is not None for s in ss.tolist()]
    side = (WINDOW - STRIDE) // 2
    for at in range(0, len(todo), CHUNK):
        part = todo[at:at + CHUNK]
        best = viterbi(model, np.stack([_window(xs[k], s) for k, s in part]))
        for (k, s), t in zip(part, best):
            # the middle of each window; the first and the last one also have the text's ends
            a = 0 if s == 0 else side
            b = WINDOW if s + WINDOW >= len(xs[k]) else WINDOW - side
            tags[k][s + a:s + b] = t[a:min(b, len(xs[k]) - s)]
    out = []
    for text, t in zip(texts, tags):
        base = base_spans(text)
        added = []
        if t is not None and t.any():
            added = _apart(spans_of_tags(text, t), base)
        out.append((base, added))
    return out


def _apart(spans, base):
    """The spans that overlap no base span (these may overlap each other)."""
    taken = sorted((a, b) for _, a, b in base)
    begins = [a for a, _ in taken]
    ends = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    out = []
    for span in spans:
        k = bisect.bisect_left(begins, span[2])              # base spans that begin before its end
        if not k or ends[k - 1] <= span[1]:
            out.append(span)
    return out


def _window(x: np.ndarray, s: int) -> np.ndarray:
    w = x[s:s + WINDOW]
    return w if len(w) == WINDOW else np.concatenate([w, np.zeros(WINDOW - len(w), x.dtype)])


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def scan(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (base and added)."""
    model = model or train(docs)

    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for base, added in find([t or "" for t in b.column(1).to_pylist()], model):
                n = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((*n, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(base + added)))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64() if n.startswith("n_") else pa.string())
                                                  for n, c in zip(names, columns))], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string")


def masked(text: str, spans) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns) with personal data in ``text`` masked."""
    model = model or train(docs)

    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"), "text")
    schema = packed.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = find([t or "" for t in texts], model)
            new = [None if t is None else masked(t, base + added) for t, (base, added) in zip(texts, found)]
            yield pa.record_batch([b.column(0), pa.array(new, pa.string())], names=["rest", "text"])

    out = packed.mapInArrow(keep, schema)
    return out.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    return scan(docs)
