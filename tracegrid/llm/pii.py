"""Personal data: plain patterns, and a linear-chain conditional random field over word shapes that adds what they miss.

The patterns (`base_spans`) drop a match whose digits don't fit, as where a card number and another number stand side
by side or a phone number runs on into an address. The field reads such places token by token: runs of digits, runs of
letters and single symbols, each with its shape, its neighbours' shapes, the shape of the word it stands in and the words
before. It is trained on a small labelled table and decoded by Viterbi in NumPy batches inside the tasks.

A word without a digit, an @ or a + is outside any span by definition, but for up to 16 characters of blanks and symbols
between two words that have one. So a text falls into fragments and decoding them apart gives what decoding the whole text would: the label before and after is known. Spans of the field
must pass the same checks of their digits as those of the patterns, and those that overlap a span of the patterns go.

Defined cases: a null or empty text has no spans; rows without an id and repeated rows are scanned like any other; an empty
table gives an empty result; other columns stay whatever their names, but for one with the result's name, which it
replaces. An empty labelled table gives a field without weights, which adds nothing. Null texts and null spans of
labelled rows are ignored. Every pattern takes time in proportion to the text, however long its words are.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .byte_bpe import _slices, numbered, with_column
from .workspace import table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])

# The patterns, written so that no start is tried twice: runs are taken whole and matches begin where a run begins.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(int(d) * 2 - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def _ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _card(s: str) -> bool:
    digits = NOT_DIGIT.sub("", s)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _phone(s: str) -> bool:
    return 10 <= len(NOT_DIGIT.sub("", s)) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start and end (code points, exclusive) of the patterns' matches, by start and then kind."""
    out = [(0, *x) for x in emails(text)]
    for kind, pattern, ok in ((1, IP, _ip), (2, CARD, _card), (3, PHONE, _phone)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if ok(m.group())]
    return [(KINDS[k], a, z) for k, a, z in sorted(out, key=lambda x: (x[1], x[0], x[2]))]


def passes(kind: str, s: str) -> bool:
    """Whether a span that the field gives is what its kind allows."""
    if kind == "email":
        return s.count("@") == 1 and emails(s) == [(0, len(s))]
    if kind == "ip":
        return bool(IP.fullmatch(s)) and _ip(s)
    return _card(s) if kind == "card" else _phone(s)


LIVE = re.compile(r"[0-9@+][^\x20\x09-\x0D]*")
BETWEEN = re.compile(r"[\W_]*")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\x20\x09-\x0D]|\w")
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
GAP = 16


def fragments(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of words with a digit, an @ or a +, with at most GAP characters, blanks and symbols alone, between them."""
    start = end = -1
    at = 0
    while m := LIVE.search(text, at):
        at = m.end()
        first = max(end, 0, 1 + max(text.rfind(c, max(end, 0), m.start()) for c in WHITE))
        if start >= 0 and first - end <= GAP and BETWEEN.match(text, end, first).end() == first:
            end = at
            continue
        if start >= 0:
            yield start, end
        start, end = first, at
    if start >= 0:
        yield start, end


def _shape(t: str) -> str:
    if t.isascii() and t.isdigit():
        return f"d{min(len(t), 20)}" + ("s" if len(t) <= 3 and int(t) <= 255 else "")
    if t.isalpha():
        return ("A" if t[0].isupper() else "a") + str(min(len(t), 4))
    return t if t.isascii() else "?"


RUNS = re.compile(r"(d+|a+|(.)\2+)", re.S)


def word_shape(word: str) -> str:
    """Digits as d, letters as a, symbols as they are, runs once; the first 24."""
    marks = "".join("d" if "0" <= c <= "9" else "a" if c.isalpha() else c for c in word[:200])
    return RUNS.sub(lambda m: m.group()[0], marks)[:24]


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text, start, end)]


def features(text: str, spans: list[tuple[int, int]]) -> Iterator[list[str]]:
    """What tells each token of a fragment from others."""
    n = len(spans)
    shapes = [_shape(text[a:z]) for a, z in spans]
    joined = ["+" if i and spans[i - 1][1] == a else "_" for i, (a, _) in enumerate(spans)]
    starts = [i for i in range(n) if joined[i] == "_"]
    words = [word_shape(text[spans[i][0] : spans[j - 1][1]]) for i, j in zip(starts, [*starts[1:], n])]
    before = text[max(0, spans[0][0] - 40) : spans[0][0]].split()[-1:] if n else []
    cue = "c:" + before[0].lower().strip(":=\"'(") if before and len(before[0]) < 24 else "c:"
    k = -1
    for i in range(n):
        k += joined[i] == "_"
        p1, n1 = (joined[i] + shapes[i - 1]) if i else "^", (joined[i + 1] + shapes[i + 1]) if i + 1 < n else "$"
        p2, n2 = (joined[i - 1] + shapes[i - 2]) if i > 1 else "^", (joined[i + 2] + shapes[i + 2]) if i + 2 < n else "$"
        yield [
            f"0:{shapes[i]}", f"w:{words[k]}", f"w0:{words[k]}|{shapes[i]}|{joined[i]}", f"w-:{words[k - 1] if k else '^'}|{joined[i]}", f"w+:{words[k + 1] if k + 1 < len(words) else '$'}|{shapes[i]}",
            f"-1:{p1}", f"+1:{n1}", f"-10:{p1}|{shapes[i]}", f"0+1:{shapes[i]}|{n1}", f"-2:{p2}|{p1}", f"+2:{n1}|{n2}", f"-1+1:{p1}|{n1}", f"{cue}|{min(i, 3)}",
        ]


FORBIDDEN = -1e4


def _allowed() -> np.ndarray:
    """0 where a label may follow another, else FORBIDDEN: the inside of a kind follows its beginning or inside."""
    ok = np.zeros((len(LABELS), len(LABELS)))
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            ok[[i for i, a in enumerate(LABELS) if a[2:] != b[2:] or a == "O"], j] = FORBIDDEN
    return ok


@dataclass
class Field:
    """Weights of features by label and of one label after another."""

    features: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray

    def ids(self, rows: Iterator[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The known features of a sequence one token after the other, and how many each token has (one at least: the last counts nothing)."""
        known, last = self.features.get, len(self.features)
        flat, counts = array("i"), array("b")
        for row in rows:
            own = [i for f in row if (i := known(f)) is not None] or [last]
            flat.extend(own)
            counts.append(len(own))
        return np.frombuffer(flat, dtype=np.int32), np.frombuffer(counts, dtype=np.int8)

    def scores(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The score of each label for each token; features that weren't trained count nothing."""
        ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        out = np.zeros((len(counts), len(LABELS)))
        for lo in range(0, len(counts), 8192):
            hi = min(lo + 8192, len(counts))
            out[lo:hi] = np.add.reduceat(self.weights[flat[ends[lo] : ends[hi]]], ends[lo:hi] - ends[lo], axis=0)
        return out

    def decode(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The best labels of each sequence, in batches of like length."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(rows)
        size = [len(counts) for _, counts in rows]
        order = sorted((i for i in range(len(rows)) if size[i]), key=lambda i: size[i])
        step, at = self.steps + _allowed(), 0
        while at < len(order):
            longest, stop = size[order[at]] + 4, at
            while stop < len(order) and (stop == at or size[order[stop]] <= longest and (stop - at + 1) * longest <= 32_768):
                stop += 1
            own, at = order[at:stop], stop
            n = np.array([size[i] for i in own])
            e = np.zeros((len(own), n.max(), len(LABELS)))
            e[np.arange(n.max()) < n[:, None]] = self.scores(np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own]))
            for i, labels in zip(own, _viterbi(e, n, step)):
                out[i] = labels
        return out


def _viterbi(e: np.ndarray, n: np.ndarray, step: np.ndarray) -> list[np.ndarray]:
    count, length, _ = e.shape
    back = np.zeros(e.shape, dtype=np.int8)
    best = e[:, 0] + step[0]  # what stands before is outside
    for t in range(1, length):
        ways = best[:, :, None] + step
        back[:, t] = ways.argmax(axis=1)
        best = np.where((t < n)[:, None], np.take_along_axis(ways, back[:, t][:, None, :].astype(np.int64), axis=1)[:, 0] + e[:, t], best)
    labels = np.zeros((count, length), dtype=np.int8)
    here = best.argmax(axis=1).astype(np.int8)
    rows = np.arange(count)
    for t in range(length - 1, -1, -1):
        labels[:, t] = np.where(t < n, here, 0)
        here = np.where(t < n, back[rows, t, here], here) if t else here
    return [labels[i, :k] for i, k in enumerate(n.tolist())]


def _likelihood(w: np.ndarray, flat: np.ndarray, ends: np.ndarray, mask: np.ndarray, gold: np.ndarray, m: int, l2: float) -> tuple[float, np.ndarray]:
    """Minus the log likelihood of the gold labels with its gradient, by forward and backward sums over all sequences at once."""
    k = len(LABELS)
    weights, step = w[: m * k].reshape(m, k), w[m * k :].reshape(k, k) + _allowed()
    e = np.zeros((*mask.shape, k))
    e[mask] = np.add.reduceat(weights[flat], ends[:-1], axis=0)
    n = mask.sum(axis=1)
    rows, length = np.arange(len(n)), mask.shape[1]

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    open_at = mask.sum(axis=0)  # sequences come longest first: those that reach step t are the first so many
    ahead, behind = np.zeros(e.shape), np.zeros(e.shape)
    ahead[:, 0] = e[:, 0] + step[0]
    for t in range(1, length):
        c = open_at[t]
        ahead[:c, t] = total(ahead[:c, t - 1, :, None] + step, 1) + e[:c, t]
    z = total(ahead[rows, n - 1], 1)
    pairs = np.zeros((k, k))
    for t in range(length - 1, 0, -1):
        c = open_at[t]
        inner = e[:c, t] + behind[:c, t]
        pairs += np.exp(ahead[:c, t - 1, :, None] + step + inner[:, None, :] - z[:c, None, None]).sum(axis=0)
        behind[:c, t - 1] = total(step[None] + inner[:, None, :], 2)
    one = np.exp(ahead + behind - z[:, None, None])[mask]
    pairs[0] += np.exp(ahead[:, 0] + behind[:, 0] - z[:, None]).sum(axis=0)
    path = np.zeros(mask.shape, dtype=np.int64)
    path[mask] = gold
    before = np.concatenate([np.zeros((len(n), 1), dtype=np.int64), path[:, :-1]], axis=1)
    score = e[mask][np.arange(len(gold)), gold].sum() + step[before[mask], gold].sum()
    one[np.arange(len(gold)), gold] -= 1
    np.subtract.at(pairs, (before[mask], gold), 1)
    each = np.repeat(np.arange(len(gold)), np.diff(ends))
    grad = np.stack([np.bincount(flat, weights=one[each, j], minlength=m) for j in range(k)], axis=1)
    return z.sum() - score + l2 / 2 * (w @ w), np.concatenate([grad.ravel(), pairs.ravel()]) + l2 * w


def _lbfgs(f, w: np.ndarray, turns: int, memory: int = 8) -> np.ndarray:
    value, grad = f(w)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(turns):
        d, parts = -grad, []
        for s, y in reversed(kept):
            a = (s @ d) / (s @ y)
            parts.append(a)
            d = d - a * y
        if kept:
            s, y = kept[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(kept, reversed(parts)):
            d = d + (a - (y @ d) / (s @ y)) * s
        size = 1.0 if kept else 1 / max(1.0, np.abs(grad).sum())
        while True:
            new = w + size * d
            v, g = f(new)
            if v <= value + 1e-4 * size * (grad @ d) or size < 1e-10:
                break
            size /= 2
        s, y, done = new - w, g - grad, value - v < 1e-6 * max(1.0, abs(v))
        w, value, grad = new, v, g
        if s @ y > 1e-12:
            kept = [*kept[-memory + 1 :], (s, y)]
        if done:
            break
    return w


def fit(labelled: DataFrame, *, max_rows: int = 2000, l2: float = 0.05, turns: int = 40) -> Field:
    """A field trained on at most max_rows rows of text and spans (an array of kind, start, end): a small labelled table by
    definition; of a larger one the rows with the least hash are taken."""
    from pyspark.sql import functions as F

    rows = labelled.where("text is not null").select("text", "spans").orderBy(F.xxhash64("text"), "text").limit(max_rows).collect()
    sequences = []
    for r in rows:
        wanted = {(x.kind, x.start, x.end) for x in r.spans or [] if x.kind in KINDS}
        for a, z in fragments(r.text):
            spans = tokens(r.text, a, z)
            own = []
            for i, j in spans:
                kind = next(((k, s) for k, s, e in wanted if s <= i and j <= e), None)
                own.append(0 if kind is None else LABELS.index(f"{'B' if i == kind[1] else 'I'}-{kind[0]}"))
            for t, label in enumerate(own):  # a span whose beginning isn't a token's begins with its first token
                if LABELS[label][0] == "I" and (t == 0 or LABELS[own[t - 1]][2:] != LABELS[label][2:]):
                    own[t] -= 1
            sequences.append((list(features(r.text, spans)), own))
    sequences.sort(key=lambda x: -len(x[1]))
    gold = np.array([label for _, own in sequences for label in own])
    sequences = [rows for rows, _ in sequences]
    names: dict[str, int] = {}
    for f in (f for s in sequences for row in s for f in row):
        names.setdefault(f, len(names))
    m, k = len(names), len(LABELS)
    if not sequences:
        return Field(names, np.zeros((1, k)), np.zeros((k, k)))
    flat = np.array([names[f] for s in sequences for row in s for f in row])
    ends = np.cumsum([0, *(len(row) for s in sequences for row in s)])
    mask = np.arange(max(map(len, sequences))) < np.array([len(s) for s in sequences])[:, None]
    w = _lbfgs(lambda w: _likelihood(w, flat, ends, mask, gold, m, l2), np.zeros(m * k + k * k), turns)
    return Field(names, np.vstack([w[: m * k].reshape(m, k), np.zeros(k)]), w[m * k :].reshape(k, k))


def added(field: Field, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """The field's spans of each text that pass their kind's check and overlap none of base."""
    places, rows, of = [], [], []
    for t, text in enumerate(texts):
        for a, z in fragments(text):
            spans = tokens(text, a, z)
            places.append(spans)
            rows.append(field.ids(features(text, spans)))
            of.append(t)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for t, spans, labels in zip(of, places, field.decode(rows)):
        i = 0
        while i < len(labels):
            if not labels[i]:
                i += 1
                continue
            j = i + 1
            while j < len(labels) and labels[j] == labels[i] + 1:
                j += 1
            kind, a, z = LABELS[labels[i]][2:], spans[i][0], spans[j - 1][1]
            if passes(kind, texts[t][a:z]):
                out[t].append((kind, a, z))
            i = j
    for t, own in enumerate(out):
        taken = sorted((a, z) for _, a, z in base[t])
        starts, reach = [a for a, _ in taken], np.maximum.accumulate([z for _, z in taken]) if taken else []
        out[t] = [(k, a, z) for k, a, z in own if (n := np.searchsorted(starts, z)) == 0 or reach[n - 1] <= a]
    return out


def detect(docs: DataFrame, field: Field, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """docs with all its columns and spans_col: kind, start and end in code points (end exclusive) and whether a pattern gave it,
    by start and then kind, of every whole text."""
    schema, keep = with_column(docs, spans_col, T.ArrayType(SPAN))
    text = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in _slices(batch, text=text):
                texts = [x or "" for x in part.column(text).to_pylist()]
                base = [base_spans(x) for x in texts]
                more = added(field, texts, base)
                rows = [sorted([(k, a, z, True) for k, a, z in b] + [(k, a, z, False) for k, a, z in m], key=lambda x: (x[1], KINDS.index(x[0]), x[2])) for b, m in zip(base, more)]
                flat = [x for r in rows for x in r]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.bool_()]
                struct = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], kinds[i]) for i in range(4)], SPAN.names)
                ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.ListArray.from_arrays(ends, struct)], schema.names)

    return numbered(docs).mapInArrow(run, schema)


def redact(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs with each span of its texts replaced by its kind in angle brackets; of spans that overlap, the first stays and the
    rest of the others goes with it."""
    schema, keep = with_column(docs, text_col, T.StringType())
    text = docs.columns.index(text_col)

    def clean(x: str, spans: list[tuple[str, int, int]]) -> str:
        out, at = [], 0
        for kind, a, z in spans:
            if a >= at:
                out += [x[at:a], f"<{kind}>"]
            at = max(at, z)
        return "".join([*out, x[at:]])

    def run(batches):
        for batch in batches:
            for part in _slices(batch, text=text):
                texts = part.column(text).to_pylist()
                base = [base_spans(x or "") for x in texts]
                more = added(field, [x or "" for x in texts], base)
                got = [None if x is None else clean(x, sorted(b + m, key=lambda s: s[1])) for x, b, m in zip(texts, base, more)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), pa.array(got, pa.string())], schema.names)

    return numbered(docs).mapInArrow(run, schema)


def made_rows(n: int = 300, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """n labelled texts by rule: personal data of the four kinds and numbers that are none, among words or side by side."""
    rng = np.random.default_rng(seed)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(pick(*"aeioulnrst") for _ in range(rng.integers(2, 9)))

    def card() -> str:
        body = digits(rng.integers(13, 19)) if rng.random() < 0.2 else digits(15)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        sep = pick("", "", "", " ", "-") if len(full) == 16 else ""
        return sep.join(full[i : i + 4] for i in range(0, 16, 4)) if sep else full

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+1 {a}.{b}.{c}", f"+{digits(2)}{a}{b}{c}", f"({a}) {b}-{c}")

    def email() -> str:
        host = pick(f"mail{digits(1)}.example.com", f"{word()}.org", f"{word()}-{word()}.co.uk", f"{word()}.net")
        return pick(f"{word()}.{digits(2)}", f"{word()}.{word()}", word(), f"{word()}_{word()}", f"{word()}+{word()}") + "@" + host

    def ip() -> str:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))

    def other() -> str:
        return pick(
            lambda: digits(rng.integers(1, 13)), lambda: digits(rng.integers(20, 40)), lambda: f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", lambda: f"{rng.integers(10, 24)}:{rng.integers(10, 60)}:{rng.integers(10, 60)}",
            lambda: f"{digits(1)}.{digits(2)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"${digits(3)},{digits(3)}.{digits(2)}", lambda: f"{digits(2)}%", lambda: "token = \"" + "".join(pick(*"0123456789abcdef") for _ in range(40)) + '"',
            lambda: f"@{word()}", lambda: f"{digits(2)} + {digits(2)}", lambda: f"+{digits(2)}%", lambda: f"https://{word()}.org/{word()}/{digits(3)}?id={digits(5)}", lambda: f"({digits(4)})", lambda: f"{digits(3)}-{digits(2)}", lambda: "Version 2.0", lambda: "CC BY-NC 4.0", lambda: f"{digits(3)} {digits(3)} {digits(2)}", lambda: f"ISBN 978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", lambda: f"{digits(2)}@{digits(1)}",
        )()

    rows = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(1, 5)):
            text += " ".join(word() for _ in range(rng.integers(0, 4)))
            text += pick(" ", " ", ": ", " (", "\n", "") if text and rng.random() < 0.8 else " " * bool(text)
            if text and text[-1] not in " (\n":
                text += " "
            for _ in range(pick(1, 1, 1, 2, 2, 3)):
                kind = pick("email", "ip", "card", "card", "phone", "phone", None, None, None)
                item = {"email": email, "ip": ip, "card": card, "phone": phone, None: other}[kind]()
                if kind:
                    spans.append((kind, len(text), len(text) + len(item)))
                text += item + pick(" ", " ", " ", " ", ", ", " | ", "$$$ ", "%%% ", "!! ", "; ")
        rows.append((text + pick("", ".", word()), spans))
    return rows


def labelled_rows(spark: SparkSession, n: int = 300) -> DataFrame:
    return spark.createDataFrame(made_rows(n), "text string, spans array<struct<kind: string, start: int, end: int>>")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the patterns' counts and the digest of their spans, all spans, and how many the field added."""
    field = fit(labelled_rows(spark))
    docs = detect(table(spark, sf_dir, "documents").select("doc_id", "text"), field)

    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            base = [[x for x in r if x["base"]] for r in rows]
            joined = [",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in r) for r in rows]
            only = [",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in r) for r in base]
            counts = [pa.array([sum(x["kind"] == k for x in r) for r in base], pa.int64()) for k in KINDS]
            digests = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in only])
            more = pa.array([len(r) - len(b) for r, b in zip(rows, base)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array(joined, pa.string()), more], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "spans").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
