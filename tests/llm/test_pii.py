"""Personal data: the patterns against the plain expressions, the field by its likelihood, held-out rows and cases the patterns miss."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tracegrid.llm import pii

SF = "/root/testdata/sf0.001"
PLAIN = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 14 <= sum(c.isdigit() for c in s) <= 19 and pii.luhn(re.sub("[ -]", "", s))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 10 <= sum(c in "0123456789" for c in s) <= 15),
)


def plain(text):
    found = [(a, k, z) for k, (_, p, ok) in enumerate(PLAIN) for a, z in (m.span() for m in p.finditer(text)) if ok(text[a:z])]
    return [(pii.KINDS[k], a, z) for a, k, z in sorted(found)]


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(pii.labelled_rows(spark))


def test_patterns_are_the_plain_expressions():
    rng = random.Random(3)
    parts = ["a", "b.", "@", "1", "23", "4111111111111111", ".", " ", "-", "+", "(", "é", "\n", "255.1", "256", "5500000000000004 ", "+1 (017) 555-7713", "x@y.z", "1.2.3.4", "٣"]
    found = 0
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 18)))
        assert pii.base_spans(text) == plain(text), text
        found += len(plain(text))
    assert found > 10_000
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_likelihood_and_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    k, m = len(pii.LABELS), 6
    flat, counts = np.array([0, 1, 2, 3, 4, 5, 0], dtype=np.int32), np.array([2, 1, 2, 2], dtype=np.int8)
    w = rng.normal(size=m * k + k * k)
    ends, mask = np.array([0, 2, 3, 5, 7]), np.array([[True, True, True], [True, False, False]])
    gold = np.array([1, 2, 0, 3])
    value, grad = pii._likelihood(w, flat, ends, mask, gold, m, 0.1)
    weights, step = w[: m * k].reshape(m, k), w[m * k :].reshape(k, k) + pii._allowed()
    e = np.array([weights[flat[a:z]].sum(axis=0) for a, z in zip(ends, ends[1:])])

    def score(path, at):
        return sum(e[at + t, y] + step[path[t - 1] if t else 0, y] for t, y in enumerate(path))

    want = 0.05 * w @ w
    for at, n, own in ((0, 3, gold[:3]), (3, 1, gold[3:])):
        paths = list(itertools.product(range(k), repeat=n))
        all_ = np.array([score(p, at) for p in paths])
        want += np.log(np.exp(all_ - all_.max()).sum()) + all_.max() - score(tuple(own), at)
        f = pii.Field({str(i): i for i in range(m)}, np.vstack([weights, np.zeros(k)]), w[m * k :].reshape(k, k))
        got = f.decode([(flat[ends[at] : ends[at + n]], counts[at : at + n])])[0]
        assert tuple(got) == paths[all_.argmax()]
    assert abs(value - want) < 1e-9
    for i in rng.choice(len(w), 40, replace=False):
        d = np.zeros(len(w))
        d[i] = 1e-5
        slope = (pii._likelihood(w + d, flat, ends, mask, gold, m, 0.1)[0] - pii._likelihood(w - d, flat, ends, mask, gold, m, 0.1)[0]) / 2e-5
        assert abs(slope - grad[i]) < 1e-4


def test_held_out_rows(field):
    rows = pii.made_rows(600, seed=99)
    texts = [t for t, _ in rows]
    base = [pii.base_spans(t) for t in texts]
    more = pii.added(field, texts, base)
    free = lambda own, b: {x for x in own if not any(x[1] < z and a < x[2] for _, a, z in b)}
    want = [free(s, b) for (_, s), b in zip(rows, base)]
    hit = sum(len(w & set(m)) for w, m in zip(want, more))
    assert hit >= 0.9 * sum(map(len, want)) and hit >= 0.9 * sum(map(len, more)) and sum(map(len, want)) > 100


def test_what_the_patterns_miss(spark, field):
    a, b = "4111111111111111", "5500000000000004"
    cases = [
        (f"les {a} {b} et", [("card", 4, 20), ("card", 21, 37)]),
        ("call +1 (826) 555-4081 190.137.223.204 now", [("phone", 5, 22), ("ip", 23, 38)]),
        (f"no. 17 {a} x", [("card", 7, 23)]),
        ("Version 2.0, 12:30:11, 2024-11-05, CC BY-NC 4.0 and 1234567", []),
        ("plain words alone", []),
        ("", []),
        (None, []),
        ("token = \"3c4226790fc3f8022bcc4434e93601b2005f1325\"", []),
        ("x " * 20_000 + f"{a} {b}", [("card", 40_000, 40_016), ("card", 40_017, 40_033)]),
    ]
    schema = "doc_id long, `a.b` string, Spans int, text string, TEXT_ string"
    df = spark.createDataFrame([(i if i else None, "y", 7, t, "z") for i, (t, _) in enumerate(cases)], schema)
    got = pii.detect(df, field)
    assert got.columns == ["doc_id", "a.b", "text", "TEXT_", "spans"]
    rows = got.collect()
    for (text, want), r in zip(cases, sorted(rows, key=lambda r: r.doc_id or 0)):
        assert [(s.kind, s.start, s.end) for s in r.spans] == want, text
        assert r["a.b"] == "y"
    clean = {r.doc_id: r.text for r in pii.redact(df, field).collect()}
    assert clean[1] == "call <phone> <ip> now" and clean[6] is None and clean[4] == cases[4][0]
    assert pii.detect(df.where("false"), field).count() == 0
    none = pii.fit(pii.labelled_rows(spark).where("false"))
    assert [len(r.spans) for r in pii.detect(df.where("doc_id = 1"), none).collect()] == [1]


def test_query_columns(spark):
    texts = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in pii.op11_pii(spark, SF).collect()}
    assert len(got) == len(texts)
    for i, text in texts:
        want = plain(text)
        joined = [f"{k}:{a}:{z}" for k, a, z in want]
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in pii.KINDS]
        assert got[i].base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        every = got[i].spans.split(",") if got[i].spans else []
        assert set(joined) <= set(every) and len(every) - len(joined) == got[i].n_added
        assert every == sorted(every, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))
