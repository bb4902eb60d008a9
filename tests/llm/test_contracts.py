"""The columns that the queries return against brute force in plain Python, and rows and columns that a user's table may bring."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tracegrid.llm import byte_bpe, kneser_ney, mixing, near_dedup, quality_rules, token_output, url_filters, warc

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, `_stats` string, `a.b` string, `_copies` int, token_ids string, decoded string, stats string, copies int, copy int, text_key string, `Kept` string"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def clashing(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (None, " ".join(words)), (None, " ".join(words[:100])), (3, " ".join(words[60:] + words[:20])), (3, " ".join(words[60:] + words[:20])), (4, " ".join(words[::-1] * 400)), (5, None), (6, "")]
    return spark.createDataFrame([(i, t, None, "s", 1, "x", "y", 7, "t", "d", "st", 3, 4, "k", "q") for i, t in rows], CLASH)


def test_stages_keep_columns_of_any_name(spark):
    docs = clashing(spark)
    for stage, ids in ((quality_rules.stage, [None, None, 1, 2, 3, 3, 4]), (kneser_ney.stage, None), (near_dedup.stage, [None, None, 1, 3, 3, 4, 5, 6]), (mixing.stage, None)):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        rows = got.collect()
        assert all(r["a.b"] == "y" and r["_copies"] == 7 and r.copies == 3 for r in rows)
        if ids is not None and stage is near_dedup.stage:
            assert sorted((r.doc_id for r in rows), key=lambda x: (x is not None, x)) == ids
        assert sum(r.doc_id is None for r in rows) == 2
        assert stage(spark, docs.where("false"), SF).count() == 0
    got = {(r.doc_id, len(r.token_ids)) for r in byte_bpe.stage(spark, docs, SF).collect()}
    assert (5, 0) in got and (6, 0) in got and len(got) >= 6
    assert byte_bpe.encode(docs, *byte_bpe._tokenizer()).columns == [c for c in docs.columns if c != "token_ids"] + ["token_ids"]


def test_token_columns(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in token_output.op1_token_output(spark, SF).collect()}
    at = 0
    for i in sorted(texts):
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


@pytest.mark.parametrize("as_text", [False, True])
def test_special_tokens(as_text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = as_text
    e = token_output.encoder(P.path("byte_bpe_50k.json"), as_text)
    for x in ("a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|>b c <|endoftext|>"):
        ids = np.frombuffer(e.encode([x])[0], "<u4").tolist()
        assert ids == t.encode(x, add_special_tokens=False).ids and (50256 in ids) != as_text


def test_small_tables_have_a_dictionary(spark, tmp_path):
    token_output.write(spark.createDataFrame([(1, "one text"), (None, None)], "doc_id long, text string"), f"{tmp_path}/a", P.path("byte_bpe_50k.json"))
    rows = spark.read.parquet(f"{tmp_path}/a/dictionary").collect()
    assert len(rows) == 1 and len(rows[0].dictionary) >= 8
    assert [(r.doc_id, r.start, r.n_tokens) for r in token_output.read(spark, f"{tmp_path}/a").orderBy("start").collect()] == [(None, 0, 1), (1, 1, 3)]


def test_bpe_columns(spark, texts):
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.op8_byte_bpe(spark, SF).collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want


def test_archive_columns(spark):
    html = ["x", None, "x", "", "y", "x", "z", "z"]
    ids = [1, 2, 3, 4, 5, None, None, None]
    pages = spark.createDataFrame([(i, "http://h", h, "e") for i, h in zip(ids, html)], "page_id long, url string, html string, `a.b` string")
    pages.write.parquet(d := warc.new_path(spark, "pages-test"))
    query = warc.op3_warc.__globals__["table"]
    warc.op3_warc.__globals__["table"] = lambda s, *_: s.read.parquet(d)
    try:
        got = sorted((tuple(r) for r in warc.op3_warc(spark, "").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    finally:
        warc.op3_warc.__globals__["table"] = query
    want = []
    for i, h in zip(ids, html):
        raw = (h or "").encode()
        keeper = max((j for j, g in zip(ids, html) if j is not None and (g or "") == (h or "")), default=None)
        again = keeper is not None and keeper != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", keeper if again else None))
    assert got == sorted(want, key=repr)


def brute_rules(texts):
    words = re.findall(r"[^\x20\x09-\x0D]+", texts)
    seen, dup = set(), 0
    for line in texts.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", texts)), dup, len(inside)


def test_rule_columns(spark, texts):
    rows = quality_rules.op10_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed and r.rule is None)


def brute_kneser_ney(train, others, order=5):
    """Log probability of each byte and end of the texts, straight from the definitions."""
    grams = lambda t: [bytes(4) + t.encode() + b"\0"][0]
    counts = [collections.Counter() for _ in range(order + 1)]
    for t in train:
        g = grams(t)
        counts[order].update(g[i : i + order] for i in range(len(g) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    cuts, totals, mass = {}, {}, {}
    for k in range(1, order + 1):
        n = [sum(c == i for c in counts[k].values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
        cuts[k] = [0.5] * 3 if y is None else [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.05), j - 0.05) if n[j - 1] else 0.5 * j for j in (1, 2, 3)]
        totals[k], mass[k] = collections.Counter(), collections.Counter()
        for g, c in counts[k].items():
            totals[k][g[:-1]] += c
            mass[k][g[:-1]] += cuts[k][min(c, 3) - 1]

    def p(g):
        low = 1 / 256 if len(g) == 1 else p(g[1:])
        k, c, h = len(g), counts[len(g)][g], g[:-1]
        return low if not totals[k][h] else (c - (cuts[k][min(c, 3) - 1] if c else 0) + mass[k][h] * low) / totals[k][h]

    return [(len(t.encode()) + 1, sum(math.log(p(grams(t)[i : i + order])) for i in range(len(t.encode()) + 1))) for t in others]


@pytest.mark.parametrize("head", [0, 300, 1 << 19])
def test_perplexity(spark, texts, head):
    some = {i: t[:400] for i, t in list(sorted(texts.items()))[:40]}
    docs = spark.createDataFrame([(i, t, "en") for i, t in some.items()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in some], "doc_id long, quality int, toxic int")
    good = {r.doc_id: r.held_out for r in kneser_ney.trusted(labels).collect()}
    want = dict(zip(some, brute_kneser_ney([some[i] for i, h in good.items() if not h], some.values())))
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels, head_grams=head).collect()}
    assert len(got) == len(some)
    for i, r in got.items():
        assert r.events == want[i][0] and abs(math.log(r.perplexity) + want[i][1] / want[i][0]) < 1e-6
    assert all(r.kept == (r.perplexity <= r.threshold) for r in got.values())


def test_mined_rules(spark):
    """Every combination of tokens by brute force, against the mined rules before longer ones are dropped for shorter ones."""
    rng = np.random.default_rng(11)
    names = ["shop", "buy", "news", "en", "de", "x1", "x2", "deal"]
    rows, labels = [], []
    for i in range(240):
        some = [w for w, p in zip(names, (0.5, 0.4, 0.3, 0.5, 0.4, 0.3, 0.3, 0.3)) if rng.random() < p]
        bad = rng.random() < (0.8 if "buy" in some and "deal" in some else 0.2)
        rows.append((i, "http://" + "/".join([*some, *(["twin", "pair"] if i % 4 == 0 else [])])))
        labels.append((i, int(not bad), 0))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {tuple(r.antecedent): (round(r.support, 9), round(r.confidence, 9)) for r in url_filters.mine(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), min_support=0.03).collect()}
    sets = [set(re.findall(r"\w+", u)) for _, u in rows]
    bads = [q == 0 for _, q, _ in labels]
    n, share = len(sets), sum(bads) / len(bads)
    found = {}
    every = sorted(set().union(*sets) - {"twin", "pair"}) + ["twin+pair"]
    for mask in range(1, 1 << len(every)):
        a = frozenset(x for w, b in zip(every, bin(mask)[:1:-1]) if b == "1" for x in w.split("+"))
        hit = [b for s, b in zip(sets, bads) if a <= s]
        if sum(hit) >= max(0.03 * n, 5):
            c = sum(hit) / len(hit)
            if c >= share + max(0.1 * share, math.sqrt(share * (1 - share) / len(hit))):
                found[a] = (round(sum(hit) / n, 9), round(c, 9))
    items = lambda a: len(a - {"pair"})
    want = {tuple(sorted(a)): v for a, v in found.items() if not any(items(b) < items(a) and b <= a and found[b][1] >= v[1] - 1e-9 for b in found)}
    assert want and got == want


def test_mixing_is_the_nearest(spark):
    """Rates against a dense solver: the nearest nonnegative rates that meet the targets."""
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.3, 0.2], 150)
    t = rng.integers(1, 400, 150).astype(float)
    members = spark.createDataFrame([(i, int(n), *map(float, x)) for i, (n, x) in enumerate(zip(t, p))], "doc_id long, n_tokens long, high double, low double, toxic double")
    got = {r.doc_id: r.rate for r in mixing.fit_rates(members, {"high": 0.8, "low": 0.17, "toxic": 0.03}).collect()}
    a, goal = (p * t[:, None]).T, np.array([0.8, 0.17, 0.03]) * t.sum()
    e = np.zeros(3)
    for _ in range(200):  # Newton's method on the dual
        r = np.maximum(0, 1 - a.T @ e)
        free = r > 0
        e += np.linalg.lstsq(a[:, free] @ a[:, free].T, a @ r - goal, rcond=None)[0]
    want = np.maximum(0, 1 - a.T @ e)
    rates = np.array([got[i] for i in range(150)])
    assert rates.min() >= 0 and np.abs(a @ rates - goal).sum() < 1e-5 * t.sum()
    # The steps before the exact ones take a little of the way elsewhere.
    assert ((rates - 1) ** 2).sum() < 1.01 * ((want - 1) ** 2).sum()


def test_labels_that_tell_nothing(spark):
    lab = spark.createDataFrame([(1, None, 0), (2, None, None), (3, 1, None), (4, 0, 0), (5, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.domain) for r in mixing.labelled(lab, 100).collect()} == {(3, "high"), (4, "low"), (5, "toxic")}


def test_repeated_labelled_texts_learn_alike(spark):
    rows = [(i % 30, " ".join(f"w{(i * k) % 91}" for k in range(60 + i % 7)) + ("!" * (i % 3) * 40)) for i in range(90)]
    lab = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert quality_rules.fit(docs, lab) == quality_rules.fit(docs.orderBy(F.desc("text")).repartition(7), lab)


def test_tables_are_deleted(spark, texts):
    import os

    root = spark.conf.get("spark.checkpoint.dir") + "/tracegrid"
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    near_dedup.classes(docs).count()
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before} == {"dup-result"}
