"""The training-data operators against brute force, round trips and their defined cases."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tracegrid.llm import byte_bpe, kneser_ney, license_scan, mixing, mpeg_audio, near_dedup, quality_rules, token_output, url_filters, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string"
LONG = "word other third " * 4000
TEXTS = [None, "", " \n\t", "one", "one two three four", "ONE two\tthree four", "a  b\n c 's 'll é ß 東京 😀", LONG, "x" * 5000, "same text of some words here", "same text of some words here"]
BASE = " ".join(f"w{i}" for i in range(120))
NEAR = " ".join("changed" if i == 60 else f"w{i}" for i in range(120))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", 0, "x") for i, t in enumerate([*TEXTS, BASE, NEAR])]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 0), (7, 0, 0), (11, 1, None), (None, 1, 0), (8, None, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")


def empty(spark):
    return spark.createDataFrame([], DOC), spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_bpe_round_trip(spark, docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.decode(byte_bpe.encode(docs, path, P.PATTERN), path, P.PATTERN).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert list(r.token_ids) == enc.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode(empty(spark)[0], path, P.PATTERN).count() == 0


def test_bpe_joins_are_exact():
    b = byte_bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    text = ("ab 'rea\n\n  x" * 700) + "y" * 3000
    cuts = [1, 7, 500, 4096, len(text) - 1]
    assert all(b.join(text[:c], b.encode(text[:c]), text[c:], b.encode(text[c:])) == b.encode(text) == b.plain(text) for c in cuts)


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    token_output.write(docs, f"{tmp_path}/a", P.path("byte_bpe_50k.json"))
    at = 0
    for r in token_output.read(spark, f"{tmp_path}/a").orderBy("doc_id").collect():
        ids = [*t.encode([*TEXTS, BASE, NEAR][r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, np.frombuffer(r.ids_le32, "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)
    one = token_output.read(spark, f"{tmp_path}/a", only=[7]).collect()
    assert [r.doc_id for r in one] == [7]
    token_output.write(empty(spark)[0], f"{tmp_path}/b", P.path("byte_bpe_50k.json"))
    assert token_output.read(spark, f"{tmp_path}/b").count() == 0


def test_url_rules_and_mined_rules(spark):
    urls = ["http://A.Example.NET/en/1?x", "http://x.example.net/fr/", "https://example.com/de/1", "http://org/fr/a#b", "notnet://notnet/", None, "no url", "http://n.net"]
    pages = spark.createDataFrame([*enumerate(urls), *((100 + i, f"http://spam.host.example/{i % 7}/{'buy' if i % 2 else 'read'}") for i in range(200))], "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, 1 - i % 2, 0) for i in range(160)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_filters.judge(pages, labels).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(8)] == [("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert (got[0].host, got[0].path, got[5].host, got[5].path) == ("a.example.net", "/en/1", "", "")
    assert all(got[100 + i].verdict == ("block" if i % 2 else "allow") for i in range(200))
    assert url_filters.judge(pages, labels.where("false")).where("confidence is not null").count() == 0


def test_warc_rejects_magic_in_payloads(spark, tmp_path):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = [None, "", "hello", "hello", f"<p>{fake}</p>", f"{fake}", "WARC/1.0\r\n", "é" * 3000]
    pages = spark.createDataFrame([(i, f"http://h/{i}", h, "extra") for i, h in enumerate(html)], "page_id long, url string, html string, kept string")
    warc.write(pages, f"{tmp_path}/w")
    got = warc.read(spark, f"{tmp_path}/w").select(warc.field("WARC-Record-ID").alias("id"), warc.field("WARC-Type").alias("kind"), warc.field("WARC-Refers-To").alias("to"), "payload").collect()
    assert len(got) == len(html)
    for r in got:
        i = int(re.search(r"\d+", r.id)[0])
        same = max(j for j, h in enumerate(html) if (h or "") == (html[i] or ""))
        assert r.kind == ("response" if same == i else "revisit")
        assert bytes(r.payload) == ((html[i] or "").encode() if same == i else b"")
        assert r.to == ("" if same == i else f"<urn:page:{same}>")


def test_mpeg_audio(spark, docs):
    got = mpeg_audio.decode(mpeg_audio.encode(docs)).collect()
    for r in got:
        raw = mpeg_audio.pad(([*TEXTS, BASE, NEAR][r.doc_id] or "").encode())
        assert bytes(r.payload) == raw and r.bad_checksums == 0 and r.skipped_bytes == 0
        assert r.vbr_frames == r.n_frames and r.n_samples == 1152 * r.n_frames
    whole = mpeg_audio.write(b"z" * 9000)
    noisy = b"junk\xff\xfa" + whole + b"tail"
    s = mpeg_audio.parse(noisy)
    assert mpeg_audio.payload(s) == b"z" * 9000 and s.skipped == 10
    hurt = bytearray(whole)
    hurt[mpeg_audio.parse(whole).offsets[1] + 8] ^= 1
    assert mpeg_audio.parse(bytes(hurt)).bad_checksums == 1
    assert mpeg_audio.parse(b"").samples == 0


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    return [len(s) for s in sets], label


@pytest.mark.parametrize("n", [4, 5])
def test_near_dedup(spark, docs, n):
    texts = [*TEXTS, BASE, NEAR]
    sizes, label = brute_components(texts, n, 80)
    got = {r.doc_id: r for r in near_dedup.classes(docs, n=n).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(s, c, c == i) for i, (s, c) in enumerate(zip(sizes, label))]
    assert near_dedup.classes(empty(spark)[0]).count() == 0


def test_near_dedup_group(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(80):
        w = list(words)
        for i in rng.integers(0, 200, rng.integers(0, 6)):
            w[i] = f"n{rng.integers(0, 1000)}"
        texts.append(" ".join(w))
    _, label = brute_components(texts, 4, 80)
    got = {r.doc_id: r.component_id for r in near_dedup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n=4).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_quality_statistics():
    t = "a b c a b c d\nx #\nx #\n\nq"
    n, chars, symbols, dup, repeats = quality_rules.statistics(t)[:5]
    assert (n, chars, symbols, dup, repeats) == (12, 12, 2, 1, 6)
    assert quality_rules.statistics(None)[:5] == (0, 0, 0, 0, 0)


def test_decision_lists(spark, labels):
    good = [(i, " ".join(f"word{(i * 7 + k * 13) % 997}" for k in range(80)), "en", "s", 0, "x") for i in range(120)]
    bad = [(1000 + i, " ".join(f"LOUD{(i * 5 + k * 11) % 997}!!" for k in range(80)), "en", "s", 0, "x") for i in range(60)]
    docs = spark.createDataFrame(good + bad, DOC)
    lab = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in good[:80] + bad[:40]], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs, lab)
    assert got.where("doc_id < 1000 and not kept").count() == 0 and got.where("doc_id >= 1000 and kept").count() == 0
    e = empty(spark)
    assert quality_rules.judge(*e).count() == 0
    assert quality_rules.judge(docs, e[1]).where("kept").count() == 180


def test_kneser_ney_sums_to_one(spark, docs, labels):
    grams = spark.createDataFrame([(int.from_bytes(b"abcd" + bytes([w]), "big"), c) for w, c in [*((97 + i, i % 5) for i in range(256 - 97)), *((i, 0) for i in range(97))]] + [(int.from_bytes(b"zbcda", "big"), 2)], "g long, c long")
    total = kneser_ney.probabilities(grams).where(F.shiftright("g", 8) == int.from_bytes(b"abcd", "big")).agg(F.sum(F.exp("lp"))).first()[0]
    assert abs(total - 1) < 1e-9
    one = {r.doc_id: r.perplexity for r in kneser_ney.classify(docs, labels).collect()}
    few = {r.doc_id: r.perplexity for r in kneser_ney.classify(docs, labels, head_grams=40).collect()}
    none = {r.doc_id: r.perplexity for r in kneser_ney.classify(docs, labels, head_grams=0).collect()}
    assert len(one) == len(TEXTS) + 2 and one == few == none
    assert kneser_ney.classify(*empty(spark)).count() == 0


def test_mixing_meets_targets(spark):
    rows = [(i, " ".join(f"{'ab'[i % 2]}{(i + k) % 50}" for k in range(60)), "en", "s", 0, "x") for i in range(200)]
    docs = spark.createDataFrame(rows, DOC)
    lab = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, lab, {"high": 0.7, "low": 0.3, "toxic": 0.0})
    s = got.agg(F.sum("n_tokens").alias("n"), *(F.sum(F.col("rate") * F.col("n_tokens") * F.col(d)).alias(d) for d in mixing.DOMAINS)).first()
    assert abs(s.high / s.n - 0.7) < 1e-3 and abs(s.low / s.n - 0.3) < 1e-3
    assert got.where("rate < 0").count() == 0
    assert mixing.mix(*empty(spark)).count() == 0


def test_mixing_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    kinds = labels.groupBy("doc_id").agg((F.coalesce(F.min("quality") == 1, F.lit(False)) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("clean"), F.max("quality").alias("q"))
    # As after the filters: no document labelled low is left.
    filtered = docs.join(kinds.where("q = 0").select("doc_id"), "doc_id", "left_anti")
    clean = filtered.join(kinds.where("clean").select("doc_id"), "doc_id", "left_semi").select("doc_id").distinct()
    kept = mixing.stage(spark, filtered, sf).select("doc_id").distinct().join(clean, "doc_id", "left_semi").count()
    assert kept >= 0.96 * clean.count()


def test_mixing_closes_what_steps_leave_open(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.1, 0.2], 400)
    rows = [(i, int(n), *map(float, x)) for i, (n, x) in enumerate(zip(rng.pareto(1.0, 400) * 50 + 1, p))]
    members = spark.createDataFrame(rows, "doc_id long, n_tokens long, high double, low double, toxic double")

    def shares(df):
        s = df.agg(F.sum("n_tokens"), *(F.sum(F.col("rate") * F.col("n_tokens") * F.col(d)) for d in mixing.DOMAINS)).first()
        return np.array(s[1:]) / s[0]

    got = mixing.fit_rates(members, {"high": 0.9, "low": 0.06, "toxic": 0.04}, steps=10)
    assert np.abs(shares(got) - [0.9, 0.06, 0.04]).sum() <= 1e-6 and got.where("rate < 0").count() == 0
    with pytest.warns(UserWarning, match="stay open"):
        least = mixing.fit_rates(members.withColumn("low", F.lit(0.0)), {"high": 0.5, "low": 0.5, "toxic": 0.0})
    s = shares(least)
    assert s[1] == 0 and s[0] > 0.3 and s[2] < 0.05 and least.where("rate < 0").count() == 0
    with pytest.warns(UserWarning, match="shares that stay open"), pytest.warns(UserWarning, match="fit ends after 0"):
        short = mixing.fit_rates(members, {"high": 0.9, "low": 0.06, "toxic": 0.04}, evaluations=0)
    assert short.count() == members.count() and short.where("rate is null or rate < 0").count() == 0


def test_licences(spark):
    files = spark.createDataFrame([("LICENSE", "Released under the MIT License.", True), ("a/x.py", None, False), ("a/b/NOTICE", "intro\nLicensed under the Apache License, Version 2.0.", True), ("a/b/c/y", "some prose of the day", False), ("z", "this work is licensed under the gnu general public license, version 3", None), (None, "MIT License", False)], "path string, text string, is_license_file boolean")
    got = {r.path: (r.license, r.origin) for r in license_scan.scan(files).collect()}
    assert got == {"LICENSE": ("MIT", "header"), "a/x.py": ("MIT", ""), "a/b/NOTICE": ("Apache-2.0", "header"), "a/b/c/y": ("Apache-2.0", "a/b"), "z": ("GPL-3.0", "header")}
    assert license_scan.scan(files.where("false")).count() == 0


def test_wrapped_notices_and_licence_texts(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    bsd = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:\n# some other words"
    gpl = "prose\n *  This program is free software: you can redistribute it and/or modify\n *  it under the terms of the GNU General Public License as published by\n *  the Free Software Foundation, either version 3 of the License, or\n *  (at your option) any later version.\n *\n *  This program is distributed in the hope that it will be useful,\n *  but WITHOUT ANY WARRANTY; without even the implied warranty of\n *  MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n *  GNU General Public License for more details.\nint main"
    rows = [("LICENSE", mit, True), ("a.py", "# SPDX-License-Identifier: MPL-2.0\nx = 1", False), ("b.py", "import os", False), ("c/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n Preamble", True), ("c/d.py", bsd, False), ("c/e.py", gpl, False), ("c/f.py", "some free prose of the software we use", False)]
    rows += [(f"p/{i}", "\n".join(f"the words of line {i} and {k} in a text with no notice" for k in range(20)), False) for i in range(30)]
    got = {r.path: (r.license, r.origin) for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string, is_license_file boolean")).collect()}
    want = {"LICENSE": ("MIT", "header"), "a.py": ("MPL-2.0", "header"), "b.py": ("MIT", ""), "c/COPYING": ("GPL-3.0", "header"), "c/d.py": ("BSD-3-Clause", "header"), "c/e.py": ("GPL-3.0", "header"), "c/f.py": ("GPL-3.0", "c")}
    assert {k: got[k] for k in want} == want and all(got[f"p/{i}"] == ("MIT", "") for i in range(30))


def test_pipeline_stages(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    b = byte_bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rows = out.join(docs, "doc_id").collect()
    assert rows and all(b.decode(list(r.token_ids)).decode() == r.text for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "mixing", "byte_bpe"]


def test_op_contracts(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in mpeg_audio.op7_mpeg_audio(spark, sf).collect():
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == mpeg_audio.brute_force(docs[r.doc_id])
    at = 0
    for r in token_output.op1_token_output(spark, sf).orderBy("doc_id").collect():
        assert r.start == at
        at += r.n_tokens
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in warc.op3_warc(spark, sf).collect():
        assert r.payload_digest == base64.b32encode(hashlib.sha1(pages[r.page_id]).digest()).decode() and r.payload_bytes == len(pages[r.page_id])
    assert zlib.crc32(b"") == 0
