"""Ranked search against scores of all documents, range maxima against plain ones, and rows that a user's tables may bring."""

import random

import numpy as np
import pytest

from tests.llm.test_oracle import duck
from tests.test_queries import rows
from tracegrid.llm import oracle
from tracegrid.llm import ranked_search as R

LETTERS = "the of and é ñandú to x1 Ünder 42 a".split() + [f"w{i}" for i in range(60)]


def made(seed, n):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(LETTERS[: rng.choice((4, 10, 70))]) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    texts[3:6] = [None, "", " .,-_ \n"]
    texts[6:9] = ["the " * 3000 + "w1", "THE of", "the OF"]
    docs = [(None if i % 17 == 9 else i // 2 * 2, t, i) for i, t in enumerate(texts)]
    items = [(i, " ".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 30)))) for i in range(20)] + [(100, None), (101, ""), (102, "nowhere"), (103, "the"), (5, "w7 more w8"), (None, "of and w3"), (104, "Ñandú É")]
    return docs, items


def written(spark, tmp_path, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, `a.b` long").coalesce(1).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/i")
    return spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/i")


def test_range_maxima():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 20, 100)
    t = R.sparse_table(v, 64)
    for _ in range(500):
        a = int(rng.integers(0, 99))
        b = int(rng.integers(a + 1, min(100, a + 64) + 1))
        i = (b - a).bit_length() - 1
        x, y = t[i][a], t[i][b - (1 << i)]
        assert max(v[x], v[y]) == v[a:b].max() and a <= x < b and a <= y < b


def test_search_of_one_shard_visits_few():
    rng = np.random.default_rng(2)
    docs = 3000
    places = [np.sort(rng.choice(docs, n, replace=False)).astype(np.int32) for n in (1, 5, 200, 2900, 3000)]
    impacts = [rng.integers(1, 1000, len(p)) * w for p, w in zip(places, (50, 40, 20, 2, 1))]
    shard = R.Shard(places, impacts, docs)
    full = np.zeros(docs, dtype=np.int64)
    for p, i in zip(places, impacts):
        full[p] += i
    for k in (1, 7, 50, 4000):
        for floor in (1, 5000):
            found, scores = shard.search(np.arange(5), k, floor)
            order = np.lexsort((np.arange(docs), -full))
            want = [d for d in order if full[d] >= floor][:k]
            assert found.tolist() == want and scores.tolist() == full[want].tolist()
    asked = []
    plain = shard.largest
    shard.largest = lambda a, b: asked.append(len(a)) or plain(a, b)
    shard.search(np.arange(5), 10, 1)
    assert sum(asked) < 2 * docs


@pytest.mark.parametrize("size", [1, 40, 100_000])
def test_against_all_scores(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(R, "SHARD_DOCS", size)
    monkeypatch.setattr(R, "QUERIES", 8 if size == 40 else 256)
    docs, items = written(spark, tmp_path, *made(size, 150))
    got = R.search(R.index(docs), items)
    want = duck(oracle.OP13, documents=f"{tmp_path}/d/*.parquet", benchmark=f"{tmp_path}/i/*.parquet")
    assert rows(["item_id", "rank", "doc_id", "score"], [tuple(r) for r in got.collect()]) == want and len(want) > 700


def test_empty_tables(spark, tmp_path):
    docs, items = written(spark, tmp_path, *made(1, 20))
    assert R.search(R.index(docs.where("false")), items).count() == 0
    assert R.search(R.index(docs), items.where("false")).count() == 0
    assert R.search(R.index(docs.where("text is null or text = ''")), items).count() == 0
