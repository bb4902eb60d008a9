"""Parts of operators that the given tables don't reach: block borders, errors, empty tables and nulls."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.operators import align as J
from tracegrid.operators import events as E
from tracegrid.operators import screening as K
from tracegrid.operators import series as W
from tracegrid.operators import stats as A
from tracegrid.sources import tables as T

SIGNAL = "session string, channel int, sample long, value double"


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=60), 7) * 3
    return [("a", 0, i, None if i % 50 == 7 else float(v)) for i, v in enumerate(x)] + [("b", 1, i, 0.1) for i in range(9)]


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def spans(x, width, on):
    """Runs by plain loops: mean over the rows around each, then neighbours that are on."""
    m = []
    for i in range(len(x)):
        near = [v for v in x[max(0, i - width // 2) : i + width - width // 2] if v is not None]
        m.append(bool(near) and on(sum(near) / len(near)))
    out, i = [], 0
    while i < len(m):
        j = i
        while j < len(m) and m[j] == m[i]:
            j += 1
        if m[i]:
            out.append((i, j - 1))
        i = j
    return out


@pytest.mark.parametrize("size", [8, 33, 1 << 16])
def test_runs_over_blocks(spark, signal, size):
    d = spark.createDataFrame(signal, SIGNAL).repartition(3)
    keys = {("a", 0), ("b", 1)}
    still, active = got(E.still_periods(d, 6, 2.0, 4, size=size)), got(E.active_spans(d, 6, 2.5, size=size))
    want_still, want_active = [], []
    for s, c in keys:
        x = [v for a, b, _, v in signal if (a, b) == (s, c)]
        mean = sum(v for v in x if v is not None) / sum(v is not None for v in x)
        want_still += [(s, c, a, b, b - a + 1) for a, b in spans([None if v is None else abs(v) for v in x], 6, lambda m: m <= 2.0) if b - a + 1 >= 4]
        want_active += [(s, c, a, b) for a, b in spans([None if v is None else (v - mean) ** 2 for v in x], 6, lambda m: m**0.5 > 2.5)]
    assert still == sorted(want_still, key=repr) and active == sorted(want_active, key=repr)
    assert len(still) > 3 and len(active) > 3
    assert E.still_periods(d.limit(0), 6, 2.0, 4).count() == 0 and E.active_spans(d.limit(0), 6, 2.0).count() == 0


@pytest.mark.parametrize("width", [4, 1 << 20])
def test_places_over_blocks(spark, width):
    frames = spark.createDataFrame([("a", 3 * i) for i in range(10)] + [("b", 5)], "session string, frame long").repartition(3)
    edges = spark.createDataFrame([("a", 100 + i * i) for i in range(8)] + [("b", 1), ("b", 2)], "session string, sample long").repartition(3)
    want = sorted([("a", 3 * i, 100 + i * i if i < 8 else None) for i in range(10)] + [("b", 5, 1)], key=repr)
    assert got(J.frames_to_samples(frames, edges, width=width).select("session", "frame", "sample")) == want
    with pytest.raises(Exception, match="fewer edges"):
        J.frames_to_samples(frames, edges, strict=True, width=width).collect()
    rows = spark.createDataFrame([("a", i * 2) for i in range(23)], "k string, sample long").repartition(4)
    assert [r.sample for r in W.decimate(rows, ["k"], 5, width=width).orderBy("sample").collect()] == [0, 10, 20, 30, 40]
    assert [r.sample for r in W.downsample(rows, ["k"], 9, width=width).orderBy("sample").collect()] == [0, 18, 36]
    few = W.adaptation_sets(rows, "k", "sample", 3, catch=F.col("sample") == 4, width=width)
    assert got(few.where("first").select("sample")) == [(0,), (2,), (6,)] and got(few.where("last").select("sample")) == [(40,), (42,), (44,)] and got(few.where("catch").select("sample")) == [(4,)]
    short = W.adaptation_sets(rows.where("sample < 6"), "k", "sample", 10, width=width)
    assert short.where("first and last").count() == 3


def test_baselines(spark):
    d = spark.createDataFrame([(1, t, float(t * t)) for t in range(-20, 20)] + [(2, t, float(t)) for t in range(5, 25)] + [(3, -1, None), (3, 7, 2.0)], "trial int, rel_bin int, value double")
    by = {r.trial: r.value for r in W.baseline_zero(d, -3, -1, ["trial"], stat="median", closed=True, missing="tenth").where("rel_bin in (7, 5)").groupBy("trial").agg(F.max("value").alias("value")).collect()}
    # Trial 2 has no bin there: its first tenth is bins 5 and 6, median 5.5.
    assert by == {1: 49 - 4, 2: 7 - 5.5, 3: None}
    assert W.baseline_zero(d, -3, -1, ["trial"]).where("trial = 2 and value is not null").count() == 0
    assert W.baseline_zero(d.where("trial = 1"), -3, -1, ["trial"], missing="error").where("rel_bin = 0").first().value == -6.5
    with pytest.raises(Exception, match="no bins"):
        W.baseline_zero(d, -3, -1, ["trial"], missing="error").collect()


def test_order_of_channels(spark):
    rows = [("r", 1, -5, 1.0), ("r", 1, 5, 9.0), ("r", 2, -5, 3.0), ("r", 2, -4, 3.0), ("r", 3, -6, None), ("r", 4, -9, 0.5), ("r", 4, 0, 0.7), (None, 5, 1, 2.0)]
    d = spark.createDataFrame(rows, "region string, channel int, t int, value double")
    order = lambda **o: [r.channel for r in K.order_channels(d, **o).where("region = 'r'").orderBy("rank").collect()]
    assert order() == [2, 4, 1, 3] and order(before=True) == [2, 1, 4, 3]
    assert order(before=True, with_zero=False) == [4, 2, 1, 3] and order(before=True, with_zero=False, reverse=True) == [3, 1, 2, 4]
    # Without any early row all times count.
    assert K.order_channels(d.where("t > 0"), before=True).count() == 2


def test_trials_with_gaps(spark):
    rows = [("x", 1, 0, 1.0), ("x", 1, 1, 2.0), ("x", 2, 0, 3.0), ("x", 3, 0, 5.0), ("x", 3, 1, None), ("x", 4, 0, 7.0), ("x", 4, 1, 2.0), ("x", 4, 2, None)]
    d = spark.createDataFrame(rows, "condition string, trial int, channel int, value double")
    z = {(r.trial, r.channel): r.z for r in A.zscore(d, "channel", ["trial"]).collect()}
    # Channel 2 has no value at all and doesn't count; channel 1 has no spread.
    assert set(z) == {(1, 0), (1, 1), (4, 0), (4, 1)} and z[1, 1] == 0.0
    v = np.array([1.0, 3, 5, 7])
    assert abs(z[4, 0] - (7 - v.mean()) / v.std()) < 1e-12
    e = spark.createDataFrame([("s", float(t)) for t in (0, 10, 20, 60, 70, 80)] + [("one", 5.0)], "k string, t double")
    g = {r.k: (r.n, r.gaps, r.lost) for r in A.interval_stats(e, "k", "t", gap=1.5).collect()}
    assert g == {"s": (5, 1, 3), "one": (0, 0, 0)}


def test_encodings(spark, tmp_path):
    for name, raw, want in (("a", "n\nx\u20ac\n".encode("utf-8"), "UTF-8"), ("b", b"n\nx\x80\n", "windows-1252"), ("c", b"n\nx\x81\n", "ISO-8859-1"), ("d", b"", "UTF-8")):
        (tmp_path / name).write_bytes(raw)
        assert T.file_encoding(spark, str(tmp_path / name)) == want
    (tmp_path / "e").write_bytes("\ufeffBR File,Notes\n1,caf\u00e9\n".encode("utf-8"))
    assert T.read_metadata(spark, str(tmp_path / "e")).columns == ["br_file", "notes"]
    (tmp_path / "f").write_bytes(b"BR File,Notes\n1,caf\xe9\n")
    assert T.read_metadata(spark, str(tmp_path / "f")).first().notes == "caf\u00e9"
    (tmp_path / "g").write_bytes(b"Dur\xe9e,Co\x80t\n1,5 \x80\n")
    r = T.read_metadata(spark, str(tmp_path / "g"))
    assert r.first()[1] == "5 \u20ac" and len(r.columns) == 2


def test_velocity_over_blocks(spark):
    x = [0.0, 1.0, 4.0, None, 16.0, 25.0, 36.0]
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "k string, sample long, value double").repartition(3)
    want = [1.0, 2.0, 3.0, 6.0, 9.0, 10.0, 11.0]
    for width in (2, 1 << 20):
        assert [r.velocity for r in W.central_velocity(d, ["k"], "sample", 1.0, width).orderBy("sample").collect()] == want


def test_nearest_within_makes_no_pairs(spark):
    import random

    from tracegrid.operators import align as J

    rng = random.Random(7)
    a = [(i, float(rng.randrange(400))) for i in range(150)] + [(999, None), (998, 5000.0)]
    b = [(i, float(rng.randrange(400))) for i in rng.sample(range(1000), 60)] + [(2000, None)]
    x, y = spark.createDataFrame(a, "id long, t double"), spark.createDataFrame(b, "other long, t double")
    for tolerance in (3.0, 1000.0):
        got = J.within(x, y, tolerance)
        assert "bucket" not in got._jdf.queryExecution().optimizedPlan().toString()  # pairs of dense times were made there
        want = {i: min((abs(t - u), o) for o, u in b if u is not None and abs(t - u) <= tolerance)[1] for i, t in a if t is not None and any(u is not None and abs(t - u) <= tolerance for _, u in b)}
        assert {r.id: r.other for r in got.collect()} == want


def test_neighbours_of_channels_that_share_a_place(spark):
    n = 60_000
    near = spark.range(n).select(F.col("id").alias("channel"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    far = spark.createDataFrame([(n, 41.0, 1.0), (n + 1, 1.0, 300.0), (n + 2, 160.0, 1.0)], "channel long, x double, y double")
    began = time.time()
    got = K.neighbours(near.union(far), 30.0, 150.0).groupBy("distance").agg(F.count("*").alias("n"), F.count_distinct("channel", "neighbour").alias("d")).collect()
    assert {(r.distance, r.n, r.d) for r in got} == {(40.0, 2 * n, 2 * n), (119.0, 2, 2)}
    assert time.time() - began < 30  # 3.6 billion pairs of one place aren't looked at


def test_spikes_of_stretches_are_stitched_as_if_in_one(spark):
    rng = random.Random(30)
    spikes = [(rng.randrange(4), rng.randrange(3), rng.randrange(3000)) for _ in range(900)] + [(7, 1, 100), (7, 2, 101), (7, 2, 2990)]
    ranges = [("a", 100, 2900), ("b", 5, 1500), ("c", 1499, 2990)]
    hits, count = set(), {}
    for unit, channel, at in spikes:
        for file, first, last in ranges:
            if first <= at <= last:
                hits.add((file, unit, (at - first) // 30))
                count[file, unit, channel] = count.get((file, unit, channel), 0) + 1
    main = {(f, u): min((-n, c) for (g, v, c), n in count.items() if (g, v) == (f, u))[1] for f, u, _ in count}
    want = sorted((f, u, main[f, u], b) for f, u, b in hits)
    d, r = spark.createDataFrame(spikes, "unit int, channel int, sample long"), spark.createDataFrame(ranges, "file string, first long, last long")
    for size in (64, 1000, 1 << 22):
        got = J.stitch_spikes(d, r, size=size)
        assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate" in line and "bin#" in line]  # bins of all files aren't gathered
