"""Event operators by hand, on signals of every shape and in blocks of every size."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.operators import align as J
from tracegrid.operators import blocks as B
from tracegrid.operators import events as E
from tracegrid.operators import series as W
from tracegrid.sources import tables as T


def test_rising_edges_see_every_sample(spark):
    wave = F.when(F.col("id") == 20_001, 10.0).when(F.col("id") % 1000 < 500, 0.0).otherwise(1.0)
    s = spark.range(45_000).select(F.lit("s").alias("session"), F.lit(0).alias("channel"), F.col("id").alias("sample"), wave.alias("value"))
    assert [r.sample for r in E.rising_edges_hysteresis(s).collect()] == [20_001]
    assert E.rising_edges_hysteresis(s, points=20_000).count() == 46  # the wave and the pulse


def signal(spark, values, name="s"):
    return spark.createDataFrame([(name, 0, i, None if v is None else float(v)) for i, v in enumerate(values)], "session string, channel int, sample long, value double")


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("width", [3, 64, 1 << 20])
def test_pulses_pair_biphasic_phases(spark, width):
    train = [0, -5, -5, 0, 5, 5, 0, 0, -5, 0, 5, 0, 0]
    # Falls at 1, 6, 8, 11; rises at 3, 4, 9, 10; phases end at 3, 6, 9, 11.
    assert pairs(E.pulses(signal(spark, train), width=width), "start", "end", "size") == [(1, 6, 5), (8, 11, 3)]
    # Positive first: falls at 3, 4, 9, 10 and rises at 1, 6, 8, 11; starts are falls, as the rises aren't more.
    assert pairs(E.pulses(signal(spark, [-v for v in train]), width=width), "start", "end") == [(3, 6), (9, 11)]
    # The last phase never returns to zero, and more rises than falls make the rises the starts.
    assert pairs(E.pulses(signal(spark, [0, -5, 0, 5, 0, 5, 5, 6]), width=width), "start", "end") == [(2, 4)]
    assert E.pulses(signal(spark, [0] * 20), width=width).count() == 0 and E.pulses(signal(spark, [0]), width=width).count() == 0
    assert [r.channel for r in E.first_active(signal(spark, train).unionByName(signal(spark, train).withColumn("channel", F.lit(3)))).select("channel").distinct().collect()] == [0]


def test_pulse_blocks(spark):
    p = spark.createDataFrame([("s", 0, s, s + z, z) for s, z in ((1, 5), (20, 5), (400, 5), (420, 7))], "session string, channel int, start long, end long, size long")
    assert pairs(E.pulse_blocks(p, factor=50), "block", "start", "end", "pulses") == [(1, 1, 25, 2), (2, 400, 427, 2)]


@pytest.mark.parametrize("width", [2, 5, 1000])
def test_edges_in_blocks(spark, width):
    rng = np.random.default_rng(4)
    v = [None if x < 0.1 else round(float(10 * x)) for x in rng.random(300)]
    s = signal(spark, v)
    want = lambda f: pairs(f(1 << 20), "sample")
    for f in (lambda w: E.rising_edges_hysteresis(s, width=w), lambda w: E.edges(s, 5, width=w), lambda w: E.edges(s, 5, rising=False, width=w), lambda w: E.falling_edges(s, 3, width=w), lambda w: E.local_maxima(s, 7, width=w)):
        assert pairs(f(width), "sample") == want(f) and want(f)
    clean = [x for x in v if x is not None]
    mid = (min(clean) + max(clean)) / 2
    falls, kept = [i for i in range(1, len(clean)) if clean[i] <= mid < clean[i - 1]], []
    for i in falls:
        if not kept or i - kept[-1] >= 3:
            kept.append(i)
    assert [x for (x,) in pairs(E.falling_edges(s, 3, width=width), "sample")] == kept


def test_hysteresis_holds_inside_the_band(spark):
    # Range 0 to 10: on at 7.5 and above, off at 5 and below.
    assert pairs(E.rising_edges_hysteresis(signal(spark, [0, 6, 8, 6, 7, 8, 5, 6, 7, None, 10, 6, 4, 9])), "sample") == [(2,), (10,), (13,)]
    assert E.rising_edges_hysteresis(signal(spark, [3, 3, 3])).count() == 0 and E.rising_edges_hysteresis(signal(spark, [3])).count() == 0


def test_maxima_take_the_middle_of_plateaus(spark):
    assert pairs(E.local_maxima(signal(spark, [0, 5, 5, 9, 1, 7, 7, 7, 2, 8, 8, 1, 6, 6]), 1), "sample", "value") == [(3, 9.0), (6, 7.0), (9, 8.0)]


def test_teleports(spark):
    n = 40
    rng = np.random.default_rng(8)
    x, y = list(map(float, rng.random(n) * 3)), list(map(float, rng.random(n) * 3))
    x[20] = 500.0
    t = spark.createDataFrame([("s", 0, i, v, y[i]) for i, v in enumerate(x)], "session string, channel int, sample long, x double, y double")
    for width in (4, 1 << 20):
        got = {r.sample: (r.x, r.y) for r in W.remove_teleports(t, ["session", "channel"], width=width).collect()}
        # Both steps of the leap, at 20 and 21, go with their neighbours 19 and 22 and are filled from 18 to 23.
        assert all(abs(got[i][0] - (x[18] + (x[23] - x[18]) * (i - 18) / 5)) < 1e-9 for i in range(19, 23))
        assert all(got[i] == (x[i], y[i]) for i in (*range(19), *range(23, n)))


def test_gap_fill_leaves_ends_and_long_gaps(spark):
    v = [None, 1, None, None, 4, None, None, None, 8, None]
    got = [r.value for r in W.interpolate_gaps(signal(spark, v), 2, ["session", "channel"], width=3).orderBy("sample").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 4.0, None, None, None, 8.0, None]


def test_frames(spark):
    rows = [("a", 0, "dt", True), ("a", 1, "1o", True), ("a", 2, "20", True), ("a", 3, "25", True), ("a", 4, "30", False), ("a", 5, "35", True)]
    f = spark.createDataFrame(rows, "k string, avi long, delta_t string, ok boolean")
    for width in (2, 1 << 20):
        got = [tuple(r) for r in W.correct_frames(f, "k", width).orderBy("avi").select("avi", "n_missing", "total_missing", "n_chunks_missing", "corrected").collect()]
        assert got == [(0, 0, 0, 0, 0), (1, 0, 0, 0, 1), (2, 1, 1, 1, 3), (3, 2, 3, 2, 6), (4, None, 3, 2, None), (5, 2, 5, 3, 10)]


def test_windows_outside_the_recording_are_null(spark):
    bins = spark.createDataFrame([("s", 0, b, float(b)) for b in range(10)], "session string, trace int, bin long, value double")
    ev = spark.createDataFrame([("s", 1, 5), ("s", 2, 0), ("s", 3, 30)], "session string, event_id long, at long")
    got = {(r.event_id, r.rel_bin): r.value for r in J.window_resampled(bins, ev, 1, 2).collect()}
    assert [got[1, k] for k in range(-1, 3)] == [4, 5, 6, 7] and [got[2, k] for k in range(-1, 3)] == [0, 1, 1, 2] and [got[3, k] for k in range(-1, 3)] == [None] * 4


def test_asof_and_merged_intervals(spark):
    ev = spark.createDataFrame([("s", float(t), i) for i, t in enumerate((0, 10, 99, 500))], "session string, at double, event_id long")
    fr = spark.createDataFrame([("s", 10.0, 7), ("s", 10.0, 5), ("s", 100.0, 9), ("z", 600.0, 1)], "session string, t_ms double, frame long")
    for width in (7.0, 1e9):
        assert sorted((r.event_id, r.frame, r.late_ms) for r in J.asof_next(ev, fr, width=width).collect()) == [(0, 5, 10.0), (1, 5, 0.0), (2, 9, 1.0), (3, None, None)]
    iv = spark.createDataFrame([("a", 0.0, 50.0), ("a", 10.0, 20.0), ("a", 30.0, 60.0), ("a", 60.0, 61.0), ("a", 70.0, 71.0), ("b", 5.0, 6.0)], "k string, s double, e double")
    for width in (8.0, 1e9):
        assert pairs(J.merged(iv, ["k"], width), "k", "s", "e") == [("a", 0.0, 61.0), ("a", 70.0, 71.0), ("b", 5.0, 6.0)]


def test_block_primitives_of_an_empty_table(spark):
    e = signal(spark, []).withColumn("t_ms", F.col("sample"))
    assert B.neighbour(e, ["session"], "sample", "value", "b").count() == 0 and E.pulses(e).count() == 0 and E.burst_starts(e, 3).count() == 0
    assert T.explode_blocks(T.to_blocks(e, 7)).count() == 0


def test_impedances(spark):
    lines = ["elec1-5   201 kOhm and elec6 300 Ohm", "nothing 12", "Elec 5 90.5 kΩ"]
    got = pairs(T.parse_impedances(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")), "electrode", "kohm")
    assert got == [(5, 90.5), (6, 0.3)]


def test_still_windows_fit(spark):
    p = spark.createDataFrame([("a", 0, 10, 20), ("a", 0, 40, 43), ("b", 1, 0, 4)], "session string, channel int, start long, end long")
    got = sorted(tuple(r) for r in E.still_windows(p, 5, 3).collect())
    assert got == [("a", 0, 10, 14), ("a", 0, 13, 17), ("a", 0, 16, 20), ("b", 1, 0, 4)]


def test_gradient_and_bias(spark):
    from tracegrid.operators import screening as K

    t = spark.createDataFrame([(1, 0, 1.0), (1, 1, 4.0), (1, 2, 9.0), (2, 0, 5.0), (3, 0, None), (3, 1, 2.0)], "trial int, bin int, value double")
    assert sorted(((r.trial, r.bin, r.value) for r in K.gradient(t, ["trial"], "bin").collect()), key=lambda r: r[:2]) == [(1, 0, 3.0), (1, 1, 4.0), (1, 2, 5.0), (2, 0, None), (3, 0, None), (3, 1, None)]
    assert sorted(((r.trial, r.bin, r.value) for r in K.remove_bias(t, ["trial"], "bin", 0, 0).collect()), key=lambda r: r[:2]) == [(1, 0, 0.0), (1, 1, 3.0), (1, 2, 8.0), (2, 0, 0.0), (3, 0, None), (3, 1, 2.0)]


def test_runs_of_peaks_share_a_group(spark):
    from tracegrid.operators import events as E

    at = [0, 1, 4, 5, 6, 7, 8, 9, 12, 15, 16]  # runs 0-1, 4-9, 12 and 15-16, nearer to each other than the span
    rows = [("s", 0, s, float(s), float(s % 5 + 1)) for s in at]
    got = E.dedup_peaks(spark.createDataFrame(rows, "session string, channel int, sample long, t_ms double, amplitude double"), 2, 4)
    assert "FlatMapGroupsInPandas [session" in (p := got._jdf.queryExecution().optimizedPlan().toString()) and str(E.RUNS) in p
    assert sorted(r.sample for r in got.collect()) == [1, 4, 9, 12, 16]


def test_raster_deals_a_hot_bucket(spark, monkeypatch):
    """300 events and 400 peaks within one bucket, many at the same time: all pairs, and no task makes most of them."""
    monkeypatch.setattr(J, "PAIRS", 5_000, raising=False)
    monkeypatch.setattr(J, "MEET", 50, raising=False)
    at, t = [float(i % 7) for i in range(300)], [float(i % 11) for i in range(400)]
    ev = spark.createDataFrame([("s", i, v) for i, v in enumerate(at)] + [("s", 900, 5e6), (None, 901, 0.0), ("s", 902, None)], "session string, event_id long, at double")
    pk = spark.createDataFrame([("s", i, i % 3, v) for i, v in enumerate(t)] + [("u", 900, 0, 1.0), (None, 901, 0, 0.0), ("s", 902, 0, None)], "session string, id long, channel int, t_ms double")
    d = J.raster(pk, ev, 3.0, 1000.0)
    got = d.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(("s", i, k % 3, v - a) for i, a in enumerate(at) for k, v in enumerate(t) if -3 <= v - a < 1000)
    assert max(collections.Counter(r.task for r in got).values()) < len(got) / 4


def test_raster_sends_a_hot_bucket_once_and_goes_through_its_events(spark, monkeypatch):
    """Sent again, it would come in as many tasks as its bytes ask for; through the peaks, each row would have another event."""
    monkeypatch.setattr(J, "PAIRS", 5_000)
    monkeypatch.setattr(J, "MEET", 50)
    ev = spark.range(300).select(F.lit("s").alias("session"), F.col("id").alias("event_id"), (F.col("id") % 7).cast("double").alias("at"))
    pk = spark.range(400).select(F.lit("s").alias("session"), "id", F.lit(0).alias("channel"), (F.col("id") % 11).cast("double").alias("t_ms"))
    d = J.raster(pk, ev, 3.0, 1000.0)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2
    got = d.withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == sum(k % 11 - i % 7 >= -3 for i in range(300) for k in range(400)) and len({r.task for r in got}) > 8
    # An event begins once for each part of the peaks at most.
    assert sum(a.event_id != b.event_id for a, b in zip(got, got[1:])) < 300 * 8
