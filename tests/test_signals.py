"""Filters, templates and statistics against plain NumPy on whole signals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracegrid.operators import artifacts as R
from tracegrid.operators import filters as L
from tracegrid.operators import movement as M
from tracegrid.operators import screening as K
from tracegrid.operators import series as W
from tracegrid.operators import stats as A
from tracegrid.operators.quantiles import quantiles

FS = 30_000.0


def frame(spark, x):
    return spark.createDataFrame([("s", 0, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "session string, channel int, sample long, value double")


def frames(spark, xs):
    return spark.createDataFrame([("s", c, i, None if np.isnan(v) else float(v)) for c, x in enumerate(xs) for i, v in enumerate(x)], "session string, channel int, sample long, value double")


def values(df):
    return np.array([np.nan if r.value is None else r.value for r in df.orderBy("sample").collect()])


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(1)
    t = np.arange(12_000) / FS
    return rng.normal(size=len(t)) + 5 * np.sin(2 * np.pi * 40 * t) + 3


def recursive(x, b, a):
    """One pass of a filter by its difference equation."""
    y = np.zeros(len(x))
    for i in range(len(x)):
        y[i] = sum(b[k] * x[i - k] for k in range(len(b)) if i >= k) - sum(a[k] * y[i - k] for k in range(1, len(a)) if i >= k)
    return y


def test_highpass_is_the_filter_both_ways(noise):
    # Second order by the bilinear transform, run forwards and backwards over a long mirrored signal.
    c = 1 / math.tan(math.pi * 300 / FS)
    b0 = c * c / (1 + math.sqrt(2) * c + c * c)
    b, a = [b0, -2 * b0, b0], [1, 2 * (1 - c * c) / (1 + math.sqrt(2) * c + c * c), (1 - math.sqrt(2) * c + c * c) / (1 + math.sqrt(2) * c + c * c)]
    x = noise[:4000]
    wide = L.extended(x, 3000)
    want = recursive(recursive(wide, b, a)[::-1], b, a)[::-1][3000:-3000]
    got = L.both_ways(x, L.butterworth("high", 300.0, FS, 2), FS, 3000)
    assert np.abs(got - want).max() < 1e-6


@pytest.mark.parametrize("filter_", [lambda d, n: L.highpass(d, 300.0, FS, ["session", "channel"], size=n), lambda d, n: L.bandpass(d, 300.0, 6000.0, FS, ["session", "channel"], size=n), lambda d, n: L.gaussian_filtfilt(d, 8.0, ["session", "channel"], size=n), lambda d, n: L.remove_drift(d, 4000.0, ["session", "channel"], size=n), lambda d, n: L.lowpass(d, 800.0, FS, ["session", "channel"], size=n, reach=1500)])
def test_blocks_leave_no_seams(spark, noise, filter_):
    d = frame(spark, noise)
    whole = values(filter_(d, 1 << 20))
    assert np.abs(values(filter_(d, 2500)) - whole).max() < 1e-6 and np.abs(whole).max() > 0.1


def test_missing_values_stay_missing(spark, noise):
    x = noise[:3000].copy()
    x[100:110] = np.nan
    got = values(L.gaussian_filtfilt(frame(spark, x), 4.0, ["session", "channel"]))
    assert np.isnan(got[100:110]).all() and np.isfinite(np.delete(got, np.s_[100:110])).all()
    assert np.isnan(values(L.highpass(frame(spark, np.full(5, np.nan)), 300.0, FS, ["session", "channel"]))).all()


def test_gaussian_and_drift_by_hand(spark):
    x = np.random.default_rng(2).normal(size=400)
    g = L.gauss(2.0)
    wide = L.extended(x, 3 * (len(g) - 1))
    twice = np.array([sum(g[k] * sum(g[m] * wide[i + k + m - 2 * (len(g) // 2)] for m in range(len(g))) for k in range(len(g))) for i in range(3 * (len(g) - 1), len(wide) - 3 * (len(g) - 1))])
    assert np.abs(values(L.gaussian_filtfilt(frame(spark, x), 2.0, ["session", "channel"])) - twice).max() < 1e-9
    assert np.allclose(L.rolling_median(np.array([1.0, 5.0, 2.0]), 3), [1.0, 2.0, 2.0])


def test_template_anchor_across_blocks(spark):
    rng = np.random.default_rng(3)
    x, t = rng.normal(size=3000) * 0.1, np.sin(np.arange(60))
    x[1500:1560] += 5 * t
    x[2500:2560] += 5 * t
    for size in (64, 1000, 1 << 18):
        got = L.template_anchor(frame(spark, x), t, ["session", "channel"], 0.9, size).collect()
        assert [r.lag for r in got] == [1500]


def peak_by_hand(x, t, least):
    """The first peak of the full correlation: a plateau's middle, ends left out."""
    z = lambda v: (v - v.mean()) / v.std()
    c = np.correlate(z(x), z(t), mode="full")
    c = np.round(c / np.abs(c).max(), 9)
    i = 1
    while i < len(c) - 1:
        j = i
        while j + 1 < len(c) and c[j + 1] == c[i]:
            j += 1
        if c[i - 1] < c[i] and j + 1 < len(c) and c[j + 1] < c[i] and c[i] >= least:
            return (i + j) // 2 - (len(t) - 1)
        i = j + 1
    return None


def test_template_anchor_before_the_signal(spark):
    t = np.array([-2.0, -1.0, 0.0, 1.0, 2.0])
    cases = [np.array([1.0, 2.0] + [0.0] * 20), np.array([0.0] * 20 + [-2.0, -1.0]), np.tile([0.0, 1.0, 1.0, 0.0], 6), np.random.default_rng(8).normal(size=300)]
    want = {c: peak_by_hand(x, t, 0.9) for c, x in enumerate(cases)}
    d = frames(spark, cases)
    for size in (5, 64):
        got = {r.channel: r.lag for r in L.template_anchor(d, t, ["session", "channel"], 0.9, size).collect()}
        assert got == {c: lag for c, lag in want.items() if lag is not None}
    assert peak_by_hand(cases[0], t, 0.9) == -3


def test_anchor_refined_between_samples(spark):
    rng = np.random.default_rng(11)
    fs_a, fs_b, reach, keys = 30_000.0, 24_000.0, 6, ["session", "channel"]
    places, xs, ys, want = [0, 150, -7, 2950], [], [], {}
    for c, anchor in enumerate(places):
        x = np.convolve(rng.normal(size=3060), np.ones(60) / 60, "valid")
        y = 3 * np.interp(anchor + 2 * fs_a / fs_b + np.arange(700) * fs_a / fs_b, np.arange(len(x)), x) + 0.01 * rng.normal(size=700)
        y[50:53] = np.nan
        xn, yn = ((v - np.nanmean(v)) / (np.nanmax(v) - np.nanmin(v) + 1e-12) for v in (x, y))
        all_, ok = [], ~np.isnan(yn)
        for n in range(-reach, reach + 1):
            u = np.interp(anchor + (np.arange(700) + n) * fs_a / fs_b, np.arange(len(x)), xn, left=np.nan, right=np.nan)
            u = np.where(np.isnan(u), np.nanmean(u[ok]), u)
            all_.append(np.sqrt(np.mean((yn - u)[ok] ** 2)))
        want[c] = int(np.argmin(np.round(all_, 9))) - reach, min(all_)
        xs.append(x)
        ys.append(y)
    assert want[1][0] == 2
    anchors = spark.createDataFrame([("s", c, a) for c, a in enumerate(places)], "session string, channel int, anchor long")
    for size in (64, 1 << 15):
        got = {r.channel: r for r in L.refine_anchor(frames(spark, xs), frames(spark, ys), anchors, fs_a, fs_b, reach, keys, both=True, size=size).collect()}
        for c, (best, rms) in want.items():
            r = got[c]
            assert r.best == best and abs(r.rms - rms) < 1e-8 and r.delta == round(best * 1.25)
            assert r.shift == min(max(places[c] + r.delta, 0), 3000) and abs(r.dt_ms - 1000 * r.delta / fs_a) < 1e-12
    cut = L.refine_anchor(frames(spark, xs), frames(spark, ys), anchors.where("channel = 1"), fs_a, fs_b, reach, keys, seconds=0.005).collect()
    assert [r.anchor for r in cut] == [150] and cut[0].rms is not None


def test_gaussian_at_irregular_times(spark):
    rows, want, sigma = [], {}, 1.5
    for c, n in enumerate((1, 2, 40, 300)):
        rng = np.random.default_rng(n)
        t = np.sort(rng.exponential(2.0, n).cumsum() + np.repeat(rng.integers(0, 60, max(1, -(-n // 20))).cumsum(), 20)[:n])
        z = rng.normal(size=n) + 2
        rows += [("s", c, float(a), float(b)) for a, b in zip(t, z)] + [("s", c, float(t[-1] + 9), None)]
        out = z.copy()
        if n > 1:
            w = np.empty(n)
            w[1:-1], w[0], w[-1] = (t[2:] - t[:-2]) / 2, t[1] - t[0], t[-1] - t[-2]
            w = np.minimum(w, 2.5 * sigma)
            g = np.exp(-0.5 * ((t[None, :] - t[:, None]) / sigma) ** 2) / (math.sqrt(2 * math.pi) * sigma)
            out = (g * w * z).sum(axis=1)
            for i in range(n):
                if t[i] < t[0] + 2.4 * sigma:
                    out[i] += (g[i] * w * z)[t > 2 * t[i] - t[0]].sum()
                if t[i] > t[-1] - 2.4 * sigma:
                    out[i] += (g[i] * w * z)[t < 2 * t[i] - t[-1]].sum()
        want |= {(c, float(a)): b for a, b in zip(t, out)}
    d = spark.createDataFrame(rows, "session string, channel int, t_ms double, value double")
    for size in (None, 20.0):
        got = {(r.channel, r.t_ms): r.value for r in L.gaussian_irregular(d, sigma, ["session", "channel"], size=size).collect()}
        assert set(got) == set(want) and max(abs(got[k] - v) for k, v in want.items()) < 1e-12


def test_quantiles_by_counts(spark):
    rng = np.random.default_rng(12)
    keys = {"noise": rng.normal(size=900), "ties": rng.integers(0, 3, 900).astype(float), "far": rng.choice([-1e308, 1e308, 5e-324, 0.0, 1.0], 900), "steep": np.exp(rng.normal(size=900) * 50), "one": np.array([7.0]), "two": np.array([1.0, 4.0])}
    rows = [(k, float(v)) for k, x in keys.items() for v in x] + [("one", None), ("none", None), ("two", float("nan"))]
    d = spark.createDataFrame(rows, "k string, value double")
    shares = {"a": 0.0, "b": 0.05, "m": 0.5, "c": 0.951, "z": 1.0}
    for few, cuts in ((4096, 256), (10, 16)):
        got = {r.k: r for r in quantiles(d, ["k"], shares, few=few, cuts=cuts).collect()}
        assert set(got) == set(keys)
        for k, x in keys.items():
            for name, p in shares.items():
                h, x = (len(x) - 1) * p, np.sort(x)
                low, high = x[math.floor(h)], x[math.ceil(h)]
                want = low + (high - low) * (h - math.floor(h))
                assert got[k][name] == want or abs(got[k][name] / want - 1) < 1e-12, (k, name)


@pytest.mark.parametrize("kernel", [L.causal_kernel(5.0, 1000.0, 0.2), L.gaussian_kernel(20.0, 1000.0), L.gaussian_kernel(17.3, 1000.0), L.kaiser_kernel(20.0, 60.0, 1000.0)])
def test_rates_by_convolution(spark, kernel):
    taps, delay = kernel
    rng = np.random.default_rng(13)
    n = 2000
    spikes = np.sort(np.concatenate([rng.choice(n, 40, replace=False), np.repeat(rng.choice(np.arange(900, 1100), 150), 2)]))
    x = np.zeros(n)
    np.add.at(x, spikes, 1)
    want = np.convolve(x, taps)[delay : delay + n][::3]
    d = spark.createDataFrame([("s", 0, int(i)) for i in spikes], "session string, channel int, sample long")
    rec = spark.createDataFrame([("s", 0, n), ("s", 1, 10), ("s", 2, 0)], "session string, channel int, n_samples long")
    for size in (100, 1 << 18):
        got = L.convolved_rates(d, rec, kernel, 3, ["session", "channel"], size).orderBy("channel", "place").collect()
        assert [(r.channel, r.place) for r in got] == [(0, i) for i in range(len(want))] + [(1, i) for i in range(4)]
        assert np.abs(np.array([r.rate for r in got[: len(want)]]) - want).max() < 1e-9 * max(1, np.abs(want).max()) and all(r.rate == 0 for r in got[len(want) :])


@pytest.mark.parametrize("blanks", [False, True])
def test_smoothed_counts_in_blocks(spark, blanks):
    rng = np.random.default_rng(14)
    series = {0: rng.poisson(3, 300), 1: rng.poisson(3, 3), 2: rng.poisson(3, 5)}
    lost = {0: {0, 1, 70, 71, 72, 150, 299}, 1: {1}, 2: set()} if blanks else {0: set(), 1: set(), 2: set()}
    d = spark.createDataFrame([("s", c, i, int(v)) for c, x in series.items() for i, v in enumerate(x)], "session string, channel int, bin long, count long")
    gone = spark.createDataFrame([("s", c, i) for c, x in lost.items() for i in x], "session string, channel int, bin long") if blanks else None
    r, sigma = 6, 1.5
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    g /= g.sum()
    for size in (16, 1 << 14):
        got = {(x.channel, x.bin): x.rate_hz for x in W.smooth_counts(d, sigma, 10.0, ["session", "channel"], gone, size).collect()}
        assert len(got) == sum(map(len, series.values()))
        for c, x in series.items():
            n = len(x)
            ok = np.array([not any(abs(i - b) <= r for b in lost[c]) for i in range(n)])
            for i in range(n):
                if i in lost[c]:
                    assert got[c, i] is None
                    continue
                q = np.arange(i - r, i + r + 1) % (2 * n - 2)
                q = np.where(q >= n, 2 * n - 2 - q, q)
                den = (g * ok[q]).sum()
                want = x[i] if n < 4 else 0.0 if den < 1e-12 else (g * ok[q] * x[q]).sum() / den
                assert abs(got[c, i] - 100 * want) < 1e-9


def test_artifacts_by_components(spark):
    rng = np.random.default_rng(4)
    shape = rng.normal(size=(2, 12))
    x = rng.normal(size=(20, 2)) @ shape + rng.normal(size=(20, 12)) * 0.01 + 3
    rows = [("s", 0, 1, p, i, float(x[p, i])) for p in range(20) for i in range(12)]
    d = spark.createDataFrame(rows, "session string, channel int, block long, pulse long, pos long, value double")
    got = np.zeros((20, 12))
    for r in R.remove_artifacts_pca(d, 2, 3).collect():
        got[r.pulse, r.pos] = r.value
    base = x[2:].mean(axis=0)
    v = np.linalg.svd(x[2:] - base)[2][:3]
    assert np.abs(got - (x - base - (x - base) @ v.T @ v)).max() < 1e-9 and np.abs(got).max() < 0.1
    for n in (0, 1):  # a block with one pulse besides those left out has no components: it stays
        assert R.remove_artifacts_pca(d.where(f"pulse <= {n}"), n).exceptAll(d.where(f"pulse <= {n}")).count() == 0
    same = d.where("pulse < 2").withColumn("value", F.col("pos").cast("double"))
    assert all(r.value == 0 for r in R.remove_artifacts_pca(same, 0).collect())
    assert R.remove_artifacts_pca(d.where("pulse = 0"), 5).exceptAll(d.where("pulse = 0")).count() == 0


def cleaned_one_by_one(x, pulses, before, after, exclude, k, tail, share):
    """The edits of a whole signal, one pulse after another. pulses: block, start, end."""
    out, fits, n = x.copy(), {}, len(x)
    for block in {b for b, _, _ in pulses}:
        own = [(s - before, e + after) for b, s, e in pulses if b == block]
        size = max(z - a for a, z in own) + 1
        rows = [np.pad(x[a : z + 1], (0, size - (z - a + 1)), mode="edge") for a, z in own if a >= 0 and z < n][exclude:]
        fits[block] = (size, None)
        if len(rows) >= (2 if k else 1):
            m = np.array(rows)
            base = m.mean(axis=0)
            _, s, v = np.linalg.svd(m - base, full_matrices=False)
            fits[block] = (size, (base, v[: min(k, int((s > 1e-12 * max(s[0], 1e-300)).sum()))]))
    for i, (block, s, e) in enumerate(pulses):
        a, (size, fit) = s - before, fits[block]
        if a < 0 or a + size > n:
            continue
        if fit:
            d = out[a : a + size] - fit[0]
            out[a : a + size] = d - d @ fit[1].T @ fit[1]
        r = min(e + tail, n - 1)
        if i + 1 < len(pulses) and pulses[i + 1][1] > r:
            z = pulses[i + 1][1]
            out[r:z] -= out[r] * share * (1 - np.arange(z - r) / (z - r))
    return out


@pytest.mark.parametrize("gap,before,after,tail,k,group", [((4, 12), 4, 6, 0, 3, 8), ((4, 9), 2, 9, 2, 1, 40), ((6, 200), 0, 2, 9, 0, 8)])
def test_signal_cleaned_in_place(spark, gap, before, after, tail, k, group):
    rng = np.random.default_rng(sum(gap) + k)
    n = 3000
    x, starts = rng.normal(size=n).cumsum() * 0.1, []
    at = 1
    while at < n - 2:
        starts.append(at)
        at += int(rng.integers(*gap))
    pulses = [(i // 7, s, s + int(rng.integers(1, 4))) for i, s in enumerate(starts)]
    pulses.append((99, n - 1, n - 1))
    for _, s, e in pulses:
        x[s : e + 1] += rng.normal(50, 5)
    want = cleaned_one_by_one(x, pulses, before, after, 1, k, tail, 0.9)
    d = spark.createDataFrame([("s", 0, b, s, s, e) for b, s, e in pulses], "session string, channel int, block long, pulse long, start long, end long")
    got = R.clean_signal(frame(spark, x), d, before, after, exclude=1, k=k, tail=tail, share=0.9, group=group)
    assert np.abs(values(got) - want).max() < 1e-7
    assert R.clean_signal(frame(spark, x), d.where("false"), before, after).count() == n


@pytest.mark.parametrize("wide", [0, 64])
def test_groups_that_clean_a_signal_take_no_windows(spark, monkeypatch, wide):
    rng = np.random.default_rng(17)
    n, length = 1500, 20 + 280 * np.abs(np.sin(np.arange(1500) / 200))
    x = rng.normal(size=n).cumsum() * 0.1
    pulses = [(i // 5, s, s + int(length[s])) for i, s in enumerate(range(1, n - 2, 4)) if s + length[s] < n]
    want = cleaned_one_by_one(x, pulses, 1, 1, 1, 3, 1, 1.0)
    d = spark.createDataFrame([("s", 0, b, s, s, e) for b, s, e in pulses], "session string, channel int, block long, pulse long, start long, end long")
    sent, taken = [], []
    snippets, kept = R.pulse_snippets, R.written
    monkeypatch.setattr(R, "pulse_snippets", lambda s, p, *a: sent.append(p.count()) or snippets(s, p, *a))
    monkeypatch.setattr(R, "written", lambda df, name="cut": taken.append((name, (out := kept(df, name)).count())) or out)
    got = R.clean_signal(frame(spark, x), d, 1, 1, exclude=1, k=3, tail=1, group=32, wide=wide)
    assert np.abs(values(got) - want).max() < 1e-7
    assert sent[0] < len(pulses) / 2 and max(m for _, m in taken) < 3 * n  # snippets would be of some 80,000 values


def test_local_templates_begin_and_end_at_zero(spark):
    rows = [("s", 0, b, 10 * b + p, i, float(v), p == 0) for b in range(3) for p, shape in enumerate(([1, 2, 4], [5, 1, 2], [0, 6, 1, 9])) for i, v in enumerate(shape)]
    d = spark.createDataFrame(rows, "session string, channel int, block long, pulse long, pos long, value double, is_first boolean")
    for group in (1, 4096):
        got = {(r.pulse, r.pos): r.template for r in R.template_parts(d, 2, group=group).collect()}
        assert [got[0, i] for i in range(3)] == [0, 0, 0] and [got[1, i] for i in range(3)] == [0, 0, 0]
        assert [got[10, i] for i in range(3)] == [0, 2 - 1 - 1.5, 0]
        assert [got[2, i] for i in range(4)] == [0, 1 - 5 + 1.5, 0, 0]  # longer than all before: 0 beyond them
        # the means of the two before: [2.5, 3.5, 1.5, 9]
        assert np.allclose([got[11, i] for i in range(3)], [0, 1 - (9 - 2.5) / 3, -1 - 2 * (9 - 2.5) / 3]) or np.allclose([got[11, i] for i in range(3)], [0, 1 + 0.5, 0])


def test_models(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = x @ rng.normal(size=(4, 2)) @ rng.normal(size=(2, 3)) + rng.normal(size=(300, 3)) * 0.1
    d = spark.createDataFrame([tuple(map(float, r)) for r in np.hstack([x, y])], ", ".join(f"{c} double" for c in ("x0", "x1", "x2", "x3", "y0", "y1", "y2")))
    got = {r["rank"]: r.mse for r in R.reduced_rank_regression(d, ["x0", "x1", "x2", "x3"], ["y0", "y1", "y2"], [1, 2, 3]).collect()}
    xc, yc = x - x.mean(0), y - y.mean(0)
    fit = xc @ np.linalg.lstsq(xc, yc, rcond=None)[0]
    v = np.linalg.svd(fit, full_matrices=False)[2]
    for k in (1, 2, 3):
        assert abs(got[k] - ((yc - fit @ v[:k].T @ v[:k]) ** 2).mean()) < 1e-9
    load = rng.normal(size=(6, 2))
    z = rng.normal(size=(4000, 2)) @ load.T + rng.normal(size=(4000, 6)) * 0.3
    f = spark.createDataFrame([tuple(map(float, r)) for r in z], ", ".join(f"z{i} double" for i in range(6)))
    rows = R.factor_loadings(f, [f"z{i}" for i in range(6)]).collect()
    est = np.array([[r.l1, r.l2] for r in rows])
    assert np.abs(est @ est.T + np.diag([r.noise for r in rows]) - np.cov(z.T, bias=True)).max() < 0.05


def test_pca(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 5)) + 2
    d = spark.createDataFrame([(i, c, float(x[i, c])) for i in range(40) for c in range(5)], "trial long, channel int, value double")
    scores, variances = A.pca(d, 2)
    u, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(variances, s[:2] ** 2 / 40)
    got = np.array([[r.pc1, r.pc2] for r in scores.orderBy("trial").collect()])
    sign = np.sign(v[range(2), np.abs(v[:2]).argmax(axis=1)])
    assert np.abs(got - (u * s)[:, :2] * sign).max() < 1e-9


def test_intervals_and_tests(spark):
    assert abs(M.t_quantile(0.95, 10) - 2.228138852) < 1e-6 and abs(M.t_quantile(0.99, 1) - 63.65674) < 1e-3
    rng = np.random.default_rng(7)
    rows = [(c, i, float(v)) for c in ("a", "b") for i, v in enumerate(rng.normal(size=60) + (c == "b"))] + [("one", 0, 1.0), ("none", 0, None)]
    d = spark.createDataFrame(rows, "condition string, trial long, value double")
    ci = {r.condition: r for r in M.mean_ci(d, ["condition"]).collect()}
    a = np.array([v for c, _, v in rows if c == "a"])
    half = 2.000995378 * a.std(ddof=1) / math.sqrt(60)
    assert abs(ci["a"].high - a.mean() - half) < 1e-6 and ci["one"].low is None and ci["none"].mean is None
    boot = {r.condition: r for r in M.bootstrap_ci(d, ["condition"], "trial", 400).collect()}
    assert abs((boot["a"].high - boot["a"].low) / (2 * half) - 1) < 0.2 and boot["a"].low < a.mean() < boot["a"].high
    t = {r.condition: r for r in A.ttest_vs_baseline(d, "a").collect()}
    b = np.array([v for c, _, v in rows if c == "b"])
    want = (b.mean() - a.mean()) / math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 2 * (2 / 60))
    assert abs(t["b"].t - want) < 1e-9 and t["b"].stars == "***" and set(t) == {"b"}
    assert abs(A.t_two_sided(2.0, 10) - 0.07338803) < 1e-7


def test_keypoint_names():
    assert K.match_keypoints(["net_hand_left", "net_eye", "wrist"], ["left hand", "eye center", "tail"]) == {"left hand": "net_hand_left", "eye center": "net_eye"}


def test_no_window_is_summed_anew_for_each_row(spark):
    """A frame from the row on to its block's end takes the square of the block's rows."""
    from tracegrid.operators import blocks as B

    d = frame(spark, np.array([np.nan, 1.0, np.nan, np.nan, 4.0, np.nan]))
    got = L.filled(d, ["session", "channel"])
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [r._filled for r in got.orderBy("sample").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    value = F.when(F.col("value").isNotNull(), F.struct("sample", "value"))
    for width in (2, 3, 100):
        got = B.around(d, ["session", "channel"], "sample", value, "b", "a", width=width).orderBy("sample").collect()
        assert [(r.b and r.b.value, r.a and r.a.value) for r in got] == [(None, 1.0), (1.0, 1.0), (1.0, 4.0), (1.0, 4.0), (4.0, 4.0), (4.0, None)]


def test_similarity_in_blocks_of_bounded_size(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 6))
    x[7] = 2.0
    d = spark.createDataFrame([(t, c, float(v)) for t, row in enumerate(x) for c, v in enumerate(row)] + [(30, 0, 1.0), (30, 9, 2.0), (30, 11, 4.0)], "trial long, channel int, value double")
    got = {(r.i, r.j): r.r for r in M.rsa_matrix(d, blocks=1, most=4).collect()}
    want = np.corrcoef(np.delete(x, 7, axis=0))
    names = [t for t in range(30) if t != 7]
    assert len(got) == 30 * 29 // 2
    assert all(got[a, 30] is None for a in names)
    assert max(abs(got[a, b] - want[i, j]) for i, a in enumerate(names) for j, b in enumerate(names) if a < b) < 1e-12


def test_similarity_by_value_is_whole_and_small(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    rows = [(f"t{t:02}", c, float(v)) for t, row in enumerate(x) for c, v in enumerate(row)] + [("t40", c, v) for c, v in ((0, 1.0), (9, 2.0), (11, 4.0))]
    d = spark.createDataFrame(rows, "trial string, channel int, value double")
    for blocks, most in ((1, 7), (1, 100), (12, 4)):
        got = M.rsa_matrix(d, blocks=blocks, most=most, digits=3)
        rows = {(r.i, r.j): r.r for r in got.collect()}
        assert got.count() == len(rows) == 41 * 40 // 2 and all(i < j for i, j in rows)
        want = np.corrcoef(x)
        assert all(rows[f"t{a:02}", f"t{b:02}"] == round(want[a, b], 3) for a in range(40) for b in range(a + 1, 40))
        assert all(rows[f"t{a:02}", "t40"] is None for a in range(40))
    # Trials are dealt once, not once for each pair of blocks, and rows that follow each other have the same r.
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    x = rng.normal(size=(3000, 64))
    d = spark.createDataFrame([(t, row.tolist()) for t, row in enumerate(x)], "trial long, v array<double>").select("trial", F.posexplode("v").alias("channel", "value"))
    M.rsa_matrix(d, blocks=1, digits=6).write.parquet(f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 3000 * 2999 // 2
    assert sum(f.stat().st_size for f in (tmp_path / "r").glob("*.parquet")) < 6 * 3000 * 2999 // 2


def nearest(x, k):
    """Brute force; a missing coordinate doesn't count, and a pair without any is last."""
    out = {}
    for a, p in x.items():
        gaps = {b: [abs(u - v) for u, v in zip(p, q) if u is not None and v is not None] for b, q in x.items() if b != a}
        far = sorted((not g, max(g, default=0.0), b) for b, g in gaps.items())[:k]
        out[a] = [(b, None if lost else d) for lost, d, b in far]
    return out


def test_nearest_channels_by_cells(spark):
    rng = np.random.default_rng(4)
    spread = {i: tuple(p) for i, p in enumerate(np.concatenate([rng.uniform(0, 1000, (80, 2)), rng.normal(300, 1e-4, (80, 2)), rng.integers(0, 4, (80, 2)) * 100.0, np.full((40, 2), 7.0)]).tolist())}
    lost = {**spread, 900: (None, 7.0), 901: (None, None), 902: (5.0, None)}
    for x in (spread, lost, {0: (1.0, 1.0), 1: (1.0, 1.0)}, {0: (1.0, 2.0)}):
        rows = K.nearest_channels(spark.createDataFrame([(i, *p) for i, p in x.items()], "channel long, x double, y double"), 4).collect()
        got = {i: [] for i in x}
        for r in sorted(rows, key=lambda r: (r.distance is None, r.distance or 0.0, r.neighbour)):
            got[r.channel].append((r.neighbour, r.distance))
        assert got == nearest(x, 4)


def test_nearest_channels_of_many(spark):
    """All pairs of these are 1.6 billion."""
    import time

    rng = np.random.default_rng(5)
    x = rng.uniform(0, 500, (40_000, 2))
    d = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "channel long, x double, y double")
    began = time.time()
    got = {}
    for r in K.nearest_channels(d, 4).collect():
        got.setdefault(r.channel, []).append((r.distance, r.neighbour))
    assert time.time() - began < 90 and len(got) == len(x)
    for i in range(0, len(x), 500):
        far = np.abs(x - x[i]).max(axis=1)
        far[i] = np.inf
        assert [n for _, n in sorted(got[i])] == np.argsort(far, kind="stable")[:4].tolist()


def test_gaussian_sums_of_dense_times():
    rng = np.random.default_rng(6)
    t, sigma = np.sort(rng.uniform(0, 40.0, 4000)), 2.0
    v = rng.normal(size=len(t))
    lo, hi = t[0], t[-1]
    gap = t[None, :] - t[:, None]
    times = 1 + ((t < lo + 2.4 * sigma)[:, None] & (gap > (t - lo)[:, None])) + ((t > hi - 2.4 * sigma)[:, None] & (gap < (t - hi)[:, None]))
    want = (times * v * np.exp(-0.5 * (gap / sigma) ** 2)).sum(axis=1)
    assert np.abs(L.gaussian_sums(t, v, t, sigma, 9 * sigma, lo, hi) - want).max() < 1e-10


def long_pulses(spark):
    """Two channels whose pulses overlap many times over, in blocks of 20 starts; some reach beyond the recording."""
    rng = np.random.default_rng(29)
    xs = rng.normal(size=(2, 9000))
    xs[0, 100] = np.nan
    rows = [("s", c, at // 20, at, at, at + int(rng.integers(1, 900))) for c in range(2) for at in range(0, 8900, 5 + c)]
    pulses = spark.createDataFrame(rows, "session string, channel int, block long, pulse long, start long, end long")
    return xs, frames(spark, xs), pulses, rows


def sent(df):
    """Exchanges of what the groups of pulses give."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("FlatMapGroupsInArrow")].count("Exchange")


def test_snippets_are_cut_where_their_samples_are(spark):
    xs, s, pulses, rows = long_pulses(spark)
    got = R.pulse_snippets(s, pulses, 1, 1)
    assert sent(got) == 0
    last, n = {}, 0
    for _, c, b, _, start, end in rows:
        last[c, b] = max(last.get((c, b), 0), end - start + 2)
    want = {(c, start): np.concatenate([xs[c, start - 1 : end + 2], np.full(last[c, b] - (end - start + 2), xs[c, end + 1])]) for _, c, b, _, start, end in rows if start > 0 and end + 1 < 9000}
    for r in got.groupBy("channel", "pulse").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("v")).toLocalIterator():
        x = np.array([np.nan if v.value is None else v.value for v in r.v])
        assert [v.pos for v in r.v] == list(range(len(x))) and np.array_equal(x, want[r.channel, r.pulse], equal_nan=True)
        n += 1
    assert n == len(want)
    gap = R.pulse_snippets(s.where("sample not between 200 and 210"), pulses.where("pulse = 190"), 1, 1)
    assert gap.where("pos between 11 and 21").count() == 0 and gap.count() == sum(last[c, 9] + 1 - 11 for _, c, _, at, _, _ in rows if at == 190)


def test_artifacts_of_pulses_are_taken_out_where_their_samples_are(spark):
    _, s, pulses, _ = long_pulses(spark)
    got = R.pulse_artifacts(s, pulses, 1, 1, 1, 2)
    assert sent(got) == 0
    want = R.remove_artifacts_pca(R.pulse_snippets(s, pulses, 1, 1), 1, 2).select("channel", "pulse", "pos", F.col("value").alias("w"))
    r = got.join(want, ["channel", "pulse", "pos"], "full").agg(F.max(F.abs(F.col("value") - F.col("w"))).alias("far"), F.count("value").alias("n"), F.count("w").alias("m"), F.count("*").alias("k")).first()
    assert r.far < 1e-9 and r.n == r.m == r.k > 500_000


@pytest.mark.parametrize("size", [64, 1 << 14])
def test_local_templates_of_pulses_are_taken_off_where_their_samples_are(spark, size):
    from pyspark.sql.window import Window

    _, s, pulses, _ = long_pulses(spark)
    got = R.pulse_template_parts(s, pulses, 1, 1, 4, size=size)
    assert sent(got) == 0
    snips = R.pulse_snippets(s, pulses, 1, 1).withColumn("is_first", F.col("pulse") == F.min("pulse").over(Window.partitionBy("session", "channel", "block")))
    keys = ["channel", "pulse", "pos", "is_first"]
    want = R.template_parts(snips, 4).select(*keys, F.col("value").alias("w"), F.col("template").alias("t"))
    r = got.join(want, keys, "full").agg(F.max(F.abs(F.col("value") - F.col("w"))).alias("far"), F.max(F.abs(F.col("template") - F.col("t"))).alias("off"), F.count("value").alias("n"), F.count("w").alias("m"), F.count("template").alias("k"), F.count("t").alias("l")).first()
    assert r.far < 1e-9 and r.off < 1e-9 and r.n == r.m > 500_000 and r.k == r.l


def test_gaps_are_filled_inside_the_blocks(spark, monkeypatch):
    def no_frames(*a, **b):
        raise AssertionError("the whole signal is sorted to fill its gaps")

    monkeypatch.setattr(L.B, "around", no_frames)
    rng = np.random.default_rng(23)
    n, by = 900, ["session", "channel"]
    x = rng.normal(size=n).cumsum()
    lost = np.zeros(n, dtype=bool)
    for a, z in ((0, 70), (200, 201), (300, 520), (640, 700), (850, n)):  # at both ends, and longer than blocks of 64
        lost[a:z] = True
    rows = [("s", c, i, None if c == 1 or lost[i] else float(x[i])) for c in (0, 1) for i in range(n)]
    d = spark.createDataFrame(rows, "session string, channel int, sample long, value double")
    i = np.arange(n)
    line = np.interp(i, i[~lost], x[~lost])
    gain, p, r = L.poles("stop", (58.0, 62.0), 1000.0, 2)
    h = (r @ p[:, None] ** i[None, :]).real
    want = {
        "notch": (L.notch(d, 1000.0, by, size=64), gain * line + np.convolve(line, h)[:n]),
        "mean": (L.filtered(d, by, lambda v: np.convolve(v, np.ones(11), "same"), 40, 64), np.convolve(line, np.ones(11), "same")),
    }
    for name, (got, y) in want.items():
        seen = {(s.channel, s.sample): s.value for s in got.collect()}
        assert len(seen) == 2 * n, name
        assert all(seen[1, j] is None for j in range(n)), name
        assert all(seen[0, j] is None if lost[j] else abs(seen[0, j] - y[j]) < 1e-8 for j in range(n)), name
