"""Factor models by group and recursive filters against plain NumPy, and gaps longer than blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_signals import FS, frame, recursive, values
from tracegrid.operators import filters as L
from tracegrid.operators import models as Q

KEYS = ["session", "channel"]


def test_factor_models_of_matched_groups(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g, n in ((0, 300), (1, 180), (2, 260)):
        x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, 6)) + rng.normal(size=(n, 6)) * 0.4 + 1000
        x[:, 5] = 7.0  # without spread
        rows += [(g, 1000 * g + i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1, 9998, None), (2, 9999, [1.0, float("nan"), 1.0, 1.0, 1.0, 7.0])]
    df = spark.createDataFrame(rows, "condition int, trial long, x array<double>")
    kept = {r.trial for r in Q.matched(df.where("x is not null"), ["condition"], "trial").collect()}
    models, scores = Q.factor_groups(df, ["condition"], "trial")
    loads = {(r.condition, r.channel): (r.l1, r.l2, r.noise) for r in models.collect()}
    got = {r.trial: (r.p1, r.p2) for r in scores.collect()}
    assert set(got) == kept and len(kept) == 540
    for g in range(3):
        own = [(t, np.array(x)) for c, t, x in rows if c == g and t in kept]
        x = np.array([v for _, v in own if not np.isnan(v).any()])
        load, noise = Q.factor_em(np.corrcoef(x[:, :5].T), 2)
        want = np.vstack([load, [0, 0]])
        assert np.abs(np.array([loads[g, c][:2] for c in range(6)]) - want).max() < 1e-6
        assert np.abs(np.array([loads[g, c][2] for c in range(5)]) - noise).max() < 1e-6
        assert all(np.allclose(got[t], v @ want, rtol=1e-6) for t, v in own if not np.isnan(v).any())
    model, noise = Q.factor_em(np.corrcoef(x[:, :5].T), 2)
    assert np.abs(model @ model.T + np.diag(noise) - np.corrcoef(x[:, :5].T)).max() < 0.1


@pytest.mark.parametrize("kind,cut,order", [("stop", (58.0, 62.0), 2), ("high", 2.0, 4), ("low", 100.0, 3)])
def test_recursive_filters_carry_their_state(spark, kind, cut, order):
    fs, n = 1000.0, 5000
    rng = np.random.default_rng(order)
    t = np.arange(n) / fs
    x = rng.normal(size=n) + 3 + 4 * np.sin(2 * np.pi * 60 * t)
    gain, p, r = f = L.poles(kind, cut, fs, order)
    # The same filter as a difference equation.
    a = np.poly(p).real
    b = gain * a + sum((r[j] * np.pad(np.poly(np.delete(p, j)), (0, 1))) for j in range(len(p))).real
    want = recursive(x, b, a)
    for size in (512, 1 << 17):
        assert np.abs(values(L.recursive(frame(spark, x), f, KEYS, size)) - want).max() < 1e-6
    w = np.exp(2j * np.pi * np.array([1e-9, 2.0, 60.0, 100.0, 400.0, 500.0]) / fs)
    h = np.abs(np.polyval(b, w) / np.polyval(a, w))
    edge = {"stop": (1, 1, 0, 1, 1, 1), "high": (0, 0.5**0.5, 1, 1, 1, 1), "low": (1, 1, None, 0.5**0.5, None, 0)}[kind]
    assert all(e is None or abs(g - e) < 0.02 for g, e in zip(h, edge))
    if kind == "stop":
        late = values(L.notch(frame(spark, 4 * np.sin(2 * np.pi * 60 * t)), fs, KEYS, size=700))[3000:]
        assert np.abs(late).max() < 4 / 3000  # the deepest place is the band's geometric middle, 59.97 Hz: 70 dB down at 60


@pytest.mark.parametrize("filter_", [lambda d, n: L.highpass(d, 300.0, FS, KEYS, size=n), lambda d, n: L.gaussian_filtfilt(d, 8.0, KEYS, size=n), lambda d, n: L.remove_drift(d, 4000.0, KEYS, size=n), lambda d, n: L.lowpass(d, 800.0, FS, KEYS, size=n, reach=1500), lambda d, n: L.notch(d, FS, KEYS, size=n)])
def test_gaps_longer_than_blocks(spark, filter_):
    x = np.random.default_rng(3).normal(size=9000).cumsum()
    x[:40] = x[1900:4700] = x[8990:] = np.nan
    whole = values(filter_(frame(spark, x), 1 << 20))
    cut = values(filter_(frame(spark, x), 1600))
    assert (np.isnan(whole) == np.isnan(x)).all() and (np.isnan(cut) == np.isnan(x)).all()
    assert np.nanmax(np.abs(cut - whole)) < 1e-6
