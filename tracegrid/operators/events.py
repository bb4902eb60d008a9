"""Edges, pulses, blocks and peaks: gaps and islands over sampled signals.

Signals have the keys `by`, a running `sample` and a `value`; missing values are null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .lineage import written
from .quantiles import quantiles

BY = ("session", "channel")
#: Runs of events that are worked on together.
RUNS = 1024


def rising_edges_hysteresis(df: DataFrame, by=BY, points: int | None = None, width: float = B.WIDTH) -> DataFrame:
    """Samples where the state turns on: on at hi and above, off at lo and below, kept between. lo is the middle
    of the range of all samples, or of every (n // points)-th where points are given as in the reference; hi is
    the middle of lo and the top. A constant signal has none."""
    sub = df
    if points is not None:
        n = df.groupBy(*by).agg(F.count("*").alias("n"))
        sub = df.join(n, list(by)).where(F.col("sample") % F.greatest(F.lit(1), F.floor(F.col("n") / points)) == 0)
    limits = sub.groupBy(*by).agg(F.min("value").alias("least"), F.max("value").alias("most")).select(*by, ((F.col("least") + F.col("most")) / 2).alias("lo"), "most")
    limits = limits.select(*by, "lo", ((F.col("lo") + F.col("most")) / 2).alias("hi")).where("hi > lo")
    s = df.join(limits, list(by)).withColumn("state", F.when(F.col("value") >= F.col("hi"), 1).when(F.col("value") <= F.col("lo"), 0)).where("state is not null")
    return B.neighbour(s, list(by), "sample", "state", "before", width=width).where("state = 1 and coalesce(before, 0) = 0").select(*by, "sample")


def edges(df: DataFrame, threshold: float, by=BY, rising: bool = True, width: float = B.WIDTH) -> DataFrame:
    """Samples where the signal goes above the threshold (or, falling, to it or below)."""
    d = df.where("value is not null").withColumn("high", (F.col("value") > threshold).cast("int"))
    return B.neighbour(d, list(by), "sample", "high", "before", width=width).where(F.col("high") - F.col("before") == (1 if rising else -1)).select(*by, "sample")


def falling_edges(df: DataFrame, refractory: int = 1, by=BY, width: float = B.WIDTH) -> DataFrame:
    """Falls through the middle of the signal's range, at least refractory after the last kept one. Missing values are taken
    out first, and samples (counted from 0) are those of what remains."""
    d = B.running(df.where("value is not null"), list(by), "sample", F.lit(1), "n", width=width).withColumn("sample", F.col("n") - 1)
    mid = d.groupBy(*by).agg(((F.min("value") + F.max("value")) / 2).alias("mid"))
    d = d.join(mid, list(by)).withColumn("high", (F.col("value") > F.col("mid")).cast("int"))
    falls = B.neighbour(d, list(by), "sample", "high", "before", width=width).where("high = 0 and before = 1").select(*by, "sample")
    falls = written(falls, "falls")
    return refractory_greedy(falls, refractory, by, "sample", width)


def burst_starts(events: DataFrame, gap: float, by=BY, at: str = "t_ms", inclusive: bool = False, width: float = B.WIDTH) -> DataFrame:
    """Events more than gap (or at least gap) after the one before, and the first of each key."""
    d = F.col(at) - F.col("before")
    far = (d >= gap) if inclusive else (d > gap)
    return B.neighbour(events, list(by), at, at, "before", width=width).where(F.col("before").isNull() | far).select(*by, at)


def refractory_greedy(events: DataFrame, gap: float, by=BY, at: str = "t_ms", width: float = B.WIDTH) -> DataFrame:
    """Events at least gap after the last kept one. Runs in which no neighbours are that far apart
    are independent, so each run is a group of its own."""
    new = F.coalesce((F.col(at) - F.col("before") >= gap).cast("int"), F.lit(1))
    runs = B.running(B.neighbour(events.select(*by, at), list(by), at, at, "before", width=width), list(by), at, new, "run", width=width).drop("before")

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at, ignore_index=True)
        t, keep, i = pdf[at].to_numpy(), [], 0
        while i < len(t):
            keep.append(i)
            i = max(int(np.searchsorted(t, t[i] + gap, side="left")), i + 1)
        return pdf.iloc[keep]

    return runs.groupBy(*by, "run").applyInPandas(thin, runs.schema).drop("run")


def first_active(df: DataFrame) -> DataFrame:
    """The signal of each session's first channel that is ever off zero."""
    first = df.where("value != 0").groupBy("session").agg(F.min("channel").alias("channel"))
    return df.join(first, ["session", "channel"], "left_semi")


def pulses(df: DataFrame, by=BY, width: float = B.WIDTH) -> DataFrame:
    """start, end and size of biphasic pulses off a zero base.

    A signal falls and rises twice in a pulse. Each fall's phase ends at the first zero from it on. Starts are every
    second fall (or rise, where the rises are more), ends the second, fourth and so on of the phase ends; pairs go on
    as long as both lists do."""
    d = B.neighbour(df.where("value is not null"), list(by), "sample", "value", "before", width=width)
    zero = F.when(F.col("value") == 0, F.struct(F.col("sample").alias("s")))
    d = B.known(d, list(by), "sample", zero, "zero", after=True, width=width).select(*by, "sample", F.signum(F.col("value") - F.col("before")).alias("turn"), F.col("zero.s").alias("end"))
    d = written(d.where("turn != 0"), "turns")
    hits = {"falls": F.col("turn") < 0, "rises": F.col("turn") > 0, "ends": (F.col("turn") < 0) & F.col("end").isNotNull()}
    d = written(B.running(d, list(by), "sample", {n: h.cast("long") for n, h in hits.items()}, width=width), "turns")
    more = d.groupBy(*by).agg((F.max("rises") > F.max("falls")).alias("more"))
    d = d.join(more, list(by))
    starts = d.where(F.when(F.col("more"), F.col("turn") > 0).otherwise(F.col("turn") < 0)).select(*by, F.col("sample").alias("start"), F.when(F.col("more"), F.col("rises")).otherwise(F.col("falls")).alias("n")).where("n % 2 = 1")
    ends = d.where("turn < 0 and end is not null and ends % 2 = 0").select(*by, "end", (F.col("ends") - 1).alias("n"))
    return starts.join(ends, [*by, "n"]).select(*by, "start", "end", (F.col("end") - F.col("start")).alias("size"))


def pulse_blocks(p: DataFrame, by=BY, factor: int = 50, width: float = B.WIDTH) -> DataFrame:
    """Blocks of pulses: a new one where starts are more than factor median pulse sizes apart."""
    p = written(p, "pulses")
    m = p.groupBy(*by).agg(F.median("size").cast("long").alias("m"))
    d = B.neighbour(p, list(by), "start", "start", "before", width=width).join(m, list(by))
    new = F.coalesce((F.col("start") - F.col("before") > factor * F.col("m")).cast("long"), F.lit(1).cast("long"))
    d = B.running(written(d.select(*by, "start", "end", new.alias("_new")), "pulses"), list(by), "start", F.col("_new"), "block", width=width)
    return d.groupBy(*by, "block").agg(F.min("start").alias("start"), F.max_by("end", "start").alias("end"), F.count("*").alias("pulses"))


def stim_channels(df: DataFrame, eps: float = 0.0, min_edges: int = 1, by=BY) -> DataFrame:
    """Keys with at least min_edges rises over the middle of their 5th and 95th percentile."""
    q = quantiles(df, by, {"low": 0.05, "high": 0.95}).select(*by, ((F.col("low") + F.col("high")) / 2 + eps).alias("thr"))
    d = df.where("value is not null").join(q, list(by)).withColumn("high", (F.col("value") > F.col("thr")).cast("int"))
    return B.neighbour(d, list(by), "sample", "high", "before").where("high = 1 and before = 0").groupBy(*by).agg(F.count("*").alias("n_edges")).where(F.col("n_edges") >= min_edges)


def busiest_channel(df: DataFrame) -> DataFrame:
    """The channel of each session with the largest population deviation, the first of equals."""
    s = df.groupBy("session", "channel").agg(F.round(F.stddev_pop("value"), 9).alias("sd")).where("sd is not null")
    return s.groupBy("session").agg(F.min_by("channel", F.struct(-F.col("sd"), "channel")).alias("channel"), F.max("sd").alias("sd"))


def noise_levels(df: DataFrame, by=BY) -> DataFrame:
    """Exact median and scaled median deviation of each key."""
    med = written(quantiles(df, by, {"med": 0.5}), "medians")
    dev = quantiles(df.join(med, list(by)).withColumn("value", F.abs(F.col("value") - F.col("med"))), by, {"mad": 0.5})
    return med.join(dev, list(by)).select(*by, "med", (F.col("mad") / 0.6744897501960817).alias("noise"))


def detect_peaks(df: DataFrame, threshold: float = 3.0, sign: str = "neg", by=BY) -> DataFrame:
    """Local extremes beyond threshold noise levels from the median: strictly beyond the sample before, at least as far as the one after."""
    d = df.where("value is not null").join(noise_levels(df, by), list(by)).withColumn("x", F.col("value") - F.col("med"))
    d = B.beside(d, list(by), "sample", "x", "b", "a")
    far = threshold * F.col("noise")
    low = (F.col("x") < -far) & (F.col("x") < F.coalesce("b", F.lit(float("inf")))) & (F.col("x") <= F.coalesce("a", F.lit(float("inf"))))
    high = (F.col("x") > far) & (F.col("x") > F.coalesce("b", F.lit(-float("inf")))) & (F.col("x") >= F.coalesce("a", F.lit(-float("inf"))))
    return d.where({"neg": low, "pos": high, "both": low | high}[sign]).select(*by, "sample", "t_ms", F.col("value").alias("amplitude"))


def dedup_peaks(peaks: DataFrame, gap: int, span: int, by=BY, width: float = B.WIDTH) -> DataFrame:
    """The strongest peak (the first of equals) of each cluster: neighbours at most gap apart, and all at most span from the cluster's start."""
    d = B.neighbour(peaks, list(by), "sample", "sample", "_b", width=width)
    new = F.coalesce((F.col("sample") - F.col("_b") > gap).cast("long"), F.lit(1).cast("long"))
    runs = B.running(d, list(by), "sample", new, "run", width=width).drop("_b")

    names = runs.columns

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample", ignore_index=True)
        at, run, cluster, start = pdf["sample"].to_numpy(), pdf["run"].to_numpy(), np.zeros(len(pdf), dtype=np.int64), 0
        while start < len(at):
            stop = int(min(np.searchsorted(at, at[start] + span, side="right"), np.searchsorted(run, run[start], side="right")))
            cluster[start:stop], start = start, stop
        best = pdf.assign(c=cluster, m=-pdf["amplitude"].abs()).sort_values(["c", "m", "sample"]).drop_duplicates("c")
        return best[names]

    # Most runs are a few peaks long, and a group for each would cost more than its work.
    return runs.groupBy(*by, F.floor(F.col("run") / RUNS)).applyInPandas(split, runs.schema).drop("run")


def local_maxima(df: DataFrame, height: float, by=BY, width: float = B.WIDTH) -> DataFrame:
    """Peaks of at least height: runs of equal values with lower ones on both sides, at their middle sample (the left one of
    two). Missing values are taken out first."""
    keys = list(by)
    d = B.beside(df.where("value is not null"), keys, "sample", "value", "b", "a", width=width)
    # A run is open from a rise to it up to the next change; its last row has another value after it.
    rise = F.when(F.col("b").isNull() | (F.col("b") != F.col("value")), F.struct(F.col("sample").alias("s"), (F.col("b") < F.col("value")).alias("up")))
    d = B.known(d, keys, "sample", rise, "r", width=width).where((F.col("value") >= height) & (F.col("a") < F.col("value")) & F.col("r.up"))
    return d.select(*by, F.floor((F.col("r.s") + F.col("sample")) / 2).alias("sample"), "value")


def still_periods(df: DataFrame, width: int, limit: float, least: int, by=BY, size: int = 1 << 16) -> DataFrame:
    """Runs of at least `least` samples whose moving mean of the absolute value is at most limit. A signal has each sample once."""
    m = B.moving_mean(df, list(by), "sample", F.abs("value"), width // 2, width - width // 2 - 1, "mean", size=size)
    still = written(m.where(F.col("mean") <= limit).select(*by, "sample"), "still")
    return B.islands(still, list(by), "sample", width=size).where(F.col("n") >= least)


def still_windows(periods: DataFrame, length: int, step: int, by=BY) -> DataFrame:
    """start and end of the windows of length samples, every step, that fit into each still period."""
    d = periods.where(F.col("end") - F.col("start") + 1 >= length)
    d = d.select(*by, F.explode(F.sequence(F.col("start"), F.col("end") - (length - 1), F.lit(step).cast("long"))).alias("start"))
    return d.withColumn("end", F.col("start") + (length - 1))


def first_sign_change(df: DataFrame, lo: int | str, hi: int | str, by=BY) -> DataFrame:
    """The first sample in [lo, hi] (numbers, or columns that hold each key's own) whose sign differs from the one before, by key."""
    lo, hi = (F.col(x) if isinstance(x, str) else F.lit(x) for x in (lo, hi))
    s = df.where(F.col("sample").between(lo, hi) & F.col("value").isNotNull()).withColumn("sign", F.signum("value"))
    return B.neighbour(s, list(by), "sample", "sign", "before").where("sign != before").groupBy(*by).agg(F.min("sample").alias("sample"))


def active_spans(df: DataFrame, width: int, limit: float, by=BY, size: int = 1 << 16) -> DataFrame:
    """Runs where the root mean square of the deviation from the key's mean, over width samples, exceeds limit."""
    keys = list(by)
    d = df.select(*by, "sample", "value").join(df.groupBy(*by).agg(F.avg("value").alias("_a")), keys)
    d = B.moving_mean(d, keys, "sample", F.pow(F.col("value") - F.col("_a"), F.lit(2)), width // 2, width - width // 2 - 1, "mean", size=size)
    active = written(d.where(F.sqrt("mean") > limit).select(*by, "sample"), "active")
    return B.islands(active, keys, "sample", width=size).drop("n")


def mark_first_pulse(pulses: DataFrame, by: list[str], at: str = "start") -> DataFrame:
    """pulses with first (whether each begins its block) and n_pulses (the block's number of pulses); by: the block's keys."""
    s = pulses.groupBy(*by).agg(F.min(at).alias("_s"), F.count("*").alias("n_pulses"))
    return pulses.join(s, list(by)).withColumn("first", F.col(at) == F.col("_s")).drop("_s")
