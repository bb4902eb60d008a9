"""Transforms of binned series and tracks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import blocks as B
from .lineage import written


def baseline_zero(windows: DataFrame, lo: int, hi: int, by: list[str], at: str = "rel_bin", stat: str = "mean", closed: bool = False, missing: str = "null") -> DataFrame:
    """Values less the mean (or the median, by stat) of their key's bins in [lo, hi), or in [lo, hi] if closed. missing says what a
    key without a bin there gets: null values, an error, or its first tenth of bins (at least one) as the baseline. A key whose
    bins there have no value gets nulls. by: the keys of a trial's trace, so that a key is one window long."""
    w = Window.partitionBy(*by)
    bins = (F.col(at) >= lo) & ((F.col(at) <= hi) if closed else (F.col(at) < hi))
    middle = lambda rows: {"mean": F.avg, "median": F.median}[stat](F.when(rows, F.col("value"))).over(w)
    if missing == "null":
        return windows.withColumn("value", F.col("value") - middle(bins))
    d = windows.withColumn("_has", F.max(bins).over(w))
    if missing == "error":
        base = F.when(F.col("_has"), middle(bins)).otherwise(F.raise_error(F.lit("baseline window has no bins")).cast("double"))
    else:
        d = d.withColumns({"_r": F.row_number().over(w.orderBy(at)), "_n": F.count("*").over(w)})
        base = F.when(F.col("_has"), middle(bins)).otherwise(middle(F.col("_r") <= F.greatest(F.lit(1), F.rint(F.col("_n") * 0.1))))
    return d.withColumn("_b", base).withColumn("value", F.col("value") - F.col("_b")).select(*windows.columns)


def smooth_counts(counts: DataFrame, sigma: float, bin_ms: float, by: list[str], blanks: DataFrame | None = None, size: int = 1 << 14) -> DataFrame:
    """Gaussian rates in Hz: weights out to ceil(4 sigma) bins, ends reflected, and bins within that reach of a blank
    one left out and weighed up; a blank bin has no rate. Series of under 4 bins aren't smoothed. A series has each bin from 0
    on; it is filtered in blocks of bins, with twice the reach more on both sides."""
    r = math.ceil(4 * sigma)
    size = max(size, 2 * r)
    taps = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    taps /= taps.sum()
    d = counts.select(*by, "bin", "count")
    if blanks is not None:
        d = d.join(blanks.withColumn("_blank", F.lit(True)), list(blanks.columns), "left")
    else:
        d = d.withColumn("_blank", F.lit(False))
    d = d.withColumn("_blank", F.coalesce("_blank", F.lit(False))).join(d.groupBy(*by).agg(F.count("*").alias("_n")), by)
    schema = T.StructType([*(counts.schema[c] for c in by), counts.schema["bin"], counts.schema["count"], T.StructField("rate_hz", T.DoubleType())])

    def run(t: pa.Table) -> pa.Table:
        lo, n = t.column("block")[0].as_py() * size, t.column("_n")[0].as_py()
        order = np.argsort(t.column("bin").to_numpy())
        at = t.column("bin").to_numpy()[order]
        x, blank = np.zeros(size + 4 * r), np.zeros(size + 4 * r, dtype=bool)
        x[at - lo + 2 * r], blank[at - lo + 2 * r] = t.column("count").to_numpy()[order], t.column("_blank").to_numpy()[order]
        own = order[(at >= lo) & (at < lo + size)]
        k = t.column("bin").to_numpy()[own] - lo
        rate = x[k + 2 * r]
        if n >= 4:
            near = np.concatenate([[0], np.cumsum(blank)])
            ok = np.zeros(len(x))
            ok[r : len(x) - r] = near[2 * r + 1 :] == near[: -2 * r - 1]
            p = np.arange(lo - r, lo + size + r) % (2 * n - 2)
            q = np.where(p >= n, 2 * n - 2 - p, p) - lo + 2 * r
            q = np.clip(q, 0, len(x) - 1)  # beyond the series' end, where no bin looks
            num, den = np.convolve((x * ok)[q], taps, "valid"), np.convolve(ok[q], taps, "valid")
            with np.errstate(invalid="ignore", divide="ignore"):
                rate = np.where(den < 1e-12, 0.0, num / den)[k]
        rate = pa.array(rate * (1000.0 / bin_ms), mask=blank[k + 2 * r])
        return t.select([*by, "bin", "count"]).take(pa.array(own)).append_column("rate_hz", rate)

    return B.halo(d, by, "bin", size, 2 * r).groupBy(*by, "block").applyInArrow(run, schema)


def interpolate_gaps(df: DataFrame, max_gap: int, by: list[str], at: str = "sample", values: tuple[str, ...] = ("value",), width: float = B.WIDTH) -> DataFrame:
    """Inner runs of at most max_gap rows in which any of the values is null, filled linearly."""
    whole = F.lit(True)
    for c in values:
        whole = whole & F.col(c).isNotNull()
    known = F.when(whole, F.struct(F.col(at).alias("i"), *(F.col(c).alias(f"v{k}") for k, c in enumerate(values))))
    d = B.known(B.known(df, by, at, known, "_l", width=width), by, at, known, "_r", after=True, width=width)
    gap = F.col("_r.i") - F.col("_l.i") - 1
    part = (F.col(at) - F.col("_l.i")) / (F.col("_r.i") - F.col("_l.i"))
    fills = {c: F.when(~whole & (gap <= max_gap), F.col(f"_l.v{k}") + (F.col(f"_r.v{k}") - F.col(f"_l.v{k}")) * part).otherwise(F.col(c)) for k, c in enumerate(values)}
    return d.withColumns(fills).drop("_l", "_r")


def remove_teleports(df: DataFrame, by: list[str], at: str = "sample", z: float = 6.0, max_gap: int = 6, width: float = B.WIDTH) -> DataFrame:
    """Tracks (x, y) without leaps: places whose step is an outlier (robust |z| over z, or beyond the upper quartile by six
    spreads of at least 1) are dropped with their neighbours, and short gaps filled."""
    d = B.neighbour(df.withColumn("_p", F.struct("x", "y")), by, at, "_p", "_q", width=width)
    step = F.hypot(F.col("x") - F.col("_q.x"), F.col("y") - F.col("_q.y"))
    first = F.col("_q").isNull() & F.col("x").isNotNull() & F.col("y").isNotNull()
    d = written(d.withColumn("step", F.when(first, 0.0).otherwise(step)).drop("_p", "_q"), "steps")
    q = d.groupBy(*by).agg(F.percentile("step", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    d = d.join(q, by)
    d = d.join(d.groupBy(*by).agg((F.median(F.abs(F.col("step") - F.col("q")[1])) + 1e-12).alias("mad")), by)
    bad = (F.abs(0.6745 * (F.col("step") - F.col("q")[1]) / F.col("mad")) > z) | (F.col("step") > F.col("q")[2] + 6.0 * F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1.0)))
    d = written(d.withColumn("bad", F.coalesce(bad, F.lit(False)).cast("int")).drop("q", "mad"), "steps")
    d = B.neighbour(B.neighbour(d, by, at, "bad", "_b", width=width), by, at, "bad", "_a", after=True, width=width)
    near = F.greatest("bad", F.coalesce("_b", F.lit(0)), F.coalesce("_a", F.lit(0))) == 1
    d = d.withColumns({c: F.when(~near, F.col(c)) for c in ("x", "y")}).select(*df.columns)
    return interpolate_gaps(written(d, "steps"), max_gap, by, at, ("x", "y"), width)


def central_velocity(df: DataFrame, by: list[str], at: str, dt: float, width: float = B.WIDTH) -> DataFrame:
    """Central differences, one-sided at the ends and beside missing values."""
    d, before, after = B.beside(df, by, at, "value", "_b", "_a", width=width), F.col("_b"), F.col("_a")
    v = F.when(before.isNull(), (after - F.col("value")) / dt).when(after.isNull(), (F.col("value") - before) / dt).otherwise((after - before) / (2 * dt))
    return d.withColumn("velocity", v).select(*df.columns, "velocity")


def correct_frames(ocr: DataFrame, by: str, width: float = B.WIDTH) -> DataFrame:
    """Missing frames from the read time step (10 a frame, as text or number, the letter o for zero): running totals and
    corrected numbers. A frame whose text wasn't read (ok is false) carries the totals only."""
    step = F.translate(F.col("delta_t").cast("string"), "oO", "00").try_cast("double")
    read = F.col("ok") if "ok" in ocr.columns else F.lit(True)
    # Steps below 10 give a negative number of frames, which the totals take as it is.
    missing = F.when(read, F.coalesce(F.rint(step / 10.0 - 1.0), F.lit(0.0)).cast("long"))
    d = ocr.withColumn("n_missing", missing)
    none = F.lit(0).cast("long")
    d = B.running(d, [by], "avi", {"total_missing": F.coalesce("n_missing", none), "n_chunks_missing": F.coalesce((F.col("n_missing") > 0).cast("long"), none)}, width=width)
    return d.withColumn("corrected", F.when(read, F.col("avi") + F.col("total_missing")))


def adaptation_sets(trials: DataFrame, by: str, at: str, k: int = 10, catch: Column | None = None, width: float = B.WIDTH) -> DataFrame:
    """Trials with first and last: whether each is of the first or the last k of its key, by the number `at`; a key of fewer has all in
    both. With catch (when a trial is one), catch trials stay as a set of their own and aren't counted among the others."""
    others = trials if catch is None else trials.where(~F.coalesce(catch, F.lit(False)))
    d = B.numbered(others, [by], at, "_i", width=width).join(others.groupBy(by).agg(F.count("*").alias("_n")), by)
    d = d.withColumns({"first": F.col("_i") <= k, "last": F.col("_i") > F.col("_n") - k}).where("first or last").select(*trials.columns, "first", "last")
    if catch is None:
        return d
    caught = trials.where(catch).withColumns({"first": F.lit(False), "last": F.lit(False), "catch": F.lit(True)})
    return d.withColumn("catch", F.lit(False)).unionByName(caught)


def common_reference(samples: DataFrame, by: list[str]) -> DataFrame:
    """Values less the median of all channels at the same sample (by: its keys)."""
    return samples.join(samples.groupBy(*by).agg(F.median("value").alias("_m")), by).withColumn("value", F.col("value") - F.col("_m")).drop("_m")


def zscore_tracks(df: DataFrame, by: list[str]) -> DataFrame:
    """Population z scores of each track; null where a track is constant."""
    s = df.groupBy(*by).agg(F.avg("value").alias("_a"), F.stddev_pop("value").alias("_s"))
    return df.join(s, by).withColumn("value", F.when(F.col("_s") > 0, (F.col("value") - F.col("_a")) / F.col("_s"))).drop("_a", "_s")


def decimate(df: DataFrame, by: list[str], max_points: int, at: str = "sample", width: float = B.WIDTH) -> DataFrame:
    """Every k-th row of a series, k = ceil(n / max_points): a preview of at most max_points rows."""
    n = df.groupBy(*by).agg(F.count("*").alias("_n"))
    d = B.numbered(df, by, at, "_r", width=width).join(n, by)
    return d.where((F.col("_r") - 1) % F.ceil(F.col("_n") / max_points) == 0).drop("_r", "_n")


def downsample(df: DataFrame, by: list[str], every: int, at: str = "sample", width: float = B.WIDTH) -> DataFrame:
    """Rows 1, 1 + every, 1 + 2 every, ... of each series."""
    return B.numbered(df, by, at, "_r", width=width).where((F.col("_r") - 1) % every == 0).drop("_r")


def template_local(snippets: DataFrame, by: list[str], order: str, width: int) -> DataFrame:
    """Snippets less the mean of up to width earlier ones at the same place (by); the first of a place has no template."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-width, -1)
    return snippets.withColumn("template", F.avg("value").over(w)).withColumn("value", F.col("value") - F.coalesce("template", F.lit(0.0)))


def ranked(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """df with each row's place within its key, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def session_offsets(lengths: DataFrame, order: str, n: str = "n_samples", by: list[str] = ()) -> DataFrame:
    """lengths (a row for each session) with start and end: each session's place, end left out, where all follow each other by order."""
    w = Window.partitionBy(*by).orderBy(order)
    ends = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return lengths.withColumn("end", ends).withColumn("start", F.col("end") - F.col(n))
