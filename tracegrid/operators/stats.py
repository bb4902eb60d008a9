"""Bins, statistics across trials, tests and similarity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks as B
from .lineage import written


def bin_counts(peaks: DataFrame, recordings: DataFrame, width: int, by=("session", "channel")) -> DataFrame:
    """Peaks in each bin with zero bins present; the last bin takes what lies beyond. recordings: keys and n_samples."""
    assert width >= 1
    n = recordings.select(*by, F.greatest(F.ceil(F.col("n_samples") / width), F.lit(1)).alias("n_bins"))
    got = peaks.join(n, list(by)).groupBy(*by, F.least(F.floor(F.col("sample") / width), F.col("n_bins") - 1).alias("bin")).agg(F.count("*").alias("n"))
    spine = n.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("bin"))
    return spine.join(got, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("count"))


def across_trials(windows: DataFrame, keys: list[str]) -> DataFrame:
    return windows.groupBy(*keys).agg(F.median("value").alias("median"), F.var_pop("value").alias("variance"), F.count("value").alias("n"))


def mean_sem(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("sem"), F.count("value").alias("n"))


def trial_features(windows: DataFrame, lo: int, hi: int, min_channels: int = 2, min_trials: int = 15, fallback: tuple[int, int] | None = None, skip: tuple = ()) -> DataFrame:
    """Mean of each (trial, channel) in [lo, hi]; trials with few finite features and conditions with few trials are dropped, and so
    are the conditions of skip. A condition none of whose bins, with or without value, is in [lo, hi] takes those of fallback."""
    d = windows.where(~F.col("condition").isin(*skip)) if skip else windows
    inside = F.col("rel_bin").between(lo, hi)
    if fallback is not None:
        has = d.groupBy("condition").agg(F.max(inside).alias("_has"))
        d = d.join(has, "condition")
        inside = F.when(F.col("_has"), inside).otherwise(F.col("rel_bin").between(*fallback))
    f = d.where(inside).groupBy("condition", "trial", "channel").agg(F.avg("value").alias("value")).where("value is not null")
    ok = f.groupBy("condition", "trial").count().where(F.col("count") >= min_channels)
    big = ok.groupBy("condition").agg(F.count("*").alias("n")).where(F.col("n") >= min_trials)
    return f.join(ok.select("condition", "trial"), ["condition", "trial"], "left_semi").join(big, "condition", "left_semi")


def zscore(df: DataFrame, key: str, trial: list[str] | None = None) -> DataFrame:
    """Values by mean and population deviation of their key; a deviation of 0 counts as 1. The statistics
    are aggregated and joined, so that a key with many rows is never one task. With trial (its keys), trials that lack a value
    of any key that has one at all are dropped."""
    s = df.groupBy(key).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    z = df.join(s, key).withColumn("z", (F.col("value") - F.col("m")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).drop("m", "sd")
    if trial is None:
        return z
    # Keys without any value don't count; a row of one number is joined on a constant.
    n = s.where("m is not null").agg(F.count("*").alias("_n"), F.lit(1).alias("_one"))
    whole = df.where("value is not null").groupBy(*trial).agg(F.count_distinct(key).alias("_got")).withColumn("_one", F.lit(1)).join(n, "_one").where("_got = _n")
    return z.where("z is not null").join(whole.select(*trial), trial, "left_semi")


def rsa_blocks(features: DataFrame) -> DataFrame:
    """Mean correlation of the trials of two conditions, without the pairs of trials.

    The correlation of two trials is the dot product of their standardized vectors over the number of channels, so
    the sum over all pairs is the dot product of the condition sums: one aggregation for each condition and channel."""
    t = features.groupBy("condition", "trial").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"), F.count("*").alias("k")).where("sd > 0")
    u = features.join(t, ["condition", "trial"]).withColumn("u", (F.col("value") - F.col("m")) / F.col("sd") / F.sqrt("k"))
    s = u.groupBy("condition", "channel").agg(F.sum("u").alias("s"))
    n = t.groupBy("condition").agg(F.count("*").alias("n"))
    a, b = s.alias("a"), s.alias("b")
    dots = a.join(b, F.col("a.channel") == F.col("b.channel")).where(F.col("a.condition") <= F.col("b.condition")).groupBy(F.col("a.condition").alias("i"), F.col("b.condition").alias("j")).agg(F.sum(F.col("a.s") * F.col("b.s")).alias("dot"))
    ni, nj = n.select(F.col("condition").alias("i"), F.col("n").alias("ni")), n.select(F.col("condition").alias("j"), F.col("n").alias("nj"))
    pairs = F.when(F.col("i") == F.col("j"), F.col("ni") * (F.col("ni") - 1)).otherwise(F.col("ni") * F.col("nj"))
    dot = F.when(F.col("i") == F.col("j"), F.col("dot") - F.col("ni")).otherwise(F.col("dot"))
    return dots.join(ni, "i").join(nj, "j").select("i", "j", F.when(pairs > 0, dot / pairs).alias("similarity"), pairs.alias("pairs"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function by the modified Lentz method."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """P of a Student t value at least as far from 0."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def ttest_vs_baseline(df: DataFrame, baseline: str) -> DataFrame:
    """Pooled two-sample t of each condition against the baseline, with two-sided p and stars; conditions of one value are left out, and without any spread there is no t."""
    s = df.groupBy("condition").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    b = s.where(F.col("condition") == baseline).select(F.col("n").alias("nb"), F.col("m").alias("mb"), F.col("v").alias("vb"), F.lit(1).alias("one"))
    both = s.where(F.col("condition") != baseline).withColumn("one", F.lit(1)).join(b, "one").where("n > 1 and nb > 1")
    pooled = ((F.col("n") - 1) * F.col("v") + (F.col("nb") - 1) * F.col("vb")) / (F.col("n") + F.col("nb") - 2)
    out = both.select("condition", (F.col("n") + F.col("nb") - 2).alias("df"), F.try_divide(F.col("m") - F.col("mb"), F.sqrt(pooled * (1 / F.col("n") + 1 / F.col("nb")))).alias("t"))

    @F.pandas_udf("double")
    def p_value(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([t_two_sided(a, b) for a, b in zip(t.astype(float), df)])

    out = out.withColumn("p", p_value("t", F.col("df").cast("double")))
    return out.withColumn("stars", F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise(""))


def condition_sets(trials: DataFrame, conditions: dict[str, Column], ends: tuple[str, list, int] | None = None, trial: str = "trial") -> DataFrame:
    """condition and trial: the sets that each trial is in, often several. conditions: a name and when a trial belongs. ends: a column, an
    order (columns) and a number: the first and last so many trials of each value of the column are sets of their own, as `value first`."""
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items()))) if conditions else F.array().cast("array<string>")
    out = trials.select(F.explode(names).alias("condition"), trial)
    if ends:
        by, order, n = ends
        turned = [c.desc() for c in order]
        for name, o in (("first", order), ("last", turned)):
            top = trials.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*o))).where(F.col("_r") <= n)
            out = out.unionByName(top.select(F.concat(F.col(by).cast("string"), F.lit(f" {name}")).alias("condition"), trial))
    return out.distinct()


def ttest_sets(trials: DataFrame, sets: DataFrame, baseline: str, trial: str = "trial") -> DataFrame:
    """The test of each set of trials against the baseline's, which may share trials with it; with n and mean."""
    d = sets.join(trials.select(trial, "value"), trial)
    s = d.groupBy("condition").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return ttest_vs_baseline(d, baseline).join(s, "condition")


def interval_stats(events: DataFrame, by: str, at: str, gap: float | None = None, per: float = 1.0) -> DataFrame:
    """Median, mean, deviation, least, most and number of the times between neighbouring events, in units of per ticks of `at`. With gap, also gaps (the times longer
    than gap medians) and lost (the events that would have filled them, one for each further median)."""
    d = B.neighbour(events.select(by, at), [by], at, at, "_b", width=B.WIDTH * max(per, 1.0)).select(by, ((F.col(at) - F.col("_b")) / per).alias("d"))
    d = d if gap is None else written(d, "intervals")
    s = d.groupBy(by).agg(F.median("d").alias("median"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("sd"), F.min("d").alias("least"), F.max("d").alias("most"), F.count("d").alias("n"))
    if gap is None:
        return s
    long = F.col("d") > gap * F.col("median")
    filled = F.when(F.col("median") > 0, F.rint(F.col("d") / F.col("median")) - 1).cast("long")
    g = d.join(s.select(by, "median"), by).groupBy(by).agg(F.count(F.when(long, 1)).alias("gaps"), F.coalesce(F.sum(F.when(long, filled)), F.lit(0)).alias("lost"))
    return s.join(g, by)


def pca(rows: DataFrame, k: int, key: str = "trial") -> tuple[DataFrame, np.ndarray]:
    """Scores of the first k components and their variances. Sums of products are aggregated in Spark; the matrix of
    channels by channels, whose size the number of channels bounds, is decomposed on the driver. Signs: the largest loading is positive."""
    mean = {r.channel: r.m for r in rows.groupBy("channel").agg(F.avg("value").alias("m")).collect()}
    at = {c: i for i, c in enumerate(sorted(mean))}
    m = np.array([mean[c] for c in sorted(mean)])
    size = len(at)
    places = F.create_map(*(x for c, i in at.items() for x in (F.lit(c), F.lit(i)))) if at else None
    vectors = rows.groupBy(key).agg(F.collect_list(F.struct(places[F.col("channel")].alias("i"), F.coalesce(F.col("value"), F.lit(0.0)).alias("v"))).alias("row"))

    def gram(batches):
        total, n = np.zeros((size, size)), 0
        for batch in batches:
            x = np.zeros((batch.num_rows, size))
            for j, row in enumerate(batch.column(0).to_pylist()):
                x[j, [e["i"] for e in row]] = [e["v"] for e in row]
            total, n = total + x.T @ x, n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["g", "n"])

    # A row for each task, of channels by channels; they are added up by place before they come to the driver.
    parts = vectors.select("row").mapInArrow(gram, "g array<double>, n long")
    n = parts.agg(F.sum("n")).first()[0] or 0
    sums = parts.select(F.posexplode("g").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    cov = np.zeros(size * size)
    for r in sums:
        cov[r["at"]] = r["v"] / max(n, 1)
    cov = cov.reshape(size, size)
    values, vectors = np.linalg.eigh(cov - np.outer(m, m))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    load = rows.sparkSession.createDataFrame([(c, float(m[i]), *map(float, vectors[i])) for c, i in at.items()], "channel int, m double, " + ", ".join(f"v{j} double" for j in range(vectors.shape[1])))
    scores = rows.join(F.broadcast(load), "channel").groupBy(key).agg(*(F.sum((F.col("value") - F.col("m")) * F.col(f"v{j}")).alias(f"pc{j + 1}") for j in range(vectors.shape[1])))
    return scores, values


def median_line(windows: DataFrame, trial: list[str], keys: list[str], at: str, lo: int, hi: int) -> DataFrame:
    """Median across trials of values less their trial's median in [lo, hi); trials without values there don't count."""
    base = windows.where((F.col(at) >= lo) & (F.col(at) < hi) & F.col("value").isNotNull()).groupBy(*trial).agg(F.median("value").alias("base"))
    return windows.join(base, trial).groupBy(*keys).agg(F.median(F.col("value") - F.col("base")).alias("median"), F.count("value").alias("n"))


def psth(windows: DataFrame, keys: list[str]) -> DataFrame:
    return windows.groupBy(*keys).agg(F.avg("value").alias("rate"), F.count("value").alias("n"))


def bin_mean(samples: DataFrame, width: int, by: list[str], at: str = "sample", n_bins: int | None = None) -> DataFrame:
    """Mean of each bin from 0 to n_bins - 1, or to each key's last; samples outside are left out and empty bins are null."""
    d = samples.withColumn("bin", F.floor(F.col(at) / width)).where("bin >= 0")
    ends = d.groupBy(*by).agg(F.max("bin").alias("_m") if n_bins is None else F.lit(n_bins - 1).cast("long").alias("_m"))
    got = d.groupBy(*by, "bin").agg(F.avg("value").alias("mean"))
    spine = ends.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m"))).alias("bin"))
    return spine.join(got, [*by, "bin"], "left")


def summarise(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, sample variance and number of values for each key, for the first keys alone, and in all."""
    return df.rollup(*keys).agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance"), F.count("value").alias("n"))


def summarise_metrics(trials: DataFrame, metrics: list[str], side: str, field: str = "field", error: str = "error") -> DataFrame:
    """Mean and sample variance of each metric of a field's trials, for the error those of its absolute value too and n_trials, the
    trials that have one. summary is the name: side_catch_summary for a field catch_..., else side_..._summary by what follows
    stim_ in the field's name (null without it). side: ipsi or contra."""
    each = [f(F.col(m)).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("var", F.var_samp))]
    size = [f(F.abs(error)).alias(f"{error}_abs_{n}") for n, f in (("mean", F.avg), ("var", F.var_samp))]
    at = F.instr(F.col(field), "stim_")
    after = F.when(at > 0, F.substring(F.col(field), at + 5, F.length(field)))
    name = F.when(F.startswith(F.col(field), F.lit("catch_")), f"{side}_catch_summary").otherwise(F.concat(F.lit(f"{side}_"), after, F.lit("_summary")))
    return trials.groupBy(field).agg(F.count(error).alias("n_trials"), *each, *(size if error in metrics else [])).withColumn("summary", name)


def rate_kinematics_corr(df: DataFrame, keys: list[str], at: str, until: int) -> DataFrame:
    """Correlation of the rate (value), as z scores of its key's rows before until, with position."""
    base = df.where(F.col(at) < until).groupBy(*keys).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("sd"))
    d = df.join(base, keys).withColumn("z", (F.col("value") - F.col("m")) / F.nullif("sd", F.lit(0.0)))
    return d.groupBy(*keys).agg(F.corr("z", "position").alias("r"), F.count(F.when(F.col("z").isNotNull() & F.col("position").isNotNull(), 1)).alias("n"))


def snr(df: DataFrame, trial: list[str], keys: list[str], raw: str, clean: str) -> DataFrame:
    """Median across trials of 10 log10 of raw power over the power of what cleaning took away; trials that lost nothing have none."""
    t = df.groupBy(*trial).agg(F.sum(F.col(raw) ** 2).alias("p"), F.sum((F.col(raw) - F.col(clean)) ** 2).alias("q"))
    return t.withColumn("snr", F.when((F.col("q") > 0) & (F.col("p") > 0), 10 * F.log10(F.col("p") / F.col("q")))).groupBy(*keys).agg(F.median("snr").alias("snr"), F.count("snr").alias("n"))


def delay_regression(df: DataFrame, lags: list[int], by: list[str], keys: list[str], at: str = "bin") -> DataFrame:
    """The lag at which y(t) ~ k x1(t + lag) + r x2(t + lag) + b explains most, with k, r, b and the share explained.
    All lags' normal equations are sums of one aggregation; ties go to the smaller lag."""
    x = df.select(*by, F.col(at), "x1", "x2").withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn(at, F.col(at) - F.col("lag"))
    d = df.select(*dict.fromkeys([*by, *keys]), at, "y").join(x, [*by, at]).where("x1 is not null and x2 is not null and y is not null")
    cov = lambda a, b: F.covar_pop(a, b)
    s = d.groupBy(*keys, "lag").agg(cov("x1", "x1").alias("aa"), cov("x1", "x2").alias("ab"), cov("x2", "x2").alias("bb"), cov("x1", "y").alias("ay"), cov("x2", "y").alias("by"), cov("y", "y").alias("yy"), F.avg("x1").alias("mx1"), F.avg("x2").alias("mx2"), F.avg("y").alias("my"))
    det = F.col("aa") * F.col("bb") - F.col("ab") ** 2
    s = s.where((det > 0) & (F.col("yy") > 0)).withColumns({"k": (F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / det, "r": (F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / det})
    s = s.withColumns({"b": F.col("my") - F.col("k") * F.col("mx1") - F.col("r") * F.col("mx2"), "vaf": (F.col("k") * F.col("ay") + F.col("r") * F.col("by")) / F.col("yy")})
    best = F.max_by(F.struct("lag", "k", "r", "b", "vaf"), F.struct(F.round("vaf", 12), -F.col("lag")))
    return s.groupBy(*keys).agg(best.alias("m")).select(*keys, "m.*")
