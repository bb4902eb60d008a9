"""Mixing sources to target weights by soft domain membership.

A multinomial naive Bayes model over hashed words, trained on labelled rows, gives each whole
text a posterior over the domains of the labelled table: high, low and toxic. Projected
gradient steps then fit a nonnegative rate for every document so that the expected
tokens of each domain meet its target; a step needs one distributed sum of as many numbers as domains.

The gradient is taken in the metric of the inverse token matrix, in which the problem has
condition 1 as long as few rates are at their bound. What is open after some steps is closed by
last steps whose length in each domain is exact: Newton's method on the dual, which has as many unknowns as
domains, for the rates nearest to those so far, with a weight on what they leave open that grows a thousandfold each time. Targets
that no rates meet (of a domain that no document has) so get the rates of least squares, and a warning with what stays open.

In a pipeline the filters before may have removed a domain, so the stage moves each domain's share
towards its target by at most a quarter of the share: mixing weights documents, it isn't a filter.
The model is fitted on at most about max_labelled
labelled rows (a documented bound), picked by a hash over all of them.

Defined cases: a null or empty text has no tokens, the prior as posterior and rate 1; rows
without an id have no rate (the stage keeps each of them once); rows that repeat an id are one document with all their words;
without labels all domains have the same posterior; labels that don't tell a domain (quality unknown, not toxic) are ignored;
an empty table gives an empty result; other columns aren't read, and the stage keeps them whatever their names.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import finished, fresh, materialize, table

DOMAINS = ("high", "low", "toxic")
TARGETS = {"high": 0.85, "low": 0.1, "toxic": 0.05}
#: For documents that filters have been through: how far a domain's share may move, as a part of the share.
STAGE_MOVE = 0.25
SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def bucket(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def labelled(labels: DataFrame, max_labelled: int) -> DataFrame:
    """doc_id and domain of at most 2 * max_labelled rows."""
    rows = labels.where("doc_id is not null and (quality is not null or toxic = 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x"))
    n = rows.count()
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1, max_labelled / max(n, 1))))).limit(2 * max_labelled)
    return rows.select("doc_id", F.when(F.col("x") == 1, "toxic").when(F.col("q") == 0, "low").otherwise("high").alias("domain"))


def train(docs: DataFrame, labels: DataFrame, *, buckets: int = 4096, max_labelled: int = 20_000) -> tuple[DataFrame, dict[str, float], dict[str, float]]:
    """Log likelihoods of each word bucket (one row for each), those of unseen words, and log priors."""
    lab = labelled(labels, max_labelled)
    seen = docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id")
    priors = {r.domain: r["count"] for r in lab.groupBy("domain").count().collect()}
    n = sum(priors.values())
    counts = seen.select("domain", F.explode(words(F.col("text"))).alias("w")).groupBy(bucket(F.col("w"), buckets).alias("b")).agg(*(F.sum((F.col("domain") == d).cast("long")).alias(d) for d in DOMAINS))
    counts = materialize(counts, "mix-counts")
    totals = counts.agg(*(F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DOMAINS)).first()
    weights = counts.select("b", *(F.log((F.col(d) + 0.5) / F.lit(totals[d] + 0.5 * buckets)).alias(d) for d in DOMAINS))
    unseen = {d: math.log(0.5 / (totals[d] + 0.5 * buckets)) for d in DOMAINS}
    return weights, unseen, {d: math.log((priors.get(d, 0) + 1) / (n + len(DOMAINS))) for d in DOMAINS}


def posteriors(docs: DataFrame, labels: DataFrame, *, buckets: int = 4096, **training) -> DataFrame:
    """doc_id, n_tokens and a posterior of each domain, from all words of the text."""
    weights, unseen, prior = train(docs, labels, buckets=buckets, **training)
    each = docs.where("doc_id is not null").select("doc_id", F.explode_outer(words(F.col("text"))).alias("w")).withColumn("b", bucket(F.col("w"), buckets))
    # The right side has one row for each bucket at most, whatever the data.
    found = each.join(F.broadcast(weights), "b", "left")
    has = F.col("w").isNotNull()
    sums = found.groupBy("doc_id").agg(F.count("w").alias("n_tokens"), *(F.sum(F.when(has, F.coalesce(F.col(d), F.lit(unseen[d]))).otherwise(0.0)).alias(d) for d in DOMAINS))
    logs = sums.select("doc_id", "n_tokens", *((F.col(d) + F.lit(prior[d])).alias(d) for d in DOMAINS))
    top = F.greatest(*DOMAINS)
    raised = logs.select("doc_id", "n_tokens", *(F.exp(F.col(d) - top).alias(d) for d in DOMAINS))
    whole = sum((F.col(d) for d in DOMAINS), F.lit(0.0))
    return raised.select("doc_id", "n_tokens", *((F.col(d) / whole).alias(d) for d in DOMAINS))


def reachable(targets: dict[str, float], shares: dict[str, float], move: float) -> dict[str, float]:
    """Targets in proportion, but each within move times the domain's own share of that share. Both sum to 1 where anything is there."""
    whole = sum(shares.values())
    if not whole:
        return targets
    own = {d: shares[d] / whole for d in targets}
    bound = lambda scale: {d: min((1 + move) * own[d], max((1 - move) * own[d], scale * targets[d])) for d in targets}
    low, high = 0.0, 1.0
    while sum(bound(high).values()) < 1 and high < 1e12:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(bound(middle).values()) < 1 else (low, middle)
    found = bound(high)
    return {d: x / sum(found.values()) for d, x in found.items()}


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, *, steps: int = 10, tolerance: float = 1e-6, ridge: float = 1e-5, evaluations: int = 60, move: float | None = None) -> DataFrame:
    """members with rate, 0 or more: the fitted number of times that each document is to be read.

    steps: gradient steps before the exact ones, which end after so many evaluations with a warning and the shares that stay open.
    ridge: share of the matrix's trace that keeps steps small towards domains that hardly any document has.
    move: bounds the targets by the domains' own shares, see reachable."""
    names = list(targets)
    members = materialize(members, "mix-members").withColumn("rate", F.lit(1.0))
    t = F.col("n_tokens").cast("double")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]

    def square(first) -> np.ndarray:
        matrix = np.zeros((len(names), len(names)))
        for i, j in pairs:
            matrix[i, j] = matrix[j, i] = first[f"m{i}_{j}"] or 0.0
        return matrix

    first = members.agg(F.sum(t).alias("all"), *(F.sum(t * F.col(d)).alias(d) for d in names), *(F.sum(t * t * F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i, j in pairs)).first()
    whole = first["all"]
    if not whole:
        return members
    if move is not None:
        targets = reachable(targets, {d: first[d] for d in names}, move)
    matrix = square(first)
    metric = np.linalg.inv(matrix + ridge * np.trace(matrix) * np.eye(len(names)))
    goal = np.array([targets[d] for d in names]) / sum(targets.values()) * whole

    def shifted(e: np.ndarray) -> Column:
        return F.col("rate") - t * sum((F.col(d) * F.lit(float(x)) for d, x in zip(names, e)), F.lit(0.0))

    def clipped(rate: Column) -> Column:
        return F.greatest(F.lit(0.0), rate)

    def with_rate(df: DataFrame, past: list[np.ndarray]) -> DataFrame:
        for e in past:
            df = df.withColumn("rate", clipped(shifted(e)))
        return df

    def gap_of(df: DataFrame) -> np.ndarray:
        got = df.agg(*(F.sum(F.col("rate") * t * F.col(d)).alias(d) for d in names)).first()
        return np.array([got[d] for d in names]) - goal

    def met(gap: np.ndarray) -> bool:
        return np.abs(gap).sum() <= tolerance * whole

    def exact(df: DataFrame) -> np.ndarray:
        """The step from df's rates to the nearest ones of least squares."""
        unit = np.eye(len(names)) * np.trace(matrix) / len(names)

        def at(e: np.ndarray, soft: float):
            d = df.withColumn("_z", shifted(e)).withColumn("_r", clipped(F.col("_z")))
            row = d.agg(F.sum((F.col("_r") - F.col("rate")) ** 2).alias("far"), *(F.sum(F.col("_r") * t * F.col(x)).alias(x) for x in names), *(F.sum(F.when(F.col("_z") > 0, t * t * F.col(names[i]) * F.col(names[j]))).alias(f"m{i}_{j}") for i, j in pairs)).first()
            gap = np.array([row[x] for x in names]) - goal
            weight = soft * unit
            return row["far"] / 2 + e @ gap - e @ weight @ e / 2, gap - weight @ e, square(row) + weight, gap

        e = np.zeros(len(names))
        for soft in (1e-3, 1e-6, 1e-9):
            value, slope, curve, gap = at(e, soft)
            left = evaluations
            while not met(slope) and not met(gap):
                step, part = np.linalg.solve(curve, slope), 1.0
                while True:
                    left -= 1
                    if left < 0:
                        warnings.warn(f"mixing: the fit ends after {evaluations} evaluations", stacklevel=2)
                        return e
                    new = at(e + part * step, soft)
                    if new[0] >= value + 1e-4 * part * (slope @ step) - 1e-12 * abs(value):
                        e, (value, slope, curve, gap) = e + part * step, new
                        break
                    part /= 2
            if met(gap):
                break
        return e

    past: list[np.ndarray] = []
    gap = gap_of(members)
    while not met(gap) and len(past) < steps:
        past.append(metric @ gap)
        gap = gap_of(with_rate(members, past))
    if met(gap):
        return with_rate(members, past)
    members = materialize(with_rate(members, past), "mix-rates")
    fitted = with_rate(members, [exact(members)])
    gap = gap_of(fitted)
    if not met(gap):
        warnings.warn("mixing: shares that stay open: " + ", ".join(f"{d} {(x + g) / whole:.6f} for {x / whole:.6f}" for d, x, g in zip(names, goal, gap)), stacklevel=2)
    return fitted


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, *, move: float | None = None, **params) -> DataFrame:
    return finished(docs.sparkSession, lambda: fit_rates(posteriors(docs, labels, **params), targets, move=move), "mix-result")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with each row as often as its rate says: the whole part, and once more with the probability of the rest (by a
    hash of the id); a row without an id stays once."""
    rates = mix(docs, table(spark, sf_dir, "labels"), move=STAGE_MOVE).select("doc_id", "rate")
    coin = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    name, each = fresh(docs, "copies"), fresh(docs, "copy")
    copies = rates.select("doc_id", F.floor(F.col("rate") + coin).cast("int").alias(name))
    times = F.coalesce(F.col(name), F.lit(1))
    joined = docs.join(copies, "doc_id", "left").where(times > 0)
    return joined.select(*(docs[f"`{c}`"] for c in docs.columns), F.explode(F.sequence(F.lit(1), times)).alias(each)).drop(each)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_tokens", *(F.round(d, 6).alias(f"p_{d}") for d in DOMAINS), F.round("rate", 6).alias("rate"))
