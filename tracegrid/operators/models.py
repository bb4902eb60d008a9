"""Models between channels, from sums of products that tasks gather: no row of the data reaches the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .lineage import written

#: Bytes of sums that a task holds before it hands them on.
HELD = 64 << 20


def vectors(long: DataFrame, by: list[str], channel: str = "channel", value: str = "value") -> DataFrame:
    """by and x: the values of each key in the order of their channels."""
    return long.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(channel, F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("x"))


def grams(df: DataFrame, by: list[str], width: int) -> DataFrame:
    """by, n, mean (an array) and gram (doubles as bytes, width by width): the sums of products of the centred vectors x of each
    group. Vectors of another width, or with missing entries, don't count."""
    x = F.col("x")
    d = df.where((F.size(x) == width) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v))).select(*by, "x")
    each = d.select(*by, F.posexplode("x").alias("_p", "_v")).groupBy(*by, "_p").agg(F.avg("_v").alias("_m"))
    mean = written(each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias("mean")), "means")
    schema = T.StructType([*(df.schema[c] for c in by), T.StructField("n", T.LongType()), T.StructField("gram", T.BinaryType())])

    def out(sums: dict) -> pa.RecordBatch:
        keys = list(sums)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds[0])]
        return pa.RecordBatch.from_arrays([*columns, pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([sums[k][1].tobytes() for k in keys], pa.binary())], schema.names)

    kinds: list = []

    def part(batches):
        sums: dict = {}
        for b in batches:
            kinds[:] = [[b.column(i).type for i in range(len(by))]]
            keys = list(zip(*(b.column(i).to_pylist() for i in range(len(by)))))
            c = b.column(len(by)).flatten().to_numpy().reshape(-1, width) - b.column(len(by) + 1).flatten().to_numpy().reshape(-1, width)
            rows: dict = {}
            for i, k in enumerate(keys):
                rows.setdefault(k, []).append(i)
            for k, own in rows.items():
                n, g = sums.get(k, (0, 0.0))
                sums[k] = (n + len(own), g + c[own].T @ c[own])
            if len(sums) * width * width * 8 > HELD:
                yield out(sums)
                sums = {}
        if sums:
            yield out(sums)

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(g) for g in t.column("gram").to_pylist())
        row = t.select(by).slice(0, 1)
        return row.append_column("n", pa.array([sum(t.column("n").to_pylist())], pa.int64())).append_column("gram", pa.array([total.tobytes()], pa.binary()))

    parts = d.join(mean, by).select(*by, "x", "mean").mapInArrow(part, schema)
    some = parts.withColumn("_s", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy(*by, "_s").applyInArrow(lambda t: add(t), schema)
    return some.groupBy(*by).applyInArrow(lambda t: add(t), schema).join(mean, by).select(*by, "n", "mean", "gram")


def factor_em(s: np.ndarray, k: int, turns: int = 2000, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Loadings and noise of a factor model of a covariance matrix by expectation and maximisation, turned to its principal axes;
    each factor's largest loading is positive."""
    values, v = np.linalg.eigh(s)
    load, noise, last = v[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 1e-12)), np.maximum(np.diag(s) / 2, 1e-12), np.inf
    for _ in range(turns):
        beta = load.T @ np.linalg.inv(load @ load.T + np.diag(noise))
        second = np.eye(k) - beta @ load + beta @ s @ beta.T
        load = s @ beta.T @ np.linalg.inv(second)
        noise = np.maximum(np.diag(s - load @ beta @ s), 1e-12)
        model = load @ load.T + np.diag(noise)
        score = np.linalg.slogdet(model)[1] + np.trace(np.linalg.solve(model, s))
        if abs(last - score) < tolerance:
            break
        last = score
    load = load @ np.linalg.svd(load, full_matrices=False)[2].T
    return load * np.where(load[np.abs(load).argmax(axis=0), range(k)] < 0, -1, 1), noise


def matched(df: DataFrame, by: list[str], key: str, seed: int = 0) -> DataFrame:
    """As many rows of each group as the smallest has, those with the least hash of key and seed (then the least key)."""
    least = df.groupBy(*by).count().agg(F.min("count")).first()[0] or 0
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= least).drop("_r")


def factor_groups(df: DataFrame, by: list[str], key: str, k: int = 2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Factor models of each group's vectors x, on matched numbers of rows, and the rows' projections.

    Models: by, channel, l1 to lk and noise, of the correlations (a channel without spread has no loading). Scores: by, key and p1 to
    pk, the vectors times the loadings. Every group is a matrix of channels by channels in one task, however many rows it has."""
    d = written(matched(df.where("x is not null").select(*by, key, "x"), by, key, seed), "matched")
    width = d.agg(F.max(F.size("x"))).first()[0] or 0
    schema = T.StructType([*(df.schema[c] for c in by), T.StructField("channel", T.IntegerType()), *(T.StructField(f"l{i + 1}", T.DoubleType()) for i in range(k)), T.StructField("noise", T.DoubleType())])

    def model(t: pa.Table) -> pa.Table:
        s = np.frombuffer(t.column("gram")[0].as_buffer()).reshape(width, width) / t.column("n")[0].as_py()
        sd = np.sqrt(np.diag(s))
        some = np.flatnonzero(sd > 0)
        load, noise = np.zeros((width, k)), np.zeros(width)
        if len(some):
            f, n = factor_em(s[np.ix_(some, some)] / np.outer(sd[some], sd[some]), min(k, len(some)))
            load[some, : f.shape[1]], noise[some] = f, n
        columns = [pa.array(np.arange(width, dtype=np.int32)), *(pa.array(load[:, i].copy()) for i in range(k)), pa.array(noise)]
        rows = t.select(by).take(pa.array(np.zeros(width, dtype=np.int64)))
        for name, c in zip(schema.names[len(by) :], columns):
            rows = rows.append_column(name, c)
        return rows

    models = written(grams(d, by, width).groupBy(*by).applyInArrow(model, schema), "loadings")
    load = lambda i: F.transform(F.sort_array(F.collect_list(F.struct("channel", F.col(f"l{i + 1}").alias("l")))), lambda s: s["l"])
    loads = models.groupBy(*by).agg(*(load(i).alias(f"_l{i}") for i in range(k)))
    dot = lambda i: F.aggregate(F.zip_with("x", f"_l{i}", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return models, d.join(loads, by).select(*by, key, *(dot(i).alias(f"p{i + 1}") for i in range(k)))
