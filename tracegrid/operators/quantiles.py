"""Exact quantiles of keys of any size: a sketch gives two values around each wanted rank, and exact counts tell where it lies.

No task holds more than sketches, a few counts for each key, or in the end few values: a buffer of every different value, as
the built-in percentile keeps, isn't needed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import written

CUTS = 256
FEW = 4096


def quantiles(df: DataFrame, by: Sequence[str], shares: dict[str, float], value: str = "value", *, cuts: int = CUTS, few: int = FEW) -> DataFrame:
    """by and a column for each name in shares: that quantile, linear between neighbours. Missing values and NaN don't count, and a
    key without others has no row.

    A pass takes cuts approximate quantiles of the values that may have a rank, and the two around it; those below, between and
    above them, and their equals, are counted, and the rank goes on with the part that it lies in. Once at most few values are
    left for each rank they are sorted, as they are at once where no key has more."""
    by = list(by)
    d = df.select(*by, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_v")).where("_v is not null")
    at = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in shares.items()}
    most = d.groupBy(*by).count().agg(F.max("count")).first()[0]
    if (most or 0) <= few:
        lists = d.groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_all"), F.count("*").alias("_n"))
        side = lambda f, h: F.get("_all", f(h).cast("int"))
        return lists.select(*by, *((side(F.floor, h) + (side(F.ceil, h) - side(F.floor, h)) * (h - F.floor(h))).alias(n) for n, h in at.items()))
    d = written(d, "values")
    whole = d.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = F.array(*(F.struct(F.lit(name).alias("name"), side.cast("long").alias("rank")) for name, h in at.items() for side in (F.floor(h), F.ceil(h))))
    found = [*by, "_name", "_rank"]
    open_ = whole.select(*by, F.explode(F.array_distinct(ranks)).alias("_r"), "_n", "_lo", "_hi").select(*by, F.col("_r.name").alias("_name"), F.col("_r.rank").alias("_rank"), F.col("_r.rank").alias("_left"), "_n", "_lo", "_hi")
    open_ = written(open_, "ranks")
    while True:
        wide = open_.where((F.col("_n") > few) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():
            break
        hit = d.join(wide, by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        q = F.percentile_approx("_v", F.array(*(F.lit(i / cuts) for i in range(cuts + 1))), F.lit(8 * cuts))
        near = F.floor((F.col("_left") + 0.5) / F.col("_n") * cuts).cast("int")
        around = hit.groupBy(*found, "_left", "_n").agg(q.alias("_q")).select(*found, F.get("_q", F.greatest(near - 1, F.lit(0))).alias("_a"), F.get("_q", F.least(near + 2, F.lit(cuts))).alias("_z"))
        zone = F.when(F.col("_v") < F.col("_a"), 0).when(F.col("_v") == F.col("_a"), 1).when(F.col("_v") < F.col("_z"), 2).when(F.col("_v") == F.col("_z"), 3).otherwise(4)
        hit = hit.drop("_n", "_lo", "_hi").join(around, found).withColumn("_b", zone)
        counts = hit.groupBy(*found, "_left", "_b").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.sum("_n").over(Window.partitionBy(*found).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
        inner = counts.withColumn("_before", before).where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_n")))
        inner = inner.withColumn("_left", F.col("_left") - F.col("_before")).select(*open_.columns)
        open_ = written(open_.where((F.col("_n") <= few) | (F.col("_lo") >= F.col("_hi"))).unionByName(inner), "ranks")
    alone = open_.where(F.col("_lo") >= F.col("_hi")).select(*found, F.col("_lo").alias("_x"))
    rest = d.join(open_.where(F.col("_lo") < F.col("_hi")).drop("_n"), by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    rest = rest.groupBy(*found).agg(F.sort_array(F.collect_list("_v")).alias("_all"), F.first("_left").alias("_left")).select(*found, F.get("_all", F.col("_left").cast("int")).alias("_x"))
    x = alone.unionByName(rest).join(whole.select(*by, "_n"), by)
    out = []
    for name, h in at.items():
        low, high = (F.max(F.when((F.col("_name") == name) & (F.col("_rank") == side.cast("long")), F.col("_x"))) for side in (F.floor(h), F.ceil(h)))
        out += [low.alias(f"_{name}_a"), high.alias(f"_{name}_z")]
    got = x.groupBy(*by, "_n").agg(*out)
    return got.select(*by, *((F.col(f"_{n}_a") + (F.col(f"_{n}_z") - F.col(f"_{n}_a")) * (h - F.floor(h))).alias(n) for n, h in at.items()))
