"""Ordered work on long keys: sorts within blocks of the order column, and small tables that carry over block borders.

A recording of hours is one key. A window over it is one task, so each primitive here sorts blocks of
`width` only, keeps one row for each block, and joins what the blocks before (or after) hand over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 1 << 20


def _blocked(df: DataFrame, at: str, width: float) -> DataFrame:
    return df.withColumn("_k", F.floor(F.col(at) / width))


def known(df: DataFrame, by: list[str], at: str, value: Column, name: str, *, after: bool = False, own: bool = True, width: float = WIDTH) -> DataFrame:
    """df with name: the largest value (a struct, or null) up to each row, or the least from it on. A struct that begins with
    the order column so gives the last row up to each row that has a value, or the first from it on. Without own the row itself
    doesn't count; no two rows of a key may have the same place then."""
    best, order = (F.min, F.col(at).desc()) if after else (F.max, F.col(at))
    d = _blocked(df, at, width).withColumn("_v", value)
    inside = Window.partitionBy(*by, "_k").orderBy(order)
    inside = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow) if own else inside.rowsBetween(Window.unboundedPreceding, -1)
    ends = d.groupBy(*by, "_k").agg(best("_v").alias("_e"))
    across = Window.partitionBy(*by).orderBy(F.col("_k").desc() if after else F.col("_k")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_k", best("_e").over(across).alias("_c"))
    return d.withColumn("_i", best("_v").over(inside)).join(ends, [*by, "_k"]).withColumn(name, (F.least if after else F.greatest)("_i", "_c")).drop("_k", "_v", "_i", "_c")


def neighbour(df: DataFrame, by: list[str], at: str, value: str, name: str, *, after: bool = False, width: float = WIDTH) -> DataFrame:
    """df with name: value of the row before (or after) each row, null where there is none."""
    pick, order = (F.min_by, F.col("_k").desc()) if after else (F.max_by, F.col("_k"))
    shift = F.lead if after else F.lag
    d = _blocked(df, at, width)
    inside = Window.partitionBy(*by, "_k").orderBy(at)
    ends = d.groupBy(*by, "_k").agg(pick(F.struct(F.col(value).alias("v")), at).alias("_e"))
    ends = ends.select(*by, "_k", F.lag("_e").over(Window.partitionBy(*by).orderBy(order)).alias("_c"))
    d = d.withColumn("_i", shift(F.struct(F.col(value).alias("v"))).over(inside)).join(ends, [*by, "_k"])
    return d.withColumn(name, F.coalesce("_i", "_c")["v"]).drop("_k", "_i", "_c")


def beside(df: DataFrame, by: list[str], at: str, value: str, before: str, after: str, *, width: float = WIDTH) -> DataFrame:
    """df with the values of the row before and the row after each row, in one pass; null where there is none."""
    d = _blocked(df, at, width)
    inside, across = Window.partitionBy(*by, "_k").orderBy(at), Window.partitionBy(*by).orderBy("_k")
    v = F.struct(F.col(value).alias("v"))
    ends = d.groupBy(*by, "_k").agg(F.min_by(v, at).alias("_f"), F.max_by(v, at).alias("_l"))
    ends = ends.select(*by, "_k", F.lag("_l").over(across).alias("_c0"), F.lead("_f").over(across).alias("_c1"))
    d = d.withColumns({"_i0": F.lag(v).over(inside), "_i1": F.lead(v).over(inside)}).join(ends, [*by, "_k"])
    return d.withColumns({before: F.coalesce("_i0", "_c0")["v"], after: F.coalesce("_i1", "_c1")["v"]}).drop("_k", "_i0", "_i1", "_c0", "_c1")


def around(df: DataFrame, by: list[str], at: str, value: Column, before: str, after: str, *, width: float = WIDTH) -> DataFrame:
    """df with the largest value (a struct, or null) up to each row and the least from it on, in one pass: with structs that begin
    with the order column, the last and the next row that have one."""
    d = _blocked(df, at, width).withColumn("_v", value)
    inside, across = Window.partitionBy(*by, "_k").orderBy(at), Window.partitionBy(*by).orderBy("_k")
    ends = d.groupBy(*by, "_k").agg(F.max("_v").alias("_l"), F.min("_v").alias("_f"))
    back = Window.partitionBy(*by).orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*by, "_k", F.max("_l").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_c0"), F.min("_f").over(back).alias("_c1"))
    # A frame that ends with its block is summed up anew for each row, so the way down is a running frame of the rows turned round.
    turned = Window.partitionBy(*by, "_k").orderBy(F.col(at).desc())
    up, down = (w.rangeBetween(Window.unboundedPreceding, Window.currentRow) for w in (inside, turned))
    d = d.withColumn("_i1", F.min("_v").over(down)).withColumn("_i0", F.max("_v").over(up)).join(ends, [*by, "_k"])
    return d.withColumns({before: F.greatest("_i0", "_c0"), after: F.least("_i1", "_c1")}).drop("_k", "_v", "_i0", "_i1", "_c0", "_c1")


def running(df: DataFrame, by: list[str], at: str, value: Column | dict[str, Column], name: str = "", *, width: float = WIDTH) -> DataFrame:
    """df with name: the sum of value over the rows up to each row; or several sums by name."""
    values = value if isinstance(value, dict) else {name: value}
    d = _blocked(df, at, width).withColumns({f"_v_{n}": v for n, v in values.items()})
    inside = Window.partitionBy(*by, "_k").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = d.groupBy(*by, "_k").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values))
    across = Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_k", *(F.sum(f"_s_{n}").over(across).alias(f"_c_{n}") for n in values))
    d = d.withColumns({f"_i_{n}": F.sum(f"_v_{n}").over(inside) for n in values}).join(sums, [*by, "_k"])
    d = d.withColumns({n: F.coalesce(f"_i_{n}", F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0)) for n in values})
    return d.drop("_k", *(f"_{x}_{n}" for n in values for x in "vic"))


def halo(df: DataFrame, by: list[str], at: str, size: int, reach: int, name: str = "block") -> DataFrame:
    """Rows in blocks (column name) of size, each with the rows up to reach before and after it, so that a block can be filtered alone."""
    k = F.floor(F.col(at) / size)
    first, last = F.floor((F.col(at) - reach) / size), F.floor((F.col(at) + reach) / size)
    return df.withColumn(name, F.explode(F.sequence(F.least(first, k), F.greatest(last, k))))


def numbered(df: DataFrame, by: list[str], at: str, name: str, *, width: float = WIDTH) -> DataFrame:
    """df with each row's place within its key, from 1, in the order of the number `at`."""
    return running(df, by, at, F.lit(1).cast("long"), name, width=width)


def moving_mean(df: DataFrame, by: list[str], at: str, value: Column, before: int, after: int, name: str, *, size: int = 1 << 16) -> DataFrame:
    """df with name: the mean of value over the rows whose `at` is from `before` below to `after` above their own. Blocks of
    size take as much of their neighbours, so that the blocks' borders don't show."""
    d = halo(df.withColumn("_v", value), by, at, max(size, before, after, 1), max(before, after), "_block")
    w = Window.partitionBy(*by, "_block").orderBy(at).rangeBetween(-before, after)
    own = F.floor(F.col(at) / max(size, before, after, 1)) == F.col("_block")
    return d.withColumn(name, F.avg("_v").over(w)).where(own).drop("_v", "_block")


def islands(df: DataFrame, by: list[str], at: str, *, width: float = WIDTH) -> DataFrame:
    """start, end and n of the runs of rows whose `at` follow each other by one."""
    d = numbered(df.select(*by, at), by, at, "_r", width=width).withColumn("_r", F.col(at) - F.col("_r"))
    return d.groupBy(*by, "_r").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n")).drop("_r")
