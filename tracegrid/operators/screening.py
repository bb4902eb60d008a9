"""Which rows, channels and trials take part, and in what order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import written


def exclude_high_impedance(df: DataFrame, impedance: DataFrame, max_kohm: float, by: str = "session") -> DataFrame:
    """Rows whose electrode isn't known to be above the limit; a key that would lose all its rows keeps them."""
    d = df.join(impedance.select("electrode", "kohm"), "electrode", "left").withColumn("ok", F.coalesce(F.col("kohm") <= max_kohm, F.lit(True)))
    some = d.groupBy(by).agg(F.max("ok").alias("some"))
    return d.join(some, by).where("ok or not some").drop("ok", "some", "kohm")


def curate_events(events: DataFrame, keep: DataFrame, by: str, index: str) -> DataFrame:
    """Events listed for their key; keys with an empty list aren't curated."""
    listed = keep.select(by, index).distinct()
    marks = listed.groupBy(by).agg(F.lit(True).alias("curated"))
    hit = events.join(marks, by, "left").join(listed.withColumn("listed", F.lit(True)), [by, index], "left")
    return hit.where("curated is null or listed").drop("curated", "listed")


def drop_near(segments: DataFrame, stims: DataFrame, tolerance: float, by: str, at: str = "start") -> DataFrame:
    """Segments that begin within the tolerance of no stimulus; times meet in buckets of the tolerance's width."""
    width = max(float(tolerance), 1.0)
    s = stims.select(by, F.col(at).alias("_s")).distinct().withColumn("_b", F.explode(F.array(*(F.floor(F.col("_s") / width) + i for i in (-1, 0, 1)))))
    d = segments.withColumn("_b", F.floor(F.col(at) / width))
    near = (d[by] == s[by]) & (d["_b"] == s["_b"]) & (F.abs(d[at] - s["_s"]) <= tolerance)
    return d.join(s, near, "left_anti").drop("_b")


def filter_coverage(df: DataFrame, by: list[str], least: float) -> DataFrame:
    """Traces with at least that share of values."""
    ok = df.groupBy(*by).agg(F.avg(F.col("value").isNotNull().cast("double")).alias("c")).where(F.col("c") >= least)
    return df.join(ok.select(*by), by, "left_semi")


def order_channels(df: DataFrame, region: str = "region", at: str = "t", mode: str = "max", before: bool = False, with_zero: bool = True, reverse: bool = False) -> DataFrame:
    """region, channel, peak, peak_t and rank by peak time, the larger peak first of equal times; channels without values last.
    before: peaks are sought up to time 0 (with_zero: 0 itself too), over all times if no row is that early. reverse: ranks of a region
    turned round, channels without values then first."""
    size = {"max": F.col("value"), "min": -F.col("value"), "abs": F.abs("value")}[mode]
    seen = F.col("value").isNotNull()
    if before:
        early = (F.col(at) <= 0) if with_zero else (F.col(at) < 0)
        any_early = df.agg(F.coalesce(F.max(early), F.lit(False)).alias("_any"), F.lit(1).alias("_one"))
        df = df.withColumn("_one", F.lit(1)).join(any_early, "_one")
        seen = seen & (early | ~F.col("_any"))
    best = F.min(F.when(seen, F.struct((-size).alias("s"), F.col(at).alias("t"))))
    g = df.groupBy(region, "channel").agg(best.alias("b")).select(region, "channel", (-F.col("b.s")).alias("peak"), F.col("b.t").alias("peak_t"))
    order = [F.col("peak_t").desc_nulls_first(), F.col("peak").asc(), F.col("channel").desc()] if reverse else [F.col("peak_t").asc_nulls_last(), F.col("peak").desc(), F.col("channel")]
    return g.withColumn("rank", F.row_number().over(Window.partitionBy(region).orderBy(*order)))


def resolve_metadata(rows: DataFrame, key: str, wishes: list[Column], order: str) -> DataFrame:
    """One row for each key. Wishes are applied in turn, each only if it leaves rows; that is the
    least row by (wish 1 unmet, wish 2 unmet, ..., order), so one aggregation does it."""
    cols = [c for c in rows.columns if c != key]
    rank = F.struct(*(F.coalesce(~w, F.lit(True)).alias(f"w{i}") for i, w in enumerate(wishes)), F.col(order).alias("o"))
    return rows.groupBy(key).agg(F.min_by(F.struct(*cols), rank).alias("r")).select(key, "r.*")


def screen_trials(windows: DataFrame, by: list[str], at: str, limits: list[tuple[int, int, float]]) -> DataFrame:
    """Rows of trials whose largest absolute value in each [lo, hi) stays within its limit; a stretch without values passes."""
    tops = [F.max(F.when((F.col(at) >= lo) & (F.col(at) < hi), F.abs("value"))).alias(f"m{i}") for i, (lo, hi, _) in enumerate(limits)]
    ok = F.lit(True)
    for i, (_, _, most) in enumerate(limits):
        ok = ok & (F.coalesce(F.col(f"m{i}"), F.lit(0.0)) <= most)
    return windows.join(windows.groupBy(*by).agg(*tops).where(ok).select(*by), by, "left_semi")


def position_filter(windows: DataFrame, by: list[str], at: str, columns: list[str], pre: int, tolerance: float, back: int = 20) -> tuple[DataFrame, DataFrame]:
    """Trials that begin in the primary position, less their bias, and the rest as they were.

    A column's bias is its mean from pre - back to pre. A trial stays if the value at pre of every column, less the bias where that
    is below tolerance, is within tolerance of 0; one without a value there goes. Kept and removed are all rows of windows."""
    near = (F.col(at) >= pre - back) & (F.col(at) <= pre)
    s = windows.groupBy(*by).agg(*(F.avg(F.when(near, F.col(c))).alias(f"_b{i}") for i, c in enumerate(columns)), *(F.max(F.when(F.col(at) == pre, F.col(c))).alias(f"_p{i}") for i, c in enumerate(columns)))
    ok = F.lit(True)
    for i in range(len(columns)):
        ok = ok & F.coalesce(F.abs(F.col(f"_p{i}") - F.when(F.col(f"_b{i}") < tolerance, F.col(f"_b{i}")).otherwise(0.0)) < tolerance, F.lit(False))
    s = s.where(ok).select(*by, *(f"_b{i}" for i in range(len(columns))))
    kept = windows.join(s, by).withColumns({c: F.col(c) - F.col(f"_b{i}") for i, c in enumerate(columns)}).select(*windows.columns)
    return kept, windows.join(s, by, "left_anti").select(*windows.columns)


def remove_bias(windows: DataFrame, by: list[str], at: str, lo: int, hi: int) -> DataFrame:
    """value less the key's mean in [lo, hi]; a key without values there keeps its own."""
    bias = windows.groupBy(*by).agg(F.avg(F.when(F.col(at).between(lo, hi), F.col("value"))).alias("_bias"))
    return windows.join(bias, by).withColumn("value", F.col("value") - F.coalesce("_bias", F.lit(0.0))).select(*windows.columns)


def gradient(windows: DataFrame, by: list[str], at: str) -> DataFrame:
    """Half the difference of the values beside each row of a trial; at its ends the difference to the only one. A trial of one row has none."""
    w = Window.partitionBy(*by).orderBy(at)
    before, after = F.lag("value").over(w), F.lead("value").over(w)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    d = F.when(first, after - F.col("value")).when(last, F.col("value") - before).otherwise((after - before) / 2)
    return windows.withColumn("value", d)


def trim_to_shortest(windows: DataFrame, by: list[str], at: str, group: list[str]) -> DataFrame:
    """The rows of each trial up to the length of its group's shortest trial; rows count from each trial's first."""
    span = windows.groupBy(*group, *(c for c in by if c not in group)).agg(F.min(at).alias("_from"), F.count("*").alias("_n"))
    least = span.groupBy(*group).agg(F.min("_n").alias("_n"))
    d = windows.join(span.drop("_n"), list(dict.fromkeys([*group, *by]))).join(least, group)
    return d.where(F.col(at) < F.col("_from") + F.col("_n")).select(*windows.columns)


def neighbours(channels: DataFrame, least: float, most: float) -> DataFrame:
    """channel and neighbour at a distance in [least, most]; places meet in square cells of that width, once for all channels that
    share them, and only pairs of places that are near are made into pairs of channels."""
    cell = lambda c: F.floor(F.col(c) / most)
    near = [F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    places = channels.select("x", "y").distinct()
    b = places.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(F.array(*near)).alias("c"))
    a = places.select("x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    pairs = a.join(b.select("x2", "y2", "c.cx", "c.cy"), ["cx", "cy"]).withColumn("distance", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")))
    pairs = pairs.where(F.col("distance").between(least, most)).select("x", "y", "x2", "y2", "distance")
    other = channels.select(F.col("channel").alias("neighbour"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    # Small tables make many pairs: without a number of its own their join would be merged into a task or two.
    n = 4 * int(channels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    got = channels.select("channel", "x", "y").join(pairs, ["x", "y"]).repartition(n, "x2", "y2").join(other, ["x2", "y2"])
    return got.where(F.col("channel") != F.col("neighbour")).select("channel", "neighbour", "distance")


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Different rows that both tables have."""
    return a.intersect(b)


def removed(whole: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of whole whose key isn't among kept."""
    return whole.join(kept.select(*keys).distinct(), keys, "left_anti")


def reorder_channels(df: DataFrame, order: DataFrame) -> DataFrame:
    """Rows with their channel's place in a permutation (device, place); channels that it doesn't name are dropped."""
    return df.join(order.select(F.col("device").alias("channel"), "place"), "channel").withColumn("channel", F.col("place")).drop("place")


def apply_electrode_map(channels: DataFrame, electrodes: DataFrame) -> DataFrame:
    """channels (channel, port) with electrode (-1 where the map has none) and name. Port B's channels are 128 up."""
    d = channels.withColumn("nsp", F.col("channel") + F.when(F.upper(F.trim("port")) == "B", 128).otherwise(0))
    d = d.join(electrodes.select("nsp", "electrode"), "nsp", "left").withColumn("electrode", F.coalesce("electrode", F.lit(-1)))
    return d.withColumn("name", F.format_string("UAe%03d_NSP%03d", F.col("electrode").cast("int"), F.col("nsp").cast("int")))


def offset_to_reference(df: DataFrame, reference: str, point: str = "keypoint") -> DataFrame:
    """offset of each key point and axis: its median less the reference point's on that axis."""
    m = df.groupBy(point, "axis").agg(F.median("value").alias("m"))
    r = m.where(F.col(point) == reference).select("axis", F.col("m").alias("r"))
    return m.join(r, "axis", "left").select(point, "axis", (F.col("m") - F.col("r")).alias("offset"))


def segment_channels(channels: DataFrame, largest: DataFrame, stimulated: DataFrame, distance: float, saturation: float) -> DataFrame:
    """channel and kind: stim, saturated (largest absolute value), neighbour (no further from the stimulated span than distance) or other."""
    span = channels.join(stimulated, "channel", "left_semi").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.lit(1).alias("one"))
    d = channels.withColumn("one", F.lit(1)).join(F.broadcast(span), "one").join(largest.select("channel", "most"), "channel", "left").join(stimulated.select("channel").distinct().withColumn("stim", F.lit(True)), "channel", "left")
    near = F.col("y").between(F.col("lo") - distance, F.col("hi") + distance)
    return d.select("channel", F.when(F.col("stim"), "stim").when(F.col("most") >= saturation, "saturated").when(near, "neighbour").otherwise("other").alias("kind"))


def match_keypoints(names: list[str], wanted: list[str]) -> dict[str, str]:
    """For each wanted point, in turn, the free name that shares most of its words (the first of equals); points that share none have none."""
    import re

    words = lambda n: set(re.findall(r"[a-z0-9]+", n.lower()))
    free, out = list(names), {}
    for w in wanted:
        best = max(free, key=lambda n: len(words(n) & words(w)), default=None)
        if best is not None and words(best) & words(w):
            out[w] = best
            free.remove(best)
    return out


def good_units(units: DataFrame, spikes: DataFrame, seconds: float) -> DataFrame:
    """Units labelled good with their mean rate; silent ones have rate 0."""
    n = spikes.groupBy("unit").agg(F.count("*").alias("n"))
    return units.where(F.lower(F.trim("label")) == "good").join(n, "unit", "left").select("unit", (F.coalesce("n", F.lit(0)) / seconds).alias("rate"))


def nearest_channels(channels: DataFrame, k: int, levels: int = 20) -> DataFrame:
    """channel, neighbour and distance of the k channels nearest by the larger of the x and y distance, the smaller neighbour of equals.

    Square cells are halved from one that holds all places. A place takes the smallest of its cells that has more than k channels: the k
    nearest are then within a cell's width, in the cells beside it. A smaller cell has at most k channels, so few places look into
    a large one and pairs grow with the places. Channels at one place share its neighbours, of which each place gives its first
    k + 1. Channels without a place (a missing or infinite x or y) meet all others, by what they have."""
    c = written(channels.select("channel", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "channels")
    placed = F.coalesce(F.abs("x") < float("inf"), F.lit(False)) & F.coalesce(F.abs("y") < float("inf"), F.lit(False))
    clean, odd = c.where(placed), c.where(~placed)
    low = clean.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("w")).first()
    x0, y0, width = (low.x, low.y, 1.001 * low.w or 1.0) if low.x is not None else (0.0, 0.0, 1.0)
    first = F.slice(F.array_sort(F.collect_list("channel")), 1, k + 1)
    w = Window.partitionBy("x", "y").orderBy("channel")
    top = clean.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    places = written(top.groupBy("x", "y").agg(first.alias("ids")).join(clean.groupBy("x", "y").agg(F.count("*").alias("n")), ["x", "y"]), "places")
    side = F.lit(width) / F.pow(F.lit(2.0), F.col("level"))
    cells = places.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    cells = cells.withColumns({"cx": F.floor((F.col("x") - F.lit(x0)) / side), "cy": F.floor((F.col("y") - F.lit(y0)) / side)})
    full = cells.groupBy("level", "cx", "cy").agg(F.sum("n").alias("_n")).where((F.col("_n") > k) | (F.col("level") == 0))
    own = cells.join(full, ["level", "cx", "cy"]).groupBy("x", "y").agg(F.max(F.struct("level", "cx", "cy")).alias("own")).select("x", "y", "own.*")
    beside = F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    asks = written(own.select("x", "y", "level", beside.alias("c")).select("x", "y", "level", "c.*"), "asks")
    there = cells.select("level", "cx", "cy", F.col("x").alias("x2"), F.col("y").alias("y2"), "ids")
    far = F.greatest(F.abs(F.col("x") - F.col("x2")), F.abs(F.col("y") - F.col("y2")))
    got = asks.join(there, ["level", "cx", "cy"]).withColumn("distance", far)
    # The first k + 1 places hold the first k + 1 channels.
    got = got.withColumn("_r", F.row_number().over(Window.partitionBy("x", "y").orderBy("distance", F.col("ids")[0]))).where(F.col("_r") <= k + 1)
    near = got.groupBy("x", "y").agg(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("distance").alias("distance"), i.alias("neighbour")))))).alias("near"))
    near = near.select("x", "y", F.slice("near", 1, k + 1).alias("near"))
    both = clean.join(near, ["x", "y"]).select("channel", F.explode("near").alias("n")).select("channel", "n.neighbour", "n.distance")
    pair = lambda a, b: a.withColumn("_one", F.lit(1)).join(b.select(F.lit(1).alias("_one"), F.col("channel").alias("neighbour"), F.col("x").alias("x2"), F.col("y").alias("y2")), "_one").select("channel", "neighbour", far.alias("distance"))
    d = both.unionByName(pair(c, odd)).unionByName(pair(odd, clean)).where("channel != neighbour")
    w = Window.partitionBy("channel").orderBy(F.col("distance").asc_nulls_last(), "neighbour")
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select("channel", "neighbour", "distance")


def ordered_conditions(df: DataFrame, listed: str, values: list[str], keys: list[tuple[str, bool]]) -> DataFrame:
    """df with place: rows sorted by where their value stands in a list (others last), then by keys, each up (True) or down. A
    table of conditions has few rows."""
    from pyspark.sql.window import Window

    at = F.array_position(F.array(*map(F.lit, values)), F.col(listed))
    order = [F.when(at > 0, at).otherwise(len(values) + 1), *(F.col(c).asc() if up else F.col(c).desc() for c, up in keys)]
    return df.withColumn("place", F.row_number().over(Window.orderBy(*order)))
