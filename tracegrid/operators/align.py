"""Joins of events, windows and clocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import blocks as B
from .lineage import written
from .screening import remove_bias


def lookup(df: DataFrame, meta: DataFrame, key: str, value: str, order: str, last: bool = True) -> DataFrame:
    """df with value of the last (or first) metadata row of its key."""
    pick = (F.max_by if last else F.min_by)(value, order).alias(value)
    return df.join(meta.where(F.col(key).isNotNull()).groupBy(key).agg(pick), key, "left")


def peri_event(bins: DataFrame, events: DataFrame, before: int, after: int, by: str = "session") -> DataFrame:
    """Bins in [at - before, at + after) of each event, numbered; events whose window isn't whole are dropped.
    Each event names the bins that it needs, so that the join is on equal keys."""
    need = events.select(by, "event_id", "at", F.explode(F.sequence(F.col("at") - before, F.col("at") + (after - 1))).alias("bin"))
    got = need.join(bins, [by, "bin"]).withColumn("n", F.count("*").over(Window.partitionBy(by, "event_id", "trace")))
    return got.where(F.col("n") == before + after).select(by, "event_id", "trace", (F.col("bin") - F.col("at")).alias("rel_bin"), "value")


def window_resampled(bins: DataFrame, events: DataFrame, before: int, after: int, by: str = "session") -> DataFrame:
    """Windows of before + after + 1 values; those cut off by the recording's ends are stretched to that length by nearest
    index, and those wholly outside are null."""
    span = bins.groupBy(by).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    e = events.join(span, by).select(by, "event_id", F.greatest(F.col("at") - before, "lo").alias("i0"), F.least(F.col("at") + after, "hi").alias("i1"))
    t = before + after
    need = e.select(by, "event_id", "i0", "i1", F.explode(F.sequence(F.lit(0), F.lit(t))).alias("k"))
    inside = F.when(F.col("i0") <= F.col("i1"), F.rint(F.col("i0") + (F.col("i1") - F.col("i0")) * F.col("k") / t).cast("long"))
    need = need.select(by, "event_id", (F.col("k") - before).alias("rel_bin"), inside.alias("bin"))
    lost = need.where("bin is null").join(bins.select(by, "trace").distinct(), by).select(by, "event_id", "trace", "rel_bin", F.lit(None).cast("double").alias("value"))
    return need.join(bins, [by, "bin"]).select(by, "event_id", "trace", "rel_bin", "value").unionByName(lost)


#: Pairs of times that a task of the raster compares, and rows of each side that meet under one key.
PAIRS, MEET = 20_000_000, 4096


def raster(peaks: DataFrame, events: DataFrame, before: float, after: float, by: str = "session") -> DataFrame:
    """Peaks in [at - before, at + after) with their time from the event; times are dealt into buckets of the window's width. Pairs grow
    with the square of a bucket's rows, so there are as many tasks as pairs ask for, and a bucket of more than MEET rows is cut on both
    sides: each part of its events meets each part of its peaks."""
    width, keys = before + after, [by, "bucket"]
    mixed = lambda d: F.xxhash64(*(c for c, kind in d.dtypes if "map" not in kind)).alias("_h")
    e = events.select(by, "event_id", F.col("at").alias("event_t"), mixed(events)).withColumn("b", F.floor((F.col("event_t") - before) / width))
    e = e.withColumn("bucket", F.explode(F.array("b", F.col("b") + 1))).drop("b")
    p = peaks.select(by, "channel", "t_ms", F.floor(F.col("t_ms") / width).alias("bucket"), mixed(peaks))

    def counts(bucket):
        n = lambda d, c: d.groupBy(by, bucket.alias("bucket")).agg(F.count("*").alias(c))
        return n(e, "_e").join(n(p, "_p"), keys)

    total = (F.sum(F.col("_e").cast("double") * F.col("_p")), F.max(F.greatest("_e", "_p")))
    # Where 64 buckets together have few rows none of them has many, and their pairs needn't be counted more closely.
    pairs, most = counts(F.floor(F.col("bucket") / 64)).agg(*total).first()
    pairs = (pairs or 0) / 64
    if (most or 0) > MEET:
        n = written(counts(F.col("bucket")), "buckets")
        pairs, most = n.agg(*total).first()
    if (most or 0) > MEET:
        # Of such buckets there are at most as many as rows over MEET. Equal rows share a part.
        cut = F.broadcast(n.where(F.greatest("_e", "_p") > MEET).select(*keys, *(F.ceil(F.col(c) / MEET).alias(c) for c in ("_e", "_p"))))
        parts = {"e": F.coalesce("_e", F.lit(1)), "p": F.coalesce("_p", F.lit(1))}
        own = lambda d, k, other: d.join(cut, keys, "left").withColumn(f"_part_{k}", F.pmod("_h", parts[k])).withColumn(f"_part_{other}", F.explode(F.sequence(F.lit(0).cast("long"), parts[other] - 1))).drop("_e", "_p")
        e, p, keys = own(e, "e", "p"), own(p, "p", "e"), [*keys, "_part_e", "_part_p"]
    tasks = math.ceil((pairs or 0) / PAIRS)
    e, p = e.drop("_h"), p.drop("_h")
    if tasks > 8:
        # One key, of the same type on both sides: of several a constant one would be left out of the join, and fields that may be null
        # on one side alone would be cast; both sides would be sent again then, to as many tasks as their bytes ask for.
        kind = T.StructType([T.StructField(f.name, f.dataType) for f in e.select(*keys).schema])
        tasks = max(tasks, int(peaks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        key = lambda d: d.where(F.col(by).isNotNull()).select(F.struct(*keys).cast(kind).alias("_key"), *(c for c in d.columns if c not in keys)).repartition(tasks, "_key")
        # A merge goes through the events, so that rows that follow each other are of one; with the events broadcast it would go through the peaks.
        d = key(e).hint("merge").join(key(p), "_key").withColumn(by, F.col("_key").getField(by))
    else:
        d = e.join(p, keys)
    return d.withColumn("rel_ms", F.col("t_ms") - F.col("event_t")).where((F.col("rel_ms") >= -before) & (F.col("rel_ms") < after)).select(by, "event_id", "channel", "rel_ms")


def asof_next(events: DataFrame, frames: DataFrame, by: str = "session", width: float = 3_600_000.0) -> DataFrame:
    """The first frame at or after each event, and how much later it is. Both sides are sorted together in blocks of width."""
    both = events.select(by, "at", "event_id", F.lit(None).cast("long").alias("frame")).unionByName(frames.select(by, F.col("t_ms").alias("at"), F.lit(None).cast("long").alias("event_id"), "frame"))
    nxt = B.known(both, [by], "at", F.when(F.col("frame").isNotNull(), F.struct("at", "frame")), "next", after=True, width=width)
    return nxt.where("event_id is not null").select(by, "event_id", F.col("next.frame").alias("frame"), (F.col("next.at") - F.col("at")).alias("late_ms"))


def merged(intervals: DataFrame, by: list[str], width: float = 3_600_000.0) -> DataFrame:
    """Intervals (s, e) that meet or overlap as one; written, as others join them. Null ends don't count."""
    top = written(intervals.groupBy(*by, "s").agg(F.max("e").alias("e")), "intervals")
    # past: the largest end before this start. An interval that begins beyond it begins a run, and all before it end by then.
    d = B.known(top, by, "s", F.struct("e"), "past", own=False, width=width).withColumn("past", F.col("past.e"))
    new = written(d.where(F.coalesce(F.col("s") > F.col("past"), F.lit(True))).select(*by, "s", "past"), "intervals")
    d = B.neighbour(new, by, "s", "past", "next", after=True, width=width).join(top.groupBy(*by).agg(F.max("e").alias("last")), by)
    return written(d.select(*by, "s", F.coalesce("next", "last").alias("e")), "intervals")


def blank_intervals(samples: DataFrame, intervals: DataFrame, pre: float, post: float, width: float, by: str = "session") -> DataFrame:
    """samples with value 0 inside an interval widened by pre and post. Intervals that
    overlap are merged, and name the time buckets that they touch."""
    iv = merged(intervals.select(by, (F.col("start") - pre).alias("s"), (F.col("end") + post).alias("e")), [by], width)
    iv = iv.select(by, "s", "e", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))).alias("bucket"))
    d = samples.withColumn("bucket", F.floor(F.col("t_ms") / width))
    # Merged intervals are apart, so a sample is in one at most and no row is made twice.
    near = d.join(iv.withColumnRenamed(by, "_by"), (d[by] == F.col("_by")) & (d["bucket"] == iv["bucket"]) & d["t_ms"].between(F.col("s"), F.col("e")), "left")
    return near.select(*(F.when(F.col("s").isNotNull(), 0.0).otherwise(d["value"]).alias("value") if c == "value" else d[c] for c in samples.columns))


def blank_bins(intervals: DataFrame, width: int, by: str = "session") -> DataFrame:
    """Bins that an interval of samples touches, up to the bin after its end."""
    return intervals.where(F.col("end") >= F.col("start")).select(by, F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") + width) / width) - 1)).alias("bin")).distinct()


def apply_anchor(df: DataFrame, shifts: DataFrame, key: str = "session") -> DataFrame:
    """Times moved to the other clock; the anchor in ms, or else from its sample and rate."""
    s = shifts.select(key, F.coalesce("anchor_ms", F.col("anchor_sample") * 1000.0 / F.col("fs")).alias("anchor"))
    return df.join(s, key).withColumn("t_ms", F.col("t_ms") - F.col("anchor")).drop("anchor")


def join_cameras(a: DataFrame, b: DataFrame, key: str = "frame") -> DataFrame:
    left = a.select(key, *(F.col(c).alias(f"cam0_{c}") for c in a.columns if c != key))
    return left.join(b.select(key, *(F.col(c).alias(f"cam1_{c}") for c in b.columns if c != key)), key, "full")


def frames_to_samples(frames: DataFrame, edges: DataFrame, by: str = "session", strict: bool = False, width: float = B.WIDTH) -> DataFrame:
    """The k-th frame has the k-th edge; frames beyond the edges have none, or are an error if strict. Frames and samples are numbers."""
    f = B.numbered(frames, [by], "frame", "k", width=width)
    e = B.numbered(edges.select(by, "sample"), [by], "sample", "k", width=width)
    got = f.join(e, [by, "k"], "left").drop("k")
    return got.withColumn("sample", F.coalesce("sample", F.raise_error(F.lit("fewer edges than frames")).cast("long"))) if strict else got


def mask_and_shift(a: DataFrame, b: DataFrame, masked: DataFrame, k: int, key: str = "session") -> DataFrame:
    """Pairs a(bin) with b(bin + k), both unmasked."""
    clear = lambda d: d.join(masked, [key, "bin"], "left_anti")
    return clear(a).select(key, "bin", F.col("value").alias("a")).join(clear(b).select(key, (F.col("bin") - k).alias("bin"), F.col("value").alias("b")), [key, "bin"])


def within(a: DataFrame, b: DataFrame, tolerance: float, at: str = "t") -> DataFrame:
    """For each row of a (id, t) the nearest of b (other, t) within the tolerance; the smaller other of equals. That is the last one up to
    it or the first from it on, so that both sides are sorted together and no pairs are made."""
    y = b.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("_t")).agg(F.min("other").alias("other")).select("_t", F.struct("_t", "other").alias("_y"))
    both = written(a.where(F.col(at).isNotNull()).select(F.col(at).alias("_t"), "id").unionByName(y, allowMissingColumns=True).withColumn("_a", F.col("_y").isNull()), "times")
    d = B.around(both, [], "_t", F.col("_y"), "_b", "_f", width=max(float(tolerance), float(B.WIDTH))).where("_a")
    near = F.explode(F.array_compact(F.array("_b", "_f")))
    d = d.select("id", "_t", near.alias("y")).withColumn("far", F.abs(F.col("_t") - F.col("y._t"))).where(F.col("far") <= tolerance)
    return d.groupBy("id").agg(F.min_by("y.other", F.struct("far", "y.other")).alias("other"))


def matched_pairs(conditions: DataFrame, vary: str, others: list[str]) -> DataFrame:
    """Groups of exactly two rows that agree in the other parameters, as a row each."""
    g = conditions.groupBy(*others).agg(F.count("*").alias("n"), F.min(F.struct(vary, "id")).alias("x"), F.max(F.struct(vary, "id")).alias("y")).where("n = 2")
    return g.select(*others, F.col(f"x.{vary}").alias("low"), F.col("x.id").alias("low_id"), F.col(f"y.{vary}").alias("high"), F.col("y.id").alias("high_id"))


def to_ms(sample: Column, fs: float) -> Column:
    return sample * (1000.0 / fs)


def extract_trials(blocks: DataFrame, events: DataFrame, before: int, after: int, size: int) -> DataFrame:
    """Samples in [at - before, at + after) of each event from blocks of size samples; a window must fit whole.
    Events name the blocks that they need, and only those are taken apart."""
    lo, hi = F.col("at") - before, F.col("at") + (after - 1)
    need = events.select("session", "event_id", "at", F.explode(F.sequence(F.floor(lo / size), F.floor(hi / size))).alias("block"))
    cut = need.join(blocks, ["session", "block"])
    rel = F.col("start_sample") + F.col("i") - F.col("at")
    d = cut.select("session", "event_id", "at", "channel", "start_sample", F.posexplode("values").alias("i", "value")).select("session", "event_id", "channel", rel.alias("rel"), "value").where((F.col("rel") >= -before) & (F.col("rel") < after))
    whole = F.count("*").over(Window.partitionBy("session", "event_id", "channel"))
    return d.withColumn("n", whole).where(F.col("n") == before + after).drop("n")


def align_frames(tracks: DataFrame, frame_map: DataFrame, by: str) -> DataFrame:
    """Tracks (frame, value) on corrected frames 0 to the last; missing frames are null, the last of a frame's duplicates counts."""
    last = frame_map.groupBy(by, F.col("avi").alias("frame")).agg(F.max_by("corrected", "row").alias("corrected"))
    got = tracks.join(last, [by, "frame"]).groupBy(by, "corrected").agg(F.max_by("value", "frame").alias("value"))
    spine = got.groupBy(by).agg(F.max("corrected").alias("m")).select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long"))).alias("corrected"))
    return spine.join(got, [by, "corrected"], "left")


def map_intervals(intervals: DataFrame, shifts: DataFrame, key: str = "session") -> DataFrame:
    """start and end on the other clock (anchor_sample, fs_from, fs_to, n_samples), cut at its ends; what falls outside goes."""
    go = lambda c: F.rint((F.col(c) - F.col("anchor_sample")) * F.col("fs_to") / F.col("fs_from")).cast("long")
    d = intervals.join(shifts, key).withColumns({"start": go("start"), "end": F.least(go("end"), F.col("n_samples"))})
    return d.where("start >= 0 and end > start").select(*intervals.columns)


def resample_linear(df: DataFrame, grid: DataFrame, by: str, at: str = "t", width: float = B.WIDTH) -> DataFrame:
    """Values at the grid's times, linear between known ones and flat beyond them; both sides are sorted together in blocks of width."""
    both = df.where("value is not null").select(by, at, F.struct(F.col(at).alias("t"), F.col("value").alias("v")).alias("k"), F.lit(False).alias("g"))
    both = both.unionByName(grid.select(by, at, F.lit(True).alias("g")), allowMissingColumns=True)
    d = B.known(B.known(both, [by], at, F.col("k"), "b", width=width), [by], at, F.col("k"), "a", after=True, width=width).where("g")
    step = F.col("b.v") + (F.col("a.v") - F.col("b.v")) * (F.col(at) - F.col("b.t")) / (F.col("a.t") - F.col("b.t"))
    value = F.when(F.col("b").isNull(), F.col("a.v")).when(F.col("a").isNull() | (F.col("a.t") == F.col("b.t")), F.col("b.v")).otherwise(step)
    return d.select(by, at, value.alias("value"))


def align_to_peak(trials: DataFrame, by: list[str], at: str, lo: int, hi: int, before: int, after: int, bias: int = 0) -> DataFrame:
    """Rows in [peak - before, peak + after] of each trial, the peak being the first largest absolute value in [lo, hi].
    bias: the mean of the first so many places of [lo, hi] is taken off first."""
    if bias:
        trials = remove_bias(trials, by, at, lo, lo + bias - 1)
    inside = F.when(F.col(at).between(lo, hi) & F.col("value").isNotNull(), F.struct((-F.abs("value")).alias("s"), F.col(at).alias("at")))
    peak = trials.groupBy(*by).agg(F.min(inside)["at"].alias("peak"))
    d = trials.join(peak.where("peak is not null"), by).withColumn("rel", F.col(at) - F.col("peak"))
    return d.where(F.col("rel").between(-before, after)).select(*by, "rel", "value")


def mask_around(df: DataFrame, events: DataFrame, delay: float, length: float, by: str = "session", at: str = "t_ms") -> DataFrame:
    """df with value null in the closed windows [s, s + length] and [s + delay, s + delay + length] of each event s."""
    iv = events.select(F.col(by).alias("_by"), F.explode(F.array(F.col("at"), F.col("at") + delay)).alias("s")).withColumn("e", F.col("s") + length)
    iv = merged(iv, ["_by"], max(length, 1.0) * 16)
    iv = iv.withColumn("_k", F.explode(F.sequence(F.floor(F.col("s") / max(length, 1.0)), F.floor(F.col("e") / max(length, 1.0)))))
    d = df.withColumn("_k2", F.floor(F.col(at) / max(length, 1.0)))
    hit = d.join(iv, (d[by] == iv["_by"]) & (d["_k2"] == iv["_k"]) & d[at].between(iv["s"], iv["e"]), "left")
    return hit.select(*(F.when(iv["s"].isNull(), d["value"]).alias("value") if c == "value" else d[c] for c in df.columns))


def stitch_spikes(spikes: DataFrame, ranges: DataFrame, width: int = 30, size: int = 1 << 22) -> DataFrame:
    """file, unit, channel (the one with most spikes, the first of equals) and the bins of width samples in which the unit fires, of the
    spikes inside each file's range of samples [first, last]. Ranges name the stretches of size samples that they touch.

    Files overlap, so spikes are dealt by unit and stretch before files take them, and a bin belongs to the stretch in which it
    starts: spikes that may lie in a bin of the stretch before are given to both. A bin is given by the first of its spikes."""
    s, k, before = F.col("sample"), F.col("_k"), F.col("_before")
    d = spikes.where("sample is not null and unit is not null").withColumn("_k", F.explode(F.array_distinct(F.array(F.floor(s / size), F.floor((s - (width - 1)) / size)))))
    d = d.repartition("unit", "_k")
    r = ranges.where("file is not null").select("file", "first", "last", F.explode(F.sequence(F.floor((F.col("first") - (width - 1)) / size), F.floor(F.col("last") / size))).alias("_k"))
    inside = lambda d: d.join(F.broadcast(r), "_k").where(s.between(F.col("first"), F.col("last")))
    counts = inside(d).where(F.floor(s / size) == k).groupBy("file", "unit", "channel", "_k").count()
    counts = counts.groupBy("file", "unit", "channel").agg(F.sum("count").alias("count"))
    main = counts.groupBy("file", "unit").agg(F.min_by("channel", F.struct(-F.col("count"), F.col("channel"))).alias("channel"))
    main = main.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("file", "channel"))).alias("_main"))
    main = d.select("unit", "_k").distinct().join(main, "unit")
    bin_ = lambda c: F.floor((c - F.col("first")) / width)
    own = d.withColumn("_before", F.lag("sample").over(Window.partitionBy("unit", "_k").orderBy("sample"))).select("unit", "_k", "sample", "_before")
    bins = inside(own.join(main, ["unit", "_k"])).where(F.floor((bin_(s) * width + F.col("first")) / size) == k)
    bins = bins.where(before.isNull() | (before < F.col("first")) | (bin_(before) != bin_(s)))
    return bins.select("file", "unit", F.col("_main")[F.col("file")].alias("channel"), bin_(s).alias("bin"))


def behaviour_ms(frames: DataFrame, fps: float, fs: float, by: str = "session") -> DataFrame:
    """frames (n, t) with ms: t counts samples where it gets above 10 000 or its median step above 10, and frames otherwise; a
    table with a column ms keeps that."""
    if "ms" in frames.columns:
        return frames
    d = B.neighbour(frames, [by], "n", "t", "_t")
    rule = d.groupBy(by).agg(((F.max("t") > 10_000) | (F.coalesce(F.median(F.col("t") - F.col("_t")), F.lit(0.0)) > 10)).alias("_s"))
    return frames.join(rule, by).withColumn("ms", F.when(F.col("_s"), F.col("t") * 1000.0 / fs).otherwise(F.col("t") * 1000.0 / fps)).drop("_s")


def joined_segments(peaks: DataFrame, segments: DataFrame, fs: float, by: str = "session") -> DataFrame:
    """peaks (segment, sample) with their sample in the whole recording and its time in ms; segments: segment, n_samples."""
    w = Window.partitionBy(by).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    base = segments.withColumn("base", F.coalesce(F.sum("n_samples").over(w), F.lit(0))).select(by, "segment", "base")
    d = peaks.join(base, [by, "segment"]).withColumn("sample", F.col("sample") + F.col("base"))
    return d.withColumn("t_ms", to_ms(F.col("sample"), fs)).drop("base")
