"""Stimulation artifacts: snippets around pulses, templates by principal components, and models between sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from . import blocks as B
from .lineage import written
from .models import factor_em, grams

KEYS = ("session", "channel", "block")


#: Values of a batch that a group of pulses hands over.
BATCH = 1 << 20
#: Samples of a chunk of signal, of which groups of pulses take those that they need.
CHUNK = 1 << 12
#: The same of groups that edit it, which may be of few pulses.
SHARED = 1 << 9


def whole_pulses(samples: DataFrame, pulses: DataFrame, before: int, after: int, size: int = 1 << 14) -> DataFrame:
    """session, channel, block, pulse, a, z, last and g of the pulses that are inside the recording: their first and last sample, how far the
    longest of all the block's pulses goes, and a group of neighbouring blocks. Groups are as wide as the longest pulse at
    least, so that they share no more samples than they own."""
    span = samples.groupBy("session", "channel").agg(F.min("sample").alias("lo"), F.max("sample").alias("hi"))
    p = pulses.select(*KEYS, "pulse", (F.col("start") - before).alias("a"), (F.col("end") + after).alias("z")).where("z >= a")
    longest = p.groupBy(*KEYS).agg(F.max(F.col("z") - F.col("a")).alias("last"))
    p = written(p.join(span, ["session", "channel"]).where("a >= lo and z <= hi").join(longest, list(KEYS)).select(*KEYS, "pulse", "a", "z", "last"), "pulses")
    width = max(size, p.agg(F.max(F.col("z") - F.col("a") + 1)).first()[0] or 0)
    return p.withColumn("g", F.floor(F.min("a").over(Window.partitionBy(*KEYS)) / width))


def by_groups(samples: DataFrame, pulses: DataFrame, fn: Callable[[list[dict], list[np.ndarray]], Iterator[tuple[dict, list[np.ndarray]]]], keep: list[str], names: list[str]) -> DataFrame:
    """keep, pos and names: for each pulse that fn gives, with arrays as long as its snippet, a row for each place. fn takes a group's pulses
    (see whole_pulses) and their snippets, NaN where a value is missing. Only samples are sent to the groups, never snippets:
    pulses may overlap many times over. Places at which the recording has no row have none here."""
    where = ["session", "channel", "g"]
    p = pulses.withColumn("_src", F.col("_src") if "_src" in pulses.columns else F.col("g"))
    need = p.groupBy(*where, "_src").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    need = need.select(*where, F.explode(F.sequence(F.floor(F.col("a") / CHUNK), F.floor(F.col("z") / CHUNK))).alias("_c")).distinct()
    rows = samples.select("session", "channel", "sample", F.col("value").cast("double").alias("value"), F.floor(F.col("sample") / CHUNK).alias("_c"))
    both = rows.join(need, ["session", "channel", "_c"]).drop("_c").unionByName(p.drop("_src"), allowMissingColumns=True)
    schema = T.StructType([pulses.schema[c] for c in keep] + [T.StructField("_n", T.LongType())] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in names])
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        todo = t.filter(t.column("a").is_valid()).drop_columns(["sample", "value"]).sort_by([("a", "ascending"), ("pulse", "ascending")]).to_pylist()
        s = t.filter(t.column("a").is_null()).select(["sample", "value"])
        order = np.argsort(s.column("sample").to_numpy(), kind="stable")
        sample, value = s.column("sample").to_numpy()[order], s.column("value").to_numpy().astype(float)[order]
        snippets, gaps = [], {}
        for i, x in enumerate(todo):
            v, n, lo = np.empty(x["last"] + 1), x["z"] - x["a"] + 1, int(np.searchsorted(sample, x["a"]))
            if lo + n <= len(sample) and sample[lo] == x["a"] and sample[lo + n - 1] == x["z"]:
                v[:n], v[n:] = value[lo : lo + n], value[lo + n - 1]
            else:
                want = np.minimum(x["a"] + np.arange(len(v)), x["z"])
                at = np.minimum(np.searchsorted(sample, want), len(sample) - 1)
                gaps[i] = sample[at] != want
                v[:] = np.where(gaps[i], np.nan, value[at])
            snippets.append(v)
            x["_i"] = i
        ready: list[tuple[dict, list[np.ndarray]]] = []

        def batch() -> pa.RecordBatch:
            length = np.cumsum([0, *(len(v[0]) for _, v in ready)])
            out = [pa.array([x[c] for x, _ in ready], fields.field(c).type) for c in keep] + [pa.array(np.diff(length))]
            lost = np.concatenate([gaps.get(x["_i"], np.zeros(len(v[0]), dtype=bool)) for x, v in ready]) if gaps else None
            for j in range(len(names)):
                out.append(pa.ListArray.from_arrays(pa.array(length, pa.int32()), pa.array(np.concatenate([v[j] for _, v in ready]), mask=lost)))
            return pa.RecordBatch.from_arrays(out, schema=fields)

        total = 0
        for x, v in fn(todo, snippets):
            ready.append((x, v))
            total += len(v[0])
            if total >= BATCH:
                yield batch()
                ready, total = [], 0
        if ready:
            yield batch()

    got = both.groupBy(*where).applyInArrow(run, schema).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("pos"))
    item: Callable[[str], Column] = lambda c: F.col(c)[F.col("pos").cast("int")]
    got = got.select(*keep, "pos", *(item(c).alias(c) for c in names)).where(F.col(names[0]).isNotNull())
    return got.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in names})


def pulse_snippets(samples: DataFrame, pulses: DataFrame, before: int, after: int) -> DataFrame:
    """session, channel, block, pulse, pos and value of each pulse's samples from start - before to end + after. Pulses that reach
    beyond the recording are dropped, and shorter ones repeat their last value up to the longest of all the block's pulses."""

    def run(todo: list[dict], snippets: list[np.ndarray]) -> Iterator[tuple[dict, list[np.ndarray]]]:
        for x, v in zip(todo, snippets):
            yield x, [v]

    return by_groups(samples, whole_pulses(samples, pulses, before, after), run, [*KEYS, "pulse"], ["value"])


def pulse_artifacts(samples: DataFrame, pulses: DataFrame, before: int, after: int, exclude: int = 0, k: int = 3) -> DataFrame:
    """What remove_artifacts_pca gives of the pulses' snippets, which aren't sent anywhere for it."""

    def run(todo: list[dict], snippets: list[np.ndarray]) -> Iterator[tuple[dict, list[np.ndarray]]]:
        blocks: dict[int, list[int]] = {}
        for i, x in sorted(enumerate(todo), key=lambda e: e[1]["pulse"]):
            blocks.setdefault(x["block"], []).append(i)
        for rows in blocks.values():
            for i, v in zip(rows, without_template(np.nan_to_num(np.array([snippets[i] for i in rows])), exclude, k)):
                yield todo[i], [v]

    return by_groups(samples, whole_pulses(samples, pulses, before, after), run, [*KEYS, "pulse"], ["value"])


def pulse_template_parts(samples: DataFrame, pulses: DataFrame, before: int, after: int, width: int, first_width: int = 3, size: int = 1 << 14) -> DataFrame:
    """What template_parts gives of the pulses' snippets, which aren't sent anywhere for it: a group of pulses also takes the earlier ones
    that its means look back to. Column is_first tells a block's first pulse."""
    p = whole_pulses(samples, pulses, before, after, size)
    p = written(p.withColumn("is_first", F.col("pulse") == F.min("pulse").over(Window.partitionBy(*KEYS))), "pulses")
    kind = ["session", "channel", "is_first"]
    p = written(B.numbered(p, kind, "pulse", "n"), "pulses")
    reach = F.when(F.col("is_first"), F.lit(first_width)).otherwise(F.lit(width)).cast("long")
    later = p.select(*kind, "g", F.explode(F.sequence(F.greatest(F.col("n") - reach, F.lit(1)), "n")).alias("n")).distinct()
    p = p.withColumnRenamed("g", "_src").join(later, [*kind, "n"]).withColumn("own", F.col("g") == F.col("_src"))

    def run(todo: list[dict], snippets: list[np.ndarray]) -> Iterator[tuple[dict, list[np.ndarray]]]:
        known = {(x["is_first"], x["n"]): v for x, v in zip(todo, snippets)}
        for x, v in zip(todo, snippets):
            if not x["own"]:
                continue
            back = first_width if x["is_first"] else width
            template = local_template(len(v), [known[x["is_first"], n] for n in range(max(1, x["n"] - back), x["n"])])
            yield x, [template, v - template]

    return by_groups(samples, p, run, [*KEYS, "pulse", "is_first"], ["template", "value"]).select(*KEYS, "pulse", "pos", "is_first", "template", "value")


def local_template(size: int, earlier: list[np.ndarray]) -> np.ndarray:
    """The mean of earlier snippets less its first value and a line to its last; 0 where none of them has a value."""
    total, count, out = np.zeros(size), np.zeros(size), np.zeros(size)
    for v in earlier:
        v = v[:size]
        ok = ~np.isnan(v)
        total[: len(v)][ok] += v[ok]
        count[: len(v)] += ok
    at = np.flatnonzero(count)
    if len(at):
        base = total[at] / count[at]
        out[at] = base - base[0] - (base[-1] - base[0]) * at / max(at[-1], 1)
    return out


def components(x: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Mean and first principal directions of the rows of x; one row is its own mean and has none."""
    base = x.mean(axis=0)
    if len(x) < 2 or k < 1:
        return base, np.zeros((0, x.shape[1]))
    _, s, v = np.linalg.svd(x - base, full_matrices=False)
    k = min(k, len(x), x.shape[1], int((s > 1e-12 * max(s[0], 1e-300)).sum()))
    return base, v[:k]


def without_template(x: np.ndarray, exclude: int, k: int) -> np.ndarray:
    """Rows less their mean and their projection on the first k components, both of all but the first `exclude` of at least two more."""
    if len(x) < exclude + 2:
        return x
    base, v = components(x[exclude:], k)
    return x - base - (x - base) @ v.T @ v


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The order of a block's rows by pulse and place, and its values, a row for each pulse; missing values are 0."""
    pulse = t.column("pulse").to_numpy()
    order = np.lexsort((t.column("pos").to_numpy(), pulse))
    x = t.column("value").to_numpy().astype(float)[order]
    return order, np.nan_to_num(x).reshape(len(np.unique(pulse)), -1)


def remove_artifacts_pca(snippets: DataFrame, exclude: int = 0, k: int = 3) -> DataFrame:
    """Snippets less their template: the mean of the block's pulses (but the first `exclude`) and their projection on its
    first k components. Blocks that have fewer than two pulses besides those stay as they are. Missing values count as 0."""
    schema = T.StructType([f for f in snippets.schema.fields if f.name != "value"] + [T.StructField("value", T.DoubleType())])

    def run(t: pa.Table) -> pa.Table:
        order, x = _matrix(t)
        x = without_template(x, exclude, k)
        out = t.drop_columns(["value"]).take(pa.array(order)).append_column("value", pa.array(x.ravel()))
        return out.select(schema.names)

    return snippets.groupBy(*KEYS).applyInArrow(run, schema)


def template_fits(snippets: DataFrame, exclude: int = 1, k: int = 3) -> DataFrame:
    """base and comps (doubles, as bytes) for each block with enough pulses besides the first `exclude`: two for components, one
    for the mean alone (k = 0)."""
    schema = T.StructType([snippets.schema[c] for c in KEYS] + [T.StructField(c, T.BinaryType()) for c in ("base", "comps")])

    def run(t: pa.Table) -> pa.Table:
        _, x = _matrix(t)
        enough = len(x) >= exclude + (2 if k else 1)
        base, v = components(x[exclude:], k) if enough else (None, None)
        row = t.select(list(KEYS)).slice(0, int(enough))
        return row.append_column("base", pa.array([base.tobytes()] * enough if enough else [], pa.binary())).append_column("comps", pa.array([v.tobytes()] * enough if enough else [], pa.binary()))

    return snippets.groupBy(*KEYS).applyInArrow(run, schema)


def _fits(sample: np.ndarray, value: np.ndarray, pulses: list[dict], exclude: int, k: int) -> Callable[[dict], tuple[np.ndarray, np.ndarray] | None]:
    """Gives a pulse's template: the one that came with its block, or that of the block's own snippets, fitted where its first pulse asks and
    dropped after its last one."""
    known = {x["block"]: (np.frombuffer(x["base"]), np.frombuffer(x["comps"]).reshape(-1, len(x["base"]) // 8)) for x in pulses if x["base"] is not None}
    own: dict[int, list[dict]] = {}
    left: dict[int, int] = {}
    for x in pulses:
        if x["local"]:
            own.setdefault(x["block"], []).append(x)
        left[x["block"]] = left.get(x["block"], 0) + x["edit"]

    def fitted(rows: list[dict]) -> tuple[np.ndarray, np.ndarray] | None:
        if len(rows) < exclude + (2 if k else 1):
            return None
        m = np.empty((len(rows), rows[0]["size"]))
        for v, x in zip(m, sorted(rows, key=lambda x: x["pulse"])):
            lo, n = int(np.searchsorted(sample, x["a"])), x["z"] - x["a"] + 1
            v[:n], v[n:] = value[lo : lo + n], value[lo + n - 1]
        return components(m[exclude:], k)

    def fit(x: dict) -> tuple[np.ndarray, np.ndarray] | None:
        block = x["block"]
        if block not in known:
            known[block] = fitted(own.get(block, []))
        left[block] -= 1
        return known[block] if left[block] else known.pop(block)

    return fit


def _edit(sample: np.ndarray, cur: np.ndarray, pulses: list[dict], fit: Callable[[dict], tuple[np.ndarray, np.ndarray] | None], share: float) -> list[tuple[int, int, float]]:
    """Patches and ramps of pulses, one after another, on cur: the values at sample (ascending), a column for each part of an
    affine form. Gives the ramps with their first values."""
    ramps = []
    for p in pulses:
        lo, n = int(np.searchsorted(sample, p["a"])), p["size"]
        known = fit(p)
        if known:
            base, v = known
            patch = cur[lo : lo + n]
            patch[:, 0] -= base
            patch -= v.T @ (v @ patch)
        r, z = p["ramp"], p["next"]
        if z is not None and z > r:
            i, j = np.searchsorted(sample, [r, z])
            first = cur[i] * share
            cur[i:j] -= (1 - (sample[i:j] - r) / (z - r))[:, None] * first[None, :]
            ramps.append((r, z, float(first[0])))
    return ramps


def clean_signal(samples: DataFrame, pulses: DataFrame, before: int, after: int, *, exclude: int = 1, k: int = 3, tail: int = 0, share: float = 1.0, group: int = 256, wide: int = 64) -> DataFrame:
    """samples (session, channel, sample, value; a row for each sample) with every pulse's artifact taken out in place.

    pulses: session, channel, block, pulse, start, end. One pulse after another, the samples from start - before on, as many as
    the block's longest pulse has, lose the block's template (its mean and their projection on its first components, fitted on
    the samples as they were, without the first `exclude` pulses). After that a line falls from share of what the sample at end +
    tail has become, to 0 at the next pulse's start, and is taken off. Pulses whose patch would pass the recording's ends
    are left out, as are their ramps. Blocks without a template (template_fits) keep their samples, but for the ramps.
    Missing values count as 0 and stay missing.

    Windows may overlap, and each edit reads what those before it left. So pulses form groups, cut in each stretch of `group` pulses
    where the fewest samples are shared, if these are at most `wide`; a longer stretch whose windows all overlap by more is one group.
    Edits are affine in what a group takes over from the one before: each group is run once for its affine map from the samples it shares
    with those before to those it shares with those after; these maps are put together in order, a row for each group; and each
    group is run again from the right values. A group takes chunks of signal, never windows, and fits the templates of blocks that
    are all its own. Ramps outside its chunks are made where the samples lie."""
    by = ["session", "channel"]
    s = samples.select(*by, "sample", F.col("value").cast("double").alias("value"))
    span = s.groupBy(*by).agg(F.min("sample").alias("lo"), F.max("sample").alias("hi"))
    p = B.neighbour(pulses.select(*by, "block", "pulse", "start", "end"), by, "start", "start", "next", after=True)
    size = pulses.groupBy(*KEYS).agg((F.max(F.col("end") - F.col("start")) + before + after + 1).alias("size"))
    p = p.join(size, list(KEYS)).join(span, by).withColumns({"a": F.col("start") - before, "z": F.col("end") + after, "ramp": F.least(F.col("end") + tail, "hi")})
    p = p.withColumns({"edit": F.expr("a >= lo and a + size - 1 <= hi and end >= start"), "fit": F.expr("z >= a and a >= lo and z <= hi")})
    p = written(p.where("edit or fit").drop("lo", "hi"), "pulses")
    if p.where("edit").isEmpty():
        return samples
    far = F.when(F.col("edit"), F.greatest(F.col("a") + F.col("size"), "next"))
    p = B.known(B.running(p, by, "start", F.col("edit").cast("long"), "n"), by, "start", far, "past", own=False)
    p = written(p.withColumns({"over": F.greatest(F.coalesce(F.col("past") - F.col("a"), F.lit(0)), F.lit(0)), "reach": F.greatest("past", far)}).drop("past"), "pulses")
    cuts = p.where("edit").groupBy(*by, F.floor((F.col("n") - 1) / group).alias("_q")).agg(F.min(F.struct("over", "start")).alias("_m"))
    cuts = cuts.where(F.col("_m.over") <= wide).select(*by, F.col("_m.start").alias("start"), F.lit(1).cast("long").alias("cut"))
    p = B.running(p.join(cuts, [*by, "start"], "left"), by, "start", F.coalesce("cut", F.lit(0).cast("long")), "g")
    p = written(p.withColumn("g", F.greatest("g", F.lit(1).cast("long"))).drop("cut", "over", "n"), "pulses")
    across = Window.partitionBy(*by).orderBy("g")
    groups = p.where("edit").groupBy(*by, "g").agg(F.min("a").alias("first"), F.min("start").alias("start"), F.max("reach").alias("reach"))
    groups = written(groups.withColumns({"stop": F.lead("first").over(across), "open": F.lag("reach").over(across)}), "groups")
    homes = written(p.where("fit").groupBy(*KEYS).agg((F.min("g") == F.max("g")).alias("one")), "homes")
    # Few blocks are in several groups, but for those of very many pulses.
    spread = pulses.join(homes.where("not one"), list(KEYS), "left_semi")
    snippets = pulse_snippets(s.withColumn("value", F.coalesce("value", F.lit(0.0))), spread, before, after)
    fits = written(template_fits(snippets, exclude, k), "fits")
    fitted = p.where("edit").groupBy(*by, "g", "block").agg(F.min("start").alias("start")).join(fits, list(KEYS)).select(*by, "g", "start", "base", "comps")
    edits = p.drop("end", "reach").join(homes, list(KEYS), "left").withColumn("local", F.col("fit") & F.col("one")).drop("fit", "one")
    edits = edits.join(fitted, [*by, "g", "start"], "left").join(groups.drop("start"), [*by, "g"])
    edits = written(edits, "edits")
    # The chunks of a group's windows and first ramp samples, of its own blocks' pulses, and of all that it shares with other groups.
    chunk = lambda d, a, z: d.where(F.col(z) >= F.col(a)).select(*by, "g", F.explode(F.sequence(F.floor(F.col(a) / SHARED), F.floor(F.col(z) / SHARED))).alias("_c"))
    ends = edits.select(*by, "g", "a", "z", "local", "edit", "ramp", (F.col("a") + F.col("size") - 1).alias("_z"), F.when(F.col("next") > F.col("ramp"), F.col("ramp")).alias("_r"))
    shares = groups.select(*by, "g", "first", "stop", (F.col("open") - 1).alias("_o"), (F.col("reach") - 1).alias("_z"))
    parts = [chunk(ends.where("edit"), "a", "_z"), chunk(ends.where("local"), "a", "z"), chunk(ends.where("edit"), "_r", "_r"), chunk(shares, "first", "_o"), chunk(shares, "stop", "_z")]
    need = parts[0]
    for d in parts[1:]:
        need = need.union(d)
    rows = written(s.withColumn("_c", F.floor(F.col("sample") / SHARED)).join(need.distinct(), [*by, "_c"]).drop("_c"), "chunks")

    def group_of(r: pa.Table, e: pa.Table) -> tuple[np.ndarray, np.ndarray, list[dict], Callable]:
        order = np.argsort(r.column("sample").to_numpy(), kind="stable")
        sample, value = r.column("sample").to_numpy()[order], np.nan_to_num(r.column("value").to_numpy().astype(float)[order])
        todo = sorted(e.to_pylist(), key=lambda x: x["start"])
        fit, todo = _fits(sample, value, todo, exclude, k), [x for x in todo if x["edit"]]
        own = (sample >= todo[0]["first"]) & (sample < todo[0]["reach"])
        return sample[own], value[own], todo, fit

    maps_schema = T.StructType([rows.schema[c] for c in (*by, "g")] + [T.StructField(c, T.BinaryType()) for c in ("taken", "given", "map")])

    def unknown(sample: np.ndarray, e: list[dict]) -> np.ndarray:
        return np.flatnonzero(sample < e[0]["open"]) if e[0]["open"] is not None else np.zeros(0, dtype=np.int64)

    def mapped(r: pa.Table, e: pa.Table) -> pa.Table:
        sample, value, todo, fit = group_of(r, e)
        free = unknown(sample, todo)
        to = np.flatnonzero(sample >= todo[0]["stop"]) if todo[0]["stop"] is not None else np.zeros(0, dtype=np.int64)
        cur = np.zeros((len(sample), 1 + len(free)))
        if len(to):
            cur[:, 0] = value
            cur[free, 1 + np.arange(len(free))] = 1
            _edit(sample, cur, todo, fit, share)
            cur[:, 0] -= value
        blobs = [sample[free].tobytes(), sample[to].tobytes(), cur[to].tobytes()]
        out = e.select([*by, "g"]).slice(0, 1)
        for name, blob in zip(("taken", "given", "map"), blobs):
            out = out.append_column(name, pa.array([blob], pa.binary()))
        return out

    carry_schema = T.StructType([rows.schema[c] for c in (*by, "g")] + [T.StructField(c, T.BinaryType()) for c in ("at", "by")])

    def folded(t: pa.Table) -> pa.Table:
        """What each group takes over, from the maps of those before it."""
        order = np.argsort(t.column("g").to_numpy())
        at, change, out = np.zeros(0, dtype=np.int64), np.zeros(0), []
        for i in order.tolist():
            out.append((at.tobytes(), change.tobytes()))
            taken, given = (np.frombuffer(t.column(c)[i].as_py(), dtype=np.int64) for c in ("taken", "given"))
            m = np.frombuffer(t.column("map")[i].as_py()).reshape(len(given), 1 + len(taken))
            x = np.zeros(len(taken))
            _, mine, theirs = np.intersect1d(taken, at, return_indices=True)
            x[mine] = change[theirs]
            at, change = given, m[:, 0] + m[:, 1:] @ x
        return t.select([*by, "g"]).take(pa.array(order)).append_column("at", pa.array([a for a, _ in out], pa.binary())).append_column("by", pa.array([b for _, b in out], pa.binary()))

    keys = [*by, "g"]
    maps = written(rows.groupBy(*keys).cogroup(edits.groupBy(*keys)).applyInArrow(mapped, maps_schema), "maps")
    carry = maps.groupBy(*by).applyInArrow(folded, carry_schema).join(groups.select(*keys, "start"), keys)
    edits = edits.join(carry, [*keys, "start"], "left")
    done_schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("sample", T.LongType()), T.StructField("cleaned", T.DoubleType()), T.StructField("until", T.LongType())])

    def cleaned(r: pa.Table, e: pa.Table) -> pa.Table:
        """Cleaned samples, and (with until) the ramps' first values."""
        sample, value, todo, fit = group_of(r, e)
        cur = value[:, None].copy()
        if todo[0]["at"]:
            at, change = np.frombuffer(todo[0]["at"], dtype=np.int64), np.frombuffer(todo[0]["by"])
            _, mine, theirs = np.intersect1d(sample, at, return_indices=True)
            cur[mine, 0] += change[theirs]
        ramps = _edit(sample, cur, todo, fit, share)
        own = (sample >= todo[0]["first"]) & (sample < (todo[0]["stop"] if todo[0]["stop"] is not None else sample[-1] + 1))
        n = int(own.sum()) + len(ramps)
        out = pa.table({c: pa.chunked_array([e.column(c).chunk(0).slice(0, 1)]).take(pa.array(np.zeros(n, dtype=np.int64))) for c in by})
        parts = [np.concatenate([sample[own], [a for a, _, _ in ramps]]).astype(np.int64), np.concatenate([cur[own, 0], [v for _, _, v in ramps]])]
        return out.append_column("sample", pa.array(parts[0])).append_column("cleaned", pa.array(parts[1])).append_column("until", pa.array([None] * int(own.sum()) + [z for _, z, _ in ramps], pa.int64()))

    done = written(rows.groupBy(*keys).cogroup(edits.groupBy(*keys)).applyInArrow(cleaned, done_schema), "cleaned")
    ramps = done.where("until is not null").select(*by, "sample", F.struct("sample", "until", "cleaned").alias("_r"))
    d = B.known(samples.join(ramps, [*by, "sample"], "left"), by, "sample", F.col("_r"), "_l")
    d = d.join(done.where("until is null").select(*by, "sample", "cleaned"), [*by, "sample"], "left")
    line = F.when(F.col("sample") < F.col("_l.until"), F.col("_l.cleaned") * (1 - (F.col("sample") - F.col("_l.sample")) / (F.col("_l.until") - F.col("_l.sample")))).otherwise(0.0)
    return d.withColumn("value", F.when(F.col("value").isNotNull(), F.coalesce("cleaned", F.col("value") - line))).select(*samples.columns)


def interpulse_ramp(samples: DataFrame, gaps: DataFrame, share: float = 1.0) -> DataFrame:
    """samples less a line from share of the value at each gap's start down to 0 at its end. gaps: session, channel, start, end, apart from each other."""
    first = gaps.join(samples.select("session", "channel", F.col("sample").alias("start"), F.col("value").alias("v0")), ["session", "channel", "start"]).where("end > start")
    each = first.select("session", "channel", "start", "end", "v0", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("sample"))
    ramp = each.select("session", "channel", "sample", (F.col("v0") * share * (1 - (F.col("sample") - F.col("start")) / (F.col("end") - F.col("start")))).alias("ramp"))
    d = samples.join(ramp, ["session", "channel", "sample"], "left")
    return d.withColumn("value", F.col("value") - F.coalesce("ramp", F.lit(0.0))).drop("ramp")


def template_rmse(snippets: DataFrame, neighbours: DataFrame) -> DataFrame:
    """session, channel, block, pulse and rmse of each snippet to the mean of its neighbours' snippets of the same pulse."""
    others = neighbours.join(snippets.withColumnRenamed("channel", "neighbour"), "neighbour").groupBy("session", "channel", "block", "pulse", "pos").agg(F.avg("value").alias("mean"))
    d = snippets.join(others, ["session", "channel", "block", "pulse", "pos"])
    return d.groupBy("session", "channel", "block", "pulse").agg(F.sqrt(F.avg((F.col("value") - F.col("mean")) ** 2)).alias("rmse"))


def template_parts(snippets: DataFrame, width: int, first_width: int = 3, group: int = 4096) -> DataFrame:
    """Snippets less a local template that begins and ends at 0: the mean of the last width earlier snippets of the same kind, a block's
    first pulse or a later one (of first pulses the last first_width), less its first value and a line to its last.

    Snippets are numbered by pulse in each kind, and groups of numbers are worked on with as many earlier ones as the mean looks
    back. Where lengths differ, a place's mean is of those that reach it; the line ends at the last place that has one,
    and beyond it, as where there are no earlier snippets, the template is 0."""
    kind = ["session", "channel", "is_first"]
    places = B.running(written(snippets.select(*kind, "pulse").distinct(), "places"), kind, "pulse", F.lit(1).cast("long"), "n")
    reach = max(width, first_width)
    d = B.halo(snippets.join(written(places, "places"), [*kind, "pulse"]), kind, "n", max(group, reach), reach, "block_")
    earlier = Window.partitionBy(*kind, "pos", "block_").orderBy("n")
    mean = F.when(F.col("is_first"), F.avg("value").over(earlier.rangeBetween(-first_width, -1))).otherwise(F.avg("value").over(earlier.rangeBetween(-width, -1)))
    d = d.withColumn("base", mean).where(F.col("block_") == F.floor(F.col("n") / max(group, reach)))
    whole = Window.partitionBy(*KEYS, "pulse")
    some = F.when(F.col("base").isNotNull(), F.struct("pos", "base"))
    d = d.withColumns({"_a": F.min(some).over(whole), "_z": F.max(some).over(whole)})
    fall = (F.col("_z.base") - F.col("_a.base")) * F.col("pos") / F.greatest(F.col("_z.pos"), F.lit(1))
    d = d.withColumn("template", F.coalesce(F.col("base") - F.col("_a.base") - fall, F.lit(0.0)))
    return d.select(*KEYS, "pulse", "pos", "is_first", "template", (F.col("value") - F.col("template")).alias("value"))


def sums_of_products(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows without nulls, their means and their covariances."""
    size = len(columns)
    row = grams(df.select(F.lit(0).alias("_g"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x")), ["_g"], size).first()
    if row is None:
        return 0, np.zeros(size), np.zeros((size, size))
    return row["n"], np.array(row["mean"]), np.frombuffer(row["gram"]).reshape(size, size) / row["n"]


def reduced_rank_regression(df: DataFrame, x: list[str], y: list[str], ranks: list[int], ridge: float = 0.0) -> DataFrame:
    """rank and mse of the best linear map of that rank from x to y, from sums of products alone."""
    n, _, cov = sums_of_products(df, [*x, *y])
    p = len(x)
    xx, xy, yy = cov[:p, :p] + ridge * np.eye(p), cov[:p, p:], cov[p:, p:]
    full = np.linalg.lstsq(xx, xy, rcond=None)[0]
    fitted = full.T @ xx @ full
    values = np.sort(np.linalg.eigvalsh(fitted))[::-1]
    rows = [(r, float((np.trace(yy) - values[:r].sum()) / len(y))) for r in ranks] if n else []
    return df.sparkSession.createDataFrame(rows, "rank int, mse double")


def factor_loadings(df: DataFrame, columns: list[str], k: int = 2, turns: int = 500, tolerance: float = 1e-9) -> DataFrame:
    """name, l1 to lk and noise of a factor model, by expectation and maximisation on the covariance matrix."""
    _, _, s = sums_of_products(df, columns)
    load, noise = factor_em(s, k, turns, tolerance)
    rows = [(c, *map(float, load[i]), float(noise[i])) for i, c in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "name string, " + ", ".join(f"l{j + 1} double" for j in range(k)) + ", noise double")
