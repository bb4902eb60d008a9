"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Each whole text gives its shingle set, 768 minima, the 2 low bits of each packed into 24
   longs, and 24 band keys of 4 minima. Equal sets are one class; only classes go on.
2. Every member of a band bucket is paired with the bucket's smallest id. The packed bits give a
   collision-corrected similarity, and each class has its most promising star confirmed on
   full sets. In a few turns, the members outside a bucket's largest component are held against
   a hashed pick of it; the turns end when fewer than a tenth of the pairs tried are links.
3. Where a bucket still spans several components, the members outside its largest one are held
   against all the others; every pair that the bits leave possible is confirmed. After that no
   candidate pair of a bucket is open, so no link is lost to stars.

A pair of similarity 0.8 shares no band with probability 3e-6, and its estimate falls below
min_estimate (4 standard deviations) with probability 3e-5; nothing is capped.

Defined cases: null, empty and blank texts have no shingles, link to nothing and are kept; a
text of fewer words than a shingle is one shingle; rows without an id are left out; texts under
one id are one document; an empty table gives an empty result; other columns aren't read, and the
stage keeps them whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .byte_bpe import _slices
from .workspace import finished, kept_by, materialize, table

MINIMA, BANDS, ROWS = 768, 24, 4
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(n: int, salt: int) -> np.ndarray:
    return _mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 32)) * _ODD)


_MULTIPLY, _FLIP = _numbers(MINIMA, 1) | np.uint64(1), _numbers(MINIMA, 2)
_BAND = _numbers(BANDS * ROWS, 3).reshape(BANDS, ROWS) | np.uint64(1)
_LANES = np.uint64(1) << (np.uint64(2) * np.arange(32, dtype=np.uint64))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted different 64-bit hashes of the text's n-word shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and white space \x20 \x09-\x0D
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    weights = _numbers(max(n, len(h)) if len(h) < n else n, 4) | np.uint64(1)
    if len(h) < n:
        return _mix((h * weights[: len(h)]).sum(keepdims=True) + np.uint64(len(h)))
    total = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for j in range(n):
        total += h[j : len(h) - n + 1 + j] * weights[j]
    return np.unique(_mix(total))


def minima(items: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(items), 1024):
        np.minimum(out, ((items[i : i + 1024, None] ^ _FLIP) * _MULTIPLY).min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set_key (hash of the whole set), bits (packed) and bands."""

    def run(batches):
        import xxhash

        kept_by("near_dedup")
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in _slices(batch, text=1):
                    rows = []
                    for text in part.column(1).to_pylist():
                        s = shingles(text, n)
                        if not len(s):
                            rows.append((0, None, None, None))
                            continue
                        m = minima(s)
                        bits = ((m & np.uint64(3)).reshape(-1, 32) * _LANES).sum(axis=1, dtype=np.uint64)
                        bands = _mix((m[: BANDS * ROWS].reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=np.uint64))
                        rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), bits.astype(np.int64), bands.astype(np.int64)))
                    cols = zip(*rows) if rows else [[]] * 4
                    kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_shingles", "set_key", "bits", "bands"])

    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return ids.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bits array<long>, bands array<long>")


def sets(docs: DataFrame, n: int) -> DataFrame:
    """doc_id and its full shingle set."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in _slices(batch, text=1):
                    got = [shingles(t, n).astype(np.int64) for t in part.column(1).to_pylist()]
                    ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got) if got else np.empty(0, np.int64)))], ["doc_id", "items"])

    return docs.mapInArrow(run, "doc_id long, items array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed 2-bit minima: a quarter of unequal minima agree by chance."""
    low = F.lit(0x5555555555555555)
    differ = sum((F.bit_count((a[i].bitwiseXOR(b[i])).bitwiseOR(F.shiftrightunsigned(a[i].bitwiseXOR(b[i]), 1)).bitwiseAND(low)) for i in range(MINIMA // 32)), F.lit(0))
    return ((F.lit(1.0) - differ / float(MINIMA)) - 0.25) / 0.75


def confirm(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * common >= percent * union."""
    pairs = materialize(pairs.select("a", "b"), "dup-pairs")
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "dup-ids")
    full = materialize(sets(docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi"), n), "dup-sets")
    both = pairs.join(full.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a").join(full.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return materialize(both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "dup-links")


def components(links: DataFrame) -> DataFrame:
    """doc_id and component of every linked id: the smallest id that it reaches.

    Each round takes the least label of the neighbours, hooks the roots met and shortcuts;
    it ends when a round changes nothing."""
    edges = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    label = materialize(edges.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("m")).select("doc_id", F.least("doc_id", "m").alias("component")), "cc-labels")
    while True:
        near = edges.join(label.select(F.col("doc_id").alias("b"), "component"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("component").alias("near"))
        low = materialize(label.join(near, "doc_id").select("doc_id", "component", F.least("component", "near").alias("low")), "cc-low")
        hook = low.groupBy("component").agg(F.min("low").alias("hook"))
        roots = materialize(hook.select(F.col("component").alias("root"), "hook"), "cc-roots")
        moved = low.join(roots.withColumnRenamed("root", "component"), "component").select("doc_id", "component", F.least("low", "hook").alias("low"))
        # Shortcut: a label that was itself a root follows where that root was hooked.
        after = moved.join(roots.select(F.col("root").alias("low"), F.col("hook").alias("further")), "low", "left").select("doc_id", "component", F.least("low", F.coalesce("further", "low")).alias("new"))
        after = materialize(after, "cc-after")
        label = after.select("doc_id", F.col("new").alias("component"))
        if after.where("component != new").isEmpty():
            return label


def classes(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row, as a written table; what it was made from is deleted."""
    return finished(docs.sparkSession, lambda: _classes(docs, **params), "dup-result")


def _classes(docs: DataFrame, *, n: int = 5, percent: int = 80, min_estimate: float = 0.73, sure: float = 0.86, picks: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row. picks: most turns of step 2; step 3 takes all that they leave."""
    sig = materialize(signatures(docs, n), "dup-signatures")
    groups = materialize(sig.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id")), "dup-groups")
    reps = materialize(sig.join(groups, ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"]), "dup-reps")
    rows = reps.select("doc_id", F.explode("bands").alias("bucket"))
    stars = rows.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.xxhash64("doc_id", "bucket").alias("h"), "doc_id"))["doc_id"].alias("pick"), F.count("*").alias("n")).where("n > 1")
    stars = materialize(stars.drop("n"), "dup-stars")
    members = materialize(rows.join(stars, "bucket"), "dup-members")
    bits = reps.select("doc_id", "bits", "n_shingles", "bands")

    def of(side: str) -> DataFrame:
        return bits.select(F.col("doc_id").alias(side), F.col("bits").alias(f"bits_{side}"), F.col("n_shingles").alias(f"n_{side}"))

    def sizes(x: str, y: str) -> Column:
        return (100 * F.least(x, y) >= percent * F.greatest(x, y))

    def likely(pairs: DataFrame) -> DataFrame:
        both = materialize(pairs.distinct(), "dup-pairs").join(of("a"), "a").join(of("b"), "b").where(sizes("n_a", "n_b"))
        return both.select("a", "b", estimate(F.col("bits_a"), F.col("bits_b")).alias("e")).where(F.col("e") >= min_estimate)

    star = likely(members.where("least != doc_id").select(F.col("least").alias("a"), F.col("doc_id").alias("b")))
    first = star.groupBy("b").agg(F.coalesce(F.min(F.when(F.col("e") >= sure, F.col("a"))), F.max_by("a", F.struct("e", -F.col("a")))).alias("a")).select("a", "b")
    tried = materialize(first, "dup-first")
    links = confirm(tried, docs, n, percent)
    comp = components(links)

    def placed() -> DataFrame:
        return members.join(comp, "doc_id", "left").select("bucket", "doc_id", "pick", F.coalesce("component", "doc_id").alias("component"))

    def spread_of(cells: DataFrame) -> DataFrame:
        """Buckets with several components, and the largest of each."""
        return cells.groupBy("bucket", "component").count().groupBy("bucket").agg(F.max_by("component", F.struct("count", "component")).alias("major"), F.count("*").alias("k")).where("k > 1").drop("k")

    for turn in range(picks):
        cells = materialize(placed().drop("pick"), "dup-cells")
        spread = materialize(spread_of(cells), "dup-spread")
        inside = cells.join(spread, "bucket")
        order = F.xxhash64("doc_id", "bucket", F.lit(turn))
        pick = inside.where("component = major").groupBy("bucket").agg(F.min(F.struct(order.alias("h"), "doc_id"))["doc_id"].alias("s"))
        apart = inside.where("component != major").select("bucket", "doc_id").join(materialize(pick, "dup-picks"), "bucket")
        more = likely(apart.select(F.least("doc_id", "s").alias("a"), F.greatest("doc_id", "s").alias("b"))).select("a", "b")
        more = materialize(more.join(tried, ["a", "b"], "left_anti"), "dup-more")
        if more.isEmpty():
            break
        fresh = confirm(more, docs, n, percent)
        links, tried = materialize(links.union(fresh), "dup-links"), materialize(tried.union(more), "dup-tried")
        comp = components(links)
        if 10 * fresh.count() < more.count():  # picks rarely hit: the sweep takes the rest
            break

    cells = materialize(placed().drop("pick"), "dup-cells")
    spread = spread_of(cells)
    spread = materialize(spread, "dup-spread")
    cross = materialize(cells.join(spread, "bucket").join(bits, "doc_id"), "dup-cross")
    x, y = cross.where("component != major").alias("x"), cross.alias("y")
    # Two documents that share several buckets are a pair in one of them alone.
    once = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.bucket")
    open_pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.major")) | (F.col("x.doc_id") < F.col("y.doc_id"))) & sizes("x.n_shingles", "y.n_shingles") & (estimate(F.col("x.bits"), F.col("y.bits")) >= min_estimate) & once)
    open_pairs = open_pairs.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).join(tried, ["a", "b"], "left_anti")
    open_pairs = materialize(open_pairs, "dup-open")
    if not open_pairs.isEmpty():
        comp = components(links.union(confirm(open_pairs, docs, n, percent)))

    named = groups.join(comp, "doc_id", "left").select("set_key", F.coalesce("component", "doc_id").alias("class"))
    # Two plain scans, so that the adaptive skew join may split a hot set.
    out = sig.select("doc_id", "n_shingles", "set_key").join(materialize(named, "dup-classes"), "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("class", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one with the smallest id. Rows
    without an id stay: nothing tells which of them is which."""
    gone = materialize(classes(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id"), "dup-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*(docs[f"`{c}`"] for c in docs.columns))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), n=4)
