"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is over the UTF-8 bytes of trusted text (labelled of quality and not toxic), of order
5: bytes need no word list, so no language has unknown words. Tasks count the byte 5-grams of whole texts and pre-aggregate them; all else about the model
is Spark joins and sums of count tables: continuation counts, discounts from counts of counts,
history totals, and, order by order, the probability of every 5-gram that any document has.

Documents are scored in one more pass, whatever the model's size. The head_grams (a fixed bound)
5-grams that the corpus has most often go to all tasks, which sum what they can of each document
and emit its other 5-grams, counted, as rows. These are joined with the table of probabilities and
summed by document. As the head has the frequent ones, none of the joined 5-grams has more than about
a head_grams-th of all rows, so the join has no hot key.

A document is kept if its perplexity is at most the quantile of the held-out trusted documents of
its language. Four fifths of the trusted documents (by a hash of the id) train the model, the
others set the thresholds, so that these don't profit from having been seen.

Defined cases: null and empty texts have one event, their end; null languages count as one
language; a language without held-out documents takes the quantile of all; without trusted text
every byte has the same probability and everything is kept; repeated rows are judged alike, each for itself;
rows without an id are judged but never trusted; an empty table gives an empty result; other columns aren't
read, and the stage keeps them whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import finished, kept_by, materialize, table

ORDER = 5
SLICE_BYTES = 1 << 20
#: Log probabilities are kept as multiples of 1 / UNIT.
UNIT = 1 << 24


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed windows of ORDER bytes, one for each byte and end of text, and where each text's begin."""
    pad = b"\0" * (ORDER - 1)
    data = np.frombuffer(b"".join(pad + t + b"\0" for t in texts) + pad, dtype=np.uint8).astype(np.int64)
    keys = np.zeros(len(data) - ORDER + 1, dtype=np.int64)
    for j in range(ORDER):
        keys |= data[j : len(keys) + j] << (8 * (ORDER - 1 - j))
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + ORDER - 1)
    valid = np.ones(len(keys), dtype=bool)
    for j in range(1, ORDER):
        valid[ends - j] = False
    return keys[valid], np.cumsum(sizes) - sizes


def _pieces(batches, text: int):
    """Slices of a few megabytes of text: the batch, and the texts as bytes."""
    for batch in batches:
        texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(text).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= SLICE_BYTES or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def trusted(labels: DataFrame) -> DataFrame:
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality") == 1, F.lit(False)) & F.coalesce(F.col("toxic") == 0, F.lit(True))).alias("good"))
    return good.where("good").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held_out"))


def count_grams(docs: DataFrame, good: DataFrame) -> DataFrame:
    """g, n (its count in all texts) and c (that in training text, 0 if it occurs elsewhere only) of every 5-gram of the documents."""
    train = good.where("not held_out").select("doc_id", F.lit(True).alias("_train"))
    marked = docs.select("doc_id", "text").join(train, "doc_id", "left").select("text", F.coalesce("_train", F.lit(False)).alias("t"))

    def run(batches):
        kept_by("kneser_ney")
        for part, texts in _pieces(batches, 0):
            flags = part.column(1).to_pylist()
            for flag in (True, False):
                chosen = [t for t, f in zip(texts, flags) if f == flag]
                if chosen:
                    g, n = np.unique(windows(chosen)[0], return_counts=True)
                    n = n.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n), pa.array(n if flag else np.zeros(len(g), np.int64))], ["g", "n", "c"])

    return marked.mapInArrow(run, "g long, n long, c long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> list[float]:
    """Those of counts 1, 2 and 3 or more, from counts of counts."""
    found = {r.c: r["count"] for r in counts.where("c between 1 and 4").groupBy("c").count().collect()}
    n = [found.get(i, 0) for i in range(1, 5)]
    if not n[0] or not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) if n[k - 1] else 0.5 * k for k in (1, 2, 3)]


def _cut(c: Column, d: list[float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).when(c >= 3, d[2]).otherwise(0.0)


def probabilities(grams: DataFrame) -> DataFrame:
    """g and lp, the natural log of the probability of each 5-gram's last byte after the others."""
    low = lambda col, k: col.bitwiseAND(F.lit((1 << 8 * k) - 1))
    counts = {ORDER: grams.where("c > 0").select("g", "c")}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: different bytes before
        counts[k] = materialize(counts[k + 1].groupBy(low(F.col("g"), k).alias("g")).agg(F.count("*").alias("c")), "kn-counts")
    wanted = {ORDER: grams.select("g")}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = wanted[k + 1].select(low(F.col("g"), k).alias("g")).distinct()
    below = None
    for k in range(1, ORDER + 1):
        d = discounts(counts[k])
        c = F.col("c")
        h = F.shiftright("g", 8).alias("h")
        hist = counts[k].groupBy(h).agg(F.sum("c").alias("total"), F.sum(_cut(c, d)).alias("mass"))
        rows = wanted[k].join(counts[k], "g", "left").select("g", h, F.coalesce("c", F.lit(0)).alias("c"), low(F.col("g"), k - 1).alias("s")).join(hist, "h", "left")
        rows = rows.withColumn("q", F.lit(1 / 256)) if below is None else rows.join(below, "s")
        p = F.when(F.col("total").isNull(), F.col("q")).otherwise((c - _cut(c, d) + F.col("mass") * F.col("q")) / F.col("total"))
        below = materialize(rows.select(F.col("g").alias("s"), p.alias("q")), "kn-probabilities")
    return below.select(F.col("s").alias("g"), F.log("q").alias("lp"))


def head_of(grams: DataFrame, head_grams: int) -> DataFrame:
    """g of the most frequent 5-grams, at most head_grams: those above a count taken from the histogram of the counts' logarithms."""
    level = F.floor(F.log2("n") * 64)
    rows = sorted(((r.level, r["count"]) for r in grams.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, have = float("inf"), 0
    for at, count in rows:
        if have + count > head_grams:
            break
        least, have = at, have + count
    return grams.where(level >= F.lit(float(least))).select("g")


def score(docs: DataFrame, grams: DataFrame, lps: DataFrame, *, head_grams: int = 1 << 19) -> DataFrame:
    """doc_id, lang, text_key (hash of the text), events and lp of every row."""
    spark = docs.sparkSession
    # Whole numbers, so that sums don't depend on their order and equal rows have equal ones.
    lps = materialize(lps.select("g", F.rint(F.col("lp") * UNIT).cast("long").alias("lp")), "kn-log-probabilities")
    got = lps.join(head_of(grams, head_grams), "g", "left_semi").toArrow()
    keys, values = got.column("g").to_numpy(), got.column("lp").to_numpy()
    order = np.argsort(keys)
    head = spark.sparkContext.broadcast((keys[order], values[order]))
    fields = [("doc_id", docs.schema["doc_id"].dataType), ("lang", T.StringType()), ("text_key", T.LongType()), ("row", T.LongType()), ("events", T.LongType()), ("lp", T.LongType()), ("g", T.LongType()), ("n", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def run(batches):
        kept_by("kneser_ney")
        known, value = head.value
        row = TaskContext.get().partitionId() << 40  # a number for each row; a task's rows are committed as a whole
        for part, texts in _pieces(batches, 3):
            keys, starts = windows(texts)
            n = len(texts)
            found = np.zeros(len(keys), dtype=bool)
            each = np.zeros(len(keys), dtype=np.int64)
            if len(known):
                at = np.searchsorted(known, keys)
                at[at == len(known)] = 0
                found = known[at] == keys
                each = np.where(found, value[at], 0)
            numbers = np.arange(row, row + n)
            row += n
            none = lambda kind, size: pa.nulls(size, kind)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(numbers), pa.array([len(t) + 1 for t in texts], pa.int64()), pa.array(np.add.reduceat(each, starts)), none(pa.int64(), n), none(pa.int64(), n)], schema.names)
            left = np.flatnonzero(~found)
            if len(left):
                pair = np.empty(len(left), dtype=[("row", np.int64), ("g", np.int64)])
                pair["row"], pair["g"] = numbers[np.searchsorted(starts, left, side="right") - 1], keys[left]
                order = np.lexsort((pair["g"], pair["row"]))
                pair = pair[order]
                first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                count = np.diff(np.append(first, len(pair)))
                pair = pair[first]
                m = len(pair)
                yield pa.RecordBatch.from_arrays([none(part.column(0).type, m), none(part.column(1).type, m), none(pa.int64(), m), pa.array(pair["row"]), none(pa.int64(), m), none(pa.int64(), m), pa.array(pair["g"]), pa.array(count.astype(np.int64))], schema.names)

    given = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.xxhash64("text").alias("text_key"), "text")
    both = materialize(given.mapInArrow(run, schema), "kn-parts")
    head.destroy()
    tail = both.where("g is not null").select("row", "g", "n").join(lps, "g").groupBy("row").agg(F.sum(F.col("n") * F.col("lp")).alias("more"))
    rows = both.where("g is null").select("doc_id", "lang", "text_key", "row", "events", "lp").join(materialize(tail, "kn-tails"), "row", "left")
    return rows.select("doc_id", "lang", "text_key", "events", ((F.col("lp") + F.coalesce("more", F.lit(0))) / float(UNIT)).alias("lp"))


def classify(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.995, head_grams: int = 1 << 19) -> DataFrame:
    """doc_id, lang, text_key, events, perplexity (for each byte), threshold and kept of every row."""

    def make() -> DataFrame:
        good = materialize(trusted(labels), "kn-trusted")
        grams = materialize(count_grams(docs, good), "kn-grams")
        rows = score(docs, grams, probabilities(grams), head_grams=head_grams)
        rows = materialize(rows.withColumn("perplexity", F.exp(-F.col("lp") / F.col("events"))), "kn-scores")
        held = rows.join(good.where("held_out"), "doc_id")
        at = F.percentile_approx("perplexity", quantile, 10_000)
        by_lang = materialize(held.groupBy("lang").agg(at.alias("limit")), "kn-limits")
        overall = held.agg(at.alias("limit")).first()["limit"]
        out = rows.join(by_lang, "lang", "left").withColumn("threshold", F.coalesce("limit", F.lit(overall).cast("double")))
        return out.select("doc_id", "lang", "text_key", "events", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))

    return finished(docs.sparkSession, make, "kn-classes")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their own columns; a row without an id is judged like any other."""
    gone = materialize(classify(docs, table(spark, sf_dir, "labels")).where("not kept").select("doc_id", "text_key").distinct(), "kn-rejected")
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs["text"]) == gone["text_key"])
    return docs.join(gone, same, "left_anti")


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "events", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "kept")
