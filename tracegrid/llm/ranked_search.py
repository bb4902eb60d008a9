"""Ranked lexical search: posting lists with range-maximum tables, searched best interval first.

Building the index is one pass over the whole texts. Each task cuts its documents into shards of bounded size, orders a
shard's documents by id, and writes a posting list for each term and shard (places in the shard and counts) and a list of
the shard's ids and lengths. Statistics of the corpus (documents, terms, documents with a term) are sums over these lists.

A search joins the terms of the queries with their lists. For each shard and block of queries the lists get their impacts
and one sparse table over all of them, which gives the place of the largest impact of any range of a list in two looks.
For each query the shard's documents are one interval; the sum of its lists' largest impacts bounds every score
inside. Again and again the intervals with the largest bounds are split at the document that holds their largest impact,
which gets its score, until no bound reaches the k-th score found. A first round asks each shard for few documents; the
k-th best of these bounds the answer from below, and the second round starts from there. What a shard gives is at
most k rows a query, ranked again across shards.

Defined cases: a document without terms (null or empty texts too) isn't counted and never found. Documents without an id count and may
be found; among equal scores they come first. Repeated documents are documents of their own, each with its rank. Queries
without terms, or whose terms are in no document, have no rows; queries of the same id are one, with the terms of all;
a query without an id is one too. Empty tables give an empty result. Other columns are not part of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .workspace import finished, materialize, table

#: Separators to blanks, A-Z to lower case, all other bytes as they are: ASCII digits, letters and every byte of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_BYTES = 4 << 20
SHARD_DOCS = 8192
QUERIES = 256
WIDE = 48


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _shard(docs: list[tuple[int | None, list[bytes]]], number: int) -> list[tuple]:
    """The rows of a shard: its documents, and a list for each term."""
    docs.sort(key=lambda d: (d[0] is not None, d[0]))
    vocabulary: dict[bytes, int] = {}
    ids = np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for _, own in docs for t in own), dtype=np.int64)
    lengths = np.array([len(own) for _, own in docs], dtype=np.int32)
    key, tf = np.unique(ids * len(docs) + np.repeat(np.arange(len(docs)), lengths), return_counts=True)
    term, place = key // len(docs), (key % len(docs)).astype(np.int32)
    ends = np.searchsorted(term, np.arange(len(vocabulary) + 1)).tolist()
    tf = tf.astype(np.int32)
    out = [(number, t.decode("utf-8", "replace"), ends[i + 1] - ends[i], place[ends[i] : ends[i + 1]].tobytes(), tf[ends[i] : ends[i + 1]].tobytes(), None) for t, i in vocabulary.items()]
    return [(number, None, len(docs), None, lengths.tobytes(), [i for i, _ in docs]), *out]


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written index of docs: part (docs or lists, a folder each), shard, term, n (documents), places, counts (a list's
    term counts, or the documents' lengths) and ids."""
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = d.schema["id"].dataType
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("places", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("part", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]):
        own, size, number = [], 0, TaskContext.get().partitionId() << 24

        def rows():
            made = _shard(own, number)
            for at in range(0, len(made), 4096):
                some = made[at : at + 4096]
                columns = [pa.array([r[i] for r in some], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), ids))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(["docs" if r[1] is None else "lists" for r in some])], schema.names)

        for batch in batches:
            ids = pa.list_(batch.column(0).type)
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_buffer()
                got = terms(text.to_pybytes()) if text is not None else []
                if not got:
                    continue
                own.append((batch.column(0)[i].as_py(), got))
                size += text.size
                if size >= SHARD_BYTES or len(own) >= SHARD_DOCS:
                    yield from rows()
                    own, size, number = [], 0, number + 1
        if own:
            yield from rows()

    return materialize(d.mapInArrow(run, schema), "search-index", by="part")


def sparse_table(values: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each power of two up to longest, the place of the first largest of so many values from each place on."""
    out = [np.arange(len(values), dtype=np.int32)]
    step = 1
    while 2 * step <= longest:
        a, b = out[-1][: len(values) - 2 * step + 1], out[-1][step : len(values) - step + 1]
        out.append(np.where(values[b] > values[a], b, a))
        step *= 2
    return out


class Shard:
    """The lists of a shard one after the other, with their impacts and the table of range maxima."""

    def __init__(self, places: list[np.ndarray], impacts: list[np.ndarray], docs: int):
        self.docs = docs
        self.ends = np.cumsum([0, *map(len, places)])
        self.place = np.concatenate(places).astype(np.int64)
        self.impact = np.concatenate(impacts)
        self.key = self.place + np.repeat(np.arange(len(places)), np.diff(self.ends)) * docs
        table_ = sparse_table(self.impact, int(np.diff(self.ends).max()))
        self.table = np.zeros((len(table_), len(self.place)), dtype=np.int32)
        for row, best in zip(self.table, table_):
            row[: len(best)] = best
        self.log = np.zeros(docs + 2, dtype=np.int8)
        for i in range(1, int(docs + 1).bit_length()):
            self.log[1 << i :] = i

    def largest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bound of each interval (a row of list ranges from a to b) and the document of its largest impact."""
        size = b - a
        some = size > 0
        level = self.log[np.maximum(size, 1)]
        left = np.where(some, a, 0)
        right = np.where(some, b - (1 << level.astype(np.int64)), 0)
        i, j = self.table[level, left], self.table[level, right]
        best = np.where(self.impact[j] > self.impact[i], j, i)
        value = np.where(some, self.impact[best], 0)
        top = value.argmax(axis=1)
        return value.sum(axis=1), self.place[best[np.arange(len(best)), top]]

    def search(self, lists: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best for the query with these lists, of those whose score is at least floor and above 0;
        equal scores by ascending place."""
        first = lists * self.docs
        a, b = self.ends[lists][None, :], self.ends[lists + 1][None, :]
        bound, split = self.largest(a, b)
        found, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        least = max(floor, 1)
        while len(bound):
            if len(bound) > WIDE:
                now = np.argpartition(-bound, WIDE)[:WIDE]
                rest = np.ones(len(bound), dtype=bool)
                rest[now] = False
            else:
                now, rest = np.arange(len(bound)), np.zeros(len(bound), dtype=bool)
            d, lo, hi = split[now], a[now], b[now]
            at = np.searchsorted(self.key, first[None, :] + d[:, None])
            there = at < hi
            there &= self.key[np.minimum(at, len(self.key) - 1)] == first[None, :] + d[:, None]
            score = np.where(there, self.impact[np.minimum(at, len(self.key) - 1)], 0).sum(axis=1)
            ok = score >= least
            found, scores = np.concatenate([found, d[ok]]), np.concatenate([scores, score[ok]])
            if len(scores) > k:
                best = np.lexsort((found, -scores))[:k]
                found, scores = found[best], scores[best]
            if len(scores) == k:
                least = max(least, int(scores.min()))
            a2, b2 = np.concatenate([lo, at + there]), np.concatenate([at, hi])
            bound2, split2 = self.largest(a2, b2)
            keep, rest = bound2 >= least, rest & (bound >= least)
            a, b = np.concatenate([a[rest], a2[keep]]), np.concatenate([b[rest], b2[keep]])
            bound, split = np.concatenate([bound[rest], bound2[keep]]), np.concatenate([split[rest], split2[keep]])
        best = np.lexsort((found, -scores))
        return found[best], scores[best]


def impacts(tf: np.ndarray, length: np.ndarray, weight: int, n: int, total: int) -> np.ndarray:
    m = 100 - 50 + (50 * length.astype(np.int64) * n) // total
    return weight * ((1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 20 * m))


def _queries(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """query (a number), id and term of each distinct term of each query."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    t = items.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), upper, lower), F.lit(TERM), 0)).alias("term"))
    each = t.groupBy("id").agg(F.collect_set("term").alias("terms"))
    return materialize(each.withColumn("query", F.monotonically_increasing_id()), "search-queries")


def search(indexed: DataFrame, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """id, rank, doc and score of the k best documents of the index for each query."""
    lists, docs = indexed.where("part = 'lists'"), indexed.where("part = 'docs'")
    sizes = docs.select("shard", F.col("n").cast("long").alias("n"), "counts").mapInArrow(_totals, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.count("*").alias("shards")).first()
    n, total = sizes.n or 0, sizes.total or 0
    queries = _queries(items, id_col, text_col)
    blocks = max(1, -(-queries.count() // QUERIES))
    asked = queries.select("query", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), F.explode("terms").alias("term"))
    asked = asked.groupBy("block", "term").agg(F.sort_array(F.collect_list("query")).alias("queries"))
    wanted = materialize(lists.select("shard", "term", "n", "places", "counts").join(asked.select("term").distinct(), "term"), "search-lists")
    df = wanted.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2 * F.lit(n).cast("double") + 2) / (2 * F.col("df") + 1)))
    asked = materialize(asked.join(df, "term").select("block", "term", "queries", weight.alias("weight")).where("weight > 0"), "search-terms")

    def round_(k: int, floors: DataFrame | None) -> DataFrame:
        lists = wanted.join(asked, "term").select("shard", "block", "term", "weight", "queries", "places", "counts")
        own = docs.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "counts", "ids")
        if floors is None:
            floors = asked.select("block").distinct().select("block", F.lit(None).cast("array<struct<query: long, score: long>>").alias("floors"))
        else:
            floors = floors.groupBy("block").agg(F.collect_list(F.struct("query", "score")).alias("floors"))
        own = own.join(floors, "block").select("shard", "block", "counts", "ids", "floors")
        kind = docs.schema["ids"].dataType.elementType
        schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("block", T.IntegerType()), T.StructField("doc", kind), T.StructField("score", T.LongType())])
        return lists.groupBy("shard", "block").cogroup(own.groupBy("shard", "block")).applyInArrow(lambda a, b: _answers(a, b, n, total, k, schema.names), schema)

    def ranked(answers: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc"))
        return answers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    # A few of each shard's best bound the k-th from below: four times k of them in all.
    few = min(k, -(-4 * k // max(1, sizes.shards)))
    floors = None
    if few < k:
        first = ranked(round_(few, None), k)
        floors = materialize(first.groupBy("query", "block").agg(F.when(F.count("*") == k, F.min("score")).otherwise(F.lit(1)).alias("score")), "search-floors")
    best = ranked(round_(k, floors), k)
    return best.join(queries.select("query", "id"), "query").select("id", "rank", "doc", "score")


def _totals(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array([int(np.frombuffer(c.as_buffer(), dtype=np.int32).sum(dtype=np.int64)) for c in b.column(2)], pa.int64())], ["n", "total"])


def _answers(lists: pa.Table, own: pa.Table, n: int, total: int, k: int, names: list[str]) -> pa.Table:
    """The best documents of a shard for each query of a block that has terms there."""
    empty = pa.table({c: pa.array([], t) for c, t in zip(names, (pa.int64(), pa.int32(), own.column("ids").type.value_type, pa.int64()))})
    if not own.num_rows or not lists.num_rows:
        return empty
    length = np.frombuffer(own.column("counts")[0].as_buffer(), dtype=np.int32)
    places = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in lists.column("places")]
    counts = [np.frombuffer(x.as_buffer(), dtype=np.int32) for x in lists.column("counts")]
    shard = Shard(places, [impacts(tf, length[p], w, n, total) for p, tf, w in zip(places, counts, lists.column("weight").to_pylist())], len(length))
    of: dict[int, list[int]] = {}
    for i, queries in enumerate(lists.column("queries").to_pylist()):
        for q in queries:
            of.setdefault(q, []).append(i)
    floors = {x["query"]: x["score"] for x in own.column("floors")[0].as_py() or []}
    found = {q: shard.search(np.array(own_lists), k, floors.get(q, 1)) for q, own_lists in of.items()}
    size = [len(d) for d, _ in found.values()]
    place = np.concatenate([d for d, _ in found.values()])
    ids = own.column("ids").combine_chunks().flatten()
    block = int(own.column("block")[0].as_py())
    columns = [np.repeat(np.array(list(found), dtype=np.int64), size), np.full(len(place), block, dtype=np.int32), ids.take(pa.array(place)), np.concatenate([s for _, s in found.values()])]
    return pa.table({c: pa.array(x) if not isinstance(x, (pa.Array, pa.ChunkedArray)) else x for c, x in zip(names, columns)})


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id and score: the 50 best documents of each benchmark item."""

    def make() -> DataFrame:
        got = search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
        return got.select(F.col("id").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")

    return finished(spark, make, "search")
