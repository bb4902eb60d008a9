"""Quality rules as learned decision lists.

Statistics of every whole text are taken in one narrow pass. Sequential covering then grows
threshold conjunctions on one part of the labelled statistics, prunes each on the rest, and
the ordered list becomes one Spark conditional expression that judges all rows.

Defined cases: a null or empty text has no words, all statistics 0 and fails the base rules;
repeated rows are judged alike, and rows without an id like any other; an empty table gives an empty result; without labels the list
is empty and only the base rules act. Null labels and labels of unknown documents are ignored;
a document labelled twice counts with its lowest quality; of several texts under a labelled id the one with the
least hash is learned from. Other columns are kept whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import _slices, numbered, with_column
from .workspace import fresh, table

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
UPPER = bytes(range(65, 91))
ASCII_LETTERS = UPPER + bytes(range(97, 123))
DIGITS = b"0123456789"
PUNCT = b"!?.,;:"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = (
    "symbol_ratio", "upper_ratio", "digit_ratio", "bang_ratio", "punct_ratio",
    "dup_line_ratio", "repeat_ratio", "unique_ratio", "mean_word", "words_per_line",
)
FEATURES = ("n_words", *RATIOS)
SCHEMA = ", ".join([*(f"{c} long" for c in COUNTS), *(f"{r} double" for r in RATIOS)])


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero([found[w] > 1 for w in windows])
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + 3, -1)
    return int((np.cumsum(inside)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
    lines = [x for x in raw.split(b"\n") if x.strip()]
    solid = len(raw) - sum(map(raw.count, (WHITE[i : i + 1] for i in range(6))))
    chars = (len(text) if text else 0) - (len(raw) - solid)
    gone = lambda drop: len(raw) - len(raw.translate(None, drop))
    n, symbols, repeats = len(words), gone(SYMBOLS), repeat_words(words)
    dup = len(lines) - len(set(lines))
    letters = gone(ASCII_LETTERS)
    return (
        n, chars, symbols, dup, repeats,
        symbols / max(chars, 1), gone(UPPER) / max(letters, 1), gone(DIGITS) / max(chars, 1), raw.count(b"!") / max(n, 1), gone(PUNCT) / max(n, 1),
        dup / max(len(lines), 1), repeats / max(n, 1), len(set(words)) / max(n, 1), chars / max(n, 1), n / max(len(lines), 1),
    )


def with_statistics(docs: DataFrame, text_col: str = "text", stats_col: str = "_stats") -> DataFrame:
    """docs with all its columns and the struct stats_col; one narrow Arrow pass."""
    kinds = pa.struct([*((c, pa.int64()) for c in COUNTS), *((r, pa.float64()) for r in RATIOS)])
    fields = [*(T.StructField(c, T.LongType()) for c in COUNTS), *(T.StructField(r, T.DoubleType()) for r in RATIOS)]
    schema, places = with_column(docs, stats_col, T.StructType(fields))
    text = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in _slices(batch, text=text):
                rows = [statistics(x) for x in part.column(text).to_pylist()]
                cols = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), pa.StructArray.from_arrays(cols, fields=list(kinds))], schema.names)

    return numbered(docs).mapInArrow(run, schema)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, stats: Column) -> Column:
        c = stats[self.feature]
        return c >= F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


def _precision(rule: list[Test], x: dict, bad: np.ndarray) -> tuple[float, int]:
    hit = np.ones(len(bad), dtype=bool)
    for t in rule:
        hit &= t.holds(x)
    return (bad[hit].mean() if hit.any() else 0.0), int(bad[hit].sum())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, min_precision: float = 0.95, min_cover: int = 5, max_tests: int = 4, max_rules: int = 20, cuts: int = 48, seed: int = 7) -> list[list[Test]]:
    """Ordered rejecting rules. Each is grown by information gain on two thirds of what the rules before
    left over and pruned on the other third; the list ends when a rule falls below min_precision on either."""
    part = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left, rules = np.ones(len(bad), dtype=bool), []
    while len(rules) < max_rules:
        grow, prune = left & part, left & ~part
        gx, gb = {f: x[f][grow] for f in FEATURES}, bad[grow]
        px, pb = {f: x[f][prune] for f in FEATURES}, bad[prune]
        if gb.sum() < min_cover:
            break
        rule, inside = [], np.ones(len(gb), dtype=bool)
        while len(rule) < max_tests and not gb[inside].all():
            p0, best = gb[inside].mean(), None
            for f in FEATURES:
                values = np.unique(np.quantile(gx[f][inside & gb], np.linspace(0, 1, cuts)))
                for above in (True, False):
                    for v in values:
                        hit = inside & (gx[f] >= v if above else gx[f] <= v)
                        p = int(gb[hit].sum())
                        if p < min_cover:
                            continue
                        gain = p * (np.log2(p / hit.sum()) - np.log2(p0))
                        if best is None or gain > best[0] + 1e-12:
                            best = (gain, Test(f, above, float(v)), hit)
            if best is None or best[0] <= 1e-9:
                break
            rule.append(best[1])
            inside = best[2]
        while len(rule) > 1 and _precision(rule[:-1], px, pb)[0] >= max(min_precision, _precision(rule, px, pb)[0]):
            rule = rule[:-1]
        grown, cover = _precision(rule, gx, gb) if rule else (0.0, 0)
        pruned, seen = _precision(rule, px, pb) if rule else (0.0, 0)
        if grown < min_precision or cover < min_cover or (seen and pruned < min_precision) or (not seen and len(pb) >= 4 * min_cover):
            break
        rules.append(rule)
        hit = np.ones(len(bad), dtype=bool)
        for t in rule:
            hit &= t.holds(x)
        left &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 20_000, **params) -> list[list[Test]]:
    """Learns from at most about max_labelled labelled ids (a documented bound, at most twice that many), picked by a hash
    of the id over all of them; statistics are taken of their rows alone, where these lie. Of rows with the same id the
    one whose text has the least hash counts."""
    lab = labels.where("quality is not null").select(F.col(id_col).alias("id"), "quality").where("id is not null").groupBy("id").agg(F.min("quality").alias("quality"))
    picked = lab.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi")
    n = picked.count()
    if n > max_labelled:
        picked = picked.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * max_labelled / n))).limit(2 * max_labelled)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    stats = with_statistics(rows, stats_col="stats").select("id", "quality", F.xxhash64("text").alias("h"), "stats")
    one = stats.groupBy("id", "quality").agg(F.min_by("stats", "h").alias("stats"))
    got = one.select("stats.*", "quality", "id").toPandas().sort_values("id")
    return learn({f: got[f].to_numpy(dtype=float) for f in FEATURES}, got["quality"].to_numpy() == 0, **params)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def decision(rules: list[list[Test]], stats: Column) -> Column:
    """Number of the first rule that fires as an ordered conditional, null if none."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(rules))):
        hit = rules[i][0].column(stats)
        for t in rules[i][1:]:
            hit = hit & t.column(stats)
        out = F.when(hit, F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, *, stats_col: str = "_stats", **params) -> DataFrame:
    """doc_id, statistics, base_failed, rule (of the learned list, else null) and kept of each row."""
    rules = fit(docs, labels, **params)
    s = F.col(stats_col)
    judged = with_statistics(docs.select("doc_id", "text"), stats_col=stats_col).select("doc_id", s, base_failed(s).alias("base_failed"), decision(rules, s).alias("rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither base rules nor the learned list reject, with their own columns."""
    rules = fit(docs, table(spark, sf_dir, "labels"))
    name = fresh(docs, "stats")
    marked = with_statistics(docs, stats_col=name)
    s = F.col(name)
    return marked.where(~base_failed(s) & decision(rules, s).isNull()).drop(name)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *(F.col("_stats")[c].alias(c) for c in COUNTS), "base_failed", "rule", "kept")
