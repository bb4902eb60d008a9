"""URL filters: written host and path rules first, mined association rules for the rest.

FP-growth mines token combinations of the URLs of labelled pages together with the item of the
label. Tokens that occur in exactly the same pages (equal counts and equal sums of two hashes of
the page) are one item, so a group of copies of a long URL is one combination and not all
subsets of its tokens. A combination is a rule where it has the support with the label's item and its
confidence is at least min_lift times the share of blocked pages and at least min_errors standard
errors above it: what counts as a high confidence depends on how common blocked pages are. A rule
is dropped where a shorter one of its tokens is as sure. Rules are posted under their rarest token;
a page meets a rule by that token and is checked for the others.

Defined cases: a null url or one without "://" has empty host and path and fits no written rule (its
tokens may meet mined ones); null labels and labels of unknown pages are ignored; a page labelled twice is
blocked if any label blocks; repeated rows are judged alike, and rows without an id like any other; without
labels, or without a combination of the support, there are no mined rules; other columns aren't read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import materialize, table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
BLOCK = "@block"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_for(rules, host_col: Column, path_col: Column) -> tuple[Column, Column]:
    """Rule and verdict of the longest written rule that fits; a short hand-written list becomes one conditional."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(slash + p)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(url, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != ""))


def transactions(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """id, t (its tokens) and bad of the labelled pages that have tokens."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    lab = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(bad).alias("bad")).where("bad is not null")
    return pages.select(F.col("page_id").alias("id"), tokens(F.col("url")).alias("t")).where(F.size("t") > 0).join(lab, "id")


def mine(pages: DataFrame, labels: DataFrame, *, min_support: float = 0.01, min_pages: int = 5, min_lift: float = 1.1, min_errors: float = 1.0) -> DataFrame:
    """post (a rule's rarest token), antecedent, support and confidence of each kept blocking rule. min_pages: blocked
    pages that a rule needs at least, however few are labelled, so that no single page makes one."""
    none = pages.sparkSession.createDataFrame([], "post string, antecedent array<string>, support double, confidence double")
    seen = materialize(transactions(pages, labels), "url-transactions")
    whole = seen.agg(F.count("*").alias("n"), F.avg(F.col("bad").cast("double")).alias("share")).first()
    if not whole.n or not whole.share:
        return none
    support = max(min_support * whole.n, min_pages)
    each = seen.select(F.xxhash64("id", "t").alias("x"), F.hash("id", "t").cast("long").alias("y"), F.explode("t").alias("token"))
    known = each.groupBy("token").agg(F.count("*").alias("freq"), F.sum(F.shiftright("x", 20)).alias("x"), F.sum("y").alias("y")).where(F.col("freq") >= support)
    # Tokens of the same pages: at most 1 / min_support different ones in a page, whatever the size of the tables.
    same = materialize(known.groupBy("freq", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select("freq", "tokens", F.col("tokens")[0].alias("item")), "url-items")
    rows = seen.withColumn("row", F.monotonically_increasing_id()).select("row", "bad", F.explode("t").alias("item")).join(same.select("item"), "item")
    marked = F.when(F.first("bad"), F.array_append(F.collect_set("item"), F.lit(BLOCK))).otherwise(F.collect_set("item"))
    items = materialize(rows.groupBy("row").agg(marked.alias("items")).select("items"), "url-baskets")
    if items.isEmpty():
        return none
    total = items.count()
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, support / total)).fit(items).freqItemsets
    sets = materialize(sets.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    both = sets.where(F.array_contains("items", BLOCK)).select(F.array_remove("items", BLOCK).alias("items"), F.col("freq").alias("hits")).where((F.size("items") > 0) & (F.col("hits") >= support))
    rated = both.join(sets.where(~F.array_contains("items", BLOCK)), "items").withColumn("confidence", F.col("hits") / F.col("freq"))
    least = F.lit(whole.share) + F.greatest(F.lit((min_lift - 1) * whole.share), min_errors * F.sqrt(F.lit(whole.share * (1 - whole.share)) / F.col("freq")))
    rated = materialize(rated.where(F.col("confidence") >= least).select("items", "freq", "confidence"), "url-rated")
    rules = rated.select(F.monotonically_increasing_id().alias("rule"), "items", "freq", "confidence")
    rules = materialize(rules, "url-rules")
    parts = rules.select("rule", "confidence", F.size("items").alias("n"), F.explode("items").alias("item"))
    # A shorter rule meets the longer ones by its items; it is inside those where all of them meet.
    short, long = parts.select(F.col("rule").alias("s"), F.col("n").alias("sn"), F.col("confidence").alias("sc"), "item"), parts.select(F.col("rule").alias("l"), F.col("n").alias("ln"), F.col("confidence").alias("lc"), "item")
    inside = short.join(long, "item").where("sn < ln and sc >= lc").groupBy("s", "sn", "l").count().where("count = sn").select(F.col("l").alias("rule")).distinct()
    best = rules.join(inside, "rule", "left_anti").select("rule", "freq", "confidence", F.explode("items").alias("item")).join(same.withColumnRenamed("freq", "item_freq"), "item")
    kept = best.groupBy("rule", "freq", "confidence").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("antecedent"), F.min_by("item", F.struct("item_freq", "item")).alias("post"))
    return materialize(kept.select("post", "antecedent", (F.col("freq") * F.col("confidence") / whole.n).alias("support"), "confidence"), "url-rules")


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence (of the strongest mined rule that fired, else null)."""
    index = mine(pages, labels, **mining)
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    name, verdict = rule_for(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": name, "_verdict": verdict})
    # By the text of the url: each different one is judged once, and a page needs no id.
    met = rows.where("_verdict is null and url is not null").select("url").distinct().select("url", tokens(F.col("url")).alias("t"))
    met = met.select("*", F.explode("t").alias("post")).join(index, "post").where(F.size(F.array_except("antecedent", "t")) == 0)
    fired = met.groupBy("url").agg(F.max("confidence").alias("confidence"))
    out = rows.join(fired, "url", "left").withColumn("confidence", F.when(F.col("_verdict").isNull(), F.col("confidence")))
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", mined).alias("verdict"), "confidence")


def op2_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
