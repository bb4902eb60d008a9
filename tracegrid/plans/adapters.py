"""The given tables as recordings, events, trials and metadata.

samples: a signal for each event type and user group; stims: event times of a session;
windows, trials and behaviour: ordered values of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.lineage import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> F.Column:
    """Milliseconds of a time stamp with or without a zone (UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1000


#: Rows of a partition where the number of shuffle partitions, or merging them, would make a task's sorts grow with the table.
PART_ROWS = 100_000


def parted(df: DataFrame, key: str) -> DataFrame:
    """A large table by key in as many partitions as it has PART_ROWS rows; a small one as it is."""
    n = -(-df.count() // PART_ROWS)
    return df if n <= 8 else df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


#: Makes the order of an order's lines whole: line numbers repeat in the given table.
LINES = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: the block primitives read their input more than once."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("session"), (F.col("user_id") % 8).cast("int").alias("channel"), "ts", "event_id", F.nanvl("value", F.lit(None).cast("double")).alias("value"))
    w = Window.partitionBy("session", "channel").orderBy("ts", "event_id")
    return written(e.select("session", "channel", (F.row_number().over(w) - 1).cast("long").alias("sample"), micros("ts").alias("t_ms"), "value"), "samples")


SAMPLES = """samples AS (SELECT event_type AS session, CAST(user_id % 8 AS INTEGER) AS channel,
 CAST(row_number() OVER (PARTITION BY event_type, user_id % 8 ORDER BY ts, event_id) - 1 AS BIGINT) AS sample,
 epoch_us(ts) / 1000.0::DOUBLE AS t_ms, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM events)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trial for each order, a condition for each priority; the lines of an order are its bins."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("condition"))
    w = Window.partitionBy("l_orderkey").orderBy(*LINES)
    li = parted(table(spark, sf_dir, "lineitem"), "l_orderkey")
    li = li.select(F.col("l_orderkey").alias("trial"), F.row_number().over(w).alias("bin"), F.col("l_quantity").alias("value"), F.col("l_extendedprice").alias("position"))
    return li.join(o, li.trial == o.o_orderkey).select("condition", "trial", "bin", "value", "position")


TRIALS = """trials AS (SELECT o_orderpriority AS condition, l_orderkey AS trial, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS bin, l_quantity AS value, l_extendedprice AS position
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """condition, trial, channel and value of every embedding entry."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("condition"), F.col("vec_id").alias("trial"), F.posexplode("embedding").alias("channel", "value")).withColumn("value", F.col("value").cast("double"))


FEATURES = """features AS (SELECT label AS condition, vec_id AS trial, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS channel, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
