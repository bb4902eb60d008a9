"""Readers and writers: metadata, tracks, frame maps, recordings, impedances, file catalogues."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normalise_columns(df: DataFrame) -> DataFrame:
    """Lower-case names of letters, digits and underscores; on the schema alone."""
    return df.toDF(*(re.sub(r"[^a-z0-9]+", "_", c.replace("﻿", "").strip().lower()).strip("_") for c in df.columns))


def pick_col(df: DataFrame, names: list[str]) -> str | None:
    have = {re.sub(r"[^a-z0-9]", "", c.lower()): c for c in df.columns}
    return next((have[k] for k in (re.sub(r"[^a-z0-9]", "", n.lower()) for n in names) if k in have), None)


def file_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if each line is, else windows-1252 unless a byte that it doesn't define is there, else ISO-8859-1, which any bytes are."""
    undefined = F.hex("value").rlike("^(..)*(81|8D|8F|90|9D)")
    r = spark.read.text(path).agg(F.min(F.is_valid_utf8("value")).alias("utf8"), F.max(undefined).alias("undefined")).first()
    return "UTF-8" if r.utf8 is None or r.utf8 else "ISO-8859-1" if r.undefined else "windows-1252"


def read_metadata(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A table with a header; lines that don't fit it are left out. encoding: as the file was written, such as ISO-8859-1; found by
    file_encoding where none is given. Spark reads no windows-1252, so that is read as ISO-8859-1 and its own signs put in."""
    encoding = encoding or file_encoding(spark, path)
    western = encoding.lower() in ("windows-1252", "cp1252")
    d = spark.read.options(header=True, mode="DROPMALFORMED", encoding="ISO-8859-1" if western else encoding).csv(path)
    if western:
        codes = [c for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
        controls, signs = "".join(map(chr, codes)), bytes(codes).decode("cp1252")
        d = d.toDF(*(c.translate(str.maketrans(controls, signs)) for c in d.columns))
        d = d.select(*(F.translate(F.col(f"`{c.replace('`', '``')}`"), controls, signs).alias(c) for c in d.columns))
    return normalise_columns(d)


def explode_blocks(blocks: DataFrame) -> DataFrame:
    """A row for each sample of (session, channel, start_sample, values) blocks."""
    return blocks.select("session", "channel", "start_sample", F.posexplode("values").alias("i", "value")).select("session", "channel", (F.col("start_sample") + F.col("i")).alias("sample"), F.col("value").cast("double").alias("value"))


def to_blocks(samples: DataFrame, size: int) -> DataFrame:
    """Blocks of size samples: one row for each stretch, so that wide recordings stay few rows."""
    b = samples.groupBy("session", "channel", F.floor(F.col("sample") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("sample", "value"))).alias("v"))
    return b.select("session", "channel", "block", F.col("v")[0]["sample"].alias("start_sample"), F.col("v.value").alias("values"))


def write_rates(rates: DataFrame, path: str) -> None:
    """A folder for each session, and in it for each source if there is such a column."""
    rates.write.mode("overwrite").partitionBy(*(c for c in ("session", "source") if c in rates.columns)).parquet(path)


def write_aligned(parts: dict[str, DataFrame], path: str, clocks: DataFrame | None = None) -> None:
    """The aligned parts of sessions (rates, peaks, tracks, event times by name), a folder for each session and source; a field that a part
    lacks is null. clocks: session, source and offset_ms, by which t_ms gives t_ms_aligned; a session without one keeps its times."""
    whole = None
    for source, part in parts.items():
        part = part.withColumn("source", F.lit(source))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    if clocks is not None:
        whole = whole.join(clocks.select("session", "source", "offset_ms"), ["session", "source"], "left")
        whole = whole.withColumn("t_ms_aligned", F.col("t_ms") + F.coalesce("offset_ms", F.lit(0.0))).drop("offset_ms")
    whole.write.mode("overwrite").partitionBy("session", "source").parquet(path)


def parse_impedances(lines: DataFrame, text: str = "value") -> DataFrame:
    """electrode and kohm from free text, every match of a line; the last of an electrode wins. lines: text and line_no."""
    pattern = r"(?i)elec\D*(?:\d+-)?(\d+)\s+(\d+(?:\.\d+)?)\s*(k?)(?:ohm|\u03a9|\u2126)"
    parts = F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "e"), (2, "x"), (3, "k"))))
    got = lines.select("line_no", F.posexplode(parts).alias("nth", "m"))
    kohm = F.col("m.x").try_cast("double") * F.when(F.lower("m.k") == "k", 1.0).otherwise(0.001)
    return got.select(F.col("m.e").try_cast("int").alias("electrode"), F.struct("line_no", "nth").alias("at"), kohm.alias("kohm")).groupBy("electrode").agg(F.max_by("kohm", "at").alias("kohm"))


def newest_per_key(files: DataFrame, keys: list[str], order: list) -> DataFrame:
    return files.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def best_file_per_index(files: DataFrame, indexes: DataFrame, digits: int = 3) -> DataFrame:
    """index, path and strong: the file of each index. A file whose name has the index, padded to digits, as a number of its own is a strong
    match; of several the newest (mtime), then the largest (size), then the last path is taken, and where there is none, of all
    files (strong is false then). files: path, mtime, size. Names are joined on their numbers, never tried one by one."""
    stem = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.[^.]*$", "")
    best = F.max(F.struct("mtime", "size", "path")).alias("b")
    numbers = files.select("path", "mtime", "size", F.explode(F.array_distinct(F.regexp_extract_all(stem, F.lit("[0-9]+"), 0))).alias("token"))
    named = numbers.groupBy("token").agg(best).select("token", F.col("b.path").alias("_own"))
    text = F.col("index").cast("string")
    wanted = indexes.select("index").distinct().withColumn("token", F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text))
    newest = files.agg(best).first().b
    path = F.coalesce("_own", F.lit(newest.path if newest else None).cast("string"))
    return wanted.join(named, "token", "left").select("index", path.alias("path"), F.col("_own").isNotNull().alias("strong")).where("path is not null")


def preferred(files: DataFrame, keys: list[str], wishes: list[tuple[str, list]], order: list[str]) -> DataFrame:
    """One row of each key: the earliest in the first wish's list of values, then in the next one's, values that aren't listed last;
    then the largest by order."""
    ranks = [F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(c)), F.lit(0)), F.lit(len(values) + 1)).alias(f"w{i}") for i, (c, values) in enumerate(wishes)]
    rest = [c for c in files.columns if c not in keys]
    # The best is the largest of: ranks turned round, then the order.
    rank = F.struct(*(-r for r in ranks), *order)
    return files.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*keys, "_r.*")


def complete_sets(files: DataFrame, key: str, kind: str, required: list[str]) -> DataFrame:
    ok = files.where(F.col(kind).isin(required)).groupBy(key).agg(F.count_distinct(kind).alias("n")).where(F.col("n") == len(required))
    return files.join(ok.select(key), key, "left_semi")


def read_keypoints(spark: SparkSession, path: str, header_rows: int = 3, likelihood: float | None = None) -> DataFrame:
    """frame, keypoint, axis and value of a track file whose first rows name each column (scorer, body part, coordinate). The
    header is a few lines; points below the likelihood are null."""
    raw = spark.read.option("inferSchema", False).csv(path)
    head = [r.value for r in spark.read.text(path).limit(header_rows).collect()]
    parts = [line.split(",") for line in head]
    names = ["_".join(p[i].strip() for p in parts[1:]) for i in range(len(parts[0]))]
    body = raw.where(F.col("_c0").try_cast("long").isNotNull())
    each = F.array(*(F.struct(F.lit(names[i].rsplit("_", 1)[0]).alias("keypoint"), F.lit(names[i].rsplit("_", 1)[1]).alias("axis"), F.col(f"_c{i}").try_cast("double").alias("value")) for i in range(1, len(names))))
    long = body.select(F.col("_c0").try_cast("long").alias("frame"), F.explode(each).alias("p")).select("frame", "p.*")
    if likelihood is None:
        return long
    sure = long.where("axis = 'likelihood'").select("frame", "keypoint", F.col("value").alias("_l"))
    return long.where("axis != 'likelihood'").join(sure, ["frame", "keypoint"], "left").withColumn("value", F.when(F.coalesce("_l", F.lit(1.0)) >= likelihood, F.col("value"))).drop("_l")


def read_frame_map(spark: SparkSession, path: str) -> DataFrame:
    """avi, ocr and corrected frame numbers; what isn't a number is null."""
    d = normalise_columns(spark.read.option("header", True).csv(path))
    return d.select(*(F.col(c).try_cast("double").cast("long").alias(n) for c, n in (("avi_framenum", "avi"), ("ocr_framenum", "ocr"), ("corrected_framenum", "corrected"))))


def frame_map_agrees(frames: DataFrame) -> DataFrame:
    """last (the last frame with both numbers) and agrees."""
    last = frames.where("ocr is not null and corrected is not null").agg(F.max_by(F.struct("avi", "ocr", "corrected"), "avi").alias("x"))
    return last.select(F.col("x.avi").alias("last"), (F.col("x.ocr") == F.col("x.corrected")).alias("agrees"))


def write_bundle(samples: DataFrame, path: str, channels: list, digital: DataFrame | None = None) -> None:
    """The chosen sync channels and all digital ones, a folder for each session."""
    out = samples.where(F.col("channel").isin(channels)).withColumn("kind", F.lit("sync"))
    if digital is not None:
        out = out.unionByName(digital.withColumn("kind", F.lit("digital")), allowMissingColumns=True)
    out.write.mode("overwrite").partitionBy("session").parquet(path)


def read_rates(spark: SparkSession, path: str, optional: tuple[str, ...] = ("blank", "source")) -> DataFrame:
    """Written rates; optional fields that the writer had not are null."""
    d = spark.read.parquet(path)
    return d.withColumns({c: F.lit(None).cast("string") for c in optional if c not in d.columns})


def export_aligned(aligned: DataFrame, path: str, meta: str = "align_meta", fields: str = "anchor_ms double, fs double") -> None:
    """A flat table for other tools: the JSON meta text becomes columns; written as JSON lines."""
    aligned.withColumn("_m", F.from_json(meta, fields)).select(*(c for c in aligned.columns if c != meta), "_m.*").write.mode("overwrite").json(path)


def manifest(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Events, traces and window length of each output."""
    return windows.groupBy(*keys).agg(F.count_distinct("event_id").alias("n_events"), F.count_distinct("trace").alias("n_traces"), F.count_distinct("rel_bin").alias("length"))


def append_manifest(windows: DataFrame, keys: list[str], path: str, file: str, curated: bool = False) -> None:
    """Adds the outputs' rows, with the file that they are in and whether they are curated, to the manifest at path."""
    manifest(windows, keys).withColumns({"file": F.lit(file), "curated": F.lit(curated)}).write.mode("append").parquet(path)


def session_index(files: DataFrame, name: str = "name") -> DataFrame:
    """session (its YYMMDD_HHMMSS key) and place, from 1, by that key; names without one are dropped."""
    d = files.select(F.regexp_extract(name, r"(\d{6}_\d{6})", 1).alias("session")).where("session != ''").distinct()
    return d.withColumn("place", F.row_number().over(Window.orderBy("session")))
