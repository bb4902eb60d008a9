"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Records are written as plain WARC/1.0 text through Spark's own file committer. A reader task
sees the pieces between two occurrences of the magic line; each is a candidate record whose
header names its successor's offset. Pointer jumping from the start of each file keeps the
candidates that the chain reaches, so a magic line inside a payload is never taken for a
record: its piece is given back to the record around it.

Defined cases: null html is an empty payload; of equal payloads the one with the largest page
id is the response; a row without an id gets a record named null, which revisits a named page of equal payload
where there is one; each row is
a record of its own, and rows that repeat an id and its html are alike; an empty table gives an
empty result; other columns aren't read. Bytes that no record covers are left out.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import materialize, new_path, table

MAGIC = "WARC/1.0\r\n"
TAIL = "\r\n\r\n"
#: Fixed value: the digits of base 32.
DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Fixed value of the format: a revisit of an identical payload.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def base32_sha1(payload) -> F.Column:
    """Upper-case base 32 of the SHA-1: four times 40 bits are 8 digits each, in the alphabet of base 32."""
    hexa = F.sha1(payload)
    parts = (F.lpad(F.conv(F.substring(hexa, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31))
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", DIGITS)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, sha1 and keeper (the response's id) of the rows that revisit another page."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("size")).where(F.col("size") >= min_bytes)
    keyed = materialize(keyed, "warc-keys")
    several = (F.col("least") < F.col("keeper")) | (F.col("named") < F.col("all"))
    best = keyed.groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("least"), F.count("page_id").alias("named"), F.count("*").alias("all")).where(several)
    best = materialize(best.where("keeper is not null").select("sha1", "keeper"), "warc-best")
    # Both sides are plain scans here, so that the adaptive skew join may split a hot digest.
    joined = keyed.join(best, "sha1").where("page_id is null or page_id != keeper")
    return materialize(joined.select("page_id", "sha1", "keeper").distinct(), "warc-revisits")


def write(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = 10_000, date: str = "1970-01-01T00:00:00Z") -> None:
    """One record for each page: a response with its payload, or a revisit that refers to it. date: the records' WARC-Date."""
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("sha1"))
    again = revisits(pages, min_bytes).select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "keeper")
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")), "left")
    body = F.coalesce(F.col("html"), F.lit(""))
    revisit = F.col("keeper").isNotNull()
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    block = F.when(revisit, F.lit("")).otherwise(body)
    record = F.concat(
        F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(f">\r\nWARC-Date: {date}\r\nContent-Type: text/html; charset=utf-8\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_sha1(body.cast("binary")), F.lit("\r\nX-Payload-Bytes: "), F.octet_length(body).cast("string"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("keeper").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(TAIL), block, F.lit(TAIL[:-1]),
    )
    rows.select(record.alias("value")).write.options(lineSep="\n", compression="gzip", maxRecordsPerFile=records_per_file).text(path)


CANDIDATE = "file long, split long, nth long, at long, size long, next long, block_at long, payload binary"
_LENGTH = re.compile(rb"(?im)^Content-Length:\s*(\d+)\s*$")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each piece between magic lines. file: hash of the path; at, next: offsets within its split of the file;
    size: its bytes with the magic line; next is null where no header can be read."""

    def run(batches):
        key, at, nth = None, 0, 0
        for batch in batches:
            rows = []
            for body, file, split in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, split) != key:
                    key, at, nth = (file, split), 0, 0
                size, nxt, block_at = len(body) + len(MAGIC), None, None
                stop = body.find(b"\r\n\r\n")
                if stop >= 0 and (m := _LENGTH.search(body, 0, stop + 2)):
                    block_at = stop + 4
                    nxt = at + len(MAGIC) + block_at + int(m[1]) + len(TAIL)
                rows.append((file, split, nth, at, size, nxt, block_at, body))
                at, nth = at + size, nth + 1
            cols = zip(*rows) if rows else [[]] * 8
            kinds = (*[pa.int64()] * 7, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in CANDIDATE.split(", ")])

    pieces = spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("body"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    return pieces.mapInArrow(run, CANDIDATE)


def placed(pieces: DataFrame) -> DataFrame:
    """Offsets within the file: the sizes of the splits before are added. A file's first piece, before its first magic line, is no candidate."""
    splits = pieces.groupBy("file", "split").agg(F.sum("size").alias("total"))
    base = splits.select("file", "split", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    # The first piece lacks a magic line of its own: every offset is that much too large.
    at = F.col("at") + F.col("base") - len(MAGIC)
    return pieces.join(base, ["file", "split"]).withColumns({"at": at, "next": F.col("next") + F.col("base") - len(MAGIC)}).where(F.col("at") >= 0)


def reachable(nodes: DataFrame) -> DataFrame:
    """file and at of the candidates that the chain from offset 0 of their file reaches.

    Pointer jumping: in round k every candidate knows the one 2^k records on, and the reached
    set doubles; it ends when a round adds nothing, after log2(longest chain) rounds."""
    real = nodes.select("file", "at")
    jump = materialize(nodes.where("next is not null").select("file", "at", "next").join(real.withColumnRenamed("at", "next"), ["file", "next"], "left_semi"), "warc-jump")
    reached = materialize(real.where("at = 0"), "warc-reached")
    count = reached.count()
    while True:
        ahead = reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))
        reached = materialize(reached.union(ahead).distinct(), "warc-reached")
        if (now := reached.count()) == count:
            return reached
        count = now
        hop = jump.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
        jump = materialize(jump.join(hop, ["file", "next"]).select("file", "at", F.col("then").alias("next")), "warc-jump")


def read(spark: SparkSession, path: str) -> DataFrame:
    """file (hash of its path), at, header and payload of every record in the archives below path.

    Archives are scanned twice: for the candidates, and for the payloads of those that stay. A
    compressed file is one split; others must be split alike both times, as within a session."""
    pieces = candidates(spark, path)
    light = materialize(placed(materialize(pieces.drop("payload"), "warc-pieces")), "warc-candidates")
    kept = reachable(light.select("file", "at", "next"))
    starts = light.join(kept.withColumn("record", F.col("at")), ["file", "at"], "left")
    # A piece that isn't a record of its own belongs to the last record before it.
    by_file = Window.partitionBy("file").orderBy("at")
    owned = starts.withColumn("record", F.last("record", ignorenulls=True).over(by_file)).where("record is not null")
    # "at" counts from the first magic line on; a record is whole if its successor is where its piece ends.
    whole = (F.col("at") == F.col("record")) & (F.col("next") == F.col("at") + F.col("size"))
    owned = materialize(owned.select("file", "split", "nth", "at", "next", "record", whole.alias("whole")), "warc-owned")
    key = ["file", "split", "nth"]
    part = F.expr("substring(payload, cast(block_at + 1 as int), cast(length as int))")
    length = F.col("next") - F.col("record") - len(MAGIC) - len(TAIL) - F.col("block_at")
    # The offsets grow with the archives, so they are never broadcast; (file, split, nth) has no hot key.
    single = pieces.select(*key, "block_at", "payload").join(owned.where("whole").drop("whole").hint("merge"), key)
    single = single.select("file", F.col("record").alias("at"), "block_at", length.alias("length"), "payload")
    broken = pieces.select(*key, "block_at", "payload").join(owned.where("not whole or whole is null").drop("whole"), key)
    own = F.col("at") == F.col("record")
    joined = broken.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("at", "payload"))).alias("parts"), 
        F.max(F.when(own, F.col("block_at"))).alias("block_at"), F.max(F.when(own, F.col("next"))).alias("next"),
    )
    rest = F.aggregate(F.slice("parts", F.lit(2), F.size("parts")), F.col("parts")[0]["payload"], lambda acc, x: F.concat(acc, F.lit(MAGIC).cast("binary"), x["payload"]))
    joined = joined.where("next is not null").select("file", F.col("record").alias("at"), "block_at", length.alias("length"), rest.alias("payload"))
    return single.unionByName(joined).select("file", "at", F.expr("cast(substring(payload, 1, cast(block_at - 4 as int)) as string)").alias("header"), part.alias("payload"))


def field(name: str) -> F.Column:
    return F.regexp_extract("header", rf"(?im)^{re.escape(name)}:[ \t]*([^\r\n]*)", 1)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    got = read(spark, path)
    kind = field("WARC-Type")
    own = base32_sha1(F.col("payload"))
    told = F.regexp_extract(field("WARC-Payload-Digest"), r"^sha1:(\w+)$", 1)
    ident = lambda name: F.regexp_extract(field(name), r"(-?\d+)>$", 1)
    revisit = kind == "revisit"
    checked = F.when(revisit, told).when(own == told, own).otherwise(F.raise_error(F.lit("payload digest differs from the record's header")))
    return got.select(
        ident("WARC-Record-ID").try_cast("long").alias("page_id"),
        F.when(revisit, field("X-Payload-Bytes").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        checked.alias("payload_digest"), kind.alias("record_type"),
        F.when(revisit, ident("WARC-Refers-To").try_cast("long")).alias("refers_to"),
    )

