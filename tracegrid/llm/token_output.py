"""Token-id files: one zstandard frame for each document, one shared dictionary.

The file is a Parquet table of blocks, written by Spark's committer in ascending document
order. A block holds the frames of some documents back to back, the offset and token count of
each, its dictionary's hash and its ids' place in the partition; the dictionary lies beside it
under the same hash. One document is read by pruning blocks on first_id and last_id and
decompressing its frame alone.

The dictionary is trained on the serialized ids of at most about dict_docs documents (a
documented bound: the trainer takes no more), picked by a hash over all of them. The trainer
refuses very few or very uniform samples; then their bytes themselves are the dictionary, as
zstandard takes any bytes for one, so the format is the same at every size.

Ids are stored in as many bytes as the tokenizer file's largest id needs: 2, or else 4.

Defined cases: null is an empty text and gives the end id alone; null ids sort first and keep
their rows; rows that repeat an id stand in the order of their text's hash; an empty table
gives empty files; columns other than doc_id and text aren't read. Names of special tokens in a text
are those tokens, as in a plain call of the library; special_as_text makes them ordinary text.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_bpe import _slices, apart, cut_ids, looked_up, segments
from .workspace import kept_by, new_path, table

#: Segments that a worker keeps, and the longest of them: about 150 MB.
CACHE, CACHE_CHARS = 800_000, 48
BLOCK_BYTES = 1 << 20
BLOCKS = "part int, block int, part_start long, dict_sha256 string, width int, first_id long, last_id long, doc_ids array<long>, offsets array<int>, n_tokens array<int>, payload binary"


class Encoder:
    """Ids of whole texts by a file of the tokenizers library.

    A space or line break between two non-space characters begins a match of the byte-level pattern whatever
    stands around, so the text is cut there and each different segment is encoded once. New segments
    that begin with one are encoded side by side, as they would stand in a text, and told
    apart by the lengths of their tokens in bytes."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.owner = f"token_output {path} {special_as_text}"
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.largest = max(vocabulary.values())
        self.lengths = np.zeros(self.largest + 1, dtype=np.int64)
        for token, i in vocabulary.items():  # byte-level: a character stands for a byte
            self.lengths[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.lengths[i] = len(token.content.encode())

    def fresh(self, new: list[str], side: int = 32) -> dict[str, bytes]:
        row, rest = apart(new)
        parts = [row[k : k + side] for k in range(0, len(row), side)] + [[x] for x in rest]
        out = {}
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            out.update(zip(part, cut_ids(part, ids, self.lengths) if len(part) > 1 else [ids.tobytes()]))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes. The first CACHE different segments are kept; the frequent ones come early."""
        return looked_up([segments(t) if t else [] for t in texts], kept_by(self.owner), self.fresh, CACHE, CACHE_CHARS)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = Encoder(path, special_as_text)
    return _encoders[path, special_as_text]


def _narrow(ids: bytes, end_id: int, width: int) -> bytes:
    return np.append(np.frombuffer(ids, dtype="<u4"), np.uint32(end_id)).astype(f"<u{width}").tobytes()


def train(docs: DataFrame, tokenizer: str, end_id: int, width: int, special_as_text: bool = False, dict_docs: int = 2000, dict_bytes: int = 1 << 16) -> bytes:
    """A zstandard dictionary of the sampled documents; their own bytes where the trainer refuses them."""
    import zstandard

    n = docs.count()

    def run(batches):
        enc = encoder(tokenizer, special_as_text)
        for batch in batches:
            for part in _slices(batch, text=0):
                yield pa.RecordBatch.from_arrays([pa.array([_narrow(x, end_id, width) for x in enc.encode([t or "" for t in part.column(0).to_pylist()])], pa.binary())], ["ids"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1, dict_docs / max(n, 1))))).select("text").limit(2 * dict_docs)
    samples = sorted(bytes(r.ids) for r in some.mapInArrow(run, "ids binary").toLocalIterator())
    try:
        return zstandard.train_dictionary(dict_bytes, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return (b"".join(samples) or bytes(8))[-dict_bytes:].ljust(8, b"\0")


def write(docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, level: int = 3, special_as_text: bool = False, **training) -> None:
    """Writes path/blocks and path/dictionary."""
    spark, width = docs.sparkSession, 2 if max(encoder(tokenizer, special_as_text).largest, end_id) < 1 << 16 else 4
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    raw = train(docs, tokenizer, end_id, width, special_as_text, **training)
    sha = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(sha, bytearray(raw))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    ordered = docs.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "_h").select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches):
        import zstandard

        enc = encoder(tokenizer, special_as_text)
        squeeze = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw))
        part = block = start = total = 0
        ids, offsets, counts, frames, size = [], [], [], [], 0
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]

        def flush():
            row = part, block, start, sha, width, next((i for i in ids if i is not None), None), ids[-1], ids, offsets, counts, b"".join(frames)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for piece in _slices(batch, rows=1024, text=1):
                part = piece.column(2)[0].as_py()
                for i, x in zip(piece.column(0).to_pylist(), enc.encode([t or "" for t in piece.column(1).to_pylist()])):
                    frame = squeeze.compress(_narrow(x, end_id, width))
                    ids.append(i)
                    offsets.append(size)
                    counts.append(len(x) // 4 + 1)
                    frames.append(frame)
                    size, total = size + len(frame), total + counts[-1]
                    if size >= BLOCK_BYTES:
                        yield flush()
                        ids, offsets, counts, frames, size, block, start = [], [], [], [], 0, block + 1, total
        if ids:
            yield flush()

    ordered.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def _frames(df: DataFrame, raw: bytes, out: str, only: list[int] | None = None) -> DataFrame:
    """Rows of the documents in the blocks of df (with a column start)."""

    def run(batches):
        import zstandard

        loose = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        for batch in batches:
            for b in batch.to_pylist():
                at, rows = b["start"], []
                ends = [*b["offsets"][1:], len(b["payload"])]
                for i, o, e, n in zip(b["doc_ids"], b["offsets"], ends, b["n_tokens"]):
                    if only is None or i in only:
                        got = np.frombuffer(loose.decompress(b["payload"][o:e]), dtype=f"<u{b['width']}").astype("<u4")
                        rows.append((i, at, len(got), got.tobytes()))
                    at += n
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids_le32"])

    return df.select("start", "width", "doc_ids", "offsets", "n_tokens", "payload").mapInArrow(run, out)


ROWS = "doc_id long, start long, n_tokens long, ids_le32 binary"


def read(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and the ids as little-endian 32-bit bytes.

    only: these documents alone; other blocks are pruned and other frames stay compressed."""
    blocks = spark.read.parquet(f"{path}/blocks")
    found = spark.read.parquet(f"{path}/dictionary").collect()
    raw = bytes(found[0].dictionary)
    assert hashlib.sha256(raw).hexdigest() == found[0].dict_sha256
    # A row for each written partition: as many as the range shuffle had, however many rows there are.
    parts = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    before = parts.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    wanted = blocks if only is None else blocks.where(F.lit(False) if not only else (F.col("first_id") <= max(only)) & (F.col("last_id") >= min(only)))
    return _frames(wanted.join(before, "part").withColumn("start", F.col("before") + F.col("part_start")), raw, ROWS, only)


def op1_token_output(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path = new_path(spark, "token-ids")
    write(table(spark, sf_dir, "documents"), path, P.path("byte_bpe_50k.json"))
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids_le32").alias("ids_crc32"))
