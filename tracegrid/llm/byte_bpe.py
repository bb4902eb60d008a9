"""Byte-level BPE over rank files, encoded by a monoid tree reduction.

An element is a text with its ids. A text is halved down to leaves; neighbours are joined by
re-encoding a window around the seam only, and the window grows until the ids outside it
provably stay:

* Texts. A space between two non-space characters always starts a match of the pattern,
  whatever surrounds the three: letters, numbers and signs end before a space, and a space
  run of one before a non-space goes to the match behind it. So ids before the last such
  place of the left text and after the first such place of the right text don't depend on the
  other side. Without such a place the window takes the whole side.
* Long matches. Ids t1..tn are the encoding of their bytes if and only if every neighbouring
  pair encodes to itself: the first merge across a border t_i|t_i+1 would happen in the pair
  alone too, as until then all merges of the region happen in the same order there. So a
  window of ids is re-encoded and doubled until the pairs at both of its ends hold.

At the leaves, texts are cut at such spaces into segments, and the different segments of a batch
that the worker doesn't know yet are encoded in one go. Decoding concatenates the bytes of the
ids up the same tree.

Defined cases: null is encoded as an empty text and gives no ids; lone surrogates can't occur
in Spark strings; repeated rows are encoded alike; an empty table gives an empty result; all
columns are kept whatever their names, but for one of the new column's name, which it replaces.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import Kept, kept_by, table

LEAF_CHARS = 2048
LEAF_BYTES = 8
#: Segments and short windows that a worker keeps, and the longest of them: about 30 MB.
CACHE, CACHE_CHARS = 150_000, 48
WINDOWS = 50_000
#: Longest segment that is encoded beside others.
SIDE_CHARS = 256
SLICE_BYTES = 2 << 20
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_FIRST = re.compile(r"\S \S")
#: White space that meets a space or break; and other white space, with which the pattern below looks.
_MET = ("\0", "  ", " \n", "\n ", "\n\n")
_RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ODD = re.compile(r"[ \n]\s|[^\S \n][ \n]")


def segments(text: str) -> list[str]:
    """text cut before each space or line break between two non-space characters: either begins a match of its own there
    (a break is one by itself, and the word after it begins the next). The quick way holds where no white space meets one of them."""
    if any(x in text for x in _MET) or any(x in text for x in _RARE) and _ODD.search(text):
        return _CUT.split(text)
    end = text[-1:] if text[-1:] in (" ", "\n") else ""
    quick = (text[:-1] if end else text).replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    quick[-1] += end
    return quick


def apart(new: list[str]) -> tuple[list[str], list[str]]:
    """Segments that may stand side by side, as they begin with a space or break before a word and end with a word; and the others."""
    row, rest = [], []
    for x in new:
        (row if x[:1] in (" ", "\n") and 1 < len(x) <= SIDE_CHARS and not x[1].isspace() and not x[-1].isspace() and "\0" not in x else rest).append(x)
    return row, rest


def cut_ids(part: list[str], ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The packed ids of each segment of a row that was encoded side by side; lengths: bytes of each id."""
    sizes = np.fromiter(map(len, "\0".join(part).encode().split(b"\0")), dtype=np.int64, count=len(part))
    ends = ((np.searchsorted(np.cumsum(lengths[ids]), np.cumsum(sizes)) + 1) * 4).tolist()
    packed = ids.tobytes()
    return [packed[a:b] for a, b in zip([0, *ends], ends)]


def looked_up(parts: list[list[str]], known: Kept, fresh: Callable[[list[str]], dict[str, bytes]], most: int, longest: int) -> list[bytes]:
    """The ids of each list of segments, back to back; fresh gives those that known lacks. As long as known has under most
    entries it keeps those of at most longest characters that come a second time, as most words that come once never come again."""
    different = set().union(*parts)
    here = dict(zip(different, map(known.get, different)))
    got = fresh([x for x, v in here.items() if v is None])
    here.update(got)
    seen, mask = known.seen, len(known.seen) - 1
    if len(known) < most:
        for x, v in got.items():
            at = hash(x) & mask
            if seen[at] and len(x) <= longest:
                known[x] = v
            else:
                seen[at] = 1
    return [b"".join(map(here.__getitem__, p)) for p in parts]


class Ranks:
    """Ids of byte strings by the merges of one rank file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.ranks.values()) + 1)
        for k, v in self.ranks.items():
            self.bytes[v] = k
        self.lengths = np.array(list(map(len, self.bytes)), dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.pattern = regex.compile(pattern)
        self.short = tiktoken.Encoding("leaves", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pairs: dict[tuple[int, int], bool] = {}
        self.windows: dict[bytes, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> tuple[int, ...]:
        got = self.windows.get(data)
        if got is None:
            got = tuple(self.merge(data))
            if len(self.windows) >= WINDOWS:
                self.windows.clear()
            if len(data) <= 64:
                self.windows[data] = got
        return got

    def merge(self, data: bytes) -> list[int]:
        """The lowest rank of all neighbouring pairs merges first, the leftmost of equals; for short data."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def holds(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            got = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
            if len(self.pairs) >= WINDOWS:
                self.pairs.clear()
            self.pairs[a, b] = got
        return got

    def join_ids(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(k, len(right))
            mid = self.merged(b"".join(self.bytes[t] for t in left[i:] + right[:j]))
            if (i == 0 or self.holds(left[i - 1], mid[0])) and (j == len(right) or self.holds(mid[-1], right[j])):
                return left[:i] + mid + right[j:]
            k *= 2

    def tree(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        half = len(data) // 2
        return self.join_ids(self.tree(data[:half]), self.tree(data[half:]))

    def match(self, piece: str) -> tuple[int, ...]:
        """Ids of one match of the pattern; a match that is itself a token isn't merged."""
        raw = piece.encode()
        return (self.ranks[raw],) if raw in self.ranks else self.tree(raw)

    def plain(self, text: str) -> bytes:
        """Ids of a text by its matches alone, packed as little-endian 32-bit integers."""
        ids = [t for m in self.pattern.findall(text) for t in self.match(m)]
        return struct.pack(f"<{len(ids)}i", *ids)

    def fresh(self, new: list[str]) -> dict[str, bytes]:
        """Ids of different segments. Those that begin with the only space or break before a word stand one after the other, as
        they would in a text, and are told apart by their lengths in bytes; long ones go by the tree."""
        row, rest = apart(new)
        out = {x: self.plain(x) if len(x) > SIDE_CHARS else self.short.encode_to_numpy(x).astype("<i4").tobytes() for x in rest}
        for k in range(0, len(row), 4096):
            part = row[k : k + 4096]
            out.update(zip(part, cut_ids(part, self.short.encode_to_numpy("".join(part)).astype("<i4"), self.lengths)))
        return out

    def leaves(self, texts: list[str]) -> list[bytes]:
        """Ids of short texts by the segments that the worker knows, and by those that none had before."""
        return looked_up([segments(t) if t else [] for t in texts], kept_by("byte_bpe"), self.fresh, CACHE, CACHE_CHARS)

    def window(self, left: str, right: str) -> tuple[int, int]:
        """Where the window around a seam begins in left and ends in right."""
        at = len(left) - 1
        while (at := left.rfind(" ", 0, at)) > 0:
            if not left[at - 1].isspace() and not left[at + 1].isspace():
                break
        m = _FIRST.search(right)
        return max(at, 0), (m.start() + 1 if m else len(right))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts: all their leaves at once, then each text's tree."""
        pieces: list[str] = []

        def halve(text: str) -> None:
            if len(text) <= LEAF_CHARS:
                pieces.append(text)
            else:
                half = len(text) // 2
                halve(text[:half])
                halve(text[half:])

        for text in texts:
            halve(text)
        ids = iter(self.leaves(pieces))

        def fold(text: str) -> bytes:
            if len(text) <= LEAF_CHARS:
                return next(ids)
            half = len(text) // 2
            left = fold(text[:half])
            return self.join(text[:half], left, text[half:], fold(text[half:]))

        return [fold(text) for text in texts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def join(self, left: str, left_ids: bytes, right: str, right_ids: bytes) -> bytes:
        i, j = self.window(left, right)
        tail, head = left[i:], right[:j]
        mid, outer, inner = self.leaves([tail + head, tail if i else "", head if j < len(right) else ""])
        a = len(left_ids) - len(outer) if i else 0
        return left_ids[:a] + mid + right_ids[len(inner) if j < len(right) else len(right_ids) :]

    def decode(self, ids: np.ndarray, leaf: int = 1 << 16) -> bytes:
        if len(ids) <= leaf:
            sizes = self.lengths[ids]
            ends = np.cumsum(sizes)
            return self.blob[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


_loaded: dict[tuple[str, str], Ranks] = {}


def ranks(path: str, pattern: str) -> Ranks:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Ranks(path, pattern)
    return _loaded[path, pattern]


def _slices(batch: pa.RecordBatch, rows: int = 256, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of at most rows rows and, where the place of a text column is given, about SLICE_BYTES of it."""
    if text is None:
        ends = range(rows, batch.num_rows + rows, rows)
    else:
        sizes = np.diff(_offsets(batch.column(text)))
        ends, size, first = [], 0, 0
        for i, n in enumerate(sizes.tolist()):
            size += n
            if size >= SLICE_BYTES or i + 1 - first >= rows:
                ends.append(i + 1)
                size, first = 0, i + 1
        ends.append(batch.num_rows)
    start = 0
    for end in ends:
        end = min(end, batch.num_rows)
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) or pa.types.is_large_list(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)


def with_column(df: DataFrame, name: str, kind: T.DataType) -> tuple[T.StructType, list[int]]:
    """The schema of df with a last column of that name, and the places of df's columns that stay."""
    places = [i for i, f in enumerate(df.schema.fields) if f.name.lower() != name.lower()]
    return T.StructType([*(df.schema.fields[i] for i in places), T.StructField(name, kind)]), places


def numbered(df: DataFrame) -> DataFrame:
    """df for an Arrow function that takes columns by place: Spark looks them up by name there, which dots upset."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", bytes_col: str | None = None) -> DataFrame:
    """docs with all its columns and ids_col, the ids of every whole text; and, where bytes_col is named, the bytes that these
    ids decode to, in the same pass."""
    schema, places = with_column(docs, ids_col, T.ArrayType(T.IntegerType()))
    if bytes_col:
        places = [i for i in places if docs.columns[i].lower() != bytes_col.lower()]
        schema = T.StructType([f for f in schema.fields if f.name.lower() != bytes_col.lower()] + [T.StructField(bytes_col, T.BinaryType())])
    text = docs.columns.index(text_col)

    def run(batches):
        bpe = ranks(path, pattern)
        for batch in batches:
            for part in _slices(batch, text=text):
                got = bpe.encode_all([x or "" for x in part.column(text).to_pylist()])
                ends = np.cumsum([0, *(len(x) // 4 for x in got)]).astype(np.int32)
                values = np.frombuffer(b"".join(got), dtype="<i4")
                columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(values))]
                if bytes_col:
                    columns.append(pa.array([bpe.decode(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *columns], schema.names)

    return numbered(docs).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """encoded with all its columns and bytes_col, the bytes of the ids; null ids give no bytes."""
    schema, places = with_column(encoded, bytes_col, T.BinaryType())
    ids = encoded.columns.index(ids_col)

    def run(batches):
        bpe = ranks(path, pattern)
        for batch in batches:
            for part in _slices(batch):
                column = part.column(ids)
                ends, values = _offsets(column), column.values.to_numpy(zero_copy_only=False) if len(column.values) else np.empty(0, np.int32)
                got = [bpe.decode(values[a:b]) if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), pa.array(got, pa.binary())], schema.names)

    return numbered(encoded).mapInArrow(run, schema)


def _tokenizer():
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def digests(docs: DataFrame) -> DataFrame:
    path, pattern = _tokenizer()
    got = encode(docs.select("doc_id", "text"), path, pattern, bytes_col="decoded")
    return got.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids and decoded_sha256 of every row; the ids are decoded again, and a text that they don't
    give back fails the stage."""
    path, pattern = _tokenizer()
    got = encode(docs.select("doc_id", "text"), path, pattern, bytes_col="decoded")
    got = got.select("doc_id", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("same"))
    return got.select("doc_id", "token_ids", F.when(F.col("same"), F.col("decoded_sha256")).otherwise(F.raise_error(F.lit("ids don't decode to their text"))).alias("decoded_sha256"))


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
