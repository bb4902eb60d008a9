"""Tables in the folder that driver and executors share, and what Python workers keep.

Lineage is cut by writing a Parquet table there and reading it again, so a lost executor
costs a re-read and never a recomputation of everything before. A block of work drops the tables
that it made (`scratch`) once its own result is written.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[list[str]] = []


class Kept(dict):
    """A dictionary with marks of what came before (by hash)."""

    def __init__(self):
        super().__init__()
        self.seen = bytearray(1 << 22)


_held: dict[str, Kept] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a temporary one, on a local master alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="tracegrid-")
        root = _own[app]
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tracegrid/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder, in a folder for each value of by, and reads it back: same rows, no lineage, known size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _made:
        _made[-1].append(path)
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize writes inside are deleted at the end; the block's result must be written outside or read before."""
    _made.append([])
    try:
        yield
    finally:
        for path in _made.pop():
            drop(spark, path)


def finished(spark: SparkSession, make, name: str) -> DataFrame:
    """The table that make() gives, written; the tables it was made from are deleted."""
    path = new_path(spark, name)
    if _made:
        _made[-1].append(path)
    with scratch(spark):
        df = make()
        df.write.option("compression", "zstd").parquet(path)
        schema = df.schema
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def kept_by(owner: str) -> Kept:
    """A Python worker's dictionary for one operator. Workers are used again by other operators, so only
    the latest one's stays."""
    if owner not in _held:
        _held.clear()
        _held[owner] = Kept()
    return _held[owner]
