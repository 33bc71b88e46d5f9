"""Helpers that the corpus operators share: scratch tables, text rules, joins on skewed keys."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a regular-expression class body.
SPACE_CLASS = r"\x20\x09-\x0D"
#: The same six characters, for translate().
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A key with at least one in so many rows counts as heavy; so there are at most this many heavy keys.
HEAVY_SHARE = 1000
#: Ids up to this many (8 bytes each) may be broadcast; larger sets are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Rows of two or three numbers up to this many may be broadcast.
BROADCAST_ROWS = 250_000
#: Rows of an Arrow batch at most, as texts are long; a session that asks for fewer keeps its number.
BATCH_ROWS = 1000

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Workers give freed blocks back to the system instead of holding them for the next stage.
_WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "4194304", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}
_collectors: list[list[str]] = []


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package where it isn't installed on the executors, and bounds their batches."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    for name, value in _WORKER_MEMORY.items():
        env.setdefault(name, value)
    return spark


def release() -> None:
    """Gives a worker's freed memory back; workers live on, for the next stage."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session gets a folder of its
    own; on a cluster that is an error, as executors could not read it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="noteloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the application ends."""
    folder = f"{shared_dir(spark)}/noteloom-{spark.sparkContext.applicationId}"
    system, root = _path(spark, folder)
    if not system.exists(root):
        system.mkdirs(root)
        system.deleteOnExit(root)
    return folder


def collect(path: str) -> None:
    """Puts a path on the list of the caller that asked for it by collected()."""
    if _collectors:
        _collectors[-1].append(path)


def materialize(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Writes df as Parquet to the application's folder and reads it back: cuts lineage, survives lost executors. The
    table goes when the application ends, or when the caller that asked for it by collected() deletes it. A narrow table,
    of short rows that are few against the texts, is written as a file for each core of the cluster at most."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.coalesce(spark.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
    collect(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def collected() -> Iterator[list[str]]:
    """Lists the tables that materialize() writes inside, for delete() once nothing reads them any more."""
    _collectors.append([])
    try:
        yield _collectors[-1]
    finally:
        _collectors.pop()


def delete(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        system, path = _path(spark, paths.pop())
        system.delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, made longer where the table has such a column, so that helpers never meet a column of the input."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def whole_text(text: str = "text"):
    """The text, with null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def words(text):
    """Maximal runs of characters other than the six separators."""
    return F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")


def let(value, use):
    """use(value), with value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_count(text):
    """Number of words."""
    return F.size(words(text)).cast("long")


def slices(texts: list, limit: int = 2_000_000) -> Iterator[slice]:
    """Slices of a batch with about `limit` characters each, or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t or "") > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield slice(start, len(texts))


def left_join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Left join of rows with one row per key. Keys that hold 1/HEAVY_SHARE of all rows or more, at most HEAVY_SHARE
    of them whatever the input, are joined by broadcast, so no task gets all rows of one key."""
    heavy_at = max(2, -(-total // HEAVY_SHARE))
    heavy = F.broadcast(groups.filter(F.col(size) >= heavy_at))
    light = rows.join(heavy.select(*on), on, "left_anti").join(groups.filter(F.col(size) < heavy_at), on, "left")
    return light.unionByName(rows.join(heavy, on))


def small(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """ids marked for broadcast where their number is within `most`; else as they are, for a shuffle join."""
    return F.broadcast(ids) if ids.count() <= most else ids
