"""Tables of a knowledge base in a folder: immutable parts, and a list of those that count.

Every write adds a part and then a new list beside the old one; readers keep the parts they began with, and of two
writers that begin with one list the second fails instead of undoing the first. A batch of changed documents adds their
new rows, numbered by the batch, and the keys whose rows of earlier batches no longer count; reading leaves those out by
an anti-join. Parts of about one size are merged, so that their number grows with the logarithm of the rows, and each
row is rewritten as often at most."""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict
from functools import cache

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from noteloom import schemas

#: Parts of about one size that are merged, and how many times larger the next size is.
FAN = 4
#: Lists that are kept, with their parts, for readers that began with them.
KEEP = 6
#: Removed keys (two numbers each) up to this many are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 250_000


class Conflict(Exception):
    """Another writer was first."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        #: Rows that the last batch wrote to each table, without those that were merged.
        self.written: dict[str, int] = {}

    # ------------------------------------------------------------ lists of parts

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _list(self, name: str, number: int) -> list[dict] | None:
        fs, p = self._fs(f"{self.root}/{name}/list-{number}")
        stream = fs.open(p)
        try:
            content = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(content) if content.endswith("\n") else None  # else it is being written

    def _numbers(self, name: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}")
        found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[5:]) for n in found if n.startswith("list-"))

    def parts(self, name: str) -> tuple[int, list[dict]]:
        """The number of the newest list, 0 if there is none, and its parts: path, rows, gone (keys instead of rows)."""
        for number in reversed(self._numbers(name)):
            found = self._list(name, number)
            if found is not None:
                return number, found
        return 0, []

    def _commit(self, name: str, number: int, parts: list[dict]) -> None:
        fs, p = self._fs(f"{self.root}/{name}/list-{number}")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"{name}: list {number} is there already") from e
            raise
        out.write(bytearray(json.dumps(parts).encode() + b"\n"))
        out.close()
        old, kept = set(), {part["path"] for part in parts}
        for n in self._numbers(name):
            paths = {part["path"] for part in self._list(name, n) or []}
            if n <= number - KEEP:
                old |= paths
                fs.delete(self._fs(f"{self.root}/{name}/list-{n}")[1], False)
            else:
                kept |= paths
        for path in old - kept:
            fs.delete(self._fs(f"{self.root}/{name}/{path}")[1], True)

    def _save(self, name: str, df: DataFrame, gone: bool = False) -> dict:
        seen, path = Observation(), f"{'gone' if gone else 'part'}-{uuid.uuid4().hex}"
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.root}/{name}/{path}")
        return {"path": path, "rows": seen.get["rows"], "gone": gone}

    # ------------------------------------------------------------ rows

    @staticmethod
    @cache
    def schema(name: str) -> StructType:
        return StructType.fromDDL(schemas.TABLES[name])

    def _rows(self, name: str, parts: list[dict]) -> DataFrame:
        """Rows of the parts that no later batch removed, with the number of their batch."""
        schema = StructType([*self.schema(name), StructField("_batch", IntegerType())])
        paths = [f"{self.root}/{name}/{p['path']}" for p in parts if not p["gone"]]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        gone = [p for p in parts if p["gone"]]
        if gone and paths:
            keys = self.spark.read.schema("key long, below int").parquet(*[f"{self.root}/{name}/{p['path']}" for p in gone])
            keys = keys.groupBy("key").agg(F.max("below").alias("below"))
            if sum(p["rows"] for p in gone) <= BROADCAST_KEYS:
                keys = F.broadcast(keys)
            rows = rows.join(keys, (F.col(schemas.KEYS[name]) == F.col("key")) & (F.col("_batch") < F.col("below")), "left_anti")
        return rows

    def _typed(self, name: str, df: DataFrame) -> DataFrame:
        """The columns of the table's schema, in its types; those that aren't there are null."""
        present = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema(name)])

    def _sorted(self, name: str, df: DataFrame) -> DataFrame:
        by = schemas.ORDER.get(name)
        return df.repartitionByRange(by[0]).sortWithinPartitions(*by) if by else df

    def read(self, name: str, batch: int | None = None) -> DataFrame:
        """The table, or the rows that one batch wrote."""
        rows = self._rows(name, self.parts(name)[1])
        if batch is not None:
            rows = rows.filter(F.col("_batch") == batch)
        return rows.drop("_batch")

    def write(self, name: str, df: DataFrame) -> int:
        """Replaces the whole table; returns the number of the batch."""
        number = self.parts(name)[0] + 1
        part = self._save(name, self._sorted(name, self._typed(name, df)).withColumn("_batch", F.lit(number)))
        self._commit(name, number, [part])
        self.written[name] = part["rows"]
        return number

    def replace(self, name: str, df: DataFrame, gone: DataFrame) -> int:
        """Adds rows as a batch, and removes the rows of earlier batches whose key is among `gone` (one column). Without any
        of both the table stays as it is."""
        number, parts = self.parts(name)
        number += 1
        new = [self._save(name, self._sorted(name, self._typed(name, df)).withColumn("_batch", F.lit(number)))]
        if parts:
            keys = gone.select(F.col(gone.columns[0]).cast("long").alias("key"), F.lit(number).alias("below")).distinct()
            new.append(self._save(name, keys, gone=True))
        self.written[name] = new[0]["rows"]
        if any(p["rows"] for p in new):
            self._commit(name, number, parts + [p for p in new if p["rows"]])
            self._tidy(name)
        else:
            for p in new:
                fs, path = self._fs(f"{self.root}/{name}/{p['path']}")
                fs.delete(path, True)
        return number

    def append(self, name: str, rows: list[tuple], columns: list[str]) -> None:
        """Adds a few rows as a part of their own."""
        self.extend(name, self.spark.createDataFrame(rows, StructType([self.schema(name)[c] for c in columns])).coalesce(1))

    def extend(self, name: str, df: DataFrame) -> None:
        """Adds rows as a part of their own."""
        new, part = self._typed(name, df), None
        while True:
            number, parts = self.parts(name)
            part = part or self._save(name, new.withColumn("_batch", F.lit(number + 1)))
            try:
                self._commit(name, number + 1, [*parts, part])
                break
            except Conflict:  # rows that nothing removes can come after another's
                continue
        self._tidy(name)

    # ------------------------------------------------------------ merging

    def _merge(self, name: str, chosen: list[dict], files: int | None = None) -> None:
        """Makes one part of some; if no other is left, the removals have been applied and go."""
        number, parts = self.parts(name)
        gone = [p for p in parts if p["gone"]]
        others = [p for p in parts if not p["gone"] and p not in chosen]
        rows = self._sorted(name, self._rows(name, chosen + gone))
        new = [self._save(name, rows.coalesce(files) if files else rows)]
        if others and len(gone) > 1:
            keys = self.spark.read.parquet(*[f"{self.root}/{name}/{p['path']}" for p in gone]).groupBy("key").agg(F.max("below").alias("below"))
            gone = [self._save(name, keys, gone=True)]
        self._commit(name, number + 1, others + new + (gone if others else []))

    def _tidy(self, name: str) -> None:
        parts = self.parts(name)[1]
        data = [p for p in parts if not p["gone"]]
        removed = sum(p["rows"] for p in parts if p["gone"])
        if removed and removed * FAN > max(1, sum(p["rows"] for p in data)):
            self._merge(name, data)
            return
        sizes = defaultdict(list)
        for p in data:
            sizes[int(math.log(max(1, p["rows"]), FAN))].append(p)
        full = [size for size, found in sizes.items() if len(found) >= FAN]
        if full:
            self._merge(name, [p for size, found in sizes.items() if size <= max(full) for p in found])
        elif sum(p["gone"] for p in parts) >= 2 * FAN:
            self._merge(name, data[-1:])

    def compact(self, name: str, files: int | None = None) -> None:
        """Makes one part of all."""
        data = [p for p in self.parts(name)[1] if not p["gone"]]
        if data:
            self._merge(name, data, files)
