"""Exact deduplication by an extendible-hash index on shared files.

Every text gets a 64-bit key. A directory of 2**depth slots over the leading bits of the key names the bucket of each
slot; buckets that would hold more than their capacity of keys are split by doubling the directory. Texts whose key has
several rows go to the owner task of their bucket, folded map-side first, so that a text with very many copies moves once
from each task. The owner chains the different texts of a key, compared by their bytes, and writes each bucket's entries
(key, place in the chain, digest, keep_id, group_size) to a folder of the bucket's own. Directory and buckets are files
in the shared folder. Documents are looked up through them: their key's slot gives the bucket, and the digest the entry
of the chain. A key with one row needs no entry.

Null text counts as empty; empty texts are equal to each other. Very long texts are compared whole. Ties need no rule, as
the largest doc_id stays; of rows that also share the doc_id each is returned, with the same verdict. Rows without an id
are copies like others, and one of theirs stays only where no copy has an id (then each has the verdict of its null id).
An empty table gives no rows. Other columns are not read, or passed on by keep_last(), whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm import common

#: The directory has at most 2**MAX_DEPTH slots, whatever the input.
MAX_DEPTH = 14
#: Keys in a bucket before it is split; grows with the input so that the directory stays within its bound.
BUCKET_KEYS = 4096


def hashed(text: Column, bits: int = 64) -> Column:
    """The key of a text: the leading bits of its hash, all of them but in tests of collisions."""
    key = F.xxhash64(text)
    return key if bits == 64 else F.shiftleft(F.shiftrightunsigned(key, 64 - bits), 64 - bits)


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """(doc_id, key, sha): one short row per document; the only pass that hashes every text."""
    text = common.whole_text(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), hashed(text, bits).alias("key"), digest(text).alias("sha"))


def slot(key: Column, depth: int) -> Column:
    """The leading bits of a key: its slot in a directory of 2**depth."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int | None = None) -> tuple[int, list[tuple[int, int, int]]]:
    """Doubles the directory until no bucket is overfull (or it has 2**MAX_DEPTH slots).

    Returns the global depth and for each slot (slot, bucket, local depth). The driver sees counts only,
    2**MAX_DEPTH at most."""
    fine = {int(r[0]): r[1] for r in keys.groupBy(slot(F.col("key"), MAX_DEPTH)).count().collect()}
    total = sum(fine.values())
    capacity = capacity or max(BUCKET_KEYS, 4 * total >> MAX_DEPTH)
    counts = [[0] * (1 << d) for d in range(MAX_DEPTH)] + [[fine.get(i, 0) for i in range(1 << MAX_DEPTH)]]
    for d in range(MAX_DEPTH - 1, -1, -1):
        counts[d] = [counts[d + 1][2 * i] + counts[d + 1][2 * i + 1] for i in range(1 << d)]
    depth, buckets = 0, [(0, 0)]  # (local depth, prefix) of each bucket
    while full := [b for b in buckets if b[0] < MAX_DEPTH and counts[b[0]][b[1]] > capacity]:
        for local, prefix in full:
            depth = max(depth, local + 1)
            buckets.remove((local, prefix))
            buckets += [(local + 1, 2 * prefix), (local + 1, 2 * prefix + 1)]
    buckets.sort(key=lambda b: b[1] << (depth - b[0]))
    slots = []
    for number, (local, prefix) in enumerate(buckets):
        first = prefix << (depth - local)
        slots += [(s, number, local) for s in range(first, first + (1 << (depth - local)))]
    return depth, slots


class Index:
    """Directory and buckets in the shared folder."""

    def __init__(self, docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, capacity: int | None = None, bits: int = 64):
        """rows: the entries of docs."""
        spark = docs.sparkSession
        self.id_type = dict(rows.dtypes)["doc_id"]
        repeated = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
        repeated = common.materialize(repeated, "repeated", narrow=True)
        self.depth, slots = directory(repeated, capacity)
        self.directory = common.materialize(spark.createDataFrame(slots, "slot long, bucket int, local_depth int").coalesce(1), "directory")
        texts = docs.select(F.col(id_col).alias("doc_id"), common.whole_text(text_col).alias("text")).withColumn("key", hashed(F.col("text"), bits))
        if repeated.count() <= common.BROADCAST_IDS:  # else folding moves each text at most once, as a join by key would
            texts = texts.join(F.broadcast(repeated), "key", "left_semi")
        owned = self.located(texts).groupBy("bucket", "key", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        owned = owned.select("bucket", "key", digest(F.col("text")).alias("sha"), "keep_id", "group_size")
        # The owner of a bucket chains what its keys have.
        chains = owned.groupBy("bucket", "key").agg(F.array_sort(F.collect_list(F.struct("sha", "keep_id", "group_size"))).alias("chain"))
        chained = chains.repartition("bucket").sortWithinPartitions("bucket", "key").select("bucket", "key", F.posexplode("chain").alias("place", "entry"))
        self.path = f"{common.run_dir(spark)}/buckets-{uuid.uuid4().hex}"
        common.collect(self.path)
        chained.select("bucket", "key", "place", "entry.*").write.partitionBy("bucket").parquet(self.path)

    def located(self, rows: DataFrame) -> DataFrame:
        """rows with the bucket of their key: what the directory has in its slot."""
        return rows.withColumn("slot", slot(F.col("key"), self.depth)).join(F.broadcast(self.directory.select("slot", "bucket")), "slot").drop("slot")  # 2**MAX_DEPTH rows at most

    def buckets(self) -> DataFrame:
        """(key, place, sha, keep_id, group_size, bucket) of all buckets."""
        return self.directory.sparkSession.read.schema(f"key long, place int, sha binary, keep_id {self.id_type}, group_size long, bucket int").parquet(self.path)


def looked_up(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, bits: int = 64) -> DataFrame:
    """(doc_id, key, sha, keep_id, group_size) of every document, by way of the index. Entries with very many copies, a
    thousand at most, are broadcast, so that no task gets all documents of one text."""
    rows = common.materialize(entries(docs, id_col, text_col, bits), "entries")
    index = Index(docs, rows, id_col, text_col, capacity, bits)
    found = index.buckets().drop("place")
    on = ["bucket", "key", "sha"]
    heavy_at = max(2, -(-rows.count() // common.HEAVY_SHARE))
    heavy = F.broadcast(found.filter(F.col("group_size") >= heavy_at).withColumnsRenamed({"keep_id": "h_id", "group_size": "h_size"}))  # HEAVY_SHARE rows at most
    flagged = index.located(rows).join(heavy, on, "left")
    light = flagged.filter("h_size is null").join(found.filter((F.col("group_size") > 1) & (F.col("group_size") < heavy_at)), on, "left")
    done = light.unionByName(flagged.filter("h_size is not null").withColumns({"keep_id": F.col("h_id"), "group_size": F.col("h_size")}))
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    return done.select("doc_id", "key", "sha", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), size.alias("group_size"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = looked_up(docs, id_col, text_col, capacity, bits)
    return found.select("doc_id", "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_last(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, bits: int = 64) -> DataFrame:
    """The documents without the dropped copies, all columns as they were. Of rows that agree in text and doc_id
    one stays."""
    found = common.materialize(looked_up(docs, id_col, text_col, capacity, bits).filter("group_size > 1"), "found", narrow=True)
    stays = F.col("keep_id").eqNullSafe(F.col("doc_id"))
    _id, _key, _sha = common.fresh(docs, "_id", "_key", "_sha")
    text = common.whole_text(text_col)

    def within(rows: DataFrame, which: DataFrame, how: str) -> DataFrame:
        which = which.toDF(_id, _key, _sha)
        same = F.col(id_col).eqNullSafe(F.col(_id)) & (hashed(text, bits) == F.col(_key)) & (digest(text) == F.col(_sha))
        return rows.join(common.small(which, common.BROADCAST_ROWS), same, how)

    dropped = common.materialize(found.filter(~stays).select("doc_id", "key", "sha").distinct(), "dropped", narrow=True)
    again = found.filter(stays).groupBy("doc_id", "key", "sha").count().filter("count > 1").drop("count")
    again = common.materialize(again, "again", narrow=True)
    kept = within(docs, dropped, "left_anti")
    if again.isEmpty():
        return kept
    plain = common.fresh(docs, "_plain")[0]  # null and empty are equal
    once = within(kept, again, "left_semi").withColumn(plain, text).dropDuplicates([id_col, plain]).drop(plain)
    return within(kept, again, "left_anti").unionByName(once)
