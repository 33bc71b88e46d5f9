"""Incremental builds: what changed, what is stale, and last-writer-wins upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, status): new or changed files; vanished ones are not reported. Both sides: (path, content_hash)."""
    before = stored.select("path", F.col("content_hash").alias("old"))
    joined = current.select("path", "content_hash").join(before, "path", "left")
    return joined.filter(F.col("old").isNull() | (F.col("old") != F.col("content_hash"))).select("path", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("status"))


def stale_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored files whose hash differs; new files are ignored."""
    return changes(current, stored).filter("status = 'changed'").select("path")


def upsert_latest(stored: DataFrame, incoming: DataFrame, key: str, version: str, force: bool = False) -> DataFrame:
    """(key, version, status): each key's newest incoming row is created, updated if newer than the stored, or skipped."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    newest = incoming.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    old = stored.select(key, F.col(version).alias("_old"))
    status = F.when(F.col("_old").isNull(), "created").when(F.lit(force) | (F.col(version) > F.col("_old")), "updated").otherwise("skipped")
    return newest.join(old, key, "left").withColumn("status", status).drop("_old")


def merged(stored: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """The table after the upsert: each key's newest row, stored rows first among equals."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), "_new")
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


def duplicate_events(events: DataFrame) -> DataFrame:
    """Groups of one calendar id, host and recurrence cut off; a missing start comes from a sibling.
    events: (id, uid, start)."""
    group = F.regexp_replace(F.regexp_replace("uid", "@.*$", ""), "_R?[0-9]{8}(T[0-9]{6}Z?)?$", "")
    w = Window.partitionBy("event_group")
    rows = events.withColumn("event_group", group)
    return rows.withColumns({"group_size": F.count(F.lit(1)).over(w), "start": F.coalesce("start", F.min("start").over(w))})


def elected(recordings: DataFrame) -> DataFrame:
    """Role of each recording of an event: diarised ones are primary, else the first is; later ones are `mic`.
    recordings: (id, event_group, diarised, at)."""
    w = Window.partitionBy("event_group").orderBy(F.desc("diarised"), "at", "id")
    any_diarised = F.max(F.col("diarised").cast("int")).over(Window.partitionBy("event_group")) == 1
    primary = F.when(any_diarised, F.col("diarised")).otherwise(F.row_number().over(w) == 1)
    return recordings.withColumn("variant", F.when(primary, "primary").otherwise("mic"))
