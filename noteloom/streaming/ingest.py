"""Incremental ingest as Structured Streaming: offsets and checkpoints take the place of stored high-water marks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noteloom.operators import incremental
from noteloom.sources import feeds
from noteloom.streaming import state


def index_stream(source: DataFrame, index: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch of a stream to `index`; a batch that is repeated has the same number."""
    return source.writeStream.outputMode("update").foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_notes(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Notes of feeds that are new or changed since the stream's last run, as (id, feed, updated_at, raw, status)."""
    notes = feeds.register(spark).readStream.format("note_feeds").options(**options).load()
    keyed = notes.select(F.to_json(F.struct("feed", "id")).alias("key"), F.sha2("raw", 256).alias("hash"), F.col("updated_at").alias("version"), F.col("raw").alias("payload"))
    seen = state.changed_only(keyed)
    return seen.select(F.get_json_object("key", "$.id").alias("id"), F.get_json_object("key", "$.feed").alias("feed"), F.col("version").alias("updated_at"), F.col("payload").alias("raw"), "status")


def upsert_stream(source: DataFrame, table: str, key: str, version: str, checkpoint: str) -> StreamingQuery:
    """Keeps the newest row of each key in a Parquet table, written aside for each batch and then named current by a
    pointer file, so that readers never see half a table."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = current(spark, table)
        new = batch if old is None else incremental.merged(old, batch, key, version)
        new.write.mode("overwrite").parquet(f"{table}/v{number}")
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("append").parquet(f"{table}/versions")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The newest version of a table that upsert_stream() writes."""
    try:
        number = spark.read.parquet(f"{table}/versions").agg(F.max("number")).first()[0]
    except Exception as e:  # no version yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return spark.read.parquet(f"{table}/v{number}")


def access_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Accesses by document and day, with a watermark, from a stream or a table of (document_id, ts)."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", "1 day").alias("day"), "document_id").agg(F.count(F.lit(1)).alias("n_access"), F.max("ts").alias("last_access"))
