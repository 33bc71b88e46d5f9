"""Keyed state of streams: what is new or changed for each key, and running counts.

States live in the stream's checkpoint (RocksDB), one small value for each key, so a restart goes on where the last run
ended, and nothing that was emitted comes again."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from noteloom.session import ready

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> SparkSession:
    """Sets the state store that keyed state needs."""
    ready(spark).conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class _Changes(StatefulProcessor):
    """Keeps the newest version of a key and its content's hash."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "hash string, version string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda r: (r["version"] or "", r["hash"] or ""))  # of one batch's rows only the newest counts
        known = self.seen.get() if self.seen.exists() else None
        version = newest["version"] or ""
        if known is not None and version <= known[1]:
            return
        self.seen.update((newest["hash"] or "", version))
        if known is None or known[0] != (newest["hash"] or ""):
            yield Row(key=key[0], hash=newest["hash"], version=newest["version"], payload=newest["payload"], status="new" if known is None else "changed")

    def close(self) -> None:
        pass


def changed_only(source: DataFrame) -> DataFrame:
    """(key, hash, version, payload, status) of what is new or changed, from a stream of (key, hash, version, payload).

    A row whose version is not newer than the key's is late, or came before, and is skipped; one with the known hash only
    moves the version on. Rows without a key are one key."""
    stateful(source.sparkSession)
    rows = source.selectExpr("coalesce(cast(key as string), '') as key", "cast(hash as string) as hash", "cast(version as string) as version", "cast(payload as string) as payload")
    return rows.groupBy("key").transformWithState(_Changes(), "key string, hash string, version string, payload string, status string", "Update", "None")


class _Counts(StatefulProcessor):
    """Keeps the number of a key's events and the time of the last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long, last string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, last = self.total.get() if self.total.exists() else (0, "")
        for r in rows:
            n, last = n + 1, max(last, r["at"] or "")
        self.total.update((n, last))
        yield Row(key=key[0], n_access=n, last_access=last or None)

    def close(self) -> None:
        pass


def running_counts(source: DataFrame) -> DataFrame:
    """(key, n_access, last_access) after each batch, for the keys that it touched, from a stream of (key, at): deliberate views
    of documents, for example. Sums do not depend on the order of the events, so late ones count."""
    stateful(source.sparkSession)
    rows = source.selectExpr("coalesce(cast(key as string), '') as key", "cast(at as string) as at")
    return rows.groupBy("key").transformWithState(_Counts(), "key string, n_access long, last_access string", "Update", "None")
