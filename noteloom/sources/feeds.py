"""Remote notes as a Spark data source: `spark.read.format("note_feeds")` and `spark.readStream.format("note_feeds")`.

Options: `feeds`, names separated by commas, each read by a task of its own; `client`, a `module:factory` that is called
with the options in the worker and gives an object with

* `fetch(feed, cursor)`: a page, a dict with `notes`, `hasMore` and `cursor` (None asks for the first), and
* `newest(feed)`: the newest `updated_at` of a feed, or None;

`newestFirst` (true): notes come by descending `updated_at`, so a read for notes since some time ends at the first older
page; `attempts` and `wait`: how often a refused call is tried, and the first pause in seconds. The client that is
named by default reads pages from files, see FolderClient.

Rows are (feed, id, updated_at, raw), raw being the note's JSON; parsed() gives its columns. A page that doesn't say
whether there are more, or a cursor that stands still, fails the query. A filter on updated_at (`>`, `>=`) or on feed
is applied by the reader, so that older pages are never fetched.

A stream's offset is the newest updated_at of each feed. A batch reads what lies between two offsets, the lower one
included, as notes may share a time; what comes twice is for upserts, or for the state in streaming.state, to skip.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

from noteloom.session import ready
from noteloom.sources import remote

SCHEMA = "feed string, id string, updated_at string, raw string"
PERSON = "struct<name:string,email:string>"
NOTE = f"title string, created_at string, updated_at string, summary_markdown string, summary_text string, owner {PERSON}, attendees array<{PERSON}>, transcript array<{remote.SEGMENT}>"


class FolderClient:
    """Pages in files: `<path>/<feed>/first.json`, then `<cursor>.json`."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def fetch(self, feed: str, cursor: str | None) -> dict:
        name = cursor or "first"
        if "/" in name or name.startswith("."):
            raise ValueError(f"not a cursor: {name!r}")
        with open(f"{self.path}/{feed}/{name}.json", encoding="utf-8") as f:
            return json.load(f)

    def newest(self, feed: str) -> str | None:
        return max((n.get("updated_at") or "" for n in self.fetch(feed, None).get("notes", [])), default=None)


@dataclass
class Part(InputPartition):
    feed: str
    since: str | None
    until: str | None

    def __init__(self, feed: str, since: str | None = None, until: str | None = None):
        super().__init__(feed)
        self.feed, self.since, self.until = feed, since, until


class _Notes:
    """What the readers share: the client, and the notes of a part."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.feeds = [f.strip() for f in options.get("feeds", "").split(",") if f.strip()]
        if not self.feeds:
            raise ValueError("note_feeds needs the option feeds")

    def option(self, name: str, default: str) -> str:
        return {k.lower(): v for k, v in self.options.items()}.get(name.lower(), default)

    def client(self):
        module, factory = self.option("client", "noteloom.sources.feeds:FolderClient").split(":")
        return getattr(importlib.import_module(module), factory)({k.lower(): v for k, v in self.options.items()} | self.options)

    def asked(self, call):
        return remote.with_retries(call, int(self.option("attempts", "4")), float(self.option("wait", "1")), time.sleep)

    def read(self, part: Part) -> Iterator[tuple]:
        client = self.client()
        fetch = self.asked(lambda cursor: client.fetch(part.feed, cursor))
        newest_first = self.option("newestFirst", "true").lower() == "true"
        for note in remote.pages(fetch, part.since, newest_first):
            at = note.get("updated_at") or ""
            if part.until is None or at <= part.until:
                yield part.feed, note.get("id"), note.get("updated_at"), json.dumps(note, ensure_ascii=False)


class BatchReader(_Notes, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.since: str | None = self.option("since", "") or None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            match f:
                case GreaterThanOrEqual(("updated_at",), str(value)):
                    self.since = max(self.since or value, value)
                case GreaterThan(("updated_at",), str(value)):
                    self.since = max(self.since or value, value)
                    yield f  # those of that very time are read
                case EqualTo(("feed",), value):
                    self.feeds = [x for x in self.feeds if x == value]
                case In(("feed",), values):
                    self.feeds = [x for x in self.feeds if x in values]
                case _:
                    yield f

    def partitions(self) -> list[Part]:
        return [Part(feed, self.since) for feed in self.feeds]

    def read(self, part: Part) -> Iterator[tuple]:
        return _Notes.read(self, part)


class StreamReader(_Notes, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {feed: self.option("since", "") for feed in self.feeds}

    def latestOffset(self) -> dict:
        client = self.client()
        return {feed: self.asked(client.newest)(feed) or self.option("since", "") for feed in self.feeds}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(feed, start.get(feed) or None, until) for feed, until in end.items() if until and until > start.get(feed, "")]

    def read(self, part: Part) -> Iterator[tuple]:
        return _Notes.read(self, part)

    def commit(self, end: dict) -> None:
        """Nothing is kept: an offset says all."""


class NoteFeeds(DataSource):
    @classmethod
    def name(cls) -> str:
        return "note_feeds"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Makes the source known to a session, which then hands filters to it."""
    ready(spark).dataSource.register(NoteFeeds)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def parsed(notes: DataFrame) -> DataFrame:
    """feed, id and the columns of the notes."""
    return notes.select("feed", "id", F.from_json("raw", NOTE).alias("n")).select("feed", "id", "n.*")


def documents(notes: DataFrame) -> DataFrame:
    """(id, path, text, updated_at): a markdown file for each note, below meetings/, by its day and title: who was there, its
    summary, and what was said, with the turns of one speaker joined. notes: as parsed() gives them, one row for each id."""
    who = F.concat(F.array("owner"), F.coalesce("attendees", F.array().cast(f"array<{PERSON}>")))
    who = F.filter(who, lambda p: p.isNotNull() & p["email"].isNotNull() & ~p["email"].contains("@resource."))
    who = F.aggregate(who, F.array().cast(f"array<{PERSON}>"), lambda a, p: F.when(F.exists(a, lambda q: F.lower(q["email"]) == F.lower(p["email"])), a).otherwise(F.concat(a, F.array(p))))
    segments = notes.select("id", F.posexplode("transcript").alias("pos", "s")).select("id", "pos", "s.speaker", "s.source", "s.text")
    said = remote.transcript_markdown(segments).withColumnRenamed("body", "said")
    from noteloom.functions.text import file_stem

    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\"]', r"\\$0"), r"\s+", " "), F.lit('"'))
    people = F.array_join(F.transform("who", lambda p: F.concat(F.lit("- {name: "), quoted(p["name"]), F.lit(", email: "), quoted(p["email"]), F.lit("}\n"))), "")
    day = F.substring(F.coalesce("created_at", "updated_at"), 1, 10)
    head = F.concat(
        F.lit("---\ntitle: "), quoted(F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled"))), F.lit("\ndate: "), day, F.lit("\nsource: "), quoted(F.col("feed")),
        F.when(F.size("who") > 0, F.concat(F.lit("\nattendees:\n"), people)).otherwise("\n"), F.lit("---\n"))
    parts = F.concat_ws("\n\n", F.nullif(F.trim(F.coalesce("summary_markdown", "summary_text")), F.lit("")), F.when(F.col("said").isNotNull(), F.concat(F.lit("## Transcript\n\n"), F.col("said"))))
    path = F.concat(F.lit("meetings/"), F.regexp_replace(day, "-", "/"), F.lit("/"), file_stem(F.coalesce("title", F.lit("")), F.col("id")), F.lit(".notes.md"))
    return notes.join(said, "id", "left").withColumn("who", who).select("id", path.alias("path"), F.concat(head, parts, F.lit("\n")).alias("text"), "updated_at")
