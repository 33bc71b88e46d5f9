"""The data source of remote notes, in batches and streams, with keyed state and upserts behind it."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from noteloom.api import KnowledgeBase
from noteloom.operators import incremental
from noteloom.sources import feeds
from noteloom.streaming import ingest, state


def note(key, day, title="A talk", **more):
    return {"id": key, "updated_at": f"2026-03-{day:02d}T10:00:00Z", "created_at": "2026-03-01T09:00:00Z", "title": title} | more


def put(root, feed, *pages):
    """Pages of a feed, newest notes first; the last one says that it is."""
    (root / feed).mkdir(parents=True, exist_ok=True)
    for k, notes in enumerate(pages):
        more = {"hasMore": True, "cursor": f"p{k + 1}"} if k < len(pages) - 1 else {"hasMore": False}
        (root / feed / f"{f'p{k}' if k else 'first'}.json").write_text(json.dumps({"notes": notes} | more))


@pytest.fixture()
def session(spark):
    return feeds.register(spark)


def read(spark, root, names="x,y", **more):
    return spark.read.format("note_feeds").options(path=str(root), feeds=names, wait="0", **more).load()


def test_batch(session, tmp_path):
    put(tmp_path, "x", [note("a", 9), note("b", 8)], [note("c", 5, tags=["t"])], [note("d", 1)])
    put(tmp_path, "y", [note("a", 3, "Änderung")])
    rows = read(session, tmp_path)
    assert {(r.feed, r.id) for r in rows.collect()} == {("x", "a"), ("x", "b"), ("x", "c"), ("x", "d"), ("y", "a")}
    assert rows.rdd.getNumPartitions() == 2
    assert json.loads(rows.filter("id = 'c'").first().raw)["tags"] == ["t"]
    assert feeds.parsed(rows).filter("feed = 'y'").first().title == "Änderung"
    (tmp_path / "x" / "p2.json").unlink()  # older pages are not asked for
    assert {r.id for r in read(session, tmp_path, "x", since="2026-03-08").collect()} == {"a", "b"}


def test_filters_reach_the_reader():
    reader = feeds.BatchReader({"feeds": "x,y,z", "since": "2026-01-01"})
    left = list(reader.pushFilters([
        feeds.GreaterThanOrEqual(("updated_at",), "2026-02-01"), feeds.GreaterThan(("updated_at",), "2026-02-03"), feeds.In(("feed",), ("x", "z")), feeds.EqualTo(("id",), "k")]))
    assert [(p.feed, p.since) for p in reader.partitions()] == [("x", "2026-02-03"), ("z", "2026-02-03")] and len(left) == 2


def test_a_broken_feed_fails_the_query(session, tmp_path):
    put(tmp_path, "x", [note("a", 9)], [note("b", 8)])
    (tmp_path / "x" / "p1.json").write_text(json.dumps({"notes": [], "hasMore": True, "cursor": "p1"}))  # it stands still
    with pytest.raises(Exception, match="stands still"):
        read(session, tmp_path, "x").collect()
    (tmp_path / "x" / "p1.json").write_text(json.dumps({"notes": []}))
    with pytest.raises(Exception, match="hasMore"):
        read(session, tmp_path, "x").collect()
    with pytest.raises(Exception, match="option feeds"):
        read(session, tmp_path, " ").collect()


def test_stream_and_batch_give_one_table(session, tmp_path):
    root, table = tmp_path / "pages", str(tmp_path / "table")
    stages = [
        {"x": [[note("a", 5), note("b", 4)], [note("c", 2)]], "y": [[note("a", 3)]]},
        {"x": [[note("b", 7, "Changed"), note("d", 6)], [note("a", 5), note("c", 2)]], "y": [[note("a", 3)]]},
        {"x": [[note("b", 7, "Changed"), note("d", 6)], [note("a", 5), note("c", 2)]], "y": [[note("e", 8), note("a", 3)]]},
    ]
    batch = session.createDataFrame([], "key string, " + feeds.SCHEMA)
    for stage in stages:
        for feed, pages in stage.items():
            put(root, feed, *pages)
        key = F.concat_ws("/", "feed", "id").alias("key")
        stream = session.readStream.format("note_feeds").options(path=str(root), feeds="x,y", wait="0").load().select(key, "*")
        ingest.upsert_stream(stream, table, "key", "updated_at", str(tmp_path / "cp")).awaitTermination()
        batch = incremental.merged(batch, read(session, root).select(key, "*"), "key", "updated_at")
    got = {(r.key, r.updated_at, r.raw) for r in ingest.current(session, table).collect()}
    assert got == {(r.key, r.updated_at, r.raw) for r in batch.collect()} and len(got) == 6


def run(spark, source, checkpoint, of):
    out = []
    ingest.index_stream(of(source), lambda b, n: out.extend(map(tuple, b.collect())), checkpoint).awaitTermination()
    return sorted(out, key=str)


def test_only_what_is_new_or_changed(spark, tmp_path):
    src, schema = tmp_path / "src", "key string, hash string, version string, payload string"
    stream = lambda: spark.readStream.schema(schema).json(str(src))

    def add(n, *rows):
        src.mkdir(exist_ok=True)
        (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("key", "hash", "version", "payload"), r))) for r in rows))
        return [(r[0], r[4], r[2]) for r in run(spark, stream(), str(tmp_path / "cp"), state.changed_only)]

    assert add(1, ("a", "1", "01", "x"), ("a", "2", "02", "y"), ("b", "1", "01", "z")) == [("a", "new", "02"), ("b", "new", "01")]
    assert add(2, ("a", "2", "03", "y"), ("b", "0", "00", "late"), ("c", None, None, None)) == [("c", "new", None)]
    assert add(3, ("a", "9", "02", "late"), ("b", "2", "05", "w"), ("c", None, None, None)) == [("b", "changed", "05")]
    assert run(spark, stream(), str(tmp_path / "cp"), state.changed_only) == []  # a restart repeats nothing


def test_running_counts(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for n, rows in enumerate([[("a", "2026-01-02"), ("a", "2026-01-05"), ("b", "2026-01-01")], [("a", "2026-01-03")]]):
        (src / f"{n}.json").write_text("\n".join(json.dumps({"key": k, "at": at}) for k, at in rows))
        got = run(spark, spark.readStream.schema("key string, at string").json(str(src)), str(tmp_path / "cp"), state.running_counts)
        assert got == ([("a", 2, "2026-01-05"), ("b", 1, "2026-01-01")] if n == 0 else [("a", 3, "2026-01-05")])


def test_sync_writes_and_indexes_changed_notes(spark, tmp_path):
    root = tmp_path / "pages"
    said = [{"source": "microphone", "text": "hello"}, {"source": "microphone", "text": "there"}, {"speaker": "Bo", "text": "the quarterly ledger"}]
    people = {"owner": {"name": "Ann Ek", "email": "ann@x.org"}, "attendees": [{"name": "Bo Dahl", "email": "bo@x.org"}, {"name": "Again", "email": "ANN@x.org"}, {"email": "r1@resource.x.org"}]}
    put(root, "x", [note("abcdefgh1", 9, 'Plan "A"/B', transcript=said, summary_markdown="## Summary\nAll fine.", **people), note("b2", 8, "Other")])
    kb = KnowledgeBase(spark, str(tmp_path / "kb"), as_of=dt.date(2026, 4, 1))
    (tmp_path / "kb" / "memory").mkdir(parents=True)
    (tmp_path / "kb" / "meetings").mkdir()
    options = {"path": str(root), "feeds": "x", "wait": "0"}
    assert kb.sync(options) == {"new": 2, "changed": 0} and kb.sync(options) == {"new": 0, "changed": 0}
    paths = {r.path: r.title for r in kb.list_documents().collect()}
    first = next(p for p, t in paths.items() if t == 'Plan "A"/B')
    content = (tmp_path / "kb" / first).read_text()
    assert first.startswith("meetings/2026/03/01/abcdefgh-Plan") and "**Me**: hello there\n\n**Bo**: the quarterly ledger" in content and "Again" not in content and "resource" not in content
    assert {r.name for r in kb.list_entities().collect()} == {"Ann Ek", "Bo Dahl"}
    assert [r.path for r in kb.search("quarterly ledger", fast=True).collect()] == [first]
    put(root, "x", [note("b2", 12, "Other", summary_text="now with text"), note("abcdefgh1", 9, 'Plan "A"/B', transcript=said, summary_markdown="## Summary\nAll fine.", **people)])
    assert kb.sync(options) == {"new": 0, "changed": 1} and kb.store.written["texts"] == 1
