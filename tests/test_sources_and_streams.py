import pytest
from pyspark.sql import functions as F

from noteloom.sources import markdown, remote
from noteloom.streaming import ingest


def test_frontmatter(spark):
    good = "---\ntitle: T\ndate: 2026-01-02\ntags: a, b\nattendees:\n- {name: N, email: e@x}\n---\nbody"
    df = spark.createDataFrame([(good,), ("---\n: [bad\n---\nx",), ("no",), (None,)], "text string")
    got = [r["fm"] for r in markdown.with_frontmatter(df).collect()]
    assert got[0]["title"] == "T" and got[0]["tags"] == ["a", "b"] and got[0]["attendees"][0]["email"] == "e@x"
    assert all(g["title"] is None and g["tags"] == [] for g in got[1:])


def test_glossary(spark):
    df = spark.createDataFrame([("g.md", "# G\n| Term | Meaning | Notes |\n| --- | --- | --- |\n| API | interface | x |\n- bullet: no")], "path string, text string")
    rows = markdown.glossary_terms(df)
    assert [(r["term"], r["expansion"], r["notes"]) for r in rows.collect()] == [("API", "interface", "x")]
    assert markdown.glossary_chunks(rows).first()["content"] == "API: interface. x"


def test_pages():
    def client(*pages):
        left = list(pages)
        return lambda cursor: left.pop(0)

    note = lambda k: {"id": k, "updated_at": f"2026-03-0{k}"}
    two = ({"notes": [note(1), note(2)], "hasMore": True, "cursor": "p2"}, {"notes": [note(3)], "hasMore": False})
    assert [n["id"] for n in remote.pages(client(*two), "2026-03-02")] == [2, 3]
    for bad in ([{"notes": [note(1)]}], [two[0], two[0]]):
        with pytest.raises(ValueError):
            list(remote.pages(client(*bad)))
    with pytest.warns(UserWarning):
        assert len(list(remote.pages(client({"notes": [note(1)], "hasMore": True, "cursor": None})))) == 1


def test_transcript_and_attendees(spark):
    seg = spark.createDataFrame([(1, 0, None, "microphone", "hi"), (1, 1, "", "microphone", "there"), (1, 2, "Bo", "speaker", "yes"), (1, 3, None, "speaker", " ")], "id long, pos int, speaker string, source string, text string")
    assert remote.transcript_markdown(seg).first()["body"] == "**Me**: hi there\n\n**Bo**: yes"
    notes = spark.createDataFrame([(1, ("", "a.b@x"), [("C", "c@x"), ("A", "A.B@x"), ("R", "r@resource.x")])], "id long, creator struct<name:string,email:string>, people array<struct<name:string,email:string>>")
    assert [(r["name"], r["email"]) for r in remote.attendees(notes).orderBy("pos").collect()] == [("A B", "a.b@x"), ("C", "c@x")]


def test_rich_text():
    tree = {"type": "doc", "content": [{"type": "heading", "attrs": {"level": 2}, "content": [{"type": "text", "text": "H"}]}, {"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "x", "marks": [{"type": "bold"}]}]}]}]}]}
    assert remote.rich_text(tree) == "## H\n\n- **x**\n\n"
    assert remote.blocks_markdown([{"type": "to_do", "text": "a", "checked": True}, {"type": "numbered_list", "text": "b"}]) == "- [x] a\n1. b"
    assert remote.summary_section("# A\nx\n## Summary\ny\n# B\nz") == "y"


def test_upsert_stream(spark, tmp_path):
    src, table = str(tmp_path / "src"), str(tmp_path / "table")
    for k, rows in enumerate([[(1, 10, "a"), (2, 10, "b")], [(1, 9, "old"), (2, 11, "new")]]):
        spark.createDataFrame(rows, "id long, v long, x string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long, v long, x string").parquet(src)
        ingest.upsert_stream(stream, table, "id", "v", str(tmp_path / "cp")).awaitTermination()
    assert {(r["id"], r["x"]) for r in ingest.current(spark, table).collect()} == {(1, "a"), (2, "new")}


def test_access_counts(spark):
    e = spark.createDataFrame([(1, "2026-01-01 01:00:00"), (1, "2026-01-01 02:00:00"), (2, "2026-01-02 00:00:00")], "document_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["n_access"] for r in ingest.access_counts(e).collect()) == [1, 2]


def test_offset_and_token_pages():
    notes = [{"id": i, "updated_at": f"2026-01-{30 - i:02d}"} for i in range(12)]
    asked = []

    def by_offset(offset, size):
        asked.append(offset)
        return notes[offset : offset + size]

    assert [n["id"] for n in remote.offset_pages(by_offset, size=5)] == list(range(12)) and asked == [0, 5, 10]
    asked.clear()
    assert [n["id"] for n in remote.offset_pages(by_offset, since="2026-01-27", size=5)] == [0, 1, 2, 3] and asked == [0]
    page = {None: {"entries": [{"id": 1, "date": "b"}, {"id": 2, "date": "a"}], "next": "t"}, "t": {"entries": [{"id": 1, "date": "b"}, {"id": 3, "date": "c", "status": "transcribing"}, {"id": 4, "date": "c"}]}}
    assert [e["id"] for e in remote.token_pages(page.__getitem__)] == [1, 2, 4] and [e["id"] for e in remote.token_pages(page.__getitem__, since="b")] == [1, 4]
    with pytest.raises(ValueError):
        list(remote.token_pages(lambda t: {"entries": [], "next": "same"}))


def test_retries():
    waits, left = [], [remote.Refused(7), ConnectionError(), None]

    def fetch(x):
        e = left.pop(0)
        if e:
            raise e
        return x

    assert remote.with_retries(fetch, sleep=waits.append)("page") == "page" and waits == [7, 2.0]
    with pytest.raises(ConnectionError):
        remote.with_retries(lambda: (_ for _ in ()).throw(ConnectionError()), attempts=2, sleep=waits.append)()


def test_wikilinks(spark):
    from noteloom.operators import wikilinks as W

    names = ["Anna Lind", "Anna Lind Project", "C++ Guild +"]
    text = "---\na: Anna Lind\n---\n# Anna Lind\nanna lind project, [[Anna Lind]] and Anna Lind.\n```\nAnna Lind\n```\nAnna Linden C++ guild +x c++ guild +"
    out = "---\na: Anna Lind\n---\n# Anna Lind\n[[Anna Lind Project]], [[Anna Lind]] and [[Anna Lind]].\n```\nAnna Lind\n```\nAnna Linden C++ guild +x [[C++ Guild +]]"
    assert W.wikilinked(text, names) == out and W.wikilinked(out, names) == out and W.wikilinked("x", []) == "x"
    people = spark.createDataFrame([(1, "Anna Lind", ["Anna", "anna-lind x"]), (2, "ANNA LIND", [])], "id long, name string, aliases array<string>")
    files = spark.createDataFrame([("a", "met anna lind"), ("b", "none"), ("c", None)], "path string, text string")
    assert {r["path"]: r["text"] for r in W.with_wikilinks(files, people).collect()} == {"a": "met [[Anna Lind]]", "b": "none", "c": None}


def test_migrated():
    from noteloom.operators import wikilinks as W

    old = "# Anna Lind\n\n**Role:** Lead\n**Also known as:** AL, Ann\n**Pinned:** yes\n\nintro\n\n## Notes\n**Not:** this\n"
    new = W.migrated(old)
    assert new == "---\nrole: Lead\naliases:\n- AL\n- Ann\npinned: true\n---\n# Anna Lind\n\nintro\n\n## Notes\n**Not:** this\n" and W.migrated(new) == new and W.migrated("plain") == "plain"
