"""Incremental builds: they equal a full build, and cost what changed. Parts, removals and merges of stored tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from noteloom.api import KnowledgeBase
from noteloom.plans import store as st

AS_OF = dt.date(2026, 2, 10)
FILES = {
    "people/ida-berg.md": "# Ida Berg\n**Role:** Analyst\n\n- [2026-01-05] Joined in spring\n",
    "projects/north-star.md": "---\naliases: [Polaris]\nstatus: active\n---\n# North Star\n\n- [2026-01-06] Began\n- [2026-01-07] Got a budget\n",
    "notes/one.md": "---\ntitle: Plans for Polaris\ndate: 2026-01-20\ntags: [plan]\n---\n## Why\nIda Berg wants the budget of Polaris to grow.\n\n## When\nNext quarter, after the review of the ledger.\n",
    "notes/two.md": "---\ntitle: Other things\ndate: 2026-01-21\n---\n## Talk\nCleo Lund spoke of the ledger and of hiring.\n",
    "notes/three.md": "---\ntitle: Third\n---\nNothing of note here, only words.\n",
    "glossary.md": "| Term | Meaning |\n| --- | --- |\n| KPI | key performance indicator |\n",
}
TABLES = ("documents", "texts", "chunks", "postings", "stemmed", "lengths", "impacts", "vectors", "mentions", "entities", "facts", "profiles", "glossary", "attendees")


def put(root, files):
    for name, content in files.items():
        path = root / "memory" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)


def rows(kb, name):
    keyless = {"facts": ["created_at", "seq"]}.get(name, [])
    df = kb.store.read(name).drop(*keyless)
    if name == "impacts":  # changes add up; bounds of what is gone stay
        df = df.groupBy("kind", "term", "block").agg(F.sum("n").alias("n"), F.when(F.col("kind") == "corpus", F.sum("least")).alias("total")).filter("n <> 0")
    return sorted(df.select(*[F.to_json(F.struct(F.col(c).alias("v"))).alias(c) for c in df.columns]).collect())


def test_incremental_equals_full_and_costs_what_changed(spark, tmp_path):
    put(tmp_path, FILES)
    kb = KnowledgeBase(spark, str(tmp_path), as_of=AS_OF)
    assert kb.index() == {"new": 6, "changed": 0, "indexed": 6}
    assert kb.index() == {"new": 0, "changed": 0, "indexed": 0}

    put(tmp_path, {"notes/one.md": FILES["notes/one.md"].replace("grow", "shrink")})
    assert kb.stale_files() == ["notes/one.md"]
    assert kb.reindex_stale() == ["notes/one.md"]
    w = kb.store.written
    assert (w["texts"], w["chunks"], w["vectors"], w["lengths"], w["documents"]) == (1, 3, 3, 3, 1) and w["postings"] < 60 and "facts" not in w
    assert {r["path"] for r in kb.search("shrink", fast=True).collect()} == {"notes/one.md"} and kb.search("grow", fast=True).count() == 0

    (tmp_path / "memory/notes/three.md").unlink()
    put(tmp_path, {
        "notes/four.md": "---\ntitle: Fourth\n---\nCleo Lund and Ida Berg, on the ledger.\n",
        "people/cleo-lund.md": "# Cleo Lund\n**Role:** Lead\n\n- [2026-02-01] Hired two\n",  # a name that an unchanged note has
        "projects/north-star.md": FILES["projects/north-star.md"] + "- [2026-02-02] Moved on\n",
    })
    assert kb.reindex_file("notes/four.md") == {"new": 1, "changed": 0, "indexed": 1} and kb.stale_files() == ["projects/north-star.md"]
    assert kb.index() == {"new": 1, "changed": 1, "indexed": 2}
    fresh = KnowledgeBase(spark, str(tmp_path), str(tmp_path / "other"), as_of=AS_OF)
    fresh.index()
    for name in TABLES:
        assert rows(kb, name) == rows(fresh, name), name
    assert {r["seq"] for r in kb.get_entity("north star")["facts"]} == {1, 2, 3}
    kb.store.compact("chunks")
    assert rows(kb, "chunks") == rows(fresh, "chunks") and not any(p["gone"] for p in kb.store.parts("chunks")[1])


@pytest.fixture()
def store(spark, tmp_path):
    return st.Store(spark, str(tmp_path))


def mentions(spark, *pairs):
    return spark.createDataFrame([(e, d, "x") for e, d in pairs], "entity_id long, document_id long, mention_type string")


def listed(store):
    return sorted((r.entity_id, r.document_id) for r in store.read("mentions").collect())


def test_batches_replace_and_merge(spark, store):
    gone = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert listed(store) == [] and store.read("mentions").schema == mentions(spark).schema
    want = {}
    for k in range(14):
        docs = [k % 5, k % 5, 10 + k]
        store.replace("mentions", mentions(spark, *[(100 * k + i, d) for i, d in enumerate(docs)]), gone(k % 5, 99))
        want = {d: v for d, v in want.items() if d != k % 5}
        for i, d in enumerate(docs):
            want.setdefault(d, []).append((100 * k + i, d))
        assert listed(store) == sorted(x for v in want.values() for x in v)
    _, parts = store.parts("mentions")
    assert len([p for p in parts if not p["gone"]]) <= 2 * st.FAN and sum(p["rows"] for p in parts if p["gone"]) <= 14
    kept = store.read("mentions")
    store.append("mentions", [(1, 2, "manual")], ["entity_id", "document_id", "mention_type"])
    assert (1, 2) in listed(store) and kept.count() + 1 == store.read("mentions").count()  # readers keep what they began with
    number = store.parts("mentions")[0]
    store.replace("mentions", mentions(spark), gone())
    assert store.parts("mentions")[0] == number  # nothing to store
    assert len(store._numbers("mentions")) <= st.KEEP


def test_of_two_writers_one_fails(spark, store, monkeypatch):
    store.write("mentions", mentions(spark, (1, 1)))
    number, parts = store.parts("mentions")
    monkeypatch.setattr(st.Store, "parts", lambda self, name: (number, parts))
    store.write("mentions", mentions(spark, (2, 2)))
    with pytest.raises(st.Conflict):
        store.write("mentions", mentions(spark, (3, 3)))
    monkeypatch.undo()
    assert listed(store) == [(2, 2)]


def test_a_model_embeds_only_new_chunks(spark, tmp_path):
    from noteloom.operators import vectors

    log = str(tmp_path / "log")

    def load():
        with open(log, "a") as f:
            f.write("load\n")

        def model(texts):
            with open(log, "a") as f:
                f.writelines(f"text {len(t)}\n" for t in texts)
            return [[len(t), 1.0, t.count("e")] for t in texts]

        return model

    embed = vectors.model_embedding(load, batch=4, most=50)
    df = spark.createDataFrame([("abc",), ("e" * 80,), (None,)], "t string").coalesce(1)
    got = [r.v for r in df.select(embed(F.col("t")).alias("v")).collect()]
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-5 and abs(got[1][0] / got[1][1] - 50) < 1e-3 and list(got[2]) == [0.0, 1.0, 0.0]
    assert open(log).read().count("load") == 1

    put(tmp_path, {"notes/a.md": "---\ntitle: A\n---\n## One\nA first part of this note.\n\n## Two\nA second part of the note.\n", "notes/b.md": "---\ntitle: B\n---\nOther words.\n"})
    kb = KnowledgeBase(spark, str(tmp_path), as_of=AS_OF, embed=embed)
    kb.index()
    open(log, "w").close()
    put(tmp_path, {"notes/a.md": "---\ntitle: A\n---\n## One\nA first part of this note.\n\n## Two\nAnother second part.\n"})
    kb.index()
    lines = [x for x in open(log).read().splitlines() if x != "load"]
    assert len(lines) == 2 and kb.store.written["vectors"] == 3  # the changed part and the summary, not the first part
