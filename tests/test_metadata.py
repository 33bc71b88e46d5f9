"""Open metadata: paths, conditions and inventories against plain versions, and types through read, edit and write."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from noteloom import config
from noteloom.api import KnowledgeBase, _with_line
from noteloom.operators import metadata as m
from noteloom.sources import markdown

ROWS = [
    {"a": 1, "b": {"c": [1, 2.5, {"d": "x"}, {"d": "Y z"}]}, "t": True, "n": None},
    {"a": "1", "b": {"c": []}, "e.f": {"g": 3}, "t": False},
    {"a": 2.5, "b": [], "day": "2026-01-05", "quote": 'he said "{[" and \\'},
    {"a": [1, "1", None], "o": {}},
    {},
    None,
    {"a": -7, "b": {"c": {"d": "x"}}},
]
PATHS = ["a", "a[0]", "a[*]", "b.c", "b.c[*]", "b.c[*].d", "b.c.d", '["e.f"].g', "missing.x[*].y", "t", "n", "o"]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, None if r is None else json.dumps(r)) for i, r in enumerate([*ROWS, None])] + [(99, "{broken")]
    return spark.createDataFrame(data, "id long, j string").select("id", F.try_parse_json("j").alias("attributes"))


def reached(found, path):
    """All values at a path, by loops."""
    at = [found]
    for s in m.steps(path):
        got = []
        for v in at:
            if s is m.EVERY:
                got += v if isinstance(v, list) else []
            elif isinstance(s, int):
                got += [v[s]] if isinstance(v, list) and s < len(v) else []
            elif isinstance(v, dict) and s in v:
                got.append(v[s])
        at = got
    return at


def test_paths():
    assert m.steps('a.b-c[2][*]["x.y"].z') == ["a", "b-c", 2, m.EVERY, "x.y", "z"]
    for bad in (".a", "a..b", "a[", "a[b]", "a b", "a."):
        with pytest.raises(ValueError):
            m.steps(bad)


def test_values_at_paths(rows):
    shown = [F.transform(m.values(F.col("attributes"), p), lambda v: F.to_json(v)).alias(f"p{i}") for i, p in enumerate(PATHS)]
    for r in rows.select("id", *shown).collect():
        given = ROWS[r["id"]] if r["id"] < len(ROWS) else None
        for i, p in enumerate(PATHS):
            assert [json.loads(x) for x in r[f"p{i}"]] == ([] if given is None else reached(given, p)), (r["id"], p)


def test_conditions(rows):
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    cases = [
        (("a", "=", 1), lambda v: number(v) and v == 1), (("a", "=", "1"), lambda v: v == "1"), (("a[*]", "=", 1), lambda v: number(v) and v == 1),
        (("a", ">", -8.5), lambda v: number(v) and v > -8.5), (("a", "<=", 1), lambda v: number(v) and v <= 1),
        (("t", "=", True), lambda v: v is True), (("t", "=", False), lambda v: v is False), (("n", "=", None), lambda v: v is None),
        (("b.c[*].d", "~", "y Z"), lambda v: isinstance(v, str) and "y z" in v.lower()), (("o", "type", "object"), lambda v: isinstance(v, dict)),
        (("day", "<", dt.date(2026, 2, 1)), lambda v: isinstance(v, str) and v < "2026-02-01"),
        (("a", "in", [1, "1"]), lambda v: v == "1" or (number(v) and v == 1)), (("a", "in", []), lambda v: False),
    ]
    told = [m.condition(F.col("attributes"), *k) for k in [*(k for k, _ in cases), ("a", "!=", 1), ("b.c[*]", "exists"), ("b.c[*]", "missing")]]
    got = rows.select("id", *[c.alias(f"c{i}") for i, c in enumerate(told)]).collect()
    for r in got:
        given = ROWS[r["id"]] if r["id"] < len(ROWS) else None
        at = lambda p: [] if given is None else reached(given, p)  # noqa: B023, E731
        want = [any(f(v) for v in at(k[0])) for k, f in cases]
        want += [not any(number(v) and v == 1 for v in at("a")), bool(at("b.c[*]")), not at("b.c[*]")]
        assert [r[f"c{i}"] for i in range(len(told))] == want, r["id"]
    assert [r["id"] for r in m.where(rows, {"t": True, "b.c[*].d": ["x", "q"]}).collect()] == [0]
    with pytest.raises(ValueError):
        m.condition(F.col("attributes"), "a", "<>", 1)


def test_leaves_and_inventory(rows):
    def walk(v, path=""):
        if isinstance(v, dict) and v:
            for k, x in v.items():
                yield from walk(x, f'{path}["{k}"]' if "." in k else f"{path}.{k}" if path else k)
        elif isinstance(v, list) and v:
            for x in v:
                yield from walk(x, path + "[*]")
        else:
            kind = "null" if v is None else "boolean" if isinstance(v, bool) else {dict: "object", list: "array", str: "string"}.get(type(v), "number")
            yield path, kind, None if v is None or kind in ("object", "array") else json.dumps(v) if kind != "string" else v

    want = sorted((i, *leaf) for i, r in enumerate(ROWS) if r is not None for leaf in walk(r))
    order = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, m.leaves(rows).collect()), key=order) == sorted(want, key=order)
    by: dict = {}
    for _, path, kind, text in want:
        by.setdefault((path, kind), []).append(text)
    texts = {k: [t for t in v if t is not None] for k, v in by.items()}
    assert {(r["path"], r["kind"]): (r["n_values"], r["least"], r["most"]) for r in m.inventory(rows).collect()} == {k: (len(v), min(texts[k], default=None), max(texts[k], default=None)) for k, v in by.items()}
    assert m.inventory(rows.limit(0)).collect() == [] and [r[0] for r in rows.orderBy("id").select(m.depth(F.col("attributes"))).collect()] == [4, 3, 2, 2, 1, 0, 3, 0, 0]


def test_values_of_one_file():
    found = {"a": [{"b": 1}, {"b": 2}], "c": {"d": None}}
    assert m.picked(found, "a[*].b") == [1, 2] and m.picked(found, "a[1].b") == 2 and m.picked(found, "c.d") is None and m.picked(found, "x") is None
    assert m.changed(found, "a[1].b", 5)["a"] == [{"b": 1}, {"b": 5}] and m.changed(found, "a[2]", 7)["a"][2] == 7 and m.changed(found, "x.y.z", True)["x"] == {"y": {"z": True}}
    assert m.changed(found, "a[0]", None)["a"] == [{"b": 2}] and m.changed(found, "c.d", None)["c"] == {} and m.changed(found, "x.y", None) == found and found["a"] == [{"b": 1}, {"b": 2}]
    for path, new in (("a[3]", 1), ("a[*].b", 1), ("", 1), ("a.b", 1)):
        with pytest.raises(ValueError):
            m.changed(found, path, new)
    assert json.loads(m.as_json({1: dt.date(2026, 1, 5), "x": float("nan"), "y": {dt.date(2026, 1, 6): (1, True)}})) == {"1": "2026-01-05", "x": "nan", "y": {"2026-01-06": [1, True]}}
    assert m.parsed_condition("b.amount >= 10") == ("b.amount", (">=", 10)) and m.parsed_condition("a=x y") == ("a", ("=", "x y")) and m.parsed_condition("a[*]") == ("a[*]", ("exists", None)) and m.parsed_condition('a=["x",1]') == ("a", ("in", ["x", 1]))


HEAD = """---
aliases: [Hx]
status: active
lead: '[[Ida Berg]]'
budget: {amount: 1200, rate: 0.5}
remote: false
count: 0
due: 2026-03-01
sources:
- {type: wiki, id: page-9}
- {type: tracker, key: HEX-1}
---
# Helix

## Recent Facts
- [2026-01-05] Moved to the new cluster
- [2026-01-06] The budget was doubled
"""


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("meta")
    files = {"projects/helix.md": HEAD, "projects/plain.md": "# Plain\n**Status:** paused\n**Team:** Core\n", "people/ida-berg.md": "# Ida Berg\n**Role:** Lead\n\n- [2026-01-07] Moved to the new office\n",
             "notes/a.md": "---\ntitle: A\ndate: 2026-01-02\ntags:\n  - one\n  - two\nowner: Ida\n---\nHelix text\n", "glossary.md": "| Term | Meaning |\n| --- | --- |\n| MFA | multi factor |\n| **SSO** | single sign-on |\n"}
    for name, content in files.items():
        path = root / "memory" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    (root / "noteloom.toml").write_text('[data]\ndir = "tables"\n[user]\nname = "Ida Berg"\n')
    found = KnowledgeBase.from_config(spark, str(root / "memory"), as_of=dt.date(2026, 2, 10))
    assert found.root == root and found.store.root == str(root / "tables")
    found.index()
    return found


def test_types_through_read_edit_and_write(kb):
    names = lambda c: [r["name"] for r in kb.entities_where(c).collect()]
    assert names({"budget.amount": (">=", 1000), "sources[*].type": "tracker"}) == ["Helix"] and names({"remote": False}) == ["Helix"] and names({"count": 0}) == ["Helix"] and names({"count": "0"}) == []
    assert names({"status": ["active", "paused"]}) == ["Helix", "Plain"] and names({"due": ("<", dt.date(2026, 4, 1))}) == ["Helix"]
    kb.set_metadata("Helix", "budget.amount", 1500)
    kb.set_metadata("Helix", "sources[1].key", "HEX-2")
    kb.set_metadata("Helix", "budget.rate", None)
    head = markdown.frontmatter(kb.read_memory_file("projects/helix.md"))
    assert head["budget"] == {"amount": 1500} and head["remote"] is False and head["count"] == 0 and head["due"] == dt.date(2026, 3, 1) and head["lead"] == "[[Ida Berg]]"
    assert head["sources"] == [{"type": "wiki", "id": "page-9"}, {"type": "tracker", "key": "HEX-2"}] and "Moved to the new cluster" in kb.read_memory_file("projects/helix.md")
    assert names({"budget.amount": 1500}) == ["Helix"] and names({"budget.rate": ("exists", None)}) == []
    kinds = {r["path"]: r["kind"] for r in kb.metadata_paths("project").filter("path <> 'status'").collect()}
    assert kinds == {"budget.amount": "number", "remote": "boolean", "count": "number", "due": "string", "sources[*].type": "string", "sources[*].id": "string", "sources[*].key": "string", "lead": "string", "team": "string"}
    with pytest.raises(ValueError):
        kb.set_metadata("Helix", "aliases[0]", "x")


def test_profile_and_me(kb):
    assert kb.get_entity("me")["name"] == "Ida Berg"
    profile = kb.get_entity_profile("Hx")
    assert profile["attributes"]["sources"][0]["id"] == "page-9" and [f["seq"] for f in profile["facts"]] == [1, 2] and profile["breadcrumbs"]["recent"] == "project-timeline Helix --from-date 2026-01-11"
    assert [r["name"] for r in kb.list_entities(limit=2, offset=1).collect()] == ["Ida Berg", "Plain"]


def test_similar(kb):
    rows = kb.memory_similar("Moved to the new cluster", entity="Helix", threshold=0.3).collect()
    assert [(r["match_type"], r["fact_seq"], r["entity_name"], r["path"]) for r in rows][0] == ("fact", 1, "Helix", "projects/helix.md") and rows[0]["score"] == pytest.approx(1.0)
    assert all(r["entity_name"] == "Helix" for r in rows) and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert len(kb.memory_similar("Moved to the new cluster", entity="Helix", threshold=-1, limit=1).collect()) == 1 and kb.memory_similar("x", entity="Plain").collect() == []
    assert {r["path"] for r in kb.memory_similar("Helix text", path="notes/a.md", threshold=-1).collect()} == {"notes/a.md"} and kb.memory_similar("Helix text", threshold=-1, limit=50).count() > 1
    for scope in ({"entity": "Helix", "path": "notes/a.md"}, {"entity": "Nobody"}, {"path": "nowhere.md"}):
        with pytest.raises(ValueError):
            kb.memory_similar("x", **scope)


def test_notes_glossary_and_correction(kb):
    kb.edit_note("notes/a.md", tags=["three"], pin=True)
    text = kb.read_memory_file("notes/a.md")
    assert "tags: [three]\n" in text and "- one" not in text and "owner: Ida\n" in text and text.endswith("Helix text\n") and kb.get_document_pin("notes/a.md")
    assert [r["path"] for r in kb.list_notes(tag="three", pinned_only=True).collect()] == ["notes/a.md"]
    kb.edit_note("notes/a.md", pin=False)
    assert not kb.get_document_pin("notes/a.md") and "pinned: false" in kb.read_memory_file("notes/a.md")
    with pytest.raises(ValueError):
        kb.edit_note("notes/a.md")
    name = kb.add_note("Budget talk", "nothing named here", entity="Helix")
    assert "Budget talk" in [r["title"] for r in kb.get_entity_timeline("Helix").collect()]
    assert name in [r["path"] for r in kb.list_documents(since_hours=1).collect()] and kb.list_documents(since_hours=-1).count() == 0
    kb.delete_glossary_term("sso")
    assert [r["term"] for r in kb.list_glossary_terms().collect()] == ["MFA"]
    with pytest.raises(ValueError):
        kb.delete_glossary_term("SSO")
    assert [f["path"] for f in kb.correct_term("helix", file_type="helix")] == ["projects/helix.md"]
    with pytest.raises(ValueError):
        kb.correct_term("helix", apply=True)


def test_with_line():
    assert _with_line("", "tags", "[x]") == "---\ntags: [x]\n---\n"
    assert _with_line("---\ntitle: A\ntags:\n- a\n- b\nz: 1\n---\n", "tags", "[x]") == "---\ntitle: A\ntags: [x]\nz: 1\n---\n"
    assert _with_line("---\ntitle: A\n---\n", "pinned", "true") == "---\ntitle: A\npinned: true\n---\n"


def test_settings(tmp_path, monkeypatch):
    for name in (config.FILE_VARIABLE, config.DATA_VARIABLE):
        monkeypatch.delenv(name, raising=False)
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "own"))
    (tmp_path / "work" / "deep").mkdir(parents=True)
    assert config.find(str(tmp_path / "work")) is None
    own = tmp_path / "own" / "noteloom" / "config.toml"
    own.parent.mkdir(parents=True)
    own.write_text("")
    assert config.find(str(tmp_path / "work")) == own
    near = tmp_path / "work" / "noteloom.toml"
    near.write_text('[sources]\nroot = "notes"\n[data]\ndir = "s3a://bucket/index"\n')
    assert config.find(str(tmp_path / "work" / "deep")) == near
    assert config.settings(near) == {"project_root": str(tmp_path / "work" / "notes"), "data_dir": "s3a://bucket/index", "me": None}
    monkeypatch.setenv(config.DATA_VARIABLE, str(tmp_path / "d"))
    assert config.settings(near)["data_dir"] == str(tmp_path / "d")
    monkeypatch.setenv(config.FILE_VARIABLE, str(tmp_path / "none.toml"))
    assert config.find(str(tmp_path / "work")) is None
    near.write_text("user = 1\n")
    with pytest.raises(ValueError):
        config.settings(near)


def test_an_inventory_sorts_no_values(spark):
    """Only a row for each path and kind of a batch is aggregated by sorting, not every value."""
    rows = spark.range(5000).selectExpr("""try_parse_json(concat('{"a":"', id, '","b":{"é":', id, '},"c":[', if(id % 2 = 0, 'null', '"Zoë"'), '],"d":{}}')) as attributes""")
    found = m.inventory(rows, levels=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") > max(plan.index("SortAggregate"), plan.rindex("Sort "))
    got = {tuple(r) for r in found.collect()}
    want = {("a", "string", 5000, "0", "999"), ('b["é"]', "number", 5000, "0", "999"), ("c[*]", "null", 2500, None, None), ("c[*]", "string", 2500, "Zoë", "Zoë"), ("d", "object", 5000, None, None)}
    assert got == want
