import datetime as dt

import pytest

from noteloom.api import KnowledgeBase, inserted_under
from noteloom.operators import fts

AS_OF = dt.date(2026, 2, 10)


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("kb")
    files = {
        "people/linnea-holm.md": "# Linnea Holm\n**Also known as:** Nea\n**Role:** Engineer\n\n- [2026-01-05] Moved to Oslo\n",
        "projects/helix-refactor.md": "# Helix Refactor\n**Status:** active\n",
        "notes/mfa.md": "---\ntitle: MFA Implementation Review\ndate: 2026-01-27\ntags: [auth, review]\n---\n## Overview\nLinnea Holm reviewed the token rotation for the login service.\n\n## Next Steps\nRun the migration again.\n",
        "notes/helix.md": "---\ntitle: Helix status\ndate: 2026-01-20\n---\n## Status\nThe Helix Refactor is running late, migrations fail.\n",
        "glossary.md": "| Term | Meaning |\n| --- | --- |\n| MFA | multi factor authentication |\n",
    }
    for name, content in files.items():
        path = root / "memory" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    found = KnowledgeBase(spark, str(root), as_of=AS_OF)
    assert found.index()["indexed"] == 5
    return found


def test_nothing_to_do(kb):
    assert kb.index() == {"new": 0, "changed": 0, "indexed": 0}


def test_stats_and_tree(kb):
    stats = kb.get_index_stats()
    assert stats["n_documents"] == 5 and stats["n_entities"] == 2
    assert {r["dir"]: r["n_files"] for r in kb.list_memory_tree().collect()} == {"people": 1, "projects": 1, "notes": 2}


def test_entities(kb):
    assert [r["name"] for r in kb.find_entities("nea").collect()] == ["Linnea Holm"]
    entity = kb.get_entity("Linnea Holm")
    assert entity["metadata"]["role"] == "Engineer" and [f["fact_text"] for f in entity["facts"]] == ["Moved to Oslo"]
    assert "notes/mfa.md" in [r["path"] for r in kb.list_documents(limit=9).collect()]
    assert {r["title"] for r in kb.get_entity_timeline("helix refactor").collect()} >= {"Helix status"}


def test_facts(kb):
    seq = kb.add_fact("Linnea Holm", "Likes tea", "2026-02-01")
    kb.edit_fact("Linnea Holm", seq, fact="Likes coffee")
    assert "Likes coffee" in [r["fact_text"] for r in kb.list_facts(since="2w").collect()]
    kb.delete_fact("Linnea Holm", seq)
    assert "Likes coffee" not in [r["fact_text"] for r in kb.list_facts().collect()]


def test_search(kb):
    hits = kb.search("migrations", limit=5, fast=True).collect()
    assert hits and hits[0]["score"] > 0 and {h["path"] for h in hits} == {"notes/mfa.md", "notes/helix.md"}
    only = kb.search("migration", limit=5, tag="auth").collect()
    assert [h["path"] for h in only] == ["notes/mfa.md"]


def test_view_and_pin(kb):
    assert "token rotation" in kb.view_document("mfa.md")["body"]
    assert kb.toggle_document_pin("notes/helix.md") is True
    assert [r["path"] for r in kb.list_pinned_documents().collect()] == ["notes/helix.md"]


def test_unlink_and_relink(kb):
    kb.unlink_entity("Linnea Holm", "notes/mfa.md")
    assert "MFA Implementation Review" not in {r["title"] for r in kb.get_entity_timeline("Linnea Holm").collect()}
    kb.relink_entity("Linnea Holm", "notes/mfa.md")
    assert "MFA Implementation Review" in {r["title"] for r in kb.get_entity_timeline("Linnea Holm").collect()}


def test_context(kb):
    near = kb.context(topic="migrations")
    assert "Helix Refactor" in near and "Linnea Holm" not in near  # a note about them mentions the project
    assert "Linnea Holm" in kb.context(topic="what linnea holm wants") and "Linnea Holm" in kb.context(topic="linnea")
    assert "no entities for 'zzzz'" in kb.context(topic="zzzz") and "# Context" in kb.context(human=True)
    assert "Helix Refactor" in kb.context() and "MFA=multi factor authentication" in kb.context()


def test_notes_and_correction(kb):
    name = kb.add_note("Ünusual note", "The Helx thing", ["a"])
    assert name == "notes/unusual-note.md"
    assert [r["path"] for r in kb.list_notes(tag="A").collect()] == [name]
    assert [h["path"] for h in kb.correct_term("Helx", "Helix$1", apply=True)] == [name]
    assert "Helix$1 thing" in kb.read_memory_file(name)
    kb.edit_note(name, append="more", insert_under=("## Log", "- x"))
    assert kb.read_memory_file(name).endswith("## Log\n- x\n")
    kb.delete_note(name)
    assert kb.list_notes(tag="a").count() == 0


def test_file_guard(kb):
    for bad in ("../x.md", "notes/x.txt", "/etc/x.md"):
        with pytest.raises(ValueError):
            kb.read_memory_file(bad)


def test_inserted_under():
    once = inserted_under("# T\n\n## Log\n- a\n", "## Log", "- b")
    assert once == "# T\n\n## Log\n- b\n- a\n" and inserted_under(once, "## Log", "- b") == once
    assert inserted_under(once, "## Log", "- a") == "# T\n\n## Log\n- a\n- b\n- a\n"  # only the first line counts
    assert inserted_under("x", "## New", "- a") == "x\n\n## New\n- a\n" and inserted_under("", "## New", "- a") == "## New\n- a\n"


def test_facts_outlive_a_build(kb):
    seq = kb.add_fact("Linnea Holm", "Plays chess", "2026-02-03")
    kb.add_fact("Linnea Holm", "Reads maps", "2026-02-04")
    kb.edit_fact("Linnea Holm", seq, fact="Plays go")
    before = {r["fact_text"]: r["seq"] for r in kb.get_entity("Linnea Holm")["facts"]}
    kb.index(full=True)
    assert {r["fact_text"]: r["seq"] for r in kb.get_entity("Linnea Holm")["facts"]} == before and before["Plays go"] == seq
    kb.delete_fact("Linnea Holm", seq)
    kb.index(full=True)
    assert "Plays go" not in {r["fact_text"] for r in kb.get_entity("Linnea Holm")["facts"]} and "[2026-02-04] Reads maps" in kb.read_memory_file("people/linnea-holm.md")


def test_a_search_reads_the_terms_of_its_query(kb):
    found = kb.search("token rotation", limit=3, fast=True)
    assert found.first()["path"] == "notes/mfa.md" and 0 < kb.last_search["read"] <= kb.last_search["blocks"]
    for terms, pushed in ((["token", "rotat"], "In(term, ["), (["rot*"], "StringStartsWith(term,rot)")):
        plan = fts.looked_up(kb.store.read("stemmed"), terms)._jdf.queryExecution().toString()
        assert "stemmed" in plan and pushed in plan.replace("PushedFilters: [", "")
    assert [r["path"] for r in kb.search("rotation", limit=3, fast=True, stem=False, path="notes/*").collect()] == ["notes/mfa.md"]


def test_entities_in_files(kb):
    path = kb.create_entity("Omar Aziz", aliases=["OZ"], metadata={"team": "Platform", "role": "Lead", "email": "omar@x.org", "likes": "tea"}, body="## Notes\nx\n")
    assert path == "people/omar-aziz.md" and "team: '[[Platform]]'" in kb.read_memory_file(path)
    entity = kb.get_entity("omar aziz")
    assert entity["metadata"] == {"team": "Platform", "role": "Lead", "email": "omar@x.org", "likes": "tea"} and entity["aliases"] == ["OZ", "Omar", "omar-aziz"]
    with pytest.raises(ValueError):
        kb.create_entity("Omar  Aziz")
    kb.edit_entity("Omar Aziz", {"role": "Head", "likes": None}, pinned=True)
    content = kb.read_memory_file(path)
    assert "role: Head" in content and "likes" not in content and "aliases:\n- OZ\n" in content and content.endswith("# Omar Aziz\n\n## Notes\nx\n")
    assert kb.get_entity("Omar Aziz")["pinned"] is True
    assert kb.search_entities("Omar Aziz Platform Head", 1).first()["name"] == "Omar Aziz"
    assert kb.search_entities("Omar Aziz", 3, "project").count() == 1 and kb.suggest_entities("omar azis")[0] == "Omar Aziz"
    kb.delete_entity("Omar Aziz")
    assert kb.find_entities("Omar Aziz").count() == 0 and kb.suggest_entities("omar azis") == []


def test_mentions_snippets_and_diagnosis(kb):
    kinds = {(r["entity_id"], r["mention_type"]) for r in kb.store.read("mentions").collect()}
    assert {k for _, k in kinds} >= {"discussed"}
    hit = kb.search("rotation", limit=1, fast=True).first()
    assert "rotation" in hit["snippet"]
    told = kb.diagnose("rotation zzzz")
    assert told["term_hits"] == [{"term": "rotation", "doc_count": 1}, {"term": "zzzz", "doc_count": 0}] and told["near_misses"] and "leave out zzzz" in told["suggestions"]
    assert "notes/mfa.md" in kb.add_wikilinks() and "[[" not in kb.read_memory_file("notes/mfa.md")


def test_people_of_tables_and_meetings(spark, tmp_path):
    files = {
        "TEAM.md": "x\n| Who | Role |\n|---|---|\n| **Kit** | Kit Larsen, design |\n| **Tal** | Talia Ström |\n| **No** | someone |\n\n| **Out** | Out Side |\n",
        "memory/people/kit-larsen.md": "---\naliases: [KL]\nteam: \"[[Core Team]]\"\nemail: kit@x.org\nsources:\n- {type: chat, channel: C777}\ntask_keywords: [logo]\n---\n# Kit Larsen\n",
        "memory/projects/atlas.md": "# Atlas Move\n**Codename/Also called:** Bluebird\n**Pinned:** yes\n**Status:** active\n",
        "memory/context/company.md": "# C\n## Teams (from Linear)\n- **Core Team** (CT) — the [[core]] of it\nother\n## Next\n- **Not** — one\n",
        "meetings/a.notes.md": "---\ntitle: Kit x Ann\ndate: 2026-01-02\ntags: [bluebird]\nattendees:\n- {name: K. Larsen, email: KIT@x.org}\n- {name: New Person, email: new@x.org}\n---\nabout C777\n",
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    kb = KnowledgeBase(spark, str(tmp_path), as_of=AS_OF)
    kb.index()
    rows = {r["name"]: r for r in kb.store.read("entities").collect()}
    assert set(rows) == {"Kit Larsen", "Talia Ström", "Atlas Move", "Core Team", "New Person"}
    assert rows["Kit Larsen"]["aliases"] == ["KL", "src:C777", "Kit", "kit-larsen"] and rows["Kit Larsen"]["metadata"]["team"] == "Core Team"
    assert rows["Talia Ström"]["aliases"] == ["Tal", "Talia"] and rows["Core Team"]["aliases"] == ["CT"] and rows["Core Team"]["metadata"] == {"description": "the core of it"}
    assert rows["Atlas Move"]["aliases"] == ["Bluebird", "atlas"] and rows["Atlas Move"]["pinned"] and rows["Atlas Move"]["metadata"] == {"status": "active"}
    names = {r["id"]: n for n, r in rows.items()}
    doc = kb.store.read("documents").filter("path like 'meetings/%'").first()["id"]
    got = {(names[r["entity_id"]], r["mention_type"]) for r in kb.store.read("mentions").filter(f"document_id = {doc}").collect()}
    assert got == {("Kit Larsen", "attendee"), ("Kit Larsen", "participant"), ("Kit Larsen", "source_ref"), ("New Person", "attendee"), ("Atlas Move", "tagged")}
    assert {(r["name"], r["matched_by"]) for r in kb.store.read("attendees").collect()} == {("K. Larsen", "email"), ("New Person", "created")}


def test_two_passes_and_the_options_of_search(kb):
    flat = kb.search("Linnea Holm rotation", hierarchy=False, explain=True, highlight=True, include_overview=True)
    row = flat.filter("path = 'notes/mfa.md'").first()
    assert "<mark>rotation</mark>" in row["snippet"] and "overview" in row.asDict() and {"linnea", "holm", "rotation"} <= set(row["matched_terms"]) and row["fts_score"] is not None and row["fused"] > 0
    assert kb.last_search["entities"] == [] and {"fts", "vectors", "ranking"} <= set(kb.last_search["phases"]) and kb.last_search["variants"]
    seen = []
    near = kb.search("Linnea Holm Engineer", hierarchy_threshold=0.1, hook=lambda phase, seconds: seen.append(phase)).collect()
    key = kb.get_entity("Linnea Holm")["id"]
    linked = kb.store.read("mentions").filter(f"entity_id = {key}").join(kb.store.read("documents").withColumnRenamed("id", "document_id"), "document_id")
    linked = {r["path"] for r in linked.collect()}
    named = {e["name"] for e in kb.last_search["entities"]}
    assert "Linnea Holm" in named and "entities" in seen and near and all(r["parent"] >= 0.1 for r in near)
    if named == {"Linnea Holm"}:
        assert {r["path"] for r in near} <= linked
    assert [r["path"] for r in kb.search("rotation", hierarchy_threshold=0.999).collect()][0] == "notes/mfa.md"  # none is near enough: as if flat
    whole = {r["path"]: r["content"] for r in kb.search("the", fast=True, full_chunks=True, merge_chunks=True).collect()}
    assert "token rotation" in whole["notes/mfa.md"] and "\n\n" in whole["notes/mfa.md"]
    assert len(kb.search("rotation", fast=True, snippet_chars=20).first()["snippet"]) < 40
    assert kb.why_not("rotation", "notes/mfa.md", fast=True)["reason"] == "ranked" and kb.why_not("zzzz", "notes/mfa.md", fast=True)["reason"] == "no_match"
    assert kb.why_not("rotation", "notes/mfa.md", path="projects/*", fast=True)["reason"] == "filtered_path" and kb.why_not("x", "no/such.md") is None
    assert [r["path"] for r in kb.search("rotat*", fast=True).collect()] == ["notes/mfa.md"]
