"""Command line: each command is one call of the façade, printed as a table, JSON lines or CSV."""

from __future__ import annotations

import argparse
import csv
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql.types import VariantVal

from noteloom.api import KnowledgeBase
from noteloom.operators import metadata
from noteloom.session import session


def rows_of(result) -> list[dict]:
    if isinstance(result, DataFrame):
        return [r.asDict(recursive=True) for r in result.collect()]
    if isinstance(result, list):
        return [r if isinstance(r, dict) else {"value": r} for r in result]
    return [result if isinstance(result, dict) else {"value": result}]


def render(result, form: str = "table", fields: list[str] | None = None, out=None, path: str | None = None) -> None:
    """Prints rows; `fields` are kept in their order, and of each row what stands at a path."""
    out = out or sys.stdout
    rows = [{k: json.loads(v.toJson()) if isinstance(v, VariantVal) else v for k, v in r.items()} for r in rows_of(result)]
    if path:
        rows = [{"value": metadata.picked(r, path)} for r in rows]
    if fields:
        rows = [{f: r.get(f) for f in fields} for r in rows]
    if form in ("json", "jsonl"):
        text = [json.dumps(r, default=str, ensure_ascii=False) for r in rows]
        print("[" + ",\n".join(text) + "]" if form == "json" else "\n".join(text), file=out)
    elif form == "csv":
        writer = csv.DictWriter(out, list(rows[0]) if rows else fields or [])
        writer.writeheader()
        writer.writerows(rows)
    else:
        for r in rows:
            print("  ".join(f"{k}={v}" for k, v in r.items()), file=out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="noteloom")
    p.add_argument("--root", help="folder of the notes; else that of the settings, or this one")
    p.add_argument("--format", default="table", choices=["table", "json", "jsonl", "csv"])
    p.add_argument("--fields", type=lambda s: s.split(","))
    p.add_argument("--at", help="print only what stands there in each row, as sources[*].id")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, *args, **flags):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for flag, value in flags.items():
            flag = "--" + flag.replace("_", "-")
            if value is False:
                c.add_argument(flag, action="store_true")
            else:
                c.add_argument(flag, type=type(value) if value not in (None, "") else str, default=value)

    command("search", "query", limit=10, fast=False, doc_type=None, from_date=None, to_date=None, tag=None, sort_by="score", path=None, hotness=False)
    command("view", "target")
    command("list", doc_type=None, from_date=None, to_date=None, limit=50, since_hours=None)
    for kind in ("person", "project"):
        command(f"{kind}-find", "name")
        command(f"{kind}-list", limit=None, offset=0)
        command(f"{kind}-pin", "name")
        command(f"{kind}-timeline", "name", limit=10, from_date=None, to_date=None)
    command("entity-where", "conditions", entity_type=None)
    command("entity-paths", entity_type=None)
    command("entity-set", "name", "key", "value")
    command("entity-stale", days=90, entity_type=None)
    command("entity-unlink", "entity", "document")
    command("entity-relink", "entity", "document")
    command("fact-add", "entity", "text", date=None)
    command("fact-edit", "entity", "seq", text=None, date=None)
    command("fact-delete", "entity", "seq")
    command("fact-list", since=None, entity=None)
    command("note-add", "title", body="", tags="", pin=False, entity=None)
    command("note-edit", "path", body=None, append=None, tags=None, pin=False, unpin=False)
    command("note-list", tag=None, pinned=False, limit=50)
    command("note-delete", "path")
    command("similar", "text", threshold=0.85, limit=5, document=None, entity=None)
    command("pin", "path")
    command("glossary-list")
    command("glossary-edit", "term", "expansion")
    command("glossary-delete", "term")
    command("correct", "term", replacement=None, apply=False, scope=None, word_boundary=False, file_type=None)
    command("context", topic=None, human=False)
    command("tree")
    command("index-run", full=False)
    command("index-status")
    command("index-compact")
    command("access-reset")
    return p


def _read(value: str):
    """A value as JSON, else as a text."""
    try:
        return json.loads(value)
    except ValueError:
        return value


def run(kb: KnowledgeBase, a: argparse.Namespace):
    kind, _, action = a.command.partition("-")
    if kind in ("person", "project"):
        return {"find": lambda: kb.get_entity_profile(a.name), "list": lambda: kb.list_entities(kind, int(a.limit) if a.limit else None, a.offset), "pin": lambda: kb.toggle_entity_pin(a.name),
                "timeline": lambda: kb.get_entity_timeline(a.name, a.limit, a.from_date, a.to_date)}[action]()
    return {
        "search": lambda: kb.search(a.query, a.limit, a.fast, doc_type=a.doc_type, from_date=a.from_date, to_date=a.to_date, tag=a.tag, sort_by=a.sort_by, path=a.path, hotness=a.hotness),
        "view": lambda: kb.view_document(a.target),
        "list": lambda: kb.list_documents(a.doc_type, a.from_date, a.to_date, a.limit, float(a.since_hours) if a.since_hours else None),
        "entity-stale": lambda: kb.get_stale_entities(a.days, a.entity_type),
        "entity-where": lambda: kb.entities_where(dict(metadata.parsed_condition(c) for c in a.conditions.split(" and ")), a.entity_type),
        "entity-paths": lambda: kb.metadata_paths(a.entity_type),
        "entity-set": lambda: kb.set_metadata(a.name, a.key, _read(a.value)),
        "entity-unlink": lambda: kb.unlink_entity(a.entity, a.document),
        "entity-relink": lambda: kb.relink_entity(a.entity, a.document),
        "fact-add": lambda: kb.add_fact(a.entity, a.text, a.date),
        "fact-edit": lambda: kb.edit_fact(a.entity, int(a.seq), a.text, a.date),
        "fact-delete": lambda: kb.delete_fact(a.entity, int(a.seq)),
        "fact-list": lambda: kb.list_facts(a.since, a.entity),
        "note-add": lambda: kb.add_note(a.title, a.body, [t for t in a.tags.split(",") if t], a.pin, entity=a.entity),
        "note-edit": lambda: kb.edit_note(a.path, a.body, a.append, tags=None if a.tags is None else [t for t in a.tags.split(",") if t], pin=True if a.pin else False if a.unpin else None),
        "note-list": lambda: kb.list_notes(a.tag, a.pinned, a.limit),
        "note-delete": lambda: kb.delete_note(a.path),
        "similar": lambda: kb.memory_similar(a.text, a.threshold, a.limit, a.document, a.entity),
        "pin": lambda: kb.toggle_document_pin(a.path),
        "glossary-list": kb.list_glossary_terms,
        "glossary-edit": lambda: kb.edit_glossary_term(a.term, a.expansion),
        "glossary-delete": lambda: kb.delete_glossary_term(a.term),
        "correct": lambda: kb.correct_term(a.term, a.replacement, a.apply, a.scope, a.word_boundary, file_type=a.file_type),
        "context": lambda: kb.context(a.topic, a.human),
        "tree": kb.list_memory_tree,
        "index-run": lambda: kb.index(a.full),
        "index-status": kb.get_index_stats,
        "index-compact": lambda: [kb.store.compact(t) for t in ("documents", "chunks", "mentions")],
        "access-reset": kb.reset_access,
    }[a.command]()


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    kb = KnowledgeBase(session(), a.root) if a.root else KnowledgeBase.from_config(session())
    render(run(kb, a), a.format, a.fields, path=a.at)


if __name__ == "__main__":
    main()
