"""Compressed context: small aggregates collected, then a text put together on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.operators import fts, relational

BADGES = {"fresh": "●", "aging": "◐", "stale": "○"}
LINE = 80
#: States of projects that are over; letters of a name that is looked for in a topic.
DONE = ("done", "completed", "closed", "cancelled", "archived")
LEAST_NAME = 3


def packed(items: list[str], width: int = LINE, sep: str = ", ") -> list[str]:
    """Items packed in lines up to a width."""
    lines: list[str] = []
    for item in items:
        if lines and len(lines[-1]) + len(sep) + len(item) <= width:
            lines[-1] += sep + item
        else:
            lines.append(item)
    return lines


def topic_entities(entities: DataFrame, mentions: DataFrame, index: DataFrame, owners: DataFrame, topic: str) -> DataFrame:
    """(entity_id) of the entities that a topic is about: those with a name or an alias (of three letters or more) that holds the
    topic or is held by it, and those that are mentioned in a document with a chunk that has all its words.

    index: postings; owners: (chunk_id, document_id)."""
    low = topic.lower()
    names = entities.select(F.col("id").alias("entity_id"), F.explode(F.array_distinct(F.transform(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))), F.lower))).alias("n"))
    by_name = names.filter((F.length("n") >= LEAST_NAME) & (F.lit(low).contains(F.col("n")) | F.col("n").contains(low))).select("entity_id")
    words = [leaf for _, leaves in fts.variants(topic)[-1:] for leaf in leaves]
    if not words:
        return by_name.distinct()
    hits = fts.looked_up(index, words).groupBy("chunk_id").agg(F.countDistinct("term").alias("n")).filter(F.col("n") == len(words))
    documents = hits.join(owners.select("chunk_id", "document_id"), "chunk_id").select("document_id").distinct()
    return by_name.unionByName(mentions.join(documents, "document_id", "left_semi").select("entity_id")).distinct()


def build(entities: DataFrame, mentions: DataFrame, docs: DataFrame, glossary: DataFrame, as_of, about: DataFrame | None = None, least: int = 1, headings: DataFrame | None = None) -> dict:
    """The blocks of a context: totals, ranked entities by type, glossary, pinned documents with their headings.

    about: (entity_id), those of a topic. Projects that are done, and teams that nobody mentions, stay out unless they are
    pinned; so do industry terms of the glossary, which anybody knows. Nothing is cut: what is printed grows with the
    entities that are ranked, so `least` mentions should grow with the corpus."""
    counts = relational.mention_counts(entities, mentions).join(entities.select("id", "pinned", "metadata"), "id")
    if about is not None:
        counts = counts.join(about.withColumnRenamed("entity_id", "id"), "id", "left_semi")
    status = F.lower(F.coalesce(F.try_element_at("metadata", F.lit("status")), F.lit("")))
    pinned = F.coalesce("pinned", F.lit(False))
    active = (F.col("entity_type") != "project") | ~status.isin(*DONE)
    spoken_of = (F.col("entity_type") != "team") | (F.col("mention_count") > 0)
    counts = counts.filter(pinned | active & spoken_of)
    ranked = relational.context_ranking(counts, relational.last_mentioned(mentions, docs), as_of, least)
    rows = [r.asDict() for r in ranked.collect()]
    listed = docs.filter("pinned").select("id", "path", "title")
    if headings is not None:
        listed = listed.join(headings, "id", "left")
    terms = glossary.filter(~F.lower(F.coalesce("section", F.lit(""))).contains("industry")).select("term", "expansion").orderBy("term").collect()
    totals = docs.agg(F.count(F.lit(1)).alias("n"), F.min("doc_date").alias("first"), F.max("doc_date").alias("last")).first()
    return {
        "n_documents": totals["n"], "first_date": totals["first"], "last_date": totals["last"], "entities": rows, "glossary": [(r["term"], r["expansion"]) for r in terms],
        "pinned": [r.asDict() for r in listed.orderBy("path").collect()],
    }


def _people(rows: list[dict]) -> tuple[list[dict], list[dict]]:
    """Key people (pinned, or with a role or a team), and the others."""
    key = lambda r: bool(r.get("pinned") or (r.get("metadata") or {}).get("role") or (r.get("metadata") or {}).get("team"))
    return [r for r in rows if key(r)], [r for r in rows if not key(r)]


def _told(row: dict, human: bool) -> str:
    about = [v for k in ("role", "team", "status") if (v := (row.get("metadata") or {}).get(k))]
    name = f"{BADGES[row['badge']]}{row['name']}"
    if human:
        return f"- {name}" + (f" — {', '.join(about)}" if about else "") + f" ({row['mention_count']} mentions)"
    return name + (f":{'/'.join(about)}" if about else "") + f" ({row['mention_count']})"


def rendered(blocks: dict, human: bool = False, topic: str | None = None) -> str:
    """A text for readers (human) or for a model: items packed in lines, those of one kind under a head."""
    out = ["# Context"] if human else []
    span = f", {blocks['first_date']} to {blocks['last_date']}" if blocks.get("first_date") else ""
    out += [f"{blocks['n_documents']} documents{span}" + (f", about {topic!r}" if topic else "")]
    if topic and not blocks["entities"]:
        out += [f"no entities for {topic!r}"]
    for kind in sorted({r["entity_type"] for r in blocks["entities"]}):
        own = [r for r in blocks["entities"] if r["entity_type"] == kind]
        for head, rows in zip(("key people", "other people"), _people(own)) if kind == "person" else [(kind, own)]:
            if rows:
                lines = [_told(r, human) for r in rows]
                out += [f"## {head}", *(lines if human else packed(lines))]
    if blocks["glossary"]:
        own = [f"{t}={e}" for t, e in blocks["glossary"]]
        out += ["## glossary", *(own if human else packed(own))]
    if blocks["pinned"]:
        out += ["## pinned", *[f"{p['title']} <{p['path']}>" + (f": {' > '.join(p['headings'])}" if p.get("headings") else "") for p in blocks["pinned"]]]
    return "\n".join(out)
