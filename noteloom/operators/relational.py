"""Lookups over documents, entities, mentions and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import scoring, text

LAST = "desc_nulls_last"


def list_documents(docs: DataFrame, doc_type: str | None = None, first=None, last=None, tags: list[str] = (), ignore_case: bool = False, path: str | None = None,
                   limit: int | None = None) -> DataFrame:
    """Documents by type, date range (undated rows fail a bound), tags (all of them) and path pattern, newest first."""
    if doc_type is not None:
        docs = docs.filter(F.col("doc_type") == doc_type)
    if first is not None:
        docs = docs.filter(F.col("doc_date") >= F.lit(first).cast("date"))
    if last is not None:
        docs = docs.filter(F.col("doc_date") <= F.lit(last).cast("date"))
    if tags:
        docs = docs.filter(has_tags(F.col("tags"), list(tags), ignore_case))
    if path is not None:
        docs = docs.filter(F.col("path").ilike(text.glob_pattern(path)))
    docs = docs.orderBy(F.col("doc_date").desc_nulls_last(), F.desc("id"))
    return docs if limit is None else docs.limit(limit)


def has_tags(tags: Column, wanted: list[str], ignore_case: bool = False) -> Column:
    """All wanted tags are there."""
    if ignore_case:
        tags, wanted = F.transform(tags, lambda t: F.lower(t)), [w.lower() for w in wanted]
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), F.coalesce(tags, F.array().cast("array<string>")))) == 0


def mention_counts(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, name, entity_type, mention_count), 0 for entities without mentions; mentions count by row."""
    counts = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return entities.join(counts, "id", "left").select("id", "name", "entity_type", F.coalesce("n", F.lit(0)).cast("long").alias("mention_count"))


def fact_counts(facts: DataFrame, ids: list[int] | None = None) -> DataFrame:
    if ids is not None:
        facts = facts.filter(F.col("entity_id").isin(ids))
    return facts.groupBy("entity_id").agg(F.count(F.lit(1)).alias("fact_count"))


def timeline(mentions: DataFrame, docs: DataFrame, entity_id: int, limit: int | None = 10, first=None, last=None, doc_type: str | None = None) -> DataFrame:
    """Documents that mention an entity, newest first, with the kinds of mention."""
    own = mentions.filter(F.col("entity_id") == entity_id).groupBy("document_id").agg(F.array_join(F.sort_array(F.collect_set("mention_type")), ",").alias("mention_types"))
    found = list_documents(docs.join(own, docs["id"] == own["document_id"]), doc_type, first, last)
    found = found.select("id", "title", "doc_date", "doc_type", "mention_types")
    return found if limit is None else found.limit(limit)


def timeline_deduped(mentions: DataFrame, docs: DataFrame, entity_id: int, limit: int, preferred: str = "notes") -> DataFrame:
    """The oldest mentions; after the limit, of documents with one date and title one stays, the preferred type's last
    if there is any, at the place of the first."""
    ids = mentions.filter(F.col("entity_id") == entity_id).select(F.col("document_id").alias("id")).distinct()
    found = docs.join(ids, "id").orderBy(F.col("doc_date").asc_nulls_first(), "id").limit(limit).select("id", "title", "doc_date", "doc_type")
    by = ["doc_date", "title"]
    place = F.min("id").over(Window.partitionBy(*by))
    is_preferred = (F.col("doc_type") == preferred).cast("int")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("pref"), F.when(F.col("pref") == 1, -F.col("id")).otherwise(F.col("id"))))
    ranked = found.withColumn("pref", is_preferred).withColumns({"rank": rank, "place": place})
    return ranked.filter("rank = 1").orderBy(F.col("doc_date").asc_nulls_first(), "place").select("id", "title", "doc_date", "doc_type", "place")


def stale(entities: DataFrame, cutoff, as_of, entity_type: str | None = None) -> DataFrame:
    """Entities with no update and no mention since the cutoff, longest first."""
    if entity_type is not None:
        entities = entities.filter(F.col("entity_type") == entity_type)
    cut = F.lit(cutoff).cast("date")
    old = lambda c: F.col(c).isNull() | (F.col(c) < cut)
    last = F.coalesce(F.col("last_mentioned_at"), F.col("updated_at"))
    found = entities.filter(old("updated_at") & old("last_mentioned_at"))
    return found.select("id", "name", last.alias("last_seen"), F.datediff(F.lit(as_of).cast("date"), last).alias("age_days")).orderBy(F.col("last_seen").asc_nulls_first(), "id")


def with_seq(facts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Numbers facts within their entity by (fact_date, id), after the numbers that are taken."""
    w = Window.partitionBy("entity_id").orderBy(F.col("fact_date").asc_nulls_first(), "id")
    numbered = facts.withColumn("seq", F.row_number().over(w))
    if existing is None:
        return numbered
    top = existing.groupBy("entity_id").agg(F.max("seq").alias("top"))
    return numbered.join(top, "entity_id", "left").withColumn("seq", F.col("seq") + F.coalesce("top", F.lit(0))).drop("top")


def top_facts(facts: DataFrame, k: int = 5) -> DataFrame:
    """The newest k facts of each entity."""
    w = Window.partitionBy("entity_id").orderBy(F.col("fact_date").desc_nulls_last(), F.desc("id"))
    return facts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def facts_with_entities(facts: DataFrame, entities: DataFrame, since=None, entity_id: int | None = None) -> DataFrame:
    """Facts with the name of their entity, null if it is gone, newest first."""
    if since is not None:
        facts = facts.filter(F.col("fact_date") >= F.lit(since).cast("date"))
    if entity_id is not None:
        facts = facts.filter(F.col("entity_id") == entity_id)
    names = entities.select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"))
    return facts.join(names, "entity_id", "left").orderBy(F.col("fact_date").desc_nulls_last(), F.desc("id"))


def resolve(entities: DataFrame, name: str, folded: bool = False) -> DataFrame:
    """All entities of the first tier that has any: exact name, exact alias, folded name, folded alias, part of either.

    With `folded`, accents are folded by a Python function over the names; else only case is."""
    low = F.lower if not folded else text.fold_column
    want = name.lower() if not folded else text.fold(name)
    aliases = F.coalesce(F.col("aliases"), F.array().cast("array<string>"))
    joined = F.array_join(aliases, "\x1f")
    rows = entities.withColumns({"_n": low(F.col("name")), "_a": F.split(low(joined), "\x1f")})
    part = F.col("_n").contains(want) | F.exists("_a", lambda a: a.contains(want))
    tier = F.when(F.col("name") == name, 1).when(F.array_contains(aliases, name), 2).when(F.col("_n") == want, 3).when(F.array_contains(F.col("_a"), want), 4).when(part, 5)
    ranked = rows.withColumn("tier", tier).filter("tier is not null")
    best = ranked.agg(F.min("tier").alias("best"))
    return ranked.crossJoin(F.broadcast(best)).filter("tier = best").drop("best", "_n", "_a")  # one row


def last_mentioned(mentions: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity_id, last_mentioned_at)."""
    dated = docs.select(F.col("id").alias("document_id"), "doc_date")
    return mentions.join(dated, "document_id").groupBy("entity_id").agg(F.max("doc_date").alias("last_mentioned_at"))


def key_people(people: DataFrame, facts: DataFrame, fields: list[str], least: int = 2) -> DataFrame:
    """Entities with enough of the fields, or any fact."""
    n = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    having = facts.select(F.col("entity_id").alias("id")).distinct().withColumn("has_fact", F.lit(True))
    return people.withColumn("n_fields", n).join(having, "id", "left").filter((F.col("n_fields") >= least) | F.coalesce("has_fact", F.lit(False)))


def context_ranking(counts: DataFrame, last: DataFrame, as_of, least: int = 1) -> DataFrame:
    """Entities by mentions times recency, with a freshness badge: those with enough mentions, and pinned ones."""
    day = F.lit(as_of).cast("date")
    enough = F.col("mention_count") >= least
    if "pinned" in counts.columns:
        enough = enough | F.coalesce("pinned", F.lit(False))
    rows = counts.join(last.withColumnRenamed("entity_id", "id"), "id", "left").filter(enough)
    rank = F.round(F.col("mention_count") * scoring.recency_weight(F.col("last_mentioned_at"), day), 4)
    return rows.withColumns({"rank": rank, "badge": scoring.freshness(F.col("last_mentioned_at"), day)}).orderBy(F.desc("rank"), "id")


def index_stats(docs: DataFrame, chunks: DataFrame, entities: DataFrame, mentions: DataFrame, facts: DataFrame) -> DataFrame:
    """One row of totals."""
    count = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    row = docs.agg(F.count(F.lit(1)).alias("n_documents"), F.min("doc_date").alias("first_date"), F.max("doc_date").alias("last_date"))
    for df, c in ((chunks, "n_chunks"), (entities, "n_entities"), (mentions, "n_mentions"), (facts, "n_facts")):
        row = row.crossJoin(count(df, c))  # one row each
    return row


def directory_tree(docs: DataFrame) -> DataFrame:
    """(dir, parent, depth, n_files, n_below): every directory with the files in it and below it."""
    parts = F.split("path", "/")
    depth = F.size("parts") - 1
    below = docs.select(parts.alias("parts")).filter(F.size("parts") > 1).select("parts", F.explode(F.sequence(F.lit(1), depth)).alias("d"))
    at = below.select(F.array_join(F.slice("parts", F.lit(1), F.col("d")), "/").alias("dir"), F.col("d").alias("depth"), (F.col("d") == depth).alias("own"))
    grouped = at.groupBy("dir", "depth").agg(F.count_if("own").alias("n_files"), F.count(F.lit(1)).alias("n_below"))
    parent = F.when(F.col("depth") > 1, F.regexp_replace("dir", "/[^/]*$", ""))
    return grouped.select("dir", parent.alias("parent"), "depth", "n_files", "n_below")


def reassembled(chunks: DataFrame) -> DataFrame:
    """(document_id, body): chunks in order, headings put back, summary chunks left out."""
    piece = F.when(F.col("heading").isNull() | (F.col("heading") == ""), F.col("content")).otherwise(F.concat(F.lit("## "), F.col("heading"), F.lit("\n"), F.col("content")))
    own = chunks.filter(F.coalesce("heading", F.lit("")) != "__document__")
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", piece.alias("piece"))))
    return own.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "\n\n").alias("body"))


def find_document(docs: DataFrame, target: str, strict: bool = False) -> DataFrame:
    """By hash prefix (#abc), path, path suffix, title, glob, then file name; the first tier that has any."""
    if target.startswith("#"):
        return docs.filter(F.col("content_hash").startswith(target[1:])).orderBy("id").limit(1)
    name = F.element_at(F.split("path", "/"), -1)
    tier = (F.when(F.col("path") == target, 1).when(F.col("path").endswith(target), 2).when(F.lower("title") == target.lower(), 3)
            .when(F.col("path").ilike(text.glob_pattern(target)), 4).when(name.contains(target), 5))
    ranked = docs.withColumn("tier", tier).filter("tier is not null")
    best = ranked.crossJoin(F.broadcast(ranked.agg(F.min("tier").alias("best")))).filter("tier = best").drop("best")  # one row
    return best.orderBy("id") if strict else best.orderBy("id").limit(1)


def profile_texts(entities: DataFrame, facts: DataFrame, newest: int = 5) -> DataFrame:
    """(id, name, entity_type, profile): an entity in a line, with its newest facts."""
    w = Window.partitionBy("entity_id").orderBy(F.col("fact_date").desc_nulls_last(), F.desc("id"), "fact_text")
    top = facts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= newest)
    texts = top.groupBy(F.col("entity_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "fact_text"))), lambda x: x["fact_text"]), "; ").alias("texts"))
    told = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    line = F.concat_ws(" | ", "name", "entity_type", F.nullif(F.array_join("aliases", ", "), F.lit("")), F.nullif(F.array_join(told, ", "), F.lit("")), "texts")
    return entities.join(texts, "id", "left").select("id", "name", "entity_type", line.alias("profile"))
