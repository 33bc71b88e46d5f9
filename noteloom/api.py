"""The library façade: a knowledge base of markdown files (the truth) and derived tables (the index)."""

from __future__ import annotations

import datetime as dt
import json
import os
import re
import shlex
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom import config
from noteloom.functions import dates, snippets, text
from noteloom.operators import chunking, fts, incremental, linking, mentions, metadata as open_metadata, ranking, relational, vectors, wikilinks
from noteloom.plans import context as ctx
from noteloom.plans.store import Store
from noteloom.session import ready
from noteloom.sources import feeds, markdown
from noteloom.streaming import ingest


# Fields of profiles in the order of files, and those that refer to other entities.
PROFILE_FIELDS = {"person": ("email", "role", "team", "reports_to", "company", "pcm_base", "pcm_phase"), "project": ("status", "started", "lead")}
#: Characters of a hit's content, where whole ones are not asked for.
CONTENT_CHARS = 2_000
REFERENCES = ("team", "reports_to", "lead", "company")


class KnowledgeBase:
    def __init__(self, spark: SparkSession, project_root: str, data_dir: str | None = None, as_of: dt.date | None = None, embed=None, dim: int = 64, me: str | None = None):
        self.spark = ready(spark)
        self.root = Path(project_root)
        self.store = Store(spark, data_dir or str(self.root / ".index"))
        self.as_of = as_of or dt.date.today()
        #: The time of what is done now; a given day stands still at its beginning.
        self._now = F.lit(dt.datetime.combine(as_of, dt.time())) if as_of else F.current_timestamp()
        self.embed = embed or (lambda c: vectors.hash_embedding(text.tokens(c), dim))
        self.last_search: dict = {}
        self.me = me

    @classmethod
    def from_config(cls, spark: SparkSession, start: str | None = None, **options) -> KnowledgeBase:
        """A knowledge base as the settings say that are found from a folder on upwards; without any, of that folder."""
        found = config.find(start)
        return cls(spark, **(config.settings(found) if found else {"project_root": start or os.getcwd()}) | options)

    # ------------------------------------------------------------ index

    def _tree(self, paths: list[str] | None = None) -> DataFrame:
        """(path, text) of all files, or of some; those of meetings/ have that in front."""
        memory, meetings = str(self.root / "memory"), self.root / "meetings"
        own = others = None
        if paths is not None:
            own = [p for p in paths if not p.startswith("meetings/") and (self.root / "memory" / p).is_file()]
            others = [p.removeprefix("meetings/") for p in paths if p.startswith("meetings/") and (self.root / p).is_file()]
        tree = markdown.files(self.spark, memory, only=own).filter(~F.col("path").startswith("meetings/"))
        if meetings.is_dir():
            tree = tree.unionByName(markdown.files(self.spark, str(meetings), only=others).withColumn("path", F.concat(F.lit("meetings/"), "path")))
        return tree

    def index(self, full: bool = False, paths: list[str] | None = None) -> dict:
        """Brings the index up to date: with the files that changed or vanished, with some files, or (full) anew.

        Only changed documents are parsed, cut into chunks, tokenised and embedded; their rows come as a batch beside those
        of the others. Mentions are sought in changed documents, and in all where a name changed. What is found equals
        what a full build finds."""
        known = self.store.read("documents")
        if paths is not None:
            known = known.filter(F.col("path").isin(list(paths)))
        tree = self._tree(paths).withColumn("content_hash", F.sha2("text", 256))
        fresh = tree if full else tree.join(known.select("path", "content_hash"), ["path", "content_hash"], "left_anti")
        dead = known if full else known.join(tree, ["path", "content_hash"], "left_anti")
        # The files are read twice: for what is gone, and for the texts; all else comes from these two tables.
        self.store.written.clear()
        self.store.write("removed", dead)
        dead = self.store.read("removed")
        gone, n_gone = dead.select("id"), self.store.written["removed"]
        new = self._put("texts", self._parsed(fresh.drop("content_hash"), dead), gone, full)
        n_texts = self.store.written["texts"]
        if not full and not n_gone and not n_texts:
            return {"new": 0, "changed": 0, "indexed": 0}
        n_changed = new.join(dead, "path", "left_semi").count() if n_gone and n_texts else 0
        parts = chunking.chunked(new)
        summary = chunking.summaries(new).withColumn("chunk_index", F.lit(1_000_000))
        chunks = parts.unionByName(summary).withColumn("chunk_id", F.xxhash64("document_id", "chunk_index").bitwiseAND(F.lit((1 << 62) - 1)))
        chunks = self._put("chunks", chunks, gone, full)
        self._put_search_index(chunks, gone, full)
        touched = new.select("path", "doc_type", (F.size(F.coalesce("attendees", F.array())) > 0).alias("met")).unionByName(dead.select("path", "doc_type", F.lit(False).alias("met")))
        kind = touched.agg(
            F.max(F.col("doc_type").isin("memory_person", "memory_project") | F.col("path").startswith("context/") | F.col("met") | F.col("path").startswith("meetings/")).alias("entities"),
            F.max(F.col("path") == "glossary.md").alias("glossary")).first()
        renamed = full
        if full or kind["entities"] or any(self.root.glob("*.md")):
            renamed = self._write_entities() or full
            self._write_facts(touched.select("path"), full)
        self._put_mentions(new, gone, renamed)
        last = relational.last_mentioned(self.store.read("mentions"), self.store.read("texts")).withColumnRenamed("entity_id", "id")
        self.store.write("entities", self.store.read("entities").drop("last_mentioned_at").join(last, "id", "left"))
        self._write_profiles()
        if full or kind["glossary"]:
            self.store.write("glossary", markdown.glossary_terms(self._tree(["glossary.md"])))
        counts = chunks.filter(F.col("chunk_index") < 1_000_000).groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("chunk_count"))
        listed = new.join(counts, "id", "left").withColumns({
            "abstract": text.first_sentence(F.col("text"), F.col("title")), "overview": text.first_paragraph(F.col("text")),
            "indexed_at": self._now})
        self._put("documents", listed, gone, full)  # last, so that a build that broke off is done again
        return {"new": n_texts - n_changed, "changed": n_changed, "indexed": n_texts}

    def reindex_file(self, path: str) -> dict:
        """Brings one file's document up to date, or removes it with its file."""
        return self.index(paths=[path])

    def sync(self, options: dict[str, str], checkpoint: str | None = None) -> dict:
        """Writes the new and changed notes of feeds (see sources.feeds) as files and indexes those; says how many. A run goes
        on where the last one ended; notes that did not change are not written again."""
        done = {"new": 0, "changed": 0}

        def write(batch: DataFrame, number: int) -> None:
            batch = batch.persist()
            notes = feeds.documents(feeds.parsed(batch.select("feed", "id", "raw")))
            paths = []
            for row in notes.select("path", "text").toLocalIterator():  # files are on the driver's side
                self._put_file(self.root / row["path"], row["text"])
                paths.append(row["path"])
            for r in batch.groupBy("status").count().collect():
                done[r["status"]] += r["count"]
            batch.unpersist()
            if paths:
                self.index(paths=paths)

        stream = ingest.changed_notes(self.spark, options)
        ingest.index_stream(stream, write, checkpoint or f"{self.store.root}/sync").awaitTermination()
        return done

    def reindex_stale(self) -> list[str]:
        """Indexes the known files whose content changed; new files wait for index()."""
        stale = self.stale_files()
        if stale:
            self.index(paths=stale)
        return stale

    def _put(self, name: str, df: DataFrame, gone: DataFrame, full: bool) -> DataFrame:
        """Stores a batch's rows, in place of the documents that are gone or of all; returns them."""
        return self.store.read(name, self.store.write(name, df) if full else self.store.replace(name, df, gone))

    def _parsed(self, tree: DataFrame, before: DataFrame) -> DataFrame:
        """Documents of files, pinned as their file says or as they were."""
        docs = markdown.memory_documents(tree)
        if (self.root / "meetings").is_dir():
            docs = docs.unionByName(markdown.meeting_documents(tree.filter(F.col("path").startswith("meetings/"))), allowMissingColumns=True)
        docs = docs.join(before.select("path", F.col("pinned").alias("_pin")), "path", "left")
        return docs.withColumns({
            "id": F.xxhash64("path").bitwiseAND(F.lit((1 << 62) - 1)), "pinned": F.coalesce("pinned", F.lit(False)) | F.coalesce("_pin", F.lit(False)),
        }).drop("_pin")

    def _put_search_index(self, chunks: DataFrame, gone: DataFrame, full: bool) -> None:
        """Postings of words and of stems, lengths, bounds of blocks, and vectors of chunks; a search embeds nothing but the
        query. Bounds of what is gone stay; its numbers are taken off."""
        owner = chunks.select("chunk_id", "document_id")
        lost = [fts.impacts(self.store.read(t).join(gone.toDF("document_id"), "document_id", "left_semi")).withColumn("kind", F.lit(t)).withColumn("n", -F.col("n")) for t in ("postings", "stemmed")]
        lost.append(_totals(self.store.read("lengths").join(gone.toDF("document_id"), "document_id", "left_semi"), -1))
        sizes = self._put("lengths", fts.lengths(chunks).join(owner, "chunk_id"), gone, full)
        words = self._put("postings", fts.blocked(fts.postings(chunks, sized=True)).join(owner, "chunk_id"), gone, full)
        stems = self._put("stemmed", fts.blocked(fts.stemmed(words)).join(owner, "chunk_id"), gone, full)
        hashed = chunks.select("chunk_id", "document_id", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))
        before = self.store.read("vectors")
        before = before.limit(0) if full else before.join(gone.toDF("document_id"), "document_id", "left_semi")
        before = before.select("hash", F.col("embedding").alias("had")).dropDuplicates(["hash"])
        known = hashed.join(before, "hash", "left")  # a chunk that its document had before keeps its vector
        kept = known.filter("had is not null").withColumn("embedding", F.col("had"))
        new = known.filter("had is null").withColumn("embedding", self.embed(F.col("content")))
        self._put("vectors", kept.unionByName(new), gone, full)
        come = [fts.impacts(words).withColumn("kind", F.lit("postings")), fts.impacts(stems).withColumn("kind", F.lit("stemmed")), _totals(sizes, 1)]
        change = come[0]
        for part in come[1:] + ([] if full else lost):
            change = change.unionByName(part, allowMissingColumns=True)
        if full:
            self.store.write("impacts", change)
        else:
            self.store.extend("impacts", change)

    def _corpus(self) -> tuple[int, float]:
        """The number of chunks and their average length."""
        row = self.store.read("impacts").filter("kind = 'corpus'").agg(F.sum("n").alias("n"), F.sum("least").alias("total")).first()
        return row["n"] or 0, (row["total"] or 0) / (row["n"] or 1)

    def _put_mentions(self, new: DataFrame, gone: DataFrame, everywhere: bool) -> None:
        """Mentions in the new documents, or in all; those set by hand stay."""
        texts, seeds = self.store.read("texts"), self.store.read("entities")
        docs = texts if everywhere else new
        hidden = self.store.read("suppressions").join(docs.select("path", F.col("id").alias("document_id")), "path")
        hidden = hidden.join(seeds.select(F.lower("name").alias("entity"), F.col("id").alias("entity_id")), "entity").select("document_id", "entity_id")
        there = docs.select(F.col("id").alias("document_id"))
        columns = ["entity_id", "document_id", "mention_type"]
        manual = self.store.read("mentions").filter("mention_type = 'manual'").join(there, "document_id", "left_semi").select(*columns)
        sought = docs.select("id", "title", "tags", "text", F.transform("attendees", lambda p: p["name"]).alias("attendees"))
        found = mentions.find(sought, seeds, hidden).select(*columns)
        came = self.store.read("attendees").filter("entity_id is not null").join(there, "document_id", "left_semi")
        came = came.select("entity_id", "document_id", F.lit("attendee").alias("mention_type")).distinct()
        came = linking.without_suppressed(came, hidden).select(*columns)
        every = found.unionByName(came).unionByName(manual).distinct()
        if everywhere:
            self.store.write("mentions", every)
        else:
            self.store.replace("mentions", every, gone.unionByName(there.toDF("id")))

    def _write_facts(self, touched: DataFrame, full: bool) -> None:
        """Facts of touched files with the numbers that they had, new ones numbered after those; others stay."""
        old, owners = self.store.read("facts"), self.store.read("entities").filter("source_path is not null")
        owners = owners.select(F.col("source_path").alias("path"), F.col("id").alias("entity_id"))
        if not full:
            owners = owners.join(touched.distinct(), "path", "left_semi")
        found = markdown.dated_facts(self.store.read("texts").join(owners.select("path"), "path", "left_semi")).join(owners, "path").withColumn("id", _fact_key())
        had = old.groupBy("id").agg(F.min("seq").alias("seq"), F.min("created_at").alias("created_at"))
        known = found.dropDuplicates(["id"]).join(had, "id", "left")
        new = relational.with_seq(known.filter("seq is null").drop("seq"), old)
        rest = old.join(owners.select("entity_id"), "entity_id", "left_anti")
        columns = ["id", "entity_id", "fact_text", "fact_date", "created_at", "seq"]
        self.store.write("facts", known.filter("seq is not null").select(*columns).unionByName(new.select(*columns)).unionByName(rest.select(*columns)))

    def _write_entities(self) -> bool:
        """Entities of profiles, of the list of teams, of the alias tables in the project's own files, and attendees that are
        none of these; and who attended what. Says whether a name, an alias or a source id changed."""
        texts, old = self.store.read("texts"), self.store.read("entities")
        key = F.xxhash64("name", F.concat(F.lit("memory_"), "entity_type")).bitwiseAND(F.lit((1 << 62) - 1))
        own = markdown.profiles(texts.filter(F.col("doc_type").isin("memory_person", "memory_project")))
        own = own.join(texts.select("path", "doc_type"), "path").withColumn("entity_type", F.regexp_replace("doc_type", "memory_", "")).drop("doc_type")
        if any(self.root.glob("*.md")):
            table = markdown.alias_table(markdown.files(self.spark, str(self.root), below=False))
            people = markdown.with_alias_table(own.filter("entity_type = 'person'"), table).withColumn("entity_type", F.lit("person"))
            own = people.unionByName(own.filter("entity_type <> 'person'"))
        told = [str(p.relative_to(self.root / "memory")) for p in sorted((self.root / "memory" / "context").glob("*.md"))]
        groups = markdown.teams(markdown.files(self.spark, str(self.root / "memory"), only=told)).withColumn("entity_type", F.lit("team"))
        pins = old.select("id", F.col("pinned").alias("_pin"), F.col("updated_at").alias("updated_at"))
        seeds = own.unionByName(groups, allowMissingColumns=True).withColumn("id", key).dropDuplicates(["id"]).join(pins, "id", "left")
        seeds = seeds.withColumns({"pinned": F.coalesce("_pin", "pinned", F.lit(False)), "source_path": F.col("path")})
        self.store.write("entities", seeds)
        seeds = self.store.read("entities")
        present = texts.select(F.col("id").alias("document_id"), F.explode("attendees").alias("p")).select("document_id", "p.name", "p.email").filter("name is not null or email is not null").distinct()
        matched = linking.link_attendees(present, seeds.withColumn("email", F.element_at("metadata", F.lit("email"))))
        unknown = matched.filter("matched_by = 'created' and name is not null and trim(name) <> ''").groupBy(F.lower("name").alias("low")).agg(F.min("name").alias("name"), F.min("email").alias("email"))
        first = F.when(F.col("name").contains(" "), F.get(F.split("name", r"\s+"), F.lit(0)))
        known = F.when(F.col("email").isNotNull(), F.create_map(F.lit("email"), F.col("email"))).otherwise(F.create_map().cast("map<string,string>"))
        new = unknown.select("low", "name", F.array_compact(F.array(first)).alias("aliases"), known.alias("metadata"), F.lit("person").alias("entity_type")).withColumn("id", key).join(pins, "id", "left")
        ids = new.select(F.lower("name").alias("low"), F.col("id").alias("new_id"))
        attended = matched.withColumn("low", F.lower("name")).join(ids, "low", "left").withColumn("entity_id", F.coalesce("entity_id", "new_id"))
        self.store.write("attendees", attended)
        found = seeds.unionByName(new.withColumn("pinned", F.coalesce("_pin", F.lit(False))).drop("low", "_pin"), allowMissingColumns=True)
        self.store.write("entities", found.withColumn("attributes", F.coalesce("attributes", open_metadata.from_map(F.col("metadata")))))
        named = lambda e: e.select("id", "name", "entity_type", "aliases")
        now = named(self.store.read("entities"))
        return not (now.exceptAll(named(old)).isEmpty() and named(old).exceptAll(now).isEmpty())

    def _write_profiles(self) -> None:
        """A text and a vector for each entity: its name, type, aliases, metadata and five newest facts. A text that was
        embedded before keeps its vector."""
        texts = relational.profile_texts(self.store.read("entities"), self.store.read("facts"))
        had = self.store.read("profiles").select("id", "profile", "embedding")
        joined = texts.join(had, ["id", "profile"], "left")
        kept = joined.filter("embedding is not null")
        new = joined.filter("embedding is null").withColumn("embedding", self.embed(F.col("profile")))
        self.store.write("profiles", kept.unionByName(new))

    def search_entities(self, query: str, limit: int = 5, entity_type: str | None = None, threshold: float = 0.0) -> DataFrame:
        """(id, name, entity_type, score, profile): entities whose profiles are most like a text."""
        known = self.store.read("profiles")
        if entity_type:
            known = known.filter(F.col("entity_type") == entity_type)
        q = self.spark.range(1).select(self.embed(F.lit(query)).alias("q")).first()["q"]
        near = vectors.top_k(known, list(q), limit, "id")
        return near.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score"))).filter(F.col("score") >= threshold).select("id", "name", "entity_type", "score", "profile")

    def suggest_entities(self, name: str, limit: int = 3) -> list[str]:
        """Names and aliases most like a name that wasn't found."""
        return [r["name"] for r in snippets.suggested(self.store.read("entities").select("name"), name, limit).collect()]

    def stale_files(self) -> list[str]:
        """Known files of the memory folder whose content differs from what is indexed."""
        now = self._tree().filter(~F.col("path").startswith("meetings/")).withColumn("content_hash", F.sha2("text", 256))
        return sorted(r["path"] for r in incremental.stale_files(now, self.store.read("documents")).collect())

    def get_index_stats(self) -> dict:
        row = relational.index_stats(*(self.store.read(t) for t in ("documents", "chunks", "entities", "mentions", "facts"))).first()
        kinds = self.store.read("documents").groupBy("doc_type").count().orderBy(F.desc("count"), "doc_type").collect()
        return row.asDict() | {"by_type": {r["doc_type"]: r["count"] for r in kinds}}

    # ------------------------------------------------------------ entities and facts

    def list_entities(self, entity_type: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        entities = self.store.read("entities")
        if entity_type:
            entities = entities.filter(F.col("entity_type") == entity_type)
        rows = relational.mention_counts(entities, self.store.read("mentions")).orderBy("name", "id")
        rows = rows.offset(offset) if offset else rows
        return rows if limit is None else rows.limit(limit)

    def find_entities(self, name: str) -> DataFrame:
        found = relational.resolve(self.store.read("entities"), name, folded=True)
        return relational.mention_counts(found, self.store.read("mentions")).orderBy("name")

    def _entity_id(self, name: str) -> int:
        """The entity of a name; `me` is the user that was named, if any."""
        name = self.me if self.me and name.lower() == "me" else name
        row = relational.resolve(self.store.read("entities"), name, folded=True).orderBy("id").first()
        if row is None:
            raise KeyError(name)
        return row["id"]

    def get_entity(self, name: str) -> dict:
        key = self._entity_id(name)
        row = self.store.read("entities").filter(F.col("id") == key).first().asDict()
        self.touch("entity", key)
        facts = self.store.read("facts").filter(F.col("entity_id") == key).orderBy("seq").collect()
        told = {} if row["attributes"] is None else json.loads(row["attributes"].toJson())
        return row | {"attributes": told, "mention_count": self.store.read("mentions").filter(F.col("entity_id") == key).select("document_id").distinct().count(), "facts": [f.asDict() for f in facts]}

    def get_entity_profile(self, name: str) -> dict:
        """An entity in short: facts by number, days, its documents' number, and the commands that tell more."""
        row = self.get_entity(name)
        kind, quoted = row["entity_type"], shlex.quote(row["name"])
        recent = (self.as_of - dt.timedelta(days=30)).isoformat()
        if kind in ("person", "project"):
            more = {"timeline": f"{kind}-timeline {quoted} --limit 20", "recent": f"{kind}-timeline {quoted} --from-date {recent}"}
        else:
            more = {"search": f"search {quoted} --limit 20"}
        if row["source_path"]:
            more["profile"] = f"view {row['source_path']}"
        kept = ("id", "name", "entity_type", "aliases", "metadata", "attributes", "updated_at", "last_mentioned_at", "source_path")
        facts = [{"seq": f["seq"], "text": f["fact_text"], "date": f["fact_date"]} for f in row["facts"]]
        return {k: row[k] for k in kept} | {"facts": facts, "document_count": row["mention_count"], "breadcrumbs": more}

    def entities_where(self, conditions: dict, entity_type: str | None = None) -> DataFrame:
        """Entities whose metadata fit conditions on paths, such as {"budget.amount": (">=", 1000), "sources[*].type": "wiki"}."""
        return open_metadata.where(self.list_entities(entity_type), conditions)

    def metadata_paths(self, entity_type: str | None = None) -> DataFrame:
        """(path, kind, n_values, least, most): what is told of entities, and as what."""
        entities = self.store.read("entities")
        if entity_type:
            entities = entities.filter(F.col("entity_type") == entity_type)
        return open_metadata.inventory(entities).orderBy("path", "kind")

    def set_metadata(self, name: str, path: str, value) -> None:
        """Writes one value into the head of an entity's file, wherever it stands there; None takes it away. All else
        keeps its value and type."""
        source = self._profile(self._entity_id(name))
        if source is None:
            raise ValueError(f"{name!r} has no file")
        first = open_metadata.steps(path)[0]
        if first in ("aliases", "pinned"):
            raise ValueError(f"{first} is no metadata")
        row = self.get_entity(name)
        before = markdown.frontmatter(self.read_memory_file(source)) or row["attributes"]
        after = open_metadata.changed({k: v for k, v in before.items() if k not in ("aliases", "pinned")}, path, value)
        self.edit_entity(name, metadata={first: after.get(first)})

    def get_entity_timeline(self, name: str, limit: int = 10, from_date=None, to_date=None, doc_type=None) -> DataFrame:
        key = self._entity_id(name)
        self.touch("entity", key)
        return relational.timeline(self.store.read("mentions"), self.store.read("documents"), key, limit, from_date, to_date, doc_type)

    def get_stale_entities(self, days: int = 90, entity_type: str | None = None) -> DataFrame:
        entities = self.store.read("entities").withColumn("updated_at", F.to_date("updated_at"))
        return relational.stale(entities, str(self.as_of - dt.timedelta(days=days)), str(self.as_of), entity_type)

    def get_fact_counts(self, ids: list[int] | None = None) -> DataFrame:
        return relational.fact_counts(self.store.read("facts"), ids)

    def toggle_entity_pin(self, name: str) -> bool:
        key = self._entity_id(name)
        pinned = F.when(F.col("id") == key, ~F.coalesce("pinned", F.lit(False))).otherwise(F.col("pinned"))
        self.store.write("entities", self.store.read("entities").withColumn("pinned", pinned))
        return bool(self.store.read("entities").filter(F.col("id") == key).first()["pinned"])

    def _profile(self, key: int) -> str | None:
        """The file of an entity, which is the truth about its facts."""
        row = self.store.read("entities").filter(F.col("id") == key).first()
        return row["source_path"] if row["source_path"] and self._file(row["source_path"]).exists() else None

    def _rewrite_fact(self, key: int, old: str, new: str | None) -> None:
        path = self._profile(key)
        if path:
            lines = self.read_memory_file(path).split("\n")
            at = next((i for i, x in enumerate(lines) if x.strip() == old), None)
            if at is not None:
                lines[at : at + 1] = [] if new is None else [new]
                self.write_memory_file(path, "\n".join(lines))

    def add_fact(self, entity: str, fact: str, date: str | None = None) -> int:
        """Stores a fact, and writes it under `## Recent Facts` of the entity's file, from which index() reads it again."""
        key = self._entity_id(entity)
        facts = self.store.read("facts")
        seq = (facts.filter(F.col("entity_id") == key).agg(F.max("seq")).first()[0] or 0) + 1
        day = dt.date.fromisoformat(date) if date else self.as_of
        one = self.spark.createDataFrame([(key, day, fact)], "entity_id long, fact_date date, fact_text string").select(_fact_key().alias("id")).first()["id"]
        self.store.append("facts", [(one, key, fact, day, dt.datetime.combine(self.as_of, dt.time()), seq)], ["id", "entity_id", "fact_text", "fact_date", "created_at", "seq"])
        if path := self._profile(key):
            self.write_memory_file(path, inserted_under(self.read_memory_file(path), "## Recent Facts", f"- [{day}] {fact}"))
        return seq

    def edit_fact(self, entity: str, seq: int, fact: str | None = None, date: str | None = None) -> None:
        key = self._entity_id(entity)
        hit = (F.col("entity_id") == key) & (F.col("seq") == seq)
        facts = self.store.read("facts")
        old = facts.filter(hit).first()
        if old is None:
            return
        text_, day = old["fact_text"] if fact is None else fact, old["fact_date"] if date is None else dt.date.fromisoformat(date)
        facts = facts.withColumns({"fact_text": F.when(hit, F.lit(text_)).otherwise(F.col("fact_text")), "fact_date": F.when(hit, F.lit(day)).otherwise(F.col("fact_date"))})
        self.store.write("facts", facts.withColumn("id", F.when(hit, _fact_key()).otherwise(F.col("id"))))
        self._rewrite_fact(key, f"- [{old['fact_date']}] {old['fact_text']}", f"- [{day}] {text_}")

    def delete_fact(self, entity: str, seq: int) -> None:
        key = self._entity_id(entity)
        hit = (F.col("entity_id") == key) & (F.col("seq") == seq)
        old = self.store.read("facts").filter(hit).first()
        self.store.write("facts", self.store.read("facts").filter(~F.coalesce(hit, F.lit(False))))
        if old is not None:
            self._rewrite_fact(key, f"- [{old['fact_date']}] {old['fact_text']}", None)

    # ------------------------------------------------------------ entities in files

    def create_entity(self, name: str, kind: str = "person", aliases: list[str] = (), metadata: dict | None = None, pinned: bool = False, body: str = "") -> str:
        """Writes a profile of a person or a project and indexes it; a name that is taken raises."""
        folder = {"person": "people", "project": "projects"}[kind]
        slug = re.sub(r"-+", "-", re.sub(r"[^a-z0-9]+", "-", text.fold(name))).strip("-")
        path = f"{folder}/{slug}.md"
        if not slug or self._file(path).exists():
            raise ValueError(f"there is a file for {name!r} already" if slug else f"no file name in {name!r}")
        self.write_memory_file(path, wikilinks.yaml_head(name, self._head(kind, list(aliases), metadata or {}, pinned)) + body)
        self.index(paths=[path])
        return path

    @staticmethod
    def _head(kind: str, aliases: list[str], metadata: dict, pinned: bool) -> dict:
        """Fields of a profile in the order of files; references to other entities are links."""
        order = PROFILE_FIELDS[kind]
        shown = lambda k: f"[[{metadata[k]}]]" if k in REFERENCES and isinstance(metadata[k], str) and "[[" not in metadata[k] else metadata[k]
        given = {k: shown(k) for k in order if metadata.get(k)}
        return {"aliases": aliases} | given | {"pinned": pinned} | {k: v for k, v in metadata.items() if k not in order}

    def edit_entity(self, name: str, metadata: dict | None = None, aliases: list[str] | None = None, pinned: bool | None = None) -> None:
        """Rewrites the head of an entity's file; what stands from the first `##` on stays. Values of None go."""
        key = self._entity_id(name)
        path = self._profile(key)
        if path is None:
            raise ValueError(f"{name!r} has no file")
        row = self.store.read("entities").filter(F.col("id") == key).select("*", snippets.own_aliases(F.col("name"), F.col("aliases")).alias("own")).first()
        old = self.read_memory_file(path)
        raw = markdown.frontmatter(old)
        # a value in the file is kept as it is there, lists and links too
        fields = {k: raw.get(k, v) for k, v in (row["metadata"] or {}).items()} | (metadata or {})
        head = self._head(row["entity_type"], row["own"] if aliases is None else aliases, {k: v for k, v in fields.items() if v is not None}, bool(row["pinned"]) if pinned is None else pinned)
        rest = _body(old) if raw else old
        rest = re.sub(r"\A\s*#[ \t]+[^\n]*\n*", "", rest)
        if not raw:
            rest = re.sub(r"(?m)\A(?:\s*\*\*[^*:\n]+:\*\*[^\n]*\n?)+", "", rest).lstrip("\n")
        self.write_memory_file(path, wikilinks.yaml_head(row["name"], head) + rest)
        if pinned is not None:
            self.store.write("entities", self.store.read("entities").withColumn("pinned", F.when(F.col("id") == key, F.lit(pinned)).otherwise(F.col("pinned"))))
        self.index(paths=[path])

    def delete_entity(self, name: str) -> None:
        """Removes an entity with its file, mentions and facts."""
        key = self._entity_id(name)
        path = self._profile(key)
        if path is not None:
            self._file(path).unlink()
        for table, column in (("mentions", "entity_id"), ("facts", "entity_id"), ("attendees", "entity_id"), ("profiles", "id"), ("entities", "id")):
            self.store.write(table, self.store.read(table).filter(F.coalesce(F.col(column) != key, F.lit(True))))
        if path is not None:
            self.index(paths=[path])

    def add_wikilinks(self, apply: bool = False) -> list[str]:
        """Files in which names of entities would be, or with `apply` are, linked."""
        tree = markdown.files(self.spark, str(self.root / "memory"))
        new = wikilinks.with_wikilinks(tree, self.store.read("entities")).select("path", F.col("text").alias("new"))
        changed = new.join(tree, "path").filter("new <> text").select("path", "new").orderBy("path")
        paths = []
        for row in changed.toLocalIterator():  # files are on the driver's side
            paths.append(row["path"])
            if apply:
                self.write_memory_file(row["path"], row["new"])
        return paths

    def list_facts(self, since: str | None = None, entity: str | None = None) -> DataFrame:
        first = str(dates.since(since, self.as_of)) if since else None
        return relational.facts_with_entities(self.store.read("facts"), self.store.read("entities"), first, self._entity_id(entity) if entity else None)

    def unlink_entity(self, entity: str, document: str) -> None:
        row = self.store.read("entities").filter(F.col("id") == self._entity_id(entity)).first()
        doc = relational.find_document(self.store.read("documents"), document).first()
        self.store.append("suppressions", [(doc["path"], row["name"].lower())], ["path", "entity"])
        gone = (F.col("entity_id") == row["id"]) & (F.col("document_id") == doc["id"])
        self.store.write("mentions", self.store.read("mentions").filter(~gone))

    def relink_entity(self, entity: str, document: str) -> None:
        row = self.store.read("entities").filter(F.col("id") == self._entity_id(entity)).first()
        doc = relational.find_document(self.store.read("documents"), document).first()
        gone = (F.col("path") == doc["path"]) & (F.col("entity") == row["name"].lower())
        self.store.write("suppressions", self.store.read("suppressions").filter(~gone))
        self.store.append("mentions", [(row["id"], doc["id"], "manual")], ["entity_id", "document_id", "mention_type"])

    def match_tasks_to_projects(self, tasks: DataFrame, min_keyword_len: int = 4) -> DataFrame:
        projects = self.store.read("entities").filter("entity_type = 'project'")
        asked = F.udf(snippets.keywords, "array<string>")(F.element_at("metadata", F.lit("task_keywords")))  # projects only
        names = projects.select(F.col("id").alias("project_id"), F.explode(F.concat(F.array("name"), "aliases", asked)).alias("name"))
        return linking.match_tasks(tasks, names, min_keyword_len).distinct()

    # ------------------------------------------------------------ documents, notes, files

    def list_documents(self, doc_type=None, from_date=None, to_date=None, limit: int = 50, since_hours: float | None = None) -> DataFrame:
        """Documents, newest first; since_hours keeps those that were indexed that recently."""
        docs = self.store.read("documents")
        if since_hours is not None:
            docs = docs.filter(F.col("indexed_at") >= self._now - F.make_dt_interval(secs=F.lit(since_hours * 3600)))
        return relational.list_documents(docs, doc_type, from_date, to_date, limit=limit)

    def count_documents(self) -> int:
        return self.store.read("documents").count()

    def view_document(self, target: str) -> dict | None:
        doc = relational.find_document(self.store.read("documents"), target).first()
        if doc is None:
            return None
        self.touch("document", doc["id"])
        body = relational.reassembled(self.store.read("chunks").filter(F.col("document_id") == doc["id"])).first()
        return doc.asDict() | {"body": body["body"] if body else ""}

    def toggle_document_pin(self, path: str) -> bool:
        flip = F.when(F.col("path") == path, ~F.coalesce("pinned", F.lit(False))).otherwise(F.col("pinned"))
        self.store.write("documents", self.store.read("documents").withColumn("pinned", flip))
        return self.get_document_pin(path)

    def get_document_pin(self, path: str) -> bool:
        row = self.store.read("documents").filter(F.col("path") == path).first()
        return bool(row and row["pinned"])

    def list_pinned_documents(self) -> DataFrame:
        heads = self.store.read("chunks").filter("heading is not null and heading <> '__document__'").groupBy(F.col("document_id").alias("id"), "heading").agg(F.min("chunk_index").alias("at"))
        listed = heads.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "heading"))), lambda x: x["heading"]).alias("headings"))
        return self.store.read("documents").filter("pinned").join(listed, "id", "left").select("id", "path", "title", "headings").orderBy("path")

    def list_memory_tree(self) -> DataFrame:
        return relational.directory_tree(self.store.read("documents"))

    def _file(self, relative: str) -> Path:
        path = (self.root / "memory" / relative).resolve()
        if ".." in Path(relative).parts or path.suffix != ".md" or (self.root / "memory").resolve() not in path.parents:
            raise ValueError(f"not a markdown file of this knowledge base: {relative}")
        return path

    def read_memory_file(self, relative: str) -> str:
        return self._file(relative).read_text()

    def write_memory_file(self, relative: str, content: str) -> None:
        """Replaces a file at once."""
        self._put_file(self._file(relative), content)

    @staticmethod
    def _put_file(path: Path, content: str) -> None:
        path.parent.mkdir(parents=True, exist_ok=True)
        aside = path.with_name(path.name + ".new")
        aside.write_text(content)
        os.replace(aside, path)

    def list_notes(self, tag: str | None = None, pinned_only: bool = False, limit: int = 50) -> DataFrame:
        notes = self.store.read("documents").filter(F.col("doc_type").isin("memory_note", "memory_doc"))
        if pinned_only:
            notes = notes.filter("pinned")
        return relational.list_documents(notes, tags=tag.split(",") if tag else [], ignore_case=True, limit=limit)

    def add_note(self, title: str, body: str = "", tags: list[str] = (), pin: bool = False, date: str | None = None, entity: str | None = None) -> str:
        """Writes and indexes a note; an entity that it is about is linked with it."""
        about = self._entity_id(entity) if entity else None
        slug = re.sub(r"-+", "-", re.sub(r"[^a-z0-9]+", "-", text.fold(title))).strip("-")[:60] or "note"
        name, n = f"notes/{slug}.md", 1
        while self._file(name).exists():
            n += 1
            name = f"notes/{slug}-{n}.md"
        head = ["---", f"title: {title}", f"date: {date or self.as_of}", f"tags: [{', '.join(tags)}]", *(["pinned: true"] if pin else []), "---", ""]
        self.write_memory_file(name, "\n".join(head) + body + "\n")
        self.index(paths=[name])
        if about is not None:
            row = relational.find_document(self.store.read("documents"), name).first()
            self.store.append("mentions", [(about, row["id"], "tagged")], ["entity_id", "document_id", "mention_type"])
        return name

    def edit_note(self, target: str, body: str | None = None, append: str | None = None, insert_under: tuple[str, str] | None = None, tags: list[str] | None = None, pin: bool | None = None) -> None:
        """Changes a note's text, tags or pin; other lines of its head stay as they are. No change at all raises."""
        if all(x is None for x in (body, append, insert_under, tags, pin)):
            raise ValueError("nothing to change")
        old = self.read_memory_file(target)
        head, rest = old[: len(old) - len(_body(old))], _body(old)
        if tags is not None:
            head = _with_line(head, "tags", f"[{', '.join(tags)}]")
        if pin is not None:
            head = _with_line(head, "pinned", "true" if pin else "false")
        if body is not None:
            rest = body + "\n"
        if append:
            rest = rest.rstrip("\n") + f"\n\n{append}\n"
        if insert_under:
            rest = inserted_under(rest, *insert_under)
        self.write_memory_file(target, head + rest)
        if pin is not None:
            self.store.write("documents", self.store.read("documents").withColumn("pinned", F.when(F.col("path") == target, F.lit(pin)).otherwise(F.col("pinned"))))
        self.index(paths=[target])

    def delete_note(self, path: str) -> None:
        self._file(path).unlink()
        self.index(paths=[path])

    # ------------------------------------------------------------ glossary, correction

    def list_glossary_terms(self) -> DataFrame:
        return self.store.read("glossary").orderBy("term")

    def edit_glossary_term(self, term: str, expansion: str) -> bool:
        """Adds a term's row to the table, or rewrites it."""
        old = self.read_memory_file("glossary.md") if self._file("glossary.md").exists() else "| Term | Meaning |\n| --- | --- |\n"
        row = re.compile(rf"(?m)^\|\s*{re.escape(term)}\s*\|[^|\n]*\|")
        known = bool(row.search(old))
        new = row.sub(lambda m: f"| {term} | {expansion} |", old) if known else old.rstrip("\n") + f"\n| {term} | {expansion} |\n"
        self.write_memory_file("glossary.md", new)
        self.index(paths=["glossary.md"])
        return known

    def delete_glossary_term(self, term: str) -> None:
        """Takes a term's rows out of the table, case ignored; an unknown term raises."""
        old = self.read_memory_file("glossary.md") if self._file("glossary.md").exists() else ""
        new = re.sub(rf"(?mi)^\|\s*(?:\*\*)?{re.escape(term)}(?:\*\*)?\s*\|[^\n]*\n?", "", old)
        if new == old:
            raise ValueError(f"no such term: {term!r}")
        self.write_memory_file("glossary.md", new)
        self.index(paths=["glossary.md"])

    def correct_term(self, term: str, replacement: str | None = None, apply: bool = False, scope: str | None = None, word_boundary: bool = False, ignore_case: bool = True,
                     file_type: str | None = None) -> list[dict]:
        """Files with a term; with `apply`, all are rewritten or, if one fails, all put back. file_type is a part of the
        files' names."""
        if apply and replacement is None:
            raise ValueError("nothing to put in its place")
        tree = markdown.files(self.spark, str(self.root / "memory"))
        hits = linking.correction_scan(tree, term, word_boundary, ignore_case, scope, file_type)
        found = [r.asDict() for r in hits.orderBy("path").collect()]
        if apply and found:
            wanted = tree.join(F.broadcast(hits.select("path")), "path", "left_semi")
            before = {r["path"]: r["text"] for r in wanted.collect()}
            after = {r["path"]: r["text"] for r in linking.corrected(wanted, term, replacement, word_boundary, ignore_case).select("path", "text").collect()}
            try:
                for path, content in after.items():
                    self.write_memory_file(path, content)
            except OSError:
                for path, content in before.items():
                    self.write_memory_file(path, content)
                raise
            total = sum(f["hits"] for f in found)
            line = f"[{dt.datetime.now(dt.timezone.utc).isoformat()}] '{term}' → '{replacement}' | {len(after)} files, {total} replacements | paths: {', '.join(sorted(after))}\n"
            with open(self.root / "corrections.log", "a", encoding="utf-8") as log:
                log.write(line)
            self.index(paths=sorted(after))
        return found

    # ------------------------------------------------------------ search

    def touch(self, kind: str, key: int) -> None:
        """Counts a deliberate view."""
        self.store.append("access", [(kind, key, dt.datetime.combine(self.as_of, dt.time()))], ["kind", "id", "at"])

    def reset_access(self) -> None:
        self.store.write("access", self.store.read("access").limit(0))

    def search(self, query: str, limit: int = 10, fast: bool = False, recency: bool | float = True, doc_type=None, from_date=None, to_date=None, tag: str | None = None, sort_by: str = "score",
               path: str | None = None, hotness: bool = False, dedupe: bool = True, fts_weight: float = 1.0, vector_weight: float = 1.0, stem: bool = True,
               hierarchy: bool = True, hierarchy_threshold: float = 0.5, hierarchy_alpha: float = 0.5, snippet_chars: int = 200, full_chunks: bool = False, merge_chunks: bool = False,
               include_overview: bool = False, highlight: bool = False, explain: bool = False, hook=None) -> DataFrame:
        """Ranked hits with their components. Path sets restrict candidates; type, date and tag filter them.

        hierarchy: a first pass looks for entities whose profiles are like the query; if some reach the threshold, only
        documents that mention them are candidates, and the best of their scores is blended in (alpha is the share of the
        document's own). full_chunks keeps whole contents, merge_chunks joins those of a document's matching chunks;
        highlight marks the query's words in the snippet; explain adds what made up the score and the words that were
        found. hook is called with a phase and its seconds as it ends; `last_search` tells them, with the variants that
        were tried and the blocks that were read."""
        told: dict = {"phases": {}, "entities": []}
        clock = [time.perf_counter()]

        def done(phase: str) -> None:
            now = time.perf_counter()
            told["phases"][phase], clock[0] = now - clock[0], now
            if hook:
                hook(phase, told["phases"][phase])

        query, first, last = dates.date_filters(query, self.as_of)
        from_date, to_date = from_date or first, to_date or last
        docs, chunks = self.store.read("documents"), self.store.read("chunks")
        words = set(re.findall(r"[^\W_]+", query.lower()))
        extra = [r["expansion"] for r in self.store.read("glossary").filter(F.lower("term").isin(sorted(words))).collect()]  # of the query's words
        within, parents = None, None
        if path is not None:
            within = relational.list_documents(docs, path=path).select(F.col("id").alias("document_id"))
        if hierarchy and not fast:
            matched = [(r["id"], r["score"], r["name"]) for r in self.search_entities(query, 5, threshold=hierarchy_threshold).collect()]
            if matched:
                found = self.spark.createDataFrame(matched, "entity_id long, score double, name string")
                parents = ranking.parent_scores(found, self.store.read("mentions"))
                if parents.isEmpty():
                    parents = None
                else:
                    told["entities"] = [{"name": n, "score": x} for _, x, n in matched]
                    of = parents.select("document_id")
                    within = of if within is None else within.join(of, "document_id", "left_semi")
            done("entities")
        wanted = query
        if stem:
            from noteloom.functions.stem import stem as porter

            wanted = " ".join(w if w.endswith("*") else porter(w) for w in fts.clean_query(query).lower().split())
        kind = "stemmed" if stem else "postings"
        index, bounds, corpus = self.store.read(kind), None, None
        sizes, known = self.store.read("lengths"), self.store.read("vectors")
        if within is not None:  # both indexes are cut before anything is scored
            sizes, known, index = (t.join(within, "document_id", "left_semi") for t in (sizes, known, index))
        else:
            bounds, corpus = self.store.read("impacts").filter(F.col("kind") == kind), self._corpus()
        hits = fts.search(index, sizes.select("chunk_id", "dl"), wanted, 5 * limit, extra, bounds, corpus, told)
        done("fts")
        near = None
        if not fast and not ranking.strong_signal(hits).first()["strong"]:
            q = self.spark.range(1).select(self.embed(F.lit(wanted)).alias("q")).first()["q"]
            near = vectors.top_k(known, list(q), 5 * limit, "chunk_id").select("chunk_id", "score")
        fused = ranking.hybrid(hits.select("chunk_id", "score"), near, fts_weight, vector_weight)
        done("vectors")
        meta = docs.select(F.col("id").alias("document_id"), "path", "title", "doc_type", "doc_date", "tags", "abstract", *(["overview"] if include_overview else []))
        rows = fused.join(chunks.select("chunk_id", "document_id", "chunk_index", "heading", "content"), "chunk_id").join(meta, "document_id")
        if doc_type or from_date or to_date or tag:
            kept = relational.list_documents(docs, doc_type, str(from_date) if from_date else None, str(to_date) if to_date else None, tags=tag.split(",") if tag else [])
            rows = rows.join(kept.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        rows = rows.withColumn("fused", F.col("score"))
        if recency:
            rows = ranking.with_recency(rows, str(self.as_of), *([] if recency is True else [float(recency)]))
        names = self.store.read("mentions").join(self.store.read("entities").select(F.col("id").alias("entity_id"), "name"), "entity_id").groupBy("document_id").agg(F.sort_array(F.collect_set("name")).alias("entities"))
        rows = ranking.with_entity_boost(rows.join(names, "document_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>"))), sorted(words))
        if hotness:
            seen = self.store.read("access").filter("kind = 'document'").groupBy(F.col("id").alias("document_id")).agg(F.count(F.lit(1)).alias("n_access"), F.to_date(F.max("at")).alias("last_access"))
            rows = ranking.with_hotness(rows, seen, str(self.as_of))
        if parents is not None:
            rows = ranking.with_hierarchy(rows, parents, hierarchy_alpha)
        rows = rows.withColumn("score", F.round("score", 4))
        top = ranking.best_per_document(rows, limit) if dedupe else rows.orderBy(F.desc("score"), "chunk_id").limit(limit)
        shown = fts.clean_query(query).split()
        top = top.withColumn("snippet", snippets.snippet(F.col("content"), shown, snippet_chars))
        if highlight:
            top = top.withColumn("snippet", snippets.highlighted(F.col("snippet"), shown))
        if merge_chunks and full_chunks and dedupe:
            whole = ranking.merged_content(rows.select("document_id", "chunk_index", "chunk_id", "content"))
            top = top.drop("content").join(whole, "document_id").orderBy(F.desc("score"), "chunk_id")
        elif not full_chunks:
            top = top.withColumn("content", F.substring("content", 1, CONTENT_CHARS))
        if explain:
            lexical = hits.select("chunk_id", F.col("score").alias("fts_score"), "raw")
            top = top.join(lexical, "chunk_id", "left")
            top = top.join(near.withColumnRenamed("score", "vector_score"), "chunk_id", "left") if near is not None else top.withColumn("vector_score", F.lit(None).cast("double"))
            low = lambda c: F.lower(F.coalesce(c, F.lit("")))
            found = [F.when(low(F.col("title")).contains(w) | low(F.col("content")).contains(w), F.lit(w)) for w in sorted(words)]
            top = top.withColumn("matched_terms", F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")).orderBy(F.desc("score"), "chunk_id")
        done("ranking")
        self.last_search = told
        return top.orderBy(F.col("doc_date").desc_nulls_last(), "chunk_id") if sort_by == "date" else top

    def why_not(self, query: str, target: str, limit: int = 10, path: str | None = None, **options) -> dict | None:
        """Why a document is not among the first hits: ranked, below_cutoff, filtered_path or no_match, with its rank among all
        candidates; None if there is no such document."""
        docs = self.store.read("documents")
        doc = relational.find_document(docs, target).select("id").limit(1)
        found = self.search(query, limit * 20, path=path, dedupe=True, **options)
        ranks = ranking.ranked(found.select("document_id", "score"), id_col="document_id")
        allowed = relational.list_documents(docs, path=path, limit=None).select("id") if path is not None else None
        row = ranking.why_not(doc, ranks, limit, allowed).first()
        return row.asDict() if row else None

    def diagnose(self, query: str, fast: bool = False, filtered: bool = False) -> dict:
        """Why a search has no results: documents of each word, whatever the filters, the three nearest chunks' documents
        (not for fast searches), and what to try."""
        terms = fts.clean_query(query).split()
        keys = [t.lower() for t in terms]
        index = self.store.read("postings").filter(F.col("term").isin(keys))
        counts = {r["term"]: r["n_docs"] for r in fts.document_frequency(index, self.store.read("chunks"), sorted(set(keys))).collect()} if keys else {}
        hits = [{"term": t, "doc_count": counts[t.lower()]} for t in terms]
        near = []
        if not fast:
            q = self.spark.range(1).select(self.embed(F.lit(query)).alias("q")).first()["q"]
            closest = vectors.top_k(self.store.read("vectors"), list(q), 3, "chunk_id").select("document_id", "score", "chunk_id")
            docs = self.store.read("documents").select(F.col("id").alias("document_id"), "title", "path")
            rows = closest.join(docs, "document_id").orderBy(F.desc("score"), "chunk_id").collect()
            near = [{"title": r["title"], "path": r["path"], "similarity": round(r["score"], 3)} for r in rows]
        return {"term_hits": hits, "near_misses": near, "suggestions": _advice(query, hits, near, fast, filtered)}

    def memory_similar(self, query: str, threshold: float = 0.85, limit: int = 5, path: str | None = None, entity: str | None = None) -> DataFrame:
        """What is told already that is like a text, best first: among an entity's facts, a document's chunks or all chunks.

        (match_type, content, score, path, entity_name, fact_seq, fact_date, chunk_id, document_id). Both scopes at once,
        or one that isn't known, raise ValueError."""
        if entity is not None and path is not None:
            raise ValueError("entity and path exclude each other")
        q = list(self.spark.range(1).select(self.embed(F.lit(query)).alias("q")).first()["q"])
        if entity is not None:
            try:
                key = self._entity_id(entity)
            except KeyError as e:
                raise ValueError(f"no such entity: {entity!r}") from e
            owner = self.store.read("entities").filter(F.col("id") == key).select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), F.col("source_path").alias("path"))
            return similar_facts(self.store.read("facts").filter(F.col("entity_id") == key), owner, self.embed, q, threshold, limit)
        known = self.store.read("vectors")
        docs = self.store.read("documents").select(F.col("id").alias("document_id"), "path")
        if path is not None:
            row = relational.find_document(self.store.read("documents"), path).first()
            if row is None:
                raise ValueError(f"no such document: {path!r}")
            known = known.filter(F.col("document_id") == row["id"])
        found = vectors.top_k(known, q, limit, "chunk_id", threshold).select("chunk_id", "score")
        rows = found.join(self.store.read("chunks").select("chunk_id", "document_id", "content"), "chunk_id").join(docs, "document_id", "left")
        return _similar(rows.withColumn("match_type", F.lit("chunk"))).orderBy(F.desc("score"), "chunk_id")

    def context(self, topic: str | None = None, human: bool = False, mention_threshold: int = 1) -> str:
        """What there is to know, in short: of everything, or of what a topic is about."""
        entities, found = self.store.read("entities"), self.store.read("mentions")
        about = None if topic is None else ctx.topic_entities(entities, found, self.store.read("postings"), self.store.read("lengths"), topic)
        headings = self.list_pinned_documents().select("id", "headings")
        blocks = ctx.build(entities, found, self.store.read("documents"), self.store.read("glossary"), str(self.as_of), about, mention_threshold if about is None else 0, headings)
        return ctx.rendered(blocks, human, topic)


def _advice(query: str, hits: list[dict], near: list[dict], fast: bool, filtered: bool) -> list[str]:
    """What to try after a search without results."""
    known, unknown = [h["term"] for h in hits if h["doc_count"]], [h["term"] for h in hits if not h["doc_count"]]
    found = []
    if known and filtered:
        found.append(f"{' '.join(known)!r} is in indexed documents: loosen the filters")
    if len(known) > 1:
        found.append("try fewer words, or give vectors more weight")
    if unknown and known:
        found.append(f"leave out {', '.join(unknown)}")
    elif unknown:
        found.append(f"no document has {', '.join(unknown)}: check the spelling or try broader words")
    if fast:
        found.append("search by meaning as well, not fast")
    elif near:
        found.append("the nearest documents are listed, but are not near enough: say it in other words")
    return found or ["broaden the query or remove filters"]


def _totals(sizes: DataFrame, sign: int) -> DataFrame:
    """One row of the corpus: its number of chunks, and their lengths together."""
    return sizes.agg((sign * F.count(F.lit(1))).alias("n"), (sign * F.coalesce(F.sum("dl"), F.lit(0))).alias("least")).withColumn("kind", F.lit("corpus"))


#: What a search for similar things returns.
SIMILAR = ("match_type string", "content string", "score double", "path string", "entity_name string", "fact_seq int", "fact_date date", "chunk_id long", "document_id long")


def _similar(rows: DataFrame) -> DataFrame:
    """The columns of SIMILAR; those that aren't there are null."""
    kinds = dict(c.split(" ") for c in SIMILAR)
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def similar_facts(facts: DataFrame, owners: DataFrame, embed, query: list[float], threshold: float, limit: int) -> DataFrame:
    """Facts most like a query vector, embedded as they are read; equal scores by number. owners: (entity_id, entity_name,
    path)."""
    known = facts.filter("fact_text is not null").withColumn("embedding", embed(F.col("fact_text")))
    near = vectors.top_k(known, query, limit, "seq", threshold).join(owners, "entity_id", "left")
    named = near.withColumns({"match_type": F.lit("fact"), "content": F.col("fact_text"), "fact_seq": F.col("seq")})
    return _similar(named).orderBy(F.desc("score"), "fact_seq")


def _with_line(head: str, key: str, value: str) -> str:
    """Front matter with a `key: value` line, in place of the one that is there (and the list below it) or as its last."""
    line = f"{key}: {value}"
    if not head:
        return f"---\n{line}\n---\n"
    shape = re.compile(rf"(?m)^{key}:[^\n]*(?:\n[ \t]*-[ \t][^\n]*)*$")
    if shape.search(head):
        return shape.sub(lambda m: line, head, count=1)
    return head.removesuffix("---\n") + f"{line}\n---\n"


def _fact_key():
    """The id of a fact: of its entity, day and text."""
    return F.xxhash64("entity_id", "fact_date", "fact_text").bitwiseAND(F.lit((1 << 62) - 1))


def _body(content: str) -> str:
    """What follows the front matter."""
    m = re.match(r"---\n.*?\n---\n", content, re.DOTALL)
    return content[m.end() :] if m else content


def inserted_under(body: str, heading: str, line: str) -> str:
    """The body with a line as the first under a heading line, as `## Log`, which is made at the end if it isn't there. A
    line that already comes first there stays single."""
    heading, line = heading.strip(), line.rstrip("\n")
    lines = body.splitlines()
    at = next((i for i, x in enumerate(lines) if x.strip() == heading), None)
    if at is None:
        before = body.rstrip("\n")
        return (before + "\n\n" if before else "") + f"{heading}\n{line}\n"
    first = next((x for x in lines[at + 1 :] if x.strip()), None)
    if first != line:
        lines.insert(at + 1, line)
    return "\n".join(lines) + ("\n" if body.endswith("\n") else "")
