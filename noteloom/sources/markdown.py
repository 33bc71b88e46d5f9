"""Markdown trees as DataFrames: one pass reads whole files, the rest is columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import snippets
from noteloom.functions import text as T
from noteloom.operators import metadata as open_metadata
from noteloom.session import ready

# File suffixes of meetings, and types of the memory folders.
MEETING_SUFFIXES = (".notes.md", ".transcript.md", ".ai-summary.md", ".prep.md", ".debrief.md")
FOLDER_TYPES = {"people": "memory_person", "projects": "memory_project", "context": "memory_context", "notes": "memory_note"}
FRONTMATTER = (
    "title string, date string, type string, granola_id string, tags array<string>, source string, "
    "attendees array<struct<name:string,email:string,company:string>>, "
    "calendar_event struct<title:string,organiser:string,scheduled_start:string,scheduled_end:string>, "
    "granola_summary string, granola_updated_at string, pinned boolean, notion_page_id string, calendar_uid string"
)


def files(spark: SparkSession, root: str, below: bool = True, only: list[str] | None = None) -> DataFrame:
    """(path below root, text, modified) of every markdown file, of those right in root, or of some by name (all there)."""
    if only is not None:
        if not only:
            return spark.createDataFrame([], "path string, text string, modified timestamp")
        raw = spark.read.text([f"{root.rstrip('/')}/{p}" for p in only], wholetext=True)
    else:
        raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md") if below else spark.read.text(root.rstrip("/") + "/*.md", wholetext=True)
    base = F.lit(root.rstrip("/") + "/")
    full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    return raw.select(F.regexp_replace(full, F.concat(F.lit("^.*?"), F.lit("\\Q"), base, F.lit("\\E")), "").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def frontmatter(text: str | None) -> dict:
    """The known keys of a leading YAML block; bad YAML gives none."""
    import yaml

    if not text or not text.startswith("---\n") or "\n---" not in text[4:]:
        return {}
    try:
        found = yaml.safe_load(text[4 : text.index("\n---", 4)])
    except yaml.YAMLError:
        return {}
    return found if isinstance(found, dict) else {}


def _plain(found: dict) -> dict:
    text = lambda k: None if found.get(k) is None else str(found[k])
    tags = found.get("tags")
    tags = [t.strip() for t in tags.split(",")] if isinstance(tags, str) else [str(t) for t in tags or []]
    people = []
    for a in found.get("attendees") or []:
        a = a if isinstance(a, dict) else {"name": str(a)}
        people.append({k: None if a.get(k) is None else str(a[k]) for k in ("name", "email", "company")})
    event = found.get("calendar_event")
    event = {k: None if event.get(k) is None else str(event[k]) for k in ("title", "organiser", "scheduled_start", "scheduled_end")} if isinstance(event, dict) else None
    keys = ("title", "date", "type", "granola_id", "source", "granola_summary", "granola_updated_at", "notion_page_id", "calendar_uid")
    return {k: text(k) for k in keys} | {"tags": tags, "attendees": people, "calendar_event": event, "pinned": bool(found.get("pinned", False))}


def with_frontmatter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds fm, a struct of the 13 known keys."""
    ready(docs.sparkSession)
    names = ("title", "date", "type", "granola_id", "tags", "source", "attendees", "calendar_event", "granola_summary", "granola_updated_at", "pinned", "notion_page_id", "calendar_uid")

    @F.pandas_udf(FRONTMATTER)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_plain(frontmatter(t)) for t in batch], columns=list(names))

    return docs.withColumn("fm", parse(F.col(text_col)))


def title_of(text: Column, fm_title: Column, path: Column) -> Column:
    """Front matter, else the first heading, else the file name."""
    heading = F.nullif(F.trim(F.regexp_extract(text, r"(?m)^# +(.+)$", 1)), F.lit(""))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.[a-z-]+)?\.md$", "")
    return F.coalesce(fm_title, heading, T.title_from_stem(stem))


def memory_documents(tree: DataFrame) -> DataFrame:
    """Documents of a memory folder: type by sub-folder, `memory_doc` for the rest, meetings left out."""
    kind = F.when(F.col("path") == "glossary.md", "glossary")
    for folder, name in FOLDER_TYPES.items():
        kind = kind.when(F.col("path").startswith(folder + "/"), name)
    own = with_frontmatter(tree.filter(~F.col("path").startswith("meetings/")))
    return own.select(
        "path", title_of(F.col("text"), F.col("fm.title"), F.col("path")).alias("title"), F.try_to_timestamp("fm.date").cast("date").alias("doc_date"), kind.otherwise("memory_doc").alias("doc_type"),
        F.col("fm.tags").alias("tags"), F.col("fm.pinned").alias("pinned"), F.sha2("text", 256).alias("content_hash"), T.strip_wikilinks(F.col("text")).alias("text"))


def meeting_documents(tree: DataFrame) -> DataFrame:
    """Documents of a meetings folder: known suffixes with a title in the front matter."""
    known = F.lit(False)
    for suffix in MEETING_SUFFIXES:
        known = known | F.col("path").endswith(suffix)
    own = with_frontmatter(tree.filter(known)).filter("fm.title is not null")
    kind = F.coalesce(F.col("fm.type"), F.regexp_extract("path", r"\.([a-z-]+)\.md$", 1))
    return own.select(
        "path", F.col("fm.title").alias("title"), F.try_to_timestamp("fm.date").cast("date").alias("doc_date"), kind.alias("doc_type"), F.col("fm.source").alias("source_system"),
        F.col("fm.tags").alias("tags"), F.col("fm.attendees").alias("attendees"), F.sha2("text", 256).alias("content_hash"), T.strip_frontmatter(F.col("text")).alias("text"))


def glossary_terms(tree: DataFrame) -> DataFrame:
    """(path, line_no, term, expansion, notes) of the rows of markdown tables, headers and rules left out."""
    rule = r"^\|[\s:|-]+$"
    text_lines = F.split("text", "\n")
    numbered = F.transform(text_lines, lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), F.coalesce(F.get(text_lines, i + 1).rlike(rule), F.lit(False)).alias("head")))
    lines = tree.select("path", F.inline(numbered)).filter(F.col("line").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.withColumn("cells", cells).filter((F.size("cells") >= 2) & ~F.col("line").rlike(r"^\|[\s:|-]+$") & ~F.col("head"))
    return rows.select("path", "line_no", F.get("cells", F.lit(0)).alias("term"), F.get("cells", F.lit(1)).alias("expansion"), F.get("cells", F.lit(2)).alias("notes"))


def glossary_chunks(terms: DataFrame) -> DataFrame:
    content = F.concat_ws(". ", F.concat_ws(": ", "term", "expansion"), F.nullif("notes", F.lit("")))
    return terms.select("path", "line_no", F.col("term").alias("heading"), content.alias("content"))


PROFILE = "aliases array<string>, pinned boolean, metadata map<string,string>, attributes string"
# Keys of a profile that are no metadata, what its other names stand under, the heads of sections and tables.
PROFILE_KEYS = ("aliases", "pinned", "also known as", "codename/also called")
ALSO = {"memory_person": "also known as", "memory_project": "codename/also called"}
TEAMS_MARK = "Teams (from Linear)"
PEOPLE_HEAD = "| Who | Role |"


def _yaml_profile(found: dict) -> tuple[list[str], bool, dict[str, str], str]:
    """Aliases, pin, metadata as texts and as JSON of a YAML head; ids of sources are aliases."""
    given = found.get("aliases") or []
    aliases = [str(a).strip() for a in (given if isinstance(given, list) else [given])]
    kept = {str(k): v for k, v in found.items() if k not in ("aliases", "pinned") and v is not None}
    plain = {k: open_metadata.as_json(v) if isinstance(v, (list, dict)) else str(v).strip() for k, v in kept.items()}
    ids = [f"src:{x}" for x in snippets.source_ids(found)]
    return aliases + ids, bool(found.get("pinned", False)), {k: v for k, v in plain.items() if v}, open_metadata.as_json(kept)


def profiles(docs: DataFrame) -> DataFrame:
    """(name, aliases, metadata, attributes, pinned, path) of people and projects, from a YAML head or, without one, from
    `**Key:** value` lines. The file name is an alias, and so is a person's first name. docs: (path, title, doc_type, text)."""
    ready(docs.sparkSession)

    @F.pandas_udf(PROFILE)
    def head(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [frontmatter(t) for t in batch]
            yield pd.DataFrame([_yaml_profile(f) if f else (None, None, None, None) for f in found], columns=["aliases", "pinned", "metadata", "attributes"])

    lines = T.fields(F.col("text"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    also = F.lit(None).cast("string")
    for kind, key in ALSO.items():
        also = F.when(F.col("doc_type") == kind, F.element_at(lines, F.lit(key))).otherwise(also)
    listed = F.filter(F.transform(F.split(F.coalesce(also, F.lit("")), ","), lambda a: F.trim(a)), lambda a: a != "")
    first = F.when((F.col("doc_type") == "memory_person") & F.col("name").contains(" "), F.get(F.split("name", r"\s+"), F.lit(0)))
    heading = F.nullif(F.trim(F.regexp_extract("text", r"(?m)^# +(.+)$", 1)), F.lit(""))
    rows = docs.withColumns({"h": head(F.col("text")), "l": lines, "stem": stem, "listed": listed, "name": F.coalesce(heading, "title")})
    aliases = F.array_distinct(F.array_compact(F.concat(F.coalesce("h.aliases", "listed"), F.array(first, F.col("stem")))))
    old = F.map_filter("l", lambda k, v: ~k.isin(*PROFILE_KEYS))
    pinned = F.coalesce("h.pinned", F.lower(F.element_at("l", F.lit("pinned"))).isin("true", "yes", "1"), F.lit(False))
    return rows.select("name", F.array_remove(aliases, F.col("name")).alias("aliases"), F.coalesce("h.metadata", old).alias("metadata"), F.coalesce(F.try_parse_json("h.attributes"), open_metadata.from_map(old)).alias("attributes"), pinned.alias("pinned"), "path")


def _lines(tree: DataFrame) -> DataFrame:
    return tree.select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def teams(tree: DataFrame, mark: str = TEAMS_MARK) -> DataFrame:
    """(name, aliases, metadata, path) of `- **Name** (ABC) — what it does` lines, from a line with the mark to the next
    heading of level two."""
    within = F.regexp_extract("text", rf"(?s)(?:^|\n)[^\n]*\Q{mark}\E[^\n]*\n(.*?)(?=\n##|\z)", 1)
    shape = r"^-\s+\*\*(.+?)\*\*(?:\s+\((\w+)\))?\s*—\s*(.+)"
    rows = _lines(tree.filter(F.col("text").contains(mark)).select("path", within.alias("text"))).filter(F.col("line").rlike(shape) & ~F.col("line").startswith("##"))
    part = lambda i: F.trim(T.strip_wikilinks(F.regexp_extract("line", shape, i)))
    short = F.nullif(part(2), F.lit(""))
    return rows.select(part(1).alias("name"), F.array_compact(F.array(short)).alias("aliases"), F.create_map(F.lit("description"), part(3)).alias("metadata"), "path")


def alias_table(tree: DataFrame, head: str = PEOPLE_HEAD) -> DataFrame:
    """(short, name, path): `| **Short** | Full Name, ... |` rows of the table below the head line. A full name is two or more
    capitalised words at the front of the second cell."""
    quoted = "".join("\\" + c if c in "|*.()[]" else c for c in head)
    table = F.regexp_extract("text", rf"(?:^|\n)[^\n]*{quoted}[^\n]*\n((?:\|[^\n]*(?:\n|\z))*)", 1)
    shape = r"^\|\s*\*\*(.+?)\*\*\s*\|\s*(.+?)\s*\|"
    full = r"^(\p{Lu}[\p{L}\p{N}_'-]+(?:\s+\p{Lu}[\p{L}\p{N}_'-]+)+)"
    rows = _lines(tree.select("path", table.alias("text"))).filter(F.col("line").rlike(shape))
    named = rows.select(F.trim(F.regexp_extract("line", shape, 1)).alias("short"), F.regexp_extract(F.regexp_extract("line", shape, 2), full, 1).alias("name"), "path", "line_no")
    return named.filter("name <> ''")


def with_alias_table(people: DataFrame, table: DataFrame) -> DataFrame:
    """People with the short names of a table among their aliases, and those of the table that aren't among them.

    people: (name, aliases, ...); others' columns are null for the new ones."""
    shorts = table.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "short"))), lambda x: x["short"]).alias("shorts"), F.min("path").alias("of"))
    known = people.join(shorts.drop("of"), "name", "left").withColumn("aliases", F.array_distinct(F.concat("aliases", F.coalesce("shorts", F.array().cast("array<string>"))))).drop("shorts")
    first = F.get(F.split("name", r"\s+"), F.lit(0))
    extra = shorts.join(people.select("name"), "name", "left_anti").select("name", F.array_distinct(F.concat("shorts", F.array(first))).alias("aliases"), F.col("of").alias("path"))
    return known.unionByName(extra, allowMissingColumns=True)


def dated_facts(docs: DataFrame) -> DataFrame:
    """(path, fact_date, fact_text) of `- [YYYY-MM-DD] text` lines."""
    lines = docs.select("path", F.explode(F.split("text", "\n")).alias("line"))
    hit = lines.filter(F.col("line").rlike(r"^\s*- \[\d{4}-\d{2}-\d{2}\] \S"))
    date = F.try_to_timestamp(F.regexp_extract("line", r"\[(\d{4}-\d{2}-\d{2})\]", 1)).cast("date")
    return hit.select("path", date.alias("fact_date"), F.trim(F.regexp_extract("line", r"\] (.*)$", 1)).alias("fact_text")).distinct()
