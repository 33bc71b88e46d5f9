"""Chunking of notes and transcripts. Steps whose windows depend on the data before them are Python generators that
run inside mapInPandas; the rest are expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.session import ready

# Sizes of the chunking contract.
MAX_TOKENS = 2000
WINDOW_CHARS, OVERLAP_CHARS = 4000, 400
SUMMARY_OVER, SUMMARY_HEAD, SUMMARY_TAIL = 4500, 3000, 1500
SUMMARY_HEADING = "__document__"
NO_SUMMARY = ("memory_person", "memory_project", "memory_context", "glossary")
TRIVIAL = ("", "No personal notes available.", "---")

_HEADER = re.compile(r"^#{2,3}\s+(.*)$")
_TURN = re.compile(r"^\*\*(?P<name>[^*\n]+?)(?::\*\*|\*\*:)\s*(?P<text>.*)$")
_STRICT_TURN = re.compile(r"^\*\*(?P<name>[^*\n]+?):\*\*\s*(?P<text>.*)$")
CHUNK_SCHEMA = "document_id long, chunk_index int, heading string, content string"


def sections(lines: DataFrame) -> DataFrame:
    """(document_id, section, heading, body): lines cut at headers of level two and three.
    lines: (document_id, line_no, line)."""
    is_header = F.col("line").rlike(r"^#{2,3}\s+\S")
    w = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("header", is_header).withColumn("section", F.sum(F.col("header").cast("int")).over(w))
    heading = F.max(F.when(F.col("header"), F.trim(F.regexp_replace("line", r"^#{2,3}\s+", ""))))
    body = F.array_sort(F.collect_list(F.when(~F.col("header"), F.struct("line_no", "line"))))
    grouped = marked.groupBy("document_id", "section").agg(heading.alias("heading"), body.alias("body"))
    return grouped.select("document_id", "section", "heading", F.trim(F.array_join(F.transform("body", lambda x: x["line"]), "\n")).alias("body"))


def split_sections(body: str) -> list[tuple[str | None, str]]:
    """(heading, text) of a note."""
    found: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in body.split("\n"):
        if m := _HEADER.match(line):
            found.append((m[1].strip(), []))
        else:
            found[-1][1].append(line)
    return [(h, "\n".join(ls).strip()) for h, ls in found if "\n".join(ls).strip()]


def packed(text: str, limit: int = MAX_TOKENS) -> list[str]:
    """Paragraphs packed up to an estimated number of tokens; one that is larger stays whole."""
    parts: list[str] = []
    for p in re.split(r"\n\s*\n", text):
        joined = f"{parts[-1]}\n\n{p}" if parts else p
        if parts and len(joined) // 4 <= limit:
            parts[-1] = joined
        else:
            parts.append(p)
    return parts


def note_chunks(title: str, body: str) -> list[tuple[str | None, str]]:
    """(heading, content) of a note: its sections, long ones split, each under the title."""
    body = re.sub(r"\A---\n.*?\n---\n?", "", body, flags=re.DOTALL)
    found = [(h, f"{title}\n{part}") for h, text in split_sections(body) if text not in TRIVIAL for part in packed(text)]
    return found or ([(None, f"{title}\n{body.strip()}")] if body.strip() else [])


def speaker_turns(body: str, strict: bool = False) -> list[tuple[str, str]]:
    """(speaker, text) of a transcript; lines without a speaker continue the turn before."""
    found: list[list[str]] = []
    for line in body.split("\n"):
        if m := (_STRICT_TURN if strict else _TURN).match(line):
            found.append([m["name"].strip(), m["text"].strip()])
        elif found and line.strip():
            found[-1][1] = f"{found[-1][1]} {line.strip()}".strip()
    return [(a, b) for a, b in found if b]


def participants(title: str) -> list[str]:
    """Who a title names: what stands between ` / `, ` x `, ` & ` or ` vs `, but `me`."""
    names = [p.strip() for p in re.split(r"\s+(?:/|x|&|vs)\s+", title, flags=re.IGNORECASE)]
    return [p for p in names if p and p.lower() != "me"]


def named_system(turns: list[tuple[str, str]], others: list[str]) -> list[tuple[str, str]]:
    """`System` becomes the one participant, or `Other` if there are several."""
    name = "System" if not others else others[0] if len(others) == 1 else "Other"
    return [(name if s == "System" else s, t) for s, t in turns]


def transcript_windows(turns: list[tuple[str, str]], size: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """Windows of whole turns, taken until `size` characters are reached; the next begins as many turns back as reach
    `overlap`, or behind the window where that would be its start."""
    lines = [f"{s}: {t}" for s, t in turns]
    found, start = [], 0
    while start < len(lines):
        end, chars = start, 0
        while end < len(lines) and chars < size:
            chars += len(lines[end]) + 1
            end += 1
        found.append("\n".join(lines[start:end]))
        if end == len(lines):
            break
        back, shared = end, 0
        while back > start and shared < overlap:
            back -= 1
            shared += len(lines[back]) + 1
        start = back if back > start else end
    return found


def transcript_chunks(title: str, body: str) -> list[tuple[str | None, str]]:
    """(heading, content) of a transcript: its windows, or the whole text where it has no turns, under the title."""
    body = re.sub(r"\A---\n.*?\n---\n?", "", body, flags=re.DOTALL)
    turns = named_system(speaker_turns(body), participants(title))
    parts = transcript_windows(turns) or ([body.strip()] if body.strip() else [])
    return [(None, f"{title}\n{part}") for part in parts]


def chunked(docs: DataFrame) -> DataFrame:
    """Chunks of documents (id, title, doc_type, text): transcripts by windows, others by sections."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d in batch.itertuples(index=False):
                title, body = d.title or "", d.text or ""
                parts = (transcript_chunks if d.doc_type == "transcript" else note_chunks)(title, body)
                rows += [(d.id, i, h, c) for i, (h, c) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "heading", "content"])

    ready(docs.sparkSession)
    return docs.select("id", "title", "doc_type", "text").mapInPandas(run, CHUNK_SCHEMA)


def merged_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, run, role, text, n): consecutive turns of one speaker as one. turns: (conv_id, turn, role, text)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    change = F.when(F.lag("role").over(w).eqNullSafe(F.col("role")) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = turns.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).withColumn("change", change)
    runs = runs.withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return runs.groupBy("conv_id", "run").agg(F.first("role").alias("role"), F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"), F.count(F.lit(1)).alias("n"))


def summaries(docs: DataFrame) -> DataFrame:
    """(document_id, heading, content): a summary chunk for each document but people, projects, context and glossary;
    long transcripts are cut in the middle."""
    body = T.strip_frontmatter(F.col("text"))
    cut = F.concat(F.substring(body, 1, SUMMARY_HEAD), F.lit("..."), F.substring(body, F.length(body) - SUMMARY_TAIL + 1, F.lit(SUMMARY_TAIL)))
    content = F.when((F.col("doc_type") == "transcript") & (F.length(body) > SUMMARY_OVER), cut).otherwise(body)
    return docs.filter(~F.col("doc_type").isin(*NO_SUMMARY)).select(F.col("id").alias("document_id"), F.lit(SUMMARY_HEADING).alias("heading"), content.alias("content"))


def metadata_prefix(kind: str, title, date, entities):
    """`[Meeting: title | date | names]`, parts without a value left out."""
    names = F.when(F.size(entities) > 0, F.array_join(entities, ", "))
    return F.concat(F.lit(f"[{kind}: "), F.concat_ws(" | ", title, date.cast("string"), names), F.lit("]"))
