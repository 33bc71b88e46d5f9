"""Remote notes: adapters from payloads to documents, and a paged reader.

No network is used here; a client is any callable that gives a page for a cursor."""

from __future__ import annotations

import re
import time
import warnings
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = "struct<speaker:string,source:string,text:string,start_timestamp:string,end_timestamp:string>"


def pages(fetch: Callable[[str | None], dict], since: str | None = None, newest_first: bool = False) -> Iterator[dict]:
    """Notes of a cursor-paged client, those updated at `since` or later; if they come newest first, the read ends with the
    first page that has an older one. A page that doesn't say whether there are more,
    or a cursor that stands still, raises, as what was read would pass for the whole; more without a cursor ends it with a
    warning."""
    cursor = None
    while True:
        page = fetch(cursor)
        yield from (n for n in page.get("notes", []) if since is None or (n.get("updated_at") or "") >= since)
        if "hasMore" not in page:
            raise ValueError(f"a page without hasMore: {sorted(page)}")
        following = page.get("cursor")
        if not page["hasMore"] or newest_first and since is not None and any((n.get("updated_at") or "") < since for n in page.get("notes", [])):
            return
        if not following:
            warnings.warn("more notes were announced without a cursor; reading ends here", stacklevel=2)
            return
        if following == cursor:
            raise ValueError(f"the cursor stands still at {cursor!r}")
        cursor = following


def offset_pages(fetch: Callable[[int, int], list[dict]], since: str | None = None, size: int = 50, field: str = "updated_at") -> Iterator[dict]:
    """Notes of a client that is paged by offset, newest first, those of `since` or later. A page whose last note is older
    ends the read, as does one that isn't full."""
    offset = 0
    while True:
        page = fetch(offset, size)
        yield from (n for n in page if since is None or (n.get(field) or "") >= since)
        older = since is not None and page and (page[-1].get(field) or "") < since
        if len(page) < size or older:
            return
        offset += len(page)


def token_pages(fetch: Callable[[str | None], dict], since: str | None = None, key: str = "id", field: str = "date") -> Iterator[dict]:
    """Entries of a client that gives a token for the next page, each id once, those of `since` or later, without those that
    are still being transcribed. A token that comes again raises."""
    token, seen, tokens = None, set(), set()
    while True:
        page = fetch(token)
        for entry in page.get("entries", []):
            if entry.get(key) not in seen and entry.get("status") != "transcribing":
                seen.add(entry.get(key))
                if since is None or (entry.get(field) or "") >= since:
                    yield entry
        token = page.get("next")
        if not token:
            return
        if token in tokens:
            raise ValueError(f"the token {token!r} comes again")
        tokens.add(token)


class Refused(Exception):
    """A client that asks to wait (`after` seconds, if it says how long)."""

    def __init__(self, after: float | None = None):
        super().__init__(f"retry after {after}")
        self.after = after


def with_retries(fetch: Callable, attempts: int = 4, first: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """A client that is asked again after it refused or lost the connection, each time after twice as long, or after what
    it says; the last failure is raised."""

    def asked(*args):
        for n in range(attempts):
            try:
                return fetch(*args)
            except (Refused, ConnectionError, TimeoutError) as e:
                if n == attempts - 1:
                    raise
                after = getattr(e, "after", None)
                sleep(first * 2**n if after is None else after)

    return asked


def high_water(notes: DataFrame) -> DataFrame:
    """One row: the newest updated_at, from which the next run starts."""
    return notes.agg(F.max("updated_at").alias("last_sync"), F.count(F.lit(1)).alias("n"))


def transcript_markdown(segments: DataFrame) -> DataFrame:
    """(id, body): runs of one speaker as `**Speaker**: text`; a diarised label wins over the microphone's.
    segments: (id, pos, speaker, source, text)."""
    own = segments.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("who", F.coalesce(F.nullif(F.trim("speaker"), F.lit("")), F.when(F.col("source") == "microphone", "Me").otherwise("System")))
    w = Window.partitionBy("id").orderBy("pos")
    change = F.when(F.lag("who").over(w) == F.col("who"), 0).otherwise(1)
    runs = own.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("text").alias("text")))), lambda x: x["text"]), " ")
    lines = runs.groupBy("id", "run").agg(F.concat(F.lit("**"), F.first("who"), F.lit("**: "), said).alias("line"))
    return lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "line"))), lambda x: x["line"]), "\n\n").alias("body"))


def attendees(notes: DataFrame) -> DataFrame:
    """(id, pos, name, email): creator first, rooms left out, one row for each email whatever its case.
    notes: (id, creator struct<name,email>, people array<struct<name,email>>)."""
    every = F.concat(F.array(F.col("creator")), F.coalesce("people", F.array().cast("array<struct<name:string,email:string>>")))
    rows = notes.select("id", F.posexplode(F.filter(every, lambda p: p["email"].isNotNull() & ~p["email"].contains("@resource."))).alias("pos", "p"))
    w = Window.partitionBy("id", F.lower("p.email")).orderBy("pos")
    from noteloom.functions.text import name_from_email

    named = F.coalesce(F.nullif("p.name", F.lit("")), name_from_email(F.col("p.email")))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("id", "pos", named.alias("name"), F.col("p.email").alias("email"))


def rich_text(node: dict, depth: int = 0) -> str:
    """Markdown of a rich-text tree."""
    kind, inner = node.get("type"), node.get("content") or []
    if kind == "text":
        out = node.get("text", "")
        for mark in node.get("marks") or []:
            name = mark.get("type")
            if name == "link":
                out = f"[{out}]({mark.get('attrs', {}).get('href', '')})"
            else:
                sign = {"bold": "**", "italic": "*", "code": "`", "strike": "~~"}.get(name, "")
                out = f"{sign}{out}{sign}"
        return out
    parts = [rich_text(n, depth + (kind in ("bulletList", "orderedList"))) for n in inner]
    body = "".join(parts)
    if kind == "heading":
        return "#" * node.get("attrs", {}).get("level", 1) + f" {body}\n\n"
    if kind == "paragraph":
        return body + "\n" * (1 if depth else 2)
    if kind in ("bulletList", "orderedList"):
        sign = (lambda i: "- ") if kind == "bulletList" else (lambda i: f"{i}. ")
        return "".join("  " * depth + sign(i) + p.strip("\n") + "\n" for i, p in enumerate(parts, 1)) + ("" if depth else "\n")
    if kind == "blockquote":
        return "".join(f"> {line}\n" for line in body.strip().split("\n")) + "\n"
    if kind == "codeBlock":
        return f"```\n{body}\n```\n\n"
    if kind == "horizontalRule":
        return "---\n\n"
    return body


def blocks_markdown(blocks: list[dict]) -> str:
    """Markdown of a flat list of blocks (type, text, checked)."""
    lines, number = [], 0
    for b in blocks:
        kind, text = b.get("type"), b.get("text", "")
        number = number + 1 if kind == "numbered_list" else 0
        lines.append({
            "header": f"### {text}", "sub_header": f"### {text}", "sub_sub_header": f"#### {text}", "bulleted_list": f"- {text}", "numbered_list": f"{number}. {text}",
            "to_do": f"- [{'x' if b.get('checked') else ' '}] {text}"}.get(kind, text))
    return "\n".join(line for line in lines if line)


def summary_section(markdown: str) -> str:
    """What stands under the first heading with `summary` in it."""
    found, inside = [], False
    for line in markdown.split("\n"):
        if line.startswith("#"):
            if inside:
                break
            inside = bool(re.search("summary", line, re.IGNORECASE))
        elif inside:
            found.append(line)
    return "\n".join(found).strip()
