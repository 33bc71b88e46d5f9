"""Snippets, marks, suggestions, and small parsers of keywords, sources and key-value texts."""

from __future__ import annotations

import ast
import difflib
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions import text as T

BEFORE = 50  # characters before the first hit
LEAD = 30  # a cut word at the front is dropped if it is shorter
SIMILAR = 0.45


def snippet(content: Column, words: list[str], size: int = 200) -> Column:
    """A window of plain content around the first query word that it has, cut at spaces, with dots where text is missing."""
    plain = T.strip_wikilinks(T.strip_metadata_prefix(content))
    found = [F.regexp_instr(plain, F.lit(T.literal_pattern(w.rstrip("*"), True))) for w in words if w.rstrip("*")]
    first = F.lit(0)
    for at in reversed(found):
        first = F.when(at > 0, at).otherwise(first)
    start = F.greatest(first - 1 - BEFORE, F.lit(0))
    window = F.substring(plain, start + 1, F.lit(size))
    gap = F.instr(window, " ")
    window = F.when((start > 0) & (gap > 0) & (gap <= LEAD), F.substring(window, gap + 1, F.lit(size))).otherwise(window)
    more = start + size < F.length(plain)
    window = F.when(more, F.concat(F.regexp_replace(window, r" [^ ]*$", ""), F.lit("..."))).otherwise(window)
    window = F.when(start > 0, F.concat(F.lit("..."), window)).otherwise(window)
    return F.when(F.length(plain) <= size, plain).otherwise(window)


def highlighted(content: Column, words: list[str]) -> Column:
    """Content safe for a page, with query words as whole words in <mark>, longer words first, none marked twice."""
    safe = content
    for raw in "&<>\"'":
        safe = F.replace(safe, F.lit(raw), F.lit(html.escape(raw)))
    terms = sorted({w.rstrip("*").lower() for w in words if w.rstrip("*")}, key=lambda w: (-len(w), w))
    if not terms:
        return safe
    # a word inside the escape of a sign, as amp in &amp;, is no word of the content
    pattern = "(?iu)(?<![\\p{L}\\p{N}_&#])(" + "|".join(re.escape(html.escape(w)) for w in terms) + ")(?![\\p{L}\\p{N}_])"
    return F.regexp_replace(safe, pattern, "<mark>$1</mark>")


def suggested(names: DataFrame, wanted: str, most: int = 3) -> DataFrame:
    """(name, likeness): the names most like a wanted one; those that hold it, or that it holds, come first. names: (name)."""
    low = wanted.lower()

    def ratio(name: str) -> float:
        other = name.lower()
        if low in other or other in low:
            return 1.0
        return max(difflib.SequenceMatcher(None, low, x).ratio() for x in [other, *other.split()])

    @F.pandas_udf("double")
    def likeness(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda n: 0.0 if n is None else ratio(n))

    scored = names.select("name").distinct().withColumn("likeness", likeness("name"))
    return scored.filter(F.col("likeness") >= SIMILAR).orderBy(F.desc("likeness"), "name").limit(most)


def keywords(raw: object) -> list[str]:
    """Lower-cased keywords of a list, the text of a list, or a text with commas."""
    if isinstance(raw, str) and raw.strip().startswith("[") and raw.strip().endswith("]"):
        try:
            raw = ast.literal_eval(raw.strip())
        except (ValueError, SyntaxError):
            pass
    if isinstance(raw, str):
        raw = raw.split(",")
    if not isinstance(raw, list):
        return []
    return [k for k in (str(x).strip().lower() for x in raw) if k]


def source_entries(metadata: dict) -> list[dict]:
    """The well-formed entries under `sources`."""
    found = metadata.get("sources")
    return [s for s in found if isinstance(s, dict) and "type" in s] if isinstance(found, list) else []


def source_ids(metadata: dict) -> list[str]:
    """Distinct ids, keys and channels of at least three characters, in order."""
    values = (s.get(k) for s in source_entries(metadata) for k in ("id", "key", "channel"))
    return list(dict.fromkeys(v for v in values if isinstance(v, str) and len(v) >= 3))


def source_argument(raw: str) -> dict[str, str]:
    """`type:url` or `type:key=value,...`."""
    kind, _, rest = (x.strip() for x in raw.partition(":"))
    if not kind or not rest:
        raise ValueError(f"not of the form type:url or type:key=value: {raw!r}")
    if re.match(r"https?://", rest):
        return {"type": kind, "url": rest}
    pairs = (p.partition("=") for p in rest.split(","))
    return {"type": kind} | {k.strip(): v.strip() for k, _, v in pairs if k.strip() and v.strip()}


def source_line(source: dict) -> str:
    """`type: label — url`, parts without a value left out."""
    kind, url, channel = source["type"], source.get("url", ""), source.get("channel", "")
    label = next((source[k] for k in ("name", "label", "key", "repo", "id") if source.get(k)), "")
    if label and channel and kind == "slack":
        return f"  {kind}: {label} ({channel})"
    return f"  {kind}: " + (" — ".join(x for x in (label, url) if x) or channel or "(no details)")


def key_values(raw: Column) -> Column:
    """`k=v; k2=v2` as a map; without semicolons, commas divide if there are several pairs. Of a key the last value stays."""
    several = F.length(F.regexp_replace(raw, "[^=]", "")) > 1
    pairs = F.when(raw.contains(";"), F.split(raw, ";")).when(several, F.split(raw, ",")).otherwise(F.array(raw))
    cut = F.transform(F.filter(pairs, lambda p: p.contains("=")), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))
    named = F.filter(cut, lambda p: p["k"] != "")
    last = F.filter(named, lambda p, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda q: q["k"] == p["k"]))
    return F.when(raw.isNull() | (raw == ""), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).otherwise(F.map_from_entries(last))


def path_category(path: Column) -> Column:
    """meeting, entity, note or other, by where a file lies."""
    return F.when(path.startswith("meetings/"), "meeting").when(path.startswith("people/") | path.startswith("projects/"), "entity").when(path.startswith("notes/"), "note").otherwise("other")


def short_name(name: Column, aliases: Column) -> Column:
    """The shortest of a name and its aliases of at least two characters that are no file stems; of equals the first."""
    usable = F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: (F.length(a) >= 2) & ~(a.contains("-") & (F.lower(a) == a)))
    return F.aggregate(usable, name, lambda best, a: F.when(F.length(a) < F.length(best), a).otherwise(best))


def shortened(role: Column, most: int = 20) -> Column:
    return F.when(F.length(role) > most, F.concat(F.substring(role, 1, most - 3), F.lit("..."))).otherwise(role)


def own_aliases(name: Column, aliases: Column) -> Column:
    """Aliases that someone gave: no file stems, no source ids, and not the first word of a longer name."""
    first = F.when(F.trim(name).contains(" "), F.get(F.split(F.trim(name), r"\s+"), F.lit(0)))
    return F.filter(aliases, lambda a: ~(a.contains("-") & (F.lower(a) == a)) & ~a.startswith("src:") & ~F.coalesce(a == first, F.lit(False)))


def linked(value: Column) -> Column:
    """A reference to an entity as a wikilink, once."""
    return F.when(value.contains("[["), value).otherwise(F.concat(F.lit("[["), value, F.lit("]]")))
