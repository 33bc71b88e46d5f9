"""Text functions as column expressions; Python only where Unicode tables are needed."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def profile_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def strip_wikilinks(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", "$1")


def strip_markdown(text: Column) -> Column:
    """Plain text of a line: links, emphasis and code marks removed, white space collapsed."""
    out = F.regexp_replace(text, r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", "$1")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"[*_`]+", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def strip_metadata_prefix(text: Column) -> Column:
    return F.regexp_replace(text, r"^\[(?:Meeting|Transcript|Summary): [^\]]*\]\s*", "")


def strip_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"^---\n(?s:.*?)\n---\n?", "")


def strip_emojis(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\p{So}\x{200D}\x{FE0F}]", ""))


def file_stem(title: Column, uid: Column) -> Column:
    """Safe file name of a remote note."""
    safe = F.regexp_replace(F.replace(strip_emojis(title), F.lit("/"), F.lit("___")), r"[^\p{L}\p{N}_-]+", "_")
    return F.concat_ws("-", F.substring(uid, 1, 8), F.regexp_replace(safe, "^_+|_+$", ""))


def slug(name: Column, limit: int | None = None) -> Column:
    """Lower case words without accents, joined by hyphens."""
    out = F.regexp_replace(F.regexp_replace(fold_column(name), r"[^a-z0-9\s-]", ""), r"[\s-]+", "-")
    out = F.regexp_replace(out, "^-+|-+$", "")
    return out if limit is None else F.regexp_replace(F.substring(out, 1, limit), "-+$", "")


def title_from_stem(stem: Column) -> Column:
    return F.initcap(F.regexp_replace(stem, "[-_]+", " "))


def name_from_email(email: Column) -> Column:
    """First.Last@host -> First Last."""
    parts = F.array_remove(F.split(F.element_at(F.split(email, "@"), 1), "[._-]+"), "")
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), " ")


def first_paragraph(text: Column, least: int = 20, cap: int = 500) -> Column:
    """First paragraph with some length that is no heading."""
    paragraphs = F.transform(F.split(strip_frontmatter(text), r"\n\s*\n"), lambda p: strip_markdown(p))
    good = F.filter(paragraphs, lambda p: (F.length(p) >= least) & ~p.startswith("#"))
    return F.substring(F.get(good, F.lit(0)), 1, cap)


def first_sentence(text: Column, title: Column, cap: int = 200) -> Column:
    """Abstract: the first sentence of the first usable paragraph, else the title."""
    sentence = F.regexp_extract(first_paragraph(text), r"^(.*?[.!?])(?=\s+\p{Lu}|$)", 1)
    found = F.when(sentence == "", first_paragraph(text)).otherwise(sentence)
    return F.substring(F.coalesce(found, title), 1, cap)


def field(text: Column, name: str) -> Column:
    """Value of a `**Name:** value` line."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^\*\*{re.escape(name)}:\*\*[ \t]*(.*)$", 1)), F.lit(""))


def fields(text: Column) -> Column:
    """All `**Name:** value` lines as a map."""
    pattern = r"(?m)^\*\*([^*:\n]+):\*\*[ \t]*(.*)$"
    keys = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda k: F.lower(F.trim(k)))
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda v: F.trim(v))
    pairs = F.arrays_zip(keys.alias("key"), values.alias("value"))
    first_wins = F.aggregate(
        pairs, F.array().cast("array<struct<key:string,value:string>>"),
        lambda a, p: F.when(F.exists(a, lambda x: x["key"] == p["key"]), a).otherwise(F.concat(a, F.array(p))))
    return F.map_from_entries(first_wins)


def project_link(text: Column) -> Column:
    """Lower-cased value of the first `project:` line."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(text, r"(?im)^project:[ \t]*(.+)$", 1))), F.lit(""))


def literal_count(text: Column, term: str, word_boundary: bool = False, ignore_case: bool = True) -> Column:
    return F.regexp_count(text, F.lit(literal_pattern(term, word_boundary, ignore_case)))


def literal_pattern(term: str, word_boundary: bool = False, ignore_case: bool = True) -> str:
    """A pattern for a term as it is written, whole words if wanted, with explicit Unicode classes."""
    core = re.escape(term)
    if word_boundary:
        core = rf"(?<![\p{{L}}\p{{N}}_]){core}(?![\p{{L}}\p{{N}}_])"
    return ("(?iu)" if ignore_case else "") + core


def glob_pattern(pattern: str) -> str:
    """LIKE pattern of a path glob: * and ? are wild, a trailing slash means everything below."""
    like = pattern.replace("*", "%").replace("?", "_")
    return like + "%" if like.endswith("/") else like


def fold(text: str) -> str:
    """NFKD, ASCII only, lower case."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()


def fold_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def folded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fold(x))

    return folded(text)


def nfc_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return composed(text)
