"""Wikilinks around names in markdown, and heads of files in YAML."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.operators import mentions
from noteloom.session import ready

LEAST = 5  # characters of a name that is linked


def linkable(entities: DataFrame) -> DataFrame:
    """(entity_id, name): names of two or more words and five or more characters, no file stems; of names that
    differ by case alone, that of the least entity."""
    names = mentions.names_of(entities).filter((F.col("words") >= 2) & (F.length("name") >= LEAST) & ~mentions.is_stem(F.col("name")))
    least = F.min(F.struct("entity_id", "place", "name"))
    return names.groupBy(F.lower("name").alias("low")).agg(least.alias("x")).select("x.entity_id", "x.name")


def wikilinked(text: str, names: list[str]) -> str:
    """The text with names as [[links]], longer names first and nothing linked twice; front matter, titles and code stay."""
    if not names:
        return text
    ordered = sorted(set(names), key=lambda n: (-len(n), n))
    as_is = {n.lower(): n for n in ordered}
    ends = [re.escape(n) + (r"\b" if re.match(r"\w", n[-1]) else r"(?!\w)") for n in ordered]
    pattern = re.compile(r"\[\[[^\]]*\]\]|\b(" + "|".join(ends) + ")", re.IGNORECASE)  # what is linked already is stepped over
    head = re.match(r"---\s*\n.*?\n---\s*\n", text, re.DOTALL)
    start = head.end() if head else 0
    out, code = [], False
    for line in text[start:].split("\n"):
        fence = line.strip().startswith("```")
        code ^= fence
        keep = fence or code or re.match(r"#\s+", line)
        out.append(line if keep else pattern.sub(lambda m: f"[[{as_is.get(m[1].lower(), m[1])}]]" if m[1] else m[0], line))
    return text[:start] + "\n".join(out)


def with_wikilinks(files: DataFrame, entities: DataFrame) -> DataFrame:
    """Files (path, text, ...) with names of entities linked. Each file is searched only for names that it has."""
    ready(files.sparkSession)
    found = mentions.occurrences(files.select("path", F.coalesce("text", F.lit("")).alias("text")), linkable(entities), ["path"])
    listed = found.groupBy("path").agg(F.collect_set("name").alias("_names"))

    @F.pandas_udf("string")
    def rewritten(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or n is None else wikilinked(t, list(n)) for t, n in zip(texts, names, strict=True)], dtype=object)

    return files.join(listed, "path", "left").withColumn("text", rewritten("text", "_names")).drop("_names")


def yaml_head(name: str, fields: dict) -> str:
    """A head in YAML with a title below it; fields without a value are left out."""
    import yaml

    kept = {k: v for k, v in fields.items() if v is not None and v != "" and v != [] and not (k == "pinned" and v is False)}
    shown = yaml.dump(kept, default_flow_style=False, allow_unicode=True, sort_keys=False) if kept else ""
    return f"---\n{shown}---\n# {name}\n\n"


def migrated(text: str) -> str:
    """A file whose head is `**Key:** value` lines, with that head in YAML; files with front matter stay as they are."""
    if text.startswith("---\n"):
        return text
    at = re.search(r"(?m)^## ", text)
    head, body = (text[: at.start()], text[at.start() :]) if at else (text, "")
    title = re.search(r"(?m)^# +(.+)$", head)
    shape = r"(?m)^\*\*([^*:\n]+):\*\*[ \t]*(.*)$"
    pairs = re.findall(shape, head)
    if not title or not pairs:
        return text
    fields: dict = {}
    for key, value in pairs:
        low, value = key.strip().lower(), value.strip()
        if low in ("also known as", "codename/also called"):
            fields.setdefault("aliases", [a.strip() for a in value.split(",") if a.strip()])
        elif low == "pinned":
            fields.setdefault("pinned", value.lower() in ("true", "yes", "1"))
        else:
            fields.setdefault(low.replace(" ", "_"), value)
    rest = re.sub(shape + r"\n?", "", head).replace(title[0], "", 1).strip("\n")
    return yaml_head(title[1].strip(), fields) + (rest + "\n\n" if rest else "") + body
