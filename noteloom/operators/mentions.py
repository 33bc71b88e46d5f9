"""Which entities a document mentions: by tags, source ids, title participants, titles and texts, with bare first names
that several entities share kept only where something else in the document speaks for the entity.

Names are sought by equality of runs of pieces, never by a pattern for each name: a text is cut into runs of word
characters and runs of others, and a name is found where its own pieces follow one another. A run of word characters is
whole by construction, so a name never begins or ends inside a word."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.operators import linking

# Words that name teams as well, found in contents only as they are written; separators of participants.
COMMON_WORDS = ("product", "data", "design", "staff", "security", "core", "sources", "quality", "applied", "front", "incidents", "machine")
SEPARATORS = r"(?i)\s+(?:/|x|&|vs)\s+"
SOURCE = "src:"

WORD = r"[\p{L}\p{N}_]"
PIECES = rf"{WORD}+|[^\p{{L}}\p{{N}}_]+"
# Where a name was found, beside the participants, that are numbered from 0.
BODY, TITLE, TAG, REFERENCE, ATTENDEE = -1, -2, -3, -4, -5
#: Most beginnings of source ids that a pattern holds; shorter beginnings are taken beyond it.
BEGINNINGS = 4096


def names_of(entities: DataFrame) -> DataFrame:
    """(entity_id, place, name, words, bare, folded, shared): names and aliases in order, with what the rules ask of them.

    entities: (id, name, aliases). `bare` is a single first name that can be ambiguous; `shared` is a folded name that two
    or more entities have as a bare one."""
    every = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = entities.select(F.col("id").alias("entity_id"), F.posexplode(every).alias("place", "name")).filter("name is not null and trim(name) <> ''")
    n = F.col("name")
    words = F.size(F.split(F.trim(n), r"\s+"))
    bare = (words == 1) & (F.length(n) >= 4) & ~is_stem(n) & ~(is_capital(n) & (F.length(n) <= 4)) & ~F.lower(n).isin(*COMMON_WORDS) & ~n.startswith(SOURCE)
    rows = rows.withColumns({"words": words, "bare": bare, "folded": T.fold_column(n)})
    w, owner = Window.partitionBy("folded"), F.when(F.col("bare"), F.col("entity_id"))
    return rows.withColumn("shared", F.coalesce(F.min(owner).over(w) != F.max(owner).over(w), F.lit(False)))


def is_stem(name: Column) -> Column:
    """A file stem, as `anna-lind`."""
    return name.contains("-") & (F.lower(name) == name)


def is_capital(name: Column) -> Column:
    return (F.upper(name) == name) & (F.lower(name) != name)


def in_contents(name: Column, words: Column, as_written: Column) -> Column:
    """Whether a name that a content has counts there.

    Names of one character, file stems, and first names of up to three letters don't. Capitals of up to four characters
    and common words count only as they are written; all else whatever its case."""
    capital = is_capital(name) & (F.length(name) <= 4)
    short = (words == 1) & (F.length(name) <= 3) & name.rlike(r"^\p{Lu}\p{Ll}{1,2}$")
    exact = capital | ((words == 1) & F.lower(name).isin(*COMMON_WORDS))
    return (F.length(name) >= 2) & ~is_stem(name) & (capital | ~short) & (~exact | as_written)


def occurrences(texts: DataFrame, names: DataFrame, key: list[str]) -> DataFrame:
    """`key` with the columns of names and `as_written`: whole names that a text has, whatever their case, once each.

    A name that ends in a mark, as `Anna L.`, ends where no word character follows; one that begins with a mark is not
    found. texts: (*key, text); names: (entity_id, name, ...)."""
    cut = F.regexp_extract_all("name", F.lit(PIECES), F.lit(0))
    starts = names.filter(F.col("name").rlike(f"^{WORD}")).withColumn("_p", cut)
    mark = ~F.element_at("_p", -1).rlike(WORD)
    starts = starts.withColumns({"_tail": F.when(mark, F.element_at("_p", -1)).otherwise(""), "_n": F.size("_p") - mark.cast("int")})
    starts = starts.withColumns({"_core": F.array_join(F.slice("_p", F.lit(1), F.col("_n")), ""), "_l": F.transform("_p", F.lower)})
    starts = starts.withColumn("_gram", F.lower("_core"))

    def slot(first, second, n):
        """The place in the table of a name's first word, second word and number of pieces."""
        return F.pmod(F.xxhash64(first, F.when(n >= 3, second).otherwise(""), n), F.lit(linking.SIFT))

    told = starts.agg(
        F.collect_set("_n").alias("n"), F.count(F.lit(1)).alias("names"),
        F.collect_set(slot(F.get("_l", F.lit(0)), F.get("_l", F.lit(2)), F.col("_n"))).alias("at"),
        F.collect_set(linking.first_slot(F.get("_l", F.lit(0)))).alias("first")).first()  # SIFT at most
    lengths, begins, firsts = sorted(told["n"]) or [1], linking.table_of(told["at"]), linking.table_of(told["first"])
    # Words and what is between them alternate, so every second piece may begin a name; lengths that no name with these two
    # words has are left out, so that few runs are made which are no names.
    pieces = texts.select(*key, F.regexp_extract_all("text", F.lit(PIECES), F.lit(0)).alias("_t"))  # a filter on the pieces would cut every text twice
    odd = F.when(F.get("_t", F.lit(0)).rlike(f"^{WORD}"), 1).otherwise(2)
    at = F.when(odd <= F.size("_t"), F.sequence(odd, F.size("_t"), F.lit(2)))
    low = lambda i: F.lower(F.get("_t", i))
    at = F.filter(at, lambda i: linking.in_table(firsts, linking.first_slot(low(i - 1))))

    def known(i, n):
        return (i + n - 1 <= F.size("_t")) & linking.in_table(begins, slot(low(i - 1), low(i + 1), n))

    def gram(x):
        raw = F.array_join(F.slice("_t", x["i"], x["n"]), "")
        return F.struct(raw.alias("raw"), F.coalesce(F.get("_t", x["i"] + x["n"] - 1), F.lit("")).alias("behind"), (x["i"] + x["n"] >= F.size("_t")).alias("last"))

    runs = F.flatten(F.transform(at, lambda i: F.filter(F.array(*[F.struct(i.alias("i"), F.lit(n).alias("n")) for n in lengths]), lambda x: known(x["i"], x["n"]))))
    found = pieces.select(*key, F.explode(F.transform(runs, gram)).alias("_g"))
    found = found.select(*key, F.lower("_g.raw").alias("_gram"), F.col("_g.raw").alias("_raw"), F.col("_g.behind").alias("_behind"), F.col("_g.last").alias("_last"))
    starts = starts.drop("_l", "_p", "_n")
    joined = found.join(F.broadcast(starts) if told["names"] <= linking.FEW_NAMES else starts, "_gram")
    longer = (F.length("_behind") > F.length("_tail")) | F.col("_last")
    fits = (F.col("_tail") == "") | (F.lower("_behind").startswith(F.lower("_tail")) & longer)
    written = (F.col("_raw") == F.col("_core")) & F.col("_behind").startswith(F.col("_tail"))
    return joined.filter(fits).groupBy(*key, *names.columns).agg(F.max(written).alias("as_written"))


def source_references(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(document_id, entity_id): contents that have a source id, as it is written, anywhere.

    Texts are looked through once for the beginnings of ids, and what follows a beginning is joined to ids by it."""
    ids = names.filter(F.col("name").startswith(SOURCE)).select("entity_id", F.substring("name", len(SOURCE) + 1, 1 << 30).alias("sid")).filter("sid <> ''").distinct()
    bounds = ids.agg(F.max(F.length("sid")).alias("most"), F.min(F.length("sid")).alias("least")).first()
    if bounds["most"] is None:
        return docs.select(F.col("id").alias("document_id")).limit(0).crossJoin(ids.select("entity_id").limit(0))
    for lead in range(min(3, bounds["least"]), 0, -1):
        begins = [r["b"] for r in ids.select(F.substring("sid", 1, lead).alias("b")).distinct().limit(BEGINNINGS + 1).collect()]
        if len(begins) <= BEGINNINGS or lead == 1:
            break
    if len(begins) > BEGINNINGS:  # more first characters than that: any character may begin an id
        seek = rf"(?s)(?=(.{{1,{bounds['most']}}}))"
    else:
        seek = rf"(?s)(?=((?:{'|'.join(re.escape(x) for x in sorted(begins))}).{{0,{bounds['most'] - lead}}}))"
    windows = F.array_distinct(F.regexp_extract_all("text", F.lit(seek), F.lit(1)))
    cut = docs.select(F.col("id").alias("document_id"), F.explode(windows).alias("w")).withColumn("b", F.substring("w", 1, lead))
    joined = cut.join(ids.withColumn("b", F.substring("sid", 1, lead)), "b").filter(F.col("w").startswith(F.col("sid")))
    return joined.select("document_id", "entity_id").distinct()


def find(docs: DataFrame, entities: DataFrame, suppressions: DataFrame | None = None) -> DataFrame:
    """(entity_id, document_id, mention_type), once each: tagged, source_ref, participant, title, discussed.

    A bare first name of two or more entities counts only for an entity that the document has by a tag, a source id, a
    name of several words, as a whole participant, or among its attendees. docs: (id, title, tags, text, attendees);
    entities: (id, name, aliases); suppressions: (document_id, entity_id). Null parts of a document are empty."""
    names = names_of(entities)
    doubtful = F.col("bare") & F.col("shared")
    doc = F.col("id").alias("document_id")
    full, title = F.coalesce("text", F.lit("")), F.coalesce("title", F.lit(""))
    yes, no = F.lit(True), F.lit(False)

    def evidence(rows: DataFrame, scope: Column, kind: Column, doubt: Column, place: Column, weak: Column) -> DataFrame:
        return rows.select("entity_id", "document_id", scope.cast("int").alias("scope"), kind.alias("kind"), doubt.alias("doubt"), place.cast("int").alias("place"), weak.alias("weak"))

    # Names as a whole: tags and participants whatever their case, attendees whatever their accents.
    parts = F.filter(F.transform(F.split(title, SEPARATORS), lambda p: F.trim(p)), lambda p: p != "")
    asked = lambda c, scope: F.transform(c, lambda x, i: F.struct(scope(i).cast("int").alias("scope"), F.lower(F.trim(x)).alias("key")))
    equal = docs.select(doc, F.inline(F.concat(asked(F.coalesce("tags", F.array().cast("array<string>")), lambda i: F.lit(TAG)), asked(parts, lambda i: i)))).filter("key <> ''").distinct()
    present = docs.select(doc, F.explode("attendees").alias("who")).filter("who is not null").select("document_id", F.lit(ATTENDEE).alias("scope"), T.fold_column(F.col("who")).alias("key")).filter("key <> ''").distinct()
    kinds = F.array(F.struct(no.alias("fold"), F.lower("name").alias("key")), F.struct(yes.alias("fold"), F.col("folded").alias("key")))
    keyed = names.select("*", F.inline(kinds))
    whole = equal.unionByName(present).withColumn("fold", F.col("scope") == ATTENDEE).join(keyed, ["fold", "key"])
    part = F.col("scope") >= 0
    kind = F.when(F.col("scope") == TAG, "tagged").when(part, "participant")
    told = evidence(whole, F.col("scope"), kind, doubtful & part, F.when(part, F.col("place")).otherwise(0), no)

    # Names inside participants, titles and contents, in one pass.
    pieces = F.transform(parts, lambda p, i: F.struct(i.cast("int").alias("scope"), p.alias("text")))
    rest = F.array(F.struct(F.lit(TITLE).alias("scope"), title.alias("text")), F.struct(F.lit(BODY).alias("scope"), full.alias("text")))
    has = occurrences(docs.select(doc, F.inline(F.concat(pieces, rest))), names, ["document_id", "scope"])
    n, scope, several = F.col("name"), F.col("scope"), F.col("words") >= 2
    has = has.filter(F.when(scope == BODY, in_contents(n, F.col("words"), F.col("as_written"))).when(scope == TITLE, (F.length(n) > 3) & ~is_stem(n)).otherwise(F.length(n) >= 4))
    # In a content any name of several words is evidence; elsewhere the first name, in order, that is not doubtful decides.
    inside = evidence(
        has, scope, F.when(scope == BODY, "discussed").when(scope == TITLE, "title").otherwise("participant"), F.when(scope == BODY, ~several & F.col("shared")).otherwise(doubtful),
        F.when(scope == BODY, (~several).cast("int")).otherwise(F.col("place")), ~several)
    referred = evidence(source_references(docs.select("id", full.alias("text")), names), F.lit(REFERENCE), F.lit("source_ref"), no, F.lit(0), no)

    every = told.unionByName(inside).unionByName(referred)
    first = F.min(F.when(~F.col("doubt"), F.struct("place", "weak")))
    decided = every.groupBy("entity_id", "document_id", "scope", "kind").agg(first.alias("f"))
    firm = F.col("f").isNotNull()
    summed = decided.groupBy("entity_id", "document_id").agg(
        F.collect_set(F.when(firm, F.col("kind"))).alias("sure"), F.collect_set(F.when(~firm, F.col("kind"))).alias("doubt"), F.max(firm & ~F.col("f.weak")).alias("proof"))
    kept = F.when(F.coalesce("proof", no), F.array_union("sure", "doubt")).otherwise(F.col("sure"))
    found = summed.select("entity_id", "document_id", F.explode(kept).alias("mention_type"))
    return found if suppressions is None else linking.without_suppressed(found, suppressions).select(*found.columns)
