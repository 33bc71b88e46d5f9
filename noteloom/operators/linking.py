"""Entity linking, disambiguation, attendees, task matching and term correction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import text as T


#: Bits of the hash of a first token by which places in a text are sifted.
SIFT = 1 << 16
#: Names and aliases up to this many are broadcast after they were counted; more are joined by shuffle.
FEW_NAMES = 100_000


def first_slot(first):
    """The place in a table of names' first tokens alone, by which most places of a text are passed over."""
    return F.pmod(F.xxhash64(first), F.lit(SIFT))


def table_of(places: list[int]) -> bytearray:
    """SIFT bytes, 1 at some places."""
    found = bytearray(SIFT)
    for at in places:
        found[at] = 1
    return found


def in_table(table: bytearray, slot):
    return F.substring(F.lit(table), (slot + 1).cast("int"), F.lit(1)) == F.lit(bytearray([1]))


def name_mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(entity_id, document_id, hits): names, of any number of tokens, that a document's text has.

    The text's token n-grams, of the lengths that names have, are joined to names on equality, so that names times
    documents is never formed. Only places whose first token is a name's, and whose first tokens and length are, by tables of
    SIFT bytes, are made into n-grams.
    docs: (id, text); names: (entity_id, name)."""
    wanted = names.select("entity_id", T.tokens(F.col("name")).alias("t")).filter(F.size("t") > 0)
    def slot(first, second, n):
        """The place in the table of a name's first two tokens and its number of tokens."""
        return F.pmod(F.xxhash64(first, F.when(n >= 2, second).otherwise(""), n), F.lit(SIFT))

    one = F.get("t", F.lit(0)), F.get("t", F.lit(1)), F.size("t")
    told = wanted.agg(F.collect_set(F.size("t")).alias("n"), F.collect_set(slot(*one)).alias("at"), F.collect_set(first_slot(one[0])).alias("first"), F.count(F.lit(1)).alias("names")).first()  # SIFT at most
    lengths, begins, firsts = sorted(told["n"]), table_of(told["at"]), table_of(told["first"])
    if not lengths:
        return wanted.select("entity_id", F.lit(None).cast(docs.schema["id"].dataType).alias("document_id"), F.lit(0).cast("long").alias("hits")).limit(0)
    wanted = wanted.select("entity_id", F.array_join("t", " ").alias("gram"))
    places = docs.select(F.col("id").alias("document_id"), T.tokens(F.col("text")).alias("t"))  # a filter on the tokens would cut every text twice

    def known(i, n):
        return (i + n - 1 <= F.size("t")) & in_table(begins, slot(F.get("t", i - 1), F.get("t", i), n))

    at = F.when(F.size("t") > 0, F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: in_table(firsts, first_slot(F.get("t", i - 1)))))
    runs = F.flatten(F.transform(at, lambda i: F.filter(F.array(*[F.struct(i.alias("i"), F.lit(n).alias("n")) for n in lengths]), lambda x: known(x["i"], x["n"]))))
    exploded = places.select("document_id", F.explode(F.transform(runs, lambda x: F.array_join(F.slice("t", x["i"], x["n"]), " "))).alias("gram"))
    per_document = exploded.groupBy("document_id", "gram").agg(F.count(F.lit(1)).alias("n"))  # a frequent name is counted before it is shuffled
    names = F.broadcast(wanted) if told["names"] <= FEW_NAMES else wanted
    return per_document.join(names, "gram").groupBy("entity_id", "document_id").agg(F.sum("n").alias("hits"))


def disambiguated(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Mentions by ambiguous first names stay only where the same entity is also mentioned in another way.

    mentions: (entity_id, document_id, name, strong); names: (entity_id, first_name)."""
    owners = names.groupBy("first_name").agg(F.countDistinct("entity_id").alias("owners"))
    ambiguous = mentions.join(owners, mentions["name"] == owners["first_name"], "left").withColumn("doubtful", ~F.col("strong") & (F.coalesce("owners", F.lit(1)) >= 2))
    sure = ambiguous.filter(~F.col("doubtful")).select("entity_id", "document_id").distinct()
    doubtful = ambiguous.filter("doubtful").select("entity_id", "document_id").distinct()
    return sure.unionByName(doubtful.join(sure, ["entity_id", "document_id"], "left_semi")).distinct()


def without_suppressed(mentions: DataFrame, suppressions: DataFrame) -> DataFrame:
    """suppressions: (document_id, entity_id)."""
    return mentions.join(suppressions, ["document_id", "entity_id"], "left_anti")


def link_attendees(attendees: DataFrame, entities: DataFrame) -> DataFrame:
    """(document_id, name, email, entity_id, matched_by): by email, else by name, else to be created."""
    by_email = entities.filter("email is not null").groupBy(F.lower("email").alias("_email")).agg(F.min("id").alias("e_id"))
    by_name = entities.groupBy(F.lower("name").alias("_name")).agg(F.min("id").alias("n_id"))
    out = attendees.join(by_email, F.lower(attendees["email"]) == F.col("_email"), "left").join(by_name, F.lower(attendees["name"]) == F.col("_name"), "left")
    how = F.when(F.col("e_id").isNotNull(), "email").when(F.col("n_id").isNotNull(), "name").otherwise("created")
    return out.select("document_id", attendees["name"], attendees["email"], F.coalesce("e_id", "n_id").alias("entity_id"), how.alias("matched_by"))


def match_tasks(tasks: DataFrame, projects: DataFrame, min_keyword_len: int = 4) -> DataFrame:
    """(task_id, project_id, tier): by an explicit project line, else by names in the title.

    A task with an explicit line, known or not, is not matched by title. Names are sought in the whole title, whatever
    its case; names shorter than min_keyword_len only as whole words. Titles are joined to names on the first characters
    of a name, four at most, so that titles times names is never formed. tasks: (task_id, title, description); projects:
    (project_id, name), a row for each name, alias or keyword."""
    lead = 4
    named = projects.select("project_id", F.lower("name").alias("pname")).filter("pname <> ''").distinct()
    explicit = tasks.withColumn("link", T.project_link(F.col("description")))
    # Names are told often and are few, which their size as planned does not show; it must never be the titles' pieces that are
    # broadcast. More names than that are joined by shuffle.
    near = F.broadcast if named.count() <= FEW_NAMES else lambda names: names.hint("merge")
    tier1 = explicit.filter("link is not null").join(near(named), F.col("link") == F.col("pname")).select("task_id", "project_id", F.lit(1).alias("tier"))
    titles = explicit.filter("link is null").select("task_id", F.lower(F.coalesce("title", F.lit(""))).alias("title")).filter("title <> ''")
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.length("title")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(lead)), lambda n: F.substring(F.col("title"), i, n))))
    cut = titles.select("task_id", "title", F.explode(F.array_distinct(pieces)).alias("key"))
    keyed = named.withColumn("key", F.substring("pname", 1, lead))
    quoted = F.concat(F.lit("\\b\\Q"), F.col("pname"), F.lit("\\E\\b"))
    there = F.when(F.length("pname") < min_keyword_len, F.regexp_like("title", quoted)).otherwise(F.contains("title", F.col("pname")))
    tier2 = cut.join(near(keyed), "key").filter(there).select("task_id", "project_id", F.lit(2).alias("tier")).distinct()
    return tier1.unionByName(tier2)


def correction_scan(files: DataFrame, term: str, word_boundary: bool = False, ignore_case: bool = True, scope: str | None = None, file_type: str | None = None) -> DataFrame:
    """(path, hits, lines): files that have a term, how often, and all lines with it. files: (path, text).

    scope is a pattern of paths, file_type a part of the file's name."""
    if file_type:
        files = files.filter(F.element_at(F.split("path", "/"), -1).contains(file_type))
    if scope is not None:
        files = files.filter(F.col("path").ilike(T.glob_pattern(scope)))
    pattern = T.literal_pattern(term, word_boundary, ignore_case)
    hits = files.filter(F.col("text").rlike(pattern)).withColumn("hits", F.regexp_count("text", F.lit(pattern)))
    return hits.select("path", "hits", F.filter(F.split("text", "\n"), lambda line: line.rlike(pattern)).alias("lines"))


def corrected(files: DataFrame, term: str, replacement: str, word_boundary: bool = False, ignore_case: bool = True) -> DataFrame:
    """The files with a term replaced literally."""
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return files.withColumn("text", F.regexp_replace("text", T.literal_pattern(term, word_boundary, ignore_case), literal))


def denied(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Names of text files that any pattern matches, case ignored."""
    joined = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    return files.filter(~F.col("text").contains("\x00") & F.col("text").rlike(joined)).select("path").orderBy("path")


def resolve_conflicts(mentions: DataFrame) -> DataFrame:
    """One row for each (entity, document, type)."""
    w = Window.partitionBy("entity_id", "document_id", "mention_type").orderBy(F.desc("hits"))
    return mentions.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
