"""Named queries over the bound relations, each with the SQL that gives the same rows elsewhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import scoring, snippets, text
from noteloom.operators import chunking, fts, incremental, linking, mentions, metadata, ranking, relational, vectors
from noteloom.plans import bindings as b
from noteloom.plans import context

AS_OF = b.AS_OF
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The bound relations in SQL.
DOCS = """docs AS (
    SELECT doc_id AS id, 'memory/' || lang || '/' || source || '/' || doc_id || '.md' AS path,
        array_to_string(string_split(replace(text, chr(10), ' '), ' ')[1:6], ' ') AS title,
        CASE WHEN doc_id % 10 <> 9 THEN DATE '2024-01-01' + (doc_id % 365)::INT END AS doc_date, lang AS doc_type, source AS source_system,
        [lang, upper(source[1]) || lower(source[2:]), 'q' || (doc_id % 5)] AS tags, sha256(text) AS content_hash, doc_id % 17 = 0 AS pinned, text
    FROM documents)"""
CHUNKS = """lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
chunks AS (
    SELECT doc_id * 1000000 + i - 1 AS chunk_id, doc_id AS document_id, (i - 1)::INT AS chunk_index, l[i] AS content
    FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM lines))"""
TOKENS = r"""tokens AS (
    SELECT chunk_id, document_id, t[i] AS term, i - 1 AS pos
    FROM (SELECT chunk_id, document_id, t, unnest(generate_series(1, len(t))) AS i
        FROM (SELECT chunk_id, document_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS t FROM chunks))),
sizes AS (SELECT chunk_id, len(regexp_extract_all(lower(content), '[\p{L}\p{N}]+'))::BIGINT AS dl FROM chunks),
corpus AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM sizes)"""
ENTITIES = """entities AS (
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS entity_type, ['cust-' || c_custkey, lower(c_name)] AS aliases,
        CASE WHEN c_acctbal > 0 THEN c_nationkey END AS team, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS role,
        CASE WHEN c_custkey % 4 = 0 THEN DATE '1999-01-01' + (c_custkey % 700)::INT END AS updated_at FROM customer)"""
ATTRIBUTES = """attributes AS (
    SELECT c_custkey AS id, c_mktsegment AS entity_type, CASE WHEN c_custkey % 7 <> 0 THEN ('{' || array_to_string(list_filter([
        '"budget":{"amount":' || round(c_acctbal * 100)::BIGINT || ',"rate":' || c_custkey % 100 || '.5}',
        CASE WHEN c_custkey % 5 <> 0 THEN '"sources":[{"type":"wiki","id":' || c_custkey || '}' || CASE WHEN c_custkey % 3 = 0 THEN ',{"type":"tracker","id":"T-' || c_custkey || '"}' ELSE '' END || ']' END,
        '"level":' || CASE c_custkey % 3 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN '"L' || c_custkey || '"' ELSE 'null' END,
        CASE WHEN c_custkey % 2 = 0 THEN '"active":true' END, '"tags":[]', '"a.b":"' || c_mktsegment || '"'], lambda x: x IS NOT NULL), ',') || '}')::JSON END AS j FROM customer)"""
ODOCS = """odocs AS (SELECT o_orderkey AS id, 'note ' || (o_orderkey % 7) AS title, o_orderdate::DATE AS doc_date, o_orderstatus AS doc_type FROM orders)"""
MENTIONS = """mentions AS (SELECT o_custkey AS entity_id, o_orderkey AS document_id, o_orderpriority AS mention_type FROM orders)"""
FACTS = """facts AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS entity_id, l_returnflag AS fact_text, l_shipdate::DATE AS fact_date FROM lineitem)"""
ACCESS = """access AS (SELECT user_id AS document_id, count(*) AS n_access, max(ts)::DATE AS last_access FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id)"""
ENTITY = 7
TERMS = ["with", "from"]
RECENCY = "CASE WHEN doc_date IS NULL THEN 0.5::DOUBLE WHEN date_diff('day', doc_date, DATE '2024-12-31') <= 0 THEN 1.0::DOUBLE ELSE exp(-ln(2.0::DOUBLE) * date_diff('day', doc_date, DATE '2024-12-31') / 90.0::DOUBLE) END"


def _bm25_sql(leaves: str, having: str = "true") -> str:
    """Scores in SQL of `leaves`, a query for (leaf, chunk_id, f, df); f is the number of occurrences."""
    return f"""{CHUNKS}, {TOKENS}, leaves AS ({leaves}),
scored AS (
    SELECT chunk_id, -sum(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END
        * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))) AS raw, count(*) AS n_leaves
    FROM leaves JOIN sizes USING (chunk_id), corpus GROUP BY chunk_id HAVING {having})"""


_TERM_LEAVES = "SELECT term AS leaf, chunk_id, count(*) AS f, count(*) OVER (PARTITION BY term) AS df FROM tokens WHERE term IN ('with', 'from') GROUP BY term, chunk_id"


def iso(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, which every engine prints alike."""
    for c, kind in df.dtypes:
        if kind == "date":
            df = df.withColumn(c, F.col(c).cast("string"))
        elif kind.startswith("timestamp"):
            df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


def query(sql: str | None = None, name: str | None = None, dates: tuple[str, ...] = (), times: tuple[str, ...] = ()):
    """Registers a query with its SQL; dates and times name the columns that are printed as ISO text."""
    if sql is not None and (dates or times):
        texts = [f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates] + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in times]
        sql = f"SELECT * REPLACE ({', '.join(texts)}) FROM ({sql})"

    def register(f):
        QUERIES[name or f.__name__] = lambda spark, d: iso(f(spark, d))
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- documents


@query(f"WITH {DOCS} SELECT doc_type, count(*) AS n FROM docs GROUP BY doc_type")
def doc_counts_by_type(spark, d):
    return b.documents(spark, d).groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {DOCS}, {CHUNKS}, {ENTITIES}, {MENTIONS}, {FACTS}
    SELECT (SELECT count(*) FROM docs) AS n_documents, (SELECT min(doc_date) FROM docs) AS first_date, (SELECT max(doc_date) FROM docs) AS last_date,
        (SELECT count(*) FROM chunks) AS n_chunks, (SELECT count(*) FROM entities) AS n_entities, (SELECT count(*) FROM mentions) AS n_mentions, (SELECT count(*) FROM facts) AS n_facts""", dates=("first_date", "last_date"))
def index_stats(spark, d):
    return relational.index_stats(b.documents(spark, d), b.chunks(spark, d), b.entities(spark, d), b.mentions(spark, d), b.facts(spark, d))


@query(f"""WITH {DOCS} SELECT id, path, doc_date FROM docs WHERE doc_type = 'en' AND doc_date >= DATE '2024-03-01' AND doc_date <= DATE '2024-06-30'
    ORDER BY doc_date DESC NULLS LAST, id DESC LIMIT 50""", dates=("doc_date",))
def list_docs_filtered(spark, d):
    return relational.list_documents(b.documents(spark, d), "en", "2024-03-01", "2024-06-30", limit=50).select("id", "path", "doc_date")


@query(f"WITH {DOCS} SELECT id, tags FROM docs WHERE list_contains(tags, 'fr') AND list_contains(tags, 'q2')")
def tag_and_filter(spark, d):
    return relational.list_documents(b.documents(spark, d), tags=["fr", "q2"]).select("id", "tags")


@query(f"WITH {DOCS} SELECT id FROM docs WHERE list_contains(list_transform(tags, lambda x: lower(x)), 'src3') AND list_contains(list_transform(tags, lambda x: lower(x)), 'q1')")
def tag_filter_ignore_case(spark, d):
    return relational.list_documents(b.documents(spark, d), tags=["SRC3", "Q1"], ignore_case=True).select("id")


@query(f"WITH {DOCS} SELECT id, path FROM docs WHERE path ILIKE 'MEMORY/de/src_/%'")
def path_pattern(spark, d):
    return relational.list_documents(b.documents(spark, d), path="MEMORY/de/src?/").select("id", "path")


@query(f"WITH {DOCS} SELECT id, content_hash FROM docs WHERE starts_with(content_hash, 'a') ORDER BY id LIMIT 1")
def hash_prefix(spark, d):
    return relational.find_document(b.documents(spark, d), "#a").select("id", "content_hash")


@query(f"WITH {DOCS} SELECT id, path FROM docs WHERE ends_with(path, '/7.md')")
def path_suffix(spark, d):
    return relational.find_document(b.documents(spark, d), "/7.md", strict=True).select("id", "path")


@query(f"""WITH {DOCS}, dirs AS (
        SELECT array_to_string(p[1:k], '/') AS dir, k AS depth, k = len(p) - 1 AS own
        FROM (SELECT p, unnest(generate_series(1, len(p) - 1)) AS k FROM (SELECT string_split(path, '/') AS p FROM docs)))
    SELECT dir, CASE WHEN depth > 1 THEN regexp_replace(dir, '/[^/]*$', '') END AS parent, depth::INT AS depth, count(*) FILTER (own) AS n_files, count(*) AS n_below FROM dirs GROUP BY dir, depth""")
def directory_tree(spark, d):
    return relational.directory_tree(b.documents(spark, d))


@query(f"WITH {CHUNKS} SELECT document_id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS body FROM chunks GROUP BY document_id")
def document_bodies(spark, d):
    return relational.reassembled(b.chunks(spark, d))


@query(f"""WITH {DOCS}, a AS (SELECT id FROM docs WHERE path ILIKE 'memory/en/%'), c AS (SELECT id FROM docs WHERE list_contains(tags, 'q3'))
    SELECT id FROM a INTERSECT SELECT id FROM c""")
def path_and_entity_sets(spark, d):
    docs = b.documents(spark, d)
    return relational.list_documents(docs, path="memory/en/").select("id").intersect(relational.list_documents(docs, tags=["q3"]).select("id"))


@query(f"""WITH {DOCS} SELECT id, trim(regexp_replace(regexp_replace(lower(strip_accents(title)), '[^a-z0-9 -]', '', 'g'), '[ -]+', '-', 'g'), '-') AS slug, floor(length(text) / 4)::INT AS n_tokens, substr(content_hash, 1, 16) AS profile_hash FROM docs""")
def slugs_and_hashes(spark, d):
    return b.documents(spark, d).select("id", text.slug(F.col("title")).alias("slug"), text.estimate_tokens(F.col("text")).alias("n_tokens"), text.profile_hash(F.col("text")).alias("profile_hash"))


@query(r"""WITH found AS (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(text, '[a-z]+\.[0-9]+@mail[0-9]+\.example\.com'))) AS email FROM documents)
    SELECT id, email, upper(regexp_extract(email, '^([a-z])', 1)) || regexp_extract(email, '^[a-z]([a-z]*)', 1) || ' ' || regexp_extract(email, '\.([0-9]+)@', 1) AS name FROM found""")
def attendee_names(spark, d):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[a-z]+\.[0-9]+@mail[0-9]+\.example\.com"), F.lit(0)))
    return b.documents(spark, d).select("id", F.explode(found).alias("email")).withColumn("name", text.name_from_email(F.col("email")))


# ---------------------------------------------------------------- entities, mentions, facts


@query(f"""WITH {ENTITIES}, {MENTIONS} SELECT id, any_value(name) AS name, any_value(entity_type) AS entity_type, count(document_id) AS mention_count
    FROM entities LEFT JOIN mentions ON id = entity_id GROUP BY id""")
def mention_counts(spark, d):
    return relational.mention_counts(b.entities(spark, d), b.mentions(spark, d))


@query(f"WITH {FACTS} SELECT entity_id, count(*) AS fact_count FROM facts GROUP BY entity_id")
def fact_counts(spark, d):
    return relational.fact_counts(b.facts(spark, d))


@query(f"""WITH {ENTITIES}, {MENTIONS} SELECT id, any_value(name) AS name, any_value(entity_type) AS entity_type, count(document_id) AS mention_count
    FROM entities LEFT JOIN mentions ON id = entity_id GROUP BY id ORDER BY name LIMIT 20 OFFSET 40""")
def entity_page(spark, d):
    return relational.mention_counts(b.entities(spark, d), b.mentions(spark, d)).orderBy("name").offset(40).limit(20)


@query(f"""WITH {ODOCS}, {MENTIONS} SELECT id, any_value(title) AS title, any_value(doc_date) AS doc_date, any_value(doc_type) AS doc_type,
        string_agg(DISTINCT mention_type, ',' ORDER BY mention_type) AS mention_types
    FROM odocs JOIN mentions ON id = document_id WHERE entity_id = {ENTITY} GROUP BY id ORDER BY doc_date DESC NULLS LAST, id DESC LIMIT 10""", dates=("doc_date",))
def timeline(spark, d):
    return relational.timeline(b.mentions(spark, d), b.orders_as_documents(spark, d), ENTITY)


@query(f"""WITH {ODOCS}, {MENTIONS}, f AS (
        SELECT id, title, doc_date, doc_type FROM odocs WHERE id IN (SELECT document_id FROM mentions WHERE entity_id = {ENTITY}) ORDER BY doc_date NULLS FIRST, id LIMIT 25)
    SELECT id, title, doc_date, doc_type, min(id) OVER g AS place FROM f
    WINDOW g AS (PARTITION BY doc_date, title) QUALIFY row_number() OVER (PARTITION BY doc_date, title ORDER BY (doc_type = 'F') DESC, CASE WHEN doc_type = 'F' THEN -id ELSE id END) = 1""", dates=("doc_date",))
def timeline_deduped(spark, d):
    return relational.timeline_deduped(b.mentions(spark, d), b.orders_as_documents(spark, d), ENTITY, 25, "F")


@query(f"WITH {ODOCS}, {MENTIONS} SELECT entity_id, max(doc_date) AS last_mentioned_at FROM mentions JOIN odocs ON document_id = id GROUP BY entity_id", dates=("last_mentioned_at",))
def latest_mention(spark, d):
    return relational.last_mentioned(b.mentions(spark, d), b.orders_as_documents(spark, d))


def _seen_entities(spark, d):
    last = latest_mention(spark, d)
    return b.entities(spark, d).join(last.withColumnRenamed("entity_id", "id"), "id", "left")


_SEEN = f"{ENTITIES}, {ODOCS}, {MENTIONS}, seen AS (SELECT e.*, (SELECT max(doc_date) FROM mentions JOIN odocs o ON document_id = o.id WHERE entity_id = e.id) AS last_mentioned_at FROM entities e)"


@query(f"""WITH {_SEEN} SELECT id, name, coalesce(last_mentioned_at, updated_at) AS last_seen, date_diff('day', coalesce(last_mentioned_at, updated_at), DATE '2001-08-01')::INT AS age_days
    FROM seen WHERE (updated_at IS NULL OR updated_at < DATE '2000-06-01') AND (last_mentioned_at IS NULL OR last_mentioned_at < DATE '2000-06-01')""", dates=("last_seen",))
def stale_entities(spark, d):
    return relational.stale(_seen_entities(spark, d), "2000-06-01", "2001-08-01")


@query(f"""WITH {_SEEN}, c AS (SELECT s.*, (SELECT count(*) FROM mentions WHERE entity_id = s.id) AS mention_count FROM seen s)
    SELECT id, name, entity_type, mention_count, last_mentioned_at,
        round(mention_count * CASE WHEN last_mentioned_at IS NULL THEN 0.5::DOUBLE WHEN date_diff('day', last_mentioned_at, DATE '2001-08-01') <= 0 THEN 1.0::DOUBLE
            ELSE exp(-ln(2.0::DOUBLE) * date_diff('day', last_mentioned_at, DATE '2001-08-01') / 90.0::DOUBLE) END, 4) AS rank,
        CASE WHEN date_diff('day', last_mentioned_at, DATE '2001-08-01') <= 30 THEN 'fresh' WHEN date_diff('day', last_mentioned_at, DATE '2001-08-01') <= 90 THEN 'aging' ELSE 'stale' END AS badge
    FROM c WHERE mention_count >= 5""", dates=("last_mentioned_at",))
def context_ranking(spark, d):
    counts = relational.mention_counts(b.entities(spark, d), b.mentions(spark, d))
    return relational.context_ranking(counts, latest_mention(spark, d), "2001-08-01", 5)


@query(f"WITH {FACTS}, s AS (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 9 <> 0) SELECT f.id, entity_id, fact_text, fact_date, name AS entity_name FROM facts f LEFT JOIN s ON entity_id = s.id WHERE fact_date >= DATE '2000-01-01'", dates=("fact_date",))
def facts_left_join(spark, d):
    suppliers = b.table(spark, d, "supplier").filter("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return relational.facts_with_entities(b.facts(spark, d), suppliers, since="2000-01-01").select("id", "entity_id", "fact_text", "fact_date", "entity_name")


@query(f"WITH {FACTS} SELECT id, entity_id, fact_date, row_number() OVER (PARTITION BY entity_id ORDER BY fact_date NULLS FIRST, id)::INT AS seq FROM facts", dates=("fact_date",))
def fact_seq(spark, d):
    return relational.with_seq(b.facts(spark, d)).select("id", "entity_id", "fact_date", "seq")


@query(f"""WITH {FACTS}, old AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY fact_date NULLS FIRST, id) AS seq FROM facts WHERE id % 2 = 0),
    top AS (SELECT entity_id, max(seq) AS top FROM old GROUP BY entity_id)
    SELECT id, entity_id, (row_number() OVER (PARTITION BY entity_id ORDER BY fact_date NULLS FIRST, id) + coalesce(top, 0))::INT AS seq FROM facts LEFT JOIN top USING (entity_id) WHERE id % 2 = 1""")
def fact_seq_append(spark, d):
    facts = b.facts(spark, d)
    return relational.with_seq(facts.filter("id % 2 = 1"), relational.with_seq(facts.filter("id % 2 = 0"))).select("id", "entity_id", "seq")


@query(f"WITH {FACTS} SELECT entity_id, id, fact_date, (row_number() OVER w)::INT AS rank FROM facts WINDOW w AS (PARTITION BY entity_id ORDER BY fact_date DESC NULLS LAST, id DESC) QUALIFY row_number() OVER w <= 5", dates=("fact_date",))
def top_facts(spark, d):
    return relational.top_facts(b.facts(spark, d)).select("entity_id", "id", "fact_date", "rank")


def _resolve_sql(name: str) -> str:
    low = name.lower()
    return f"""WITH {ENTITIES}, t AS (
        SELECT id, name, CASE WHEN name = '{name}' THEN 1 WHEN list_contains(aliases, '{name}') THEN 2 WHEN lower(name) = '{low}' THEN 3
            WHEN list_contains(list_transform(aliases, lambda a: lower(a)), '{low}') THEN 4
            WHEN contains(lower(name), '{low}') OR len(list_filter(aliases, lambda a: contains(lower(a), '{low}'))) > 0 THEN 5 END AS tier FROM entities)
    SELECT id, name, tier::INT AS tier FROM t WHERE tier = (SELECT min(tier) FROM t)"""


for _key, _name in {"exact": "Customer#000000012", "alias": "cust-12", "folded": "CUSTOMER#000000012", "folded_alias": "CUST-12", "partial": "stomer#00000001"}.items():
    query(_resolve_sql(_name), f"resolve_{_key}")(lambda spark, d, n=_name: relational.resolve(b.entities(spark, d), n).select("id", "name", "tier"))


@query(f"""WITH {ENTITIES}, {FACTS}, h AS (SELECT DISTINCT entity_id FROM facts WHERE fact_date >= DATE '2001-06-01')
    SELECT id, ((team IS NOT NULL)::INT + (role IS NOT NULL)::INT + (updated_at IS NOT NULL)::INT)::INT AS n_fields FROM entities
    WHERE (team IS NOT NULL)::INT + (role IS NOT NULL)::INT + (updated_at IS NOT NULL)::INT >= 2 OR id IN (SELECT entity_id FROM h)""")
def key_people(spark, d):
    recent = b.facts(spark, d).filter(F.col("fact_date") >= F.lit("2001-06-01").cast("date"))
    return relational.key_people(b.entities(spark, d), recent, ["team", "role", "updated_at"]).select("id", "n_fields")


@query(f"""WITH {ENTITIES}, {FACTS}, t AS (SELECT entity_id, list(fact_text ORDER BY fact_date DESC NULLS LAST, id DESC, fact_text) AS texts FROM (
        SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY fact_date DESC NULLS LAST, id DESC, fact_text) <= 5) GROUP BY entity_id)
    SELECT id, concat_ws(' | ', name, aliases[1], role, array_to_string(texts, '; ')) AS profile FROM entities LEFT JOIN t ON id = entity_id""")
def entity_profiles(spark, d):
    from pyspark.sql import Window

    order = [F.col("fact_date").desc_nulls_last(), F.desc("id"), "fact_text"]
    top = b.facts(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order))).filter("rank <= 5")
    texts = top.groupBy(F.col("entity_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "fact_text"))), lambda x: x["fact_text"]), "; ").alias("texts"))
    return b.entities(spark, d).join(texts, "id", "left").select("id", F.concat_ws(" | ", "name", F.get("aliases", F.lit(0)), "role", "texts").alias("profile"))


# ---------------------------------------------------------------- full text


@query(f"WITH {CHUNKS}, {TOKENS} SELECT t.term, coalesce(n, 0) AS n_docs FROM (VALUES ('with'), ('from'), ('idiot'), ('zzzz')) t(term) LEFT JOIN (SELECT term, count(DISTINCT document_id) AS n FROM tokens GROUP BY term) USING (term)")
def term_doc_freq(spark, d):
    c, wanted = b.chunks(spark, d), ["with", "from", "idiot", "zzzz"]
    return fts.document_frequency(b.postings(spark, d, wanted), c, wanted)


@query(f"WITH {CHUNKS}, {TOKENS} SELECT term, count(DISTINCT chunk_id) AS df FROM tokens WHERE starts_with(term, 'stu') GROUP BY term")
def prefix_terms(spark, d):
    return fts.expand_prefix(b.postings(spark, d, ["stu*"]), "stu")


def _bm25(spark, d, leaves, mode="or"):
    words = [t for tokens in leaves.values() for t in tokens]
    return fts.bm25(b.postings(spark, d, words), b.lengths(spark, d), leaves, mode).select("chunk_id", F.round("raw", 6).alias("raw"))


_BOTH = {t: [t] for t in TERMS}


@query(f"WITH {_bm25_sql(_TERM_LEAVES)} SELECT chunk_id, round(raw, 6) AS raw FROM scored")
def bm25_or(spark, d):
    return _bm25(spark, d, _BOTH)


@query(f"WITH {_bm25_sql(_TERM_LEAVES, 'count(*) = 2')} SELECT chunk_id, round(raw, 6) AS raw FROM scored")
def bm25_and(spark, d):
    return _bm25(spark, d, _BOTH, "and")


_PHRASE = """SELECT leaf, chunk_id, f, count(*) OVER () AS df FROM (
    SELECT 'of the' AS leaf, chunk_id, count(*) AS f FROM tokens a JOIN tokens z USING (chunk_id) WHERE a.term = 'of' AND z.term = 'the' AND z.pos = a.pos + 1 GROUP BY chunk_id)"""


@query(f"WITH {_bm25_sql(_PHRASE)} SELECT chunk_id, round(raw, 6) AS raw FROM scored")
def bm25_phrase(spark, d):
    return _bm25(spark, d, {"of the": ["of", "the"]})


_NEAR = """SELECT leaf, chunk_id, f, df FROM (
        SELECT a.term AS leaf, a.chunk_id, count(DISTINCT a.pos) AS f FROM tokens a JOIN tokens z ON a.chunk_id = z.chunk_id
        WHERE a.term IN ('with', 'from') AND z.term IN ('with', 'from') AND a.term <> z.term AND abs(a.pos - z.pos) - 1 <= 10 GROUP BY a.term, a.chunk_id)
    JOIN (SELECT term AS leaf, count(DISTINCT chunk_id) AS df FROM tokens GROUP BY term) USING (leaf)"""


@query(f"WITH {_bm25_sql(_NEAR, 'count(*) = 2')} SELECT chunk_id, round(raw, 6) AS raw FROM scored")
def bm25_near(spark, d):
    return _bm25(spark, d, _BOTH, "near")


@query(f"WITH {_bm25_sql(_TERM_LEAVES)} SELECT chunk_id, round(CASE WHEN max(raw) OVER () = min(raw) OVER () THEN 1.0 ELSE (max(raw) OVER () - raw) / (max(raw) OVER () - min(raw) OVER ()) END, 4) AS score FROM scored")
def bm25_minmax(spark, d):
    raw = fts.bm25(b.postings(spark, d, TERMS), b.lengths(spark, d), _BOTH)
    return raw.select("chunk_id", F.round(scoring.minmax_bm25(F.col("raw")), 4).alias("score"))


_HITS = f"""{_bm25_sql(_TERM_LEAVES)}, pool AS (SELECT * FROM scored ORDER BY round(raw, 9), chunk_id LIMIT 50),
    hits AS (SELECT chunk_id, chunk_id // 1000000 AS document_id, round((max(raw) OVER () - raw) / (max(raw) OVER () - min(raw) OVER ()), 4) AS score FROM pool)"""


def _hits(spark, d):
    """The 50 best chunks for the terms, with scaled scores."""
    found = fts.top_k(b.postings(spark, d, TERMS), b.bounds(spark, d, TERMS), b.corpus(spark, d), TERMS, 50)
    top = spark.createDataFrame(found, "chunk_id long, raw double")
    return top.select("chunk_id", F.expr(f"chunk_id div {b.LINES}").alias("document_id"), F.round(scoring.minmax_bm25(F.col("raw")), 4).alias("score"))


@query(f"WITH {_HITS}, r AS (SELECT score, row_number() OVER (ORDER BY score DESC, chunk_id) AS k FROM hits), t AS (SELECT (SELECT least(count(*), 3) FROM hits) AS n, (SELECT score FROM r WHERE k = 1) AS top, (SELECT score FROM r WHERE k = 2) AS second) SELECT n, top, top - coalesce(second, 0) AS gap, n > 0 AND (n <= 2 OR (top >= 0.85 AND top - coalesce(second, 0) >= 0.15)) AS strong FROM t")
def strong_signal(spark, d):
    return ranking.strong_signal(_hits(spark, d))


@query(f"WITH {_HITS} SELECT document_id, chunk_id, score, count(*) OVER (PARTITION BY document_id) AS matching_chunks FROM hits QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_id) = 1 ORDER BY score DESC, chunk_id LIMIT 20")
def best_chunk_per_document(spark, d):
    return ranking.best_per_document(_hits(spark, d), 20)


@query(f"WITH {_HITS} SELECT h.document_id, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS content FROM hits h JOIN chunks USING (chunk_id) GROUP BY h.document_id")
def merged_chunks(spark, d):
    hits = _hits(spark, d).select("chunk_id", "document_id").join(b.chunks(spark, d).drop("document_id"), "chunk_id")
    return ranking.merged_content(hits)


@query(f"WITH {DOCS}, {_HITS} SELECT chunk_id, round({RECENCY}, 4) AS recency, round(CASE WHEN doc_date IS NULL THEN score ELSE 0.85 * score + 0.15 * {RECENCY} * score END, 4) AS score FROM hits JOIN docs ON document_id = id")
def recency_scored(spark, d):
    hits = _hits(spark, d).join(b.documents(spark, d).select(F.col("id").alias("document_id"), "doc_date"), "document_id")
    return ranking.with_recency(hits, AS_OF).select("chunk_id", F.round("recency", 4).alias("recency"), F.round("score", 4).alias("score"))


_HEAT = "CASE WHEN last_access IS NULL OR n_access <= 0 THEN 0.0::DOUBLE ELSE 1 / (1 + exp(-ln(1.0::DOUBLE + n_access))) * exp(-ln(2.0::DOUBLE) * greatest(date_diff('day', last_access, DATE '2024-02-05'), 0) / 7.0::DOUBLE) END"


@query(f"WITH {ACCESS}, {_HITS} SELECT chunk_id, round({_HEAT}, 4) AS hotness, round(CASE WHEN last_access IS NULL THEN score ELSE 0.8 * score + 0.2 * {_HEAT} END, 4) AS score FROM hits LEFT JOIN access USING (document_id)")
def hotness_scored(spark, d):
    return ranking.with_hotness(_hits(spark, d), b.access(spark, d), "2024-02-05").select("chunk_id", F.round("hotness", 4).alias("hotness"), F.round("score", 4).alias("score"))


_NAMES = "names AS (SELECT doc_id AS document_id, list_distinct([lang || ' corpus', source || ' feed']) AS entities FROM documents)"


@query(f"WITH {_NAMES}, {_HITS} SELECT chunk_id, len(list_intersect(list_transform(flatten(list_transform(entities, lambda e: string_split(lower(e), ' '))), lambda w: w), ['src3', 'fr'])) > 0 AS boosted, round(score * CASE WHEN len(list_intersect(flatten(list_transform(entities, lambda e: string_split(lower(e), ' '))), ['src3', 'fr'])) > 0 THEN 1.15 ELSE 1 END, 4) AS score FROM hits JOIN names USING (document_id)")
def entity_boosted(spark, d):
    names = b.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.array(F.concat("lang", F.lit(" corpus")), F.concat("source", F.lit(" feed"))).alias("entities"))
    return ranking.with_entity_boost(_hits(spark, d).join(names, "document_id"), ["src3", "FR"]).select("chunk_id", "boosted", F.round("score", 4).alias("score"))


@query(f"""WITH {_HITS}, parents AS (SELECT doc_id AS document_id, max(CASE lang WHEN 'en' THEN 0.9 ELSE 0.6 END) AS parent FROM documents WHERE lang IN ('en', 'fr') GROUP BY doc_id)
    SELECT chunk_id, round(0.5 * score + 0.5 * parent, 6) AS score FROM hits JOIN parents USING (document_id)""")
def hierarchy_blend(spark, d):
    docs = b.documents(spark, d)
    mentions = docs.select(F.col("id").alias("document_id"), F.col("doc_type").alias("entity_id"))
    found = spark.createDataFrame([("en", 0.9), ("fr", 0.6)], "entity_id string, score double")
    return ranking.with_hierarchy(_hits(spark, d), ranking.parent_scores(found, mentions)).select("chunk_id", F.round("score", 6).alias("score"))


_TWO_PASS = f"""{_bm25_sql(_TERM_LEAVES)},
    places AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x, any_value(q.q[i]::DOUBLE) AS q FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) q, generate_series(1, 64) g(i) GROUP BY label, i),
    found AS (SELECT label, round(sum(x * q) / (sqrt(sum(x * x)) * sqrt(sum(q * q))), 4) AS score FROM places GROUP BY label),
    best AS (SELECT * FROM found WHERE score >= 0.1 ORDER BY score DESC, label LIMIT 3),
    parents AS (SELECT vec_id AS document_id, max(score) AS parent FROM embeddings JOIN best USING (label) GROUP BY vec_id),
    hits AS (SELECT chunk_id, parent, raw FROM scored JOIN parents ON document_id = chunk_id // 1000000),
    scaled AS (SELECT chunk_id, parent, round((max(raw) OVER () - raw) / (max(raw) OVER () - min(raw) OVER ()), 4) AS score FROM hits)"""


@query(f"WITH {_TWO_PASS} SELECT chunk_id, score AS own, parent, round(0.5 * score + 0.5 * parent, 6) AS score FROM scaled")
def two_pass_search(spark, d):
    """The first pass finds the labels whose mean vector is like the query's; the second scores the chunks of their documents
    only, and blends the label's score in."""
    e, q = _vectors(spark, d)
    places = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    profiles = places.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("embedding"))
    found = vectors.top_k(profiles, q, 3, "label", 0.1).select(F.col("label").alias("entity_id"), "score")
    parents = ranking.parent_scores(found, e.select(F.col("label").alias("entity_id"), F.col("vec_id").alias("document_id")))
    within = b.lengths(spark, d).withColumn("document_id", F.expr(f"chunk_id div {b.LINES}")).join(parents, "document_id", "left_semi")
    scores = fts.bm25(b.postings(spark, d, TERMS), b.lengths(spark, d), _BOTH).join(within.select("chunk_id", "document_id"), "chunk_id")
    own = scores.select("chunk_id", "document_id", F.round(scoring.minmax_bm25(F.col("raw")), 4).alias("own")).withColumn("score", F.col("own"))
    return ranking.with_hierarchy(own, parents).select("chunk_id", "own", "parent", F.round("score", 6).alias("score"))


_KINDS = """kinds AS (SELECT lang || ' corpus' AS name, doc_id AS document_id FROM documents WHERE lang IS NOT NULL UNION SELECT source || ' feed', doc_id FROM documents WHERE source IS NOT NULL)"""


@query(f"""WITH {CHUNKS}, {TOKENS}, {_KINDS}, about AS (SELECT document_id FROM tokens WHERE term IN ('en', 'la') GROUP BY chunk_id, document_id HAVING count(DISTINCT term) = 2)
    SELECT DISTINCT name AS entity_id FROM kinds WHERE contains(name, 'en la') OR contains('en la', name) OR document_id IN (SELECT document_id FROM about)""")
def topic_entities(spark, d):
    """What a topic of two words is about: by name, and by the documents with a chunk that has both."""
    docs = b.table(spark, d, "documents")
    kinds = docs.filter("lang is not null").select(F.concat("lang", F.lit(" corpus")).alias("id"), F.col("doc_id").alias("document_id"))
    kinds = kinds.unionByName(docs.filter("source is not null").select(F.concat("source", F.lit(" feed")).alias("id"), F.col("doc_id").alias("document_id")))
    names = kinds.select("id").distinct().select("id", F.col("id").alias("name"), F.array().cast("array<string>").alias("aliases"))
    owners = b.chunks(spark, d).select("chunk_id", "document_id")
    return context.topic_entities(names, kinds.withColumnRenamed("id", "entity_id"), b.postings(spark, d, fts.query_terms("en la")), owners, "en la")


_VECS = "vq AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7), vsim AS (SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))), 4) AS score FROM embeddings, vq)"


def _vectors(spark, d):
    e = b.table(spark, d, "embeddings")
    return e, vectors.vector_of(e, 7)


@query(f"WITH {_VECS} SELECT vec_id, score FROM vsim ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark, d):
    e, q = _vectors(spark, d)
    return vectors.top_k(e, q, 20).select("vec_id", "score")


@query(f"WITH {_VECS} SELECT vec_id, score FROM vsim ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk_blas(spark, d):
    e, q = _vectors(spark, d)
    return vectors.top_k_blas(e, q, 20)


@query(f"WITH {_VECS} SELECT vec_id, score FROM vsim WHERE label IN (1, 4) ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, d):
    e, q = _vectors(spark, d)
    wanted = spark.createDataFrame([(1,), (4,)], "label int")
    return vectors.top_k(e.join(F.broadcast(wanted), "label", "left_semi"), q, 10).select("vec_id", "score")


@query(f"WITH {_VECS} SELECT vec_id, score FROM vsim WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 100")
def similar_threshold(spark, d):
    e, q = _vectors(spark, d)
    return vectors.top_k(e, q, 100, threshold=0.2).select("vec_id", "score")


_LISTS = f"""{_HITS}, fl AS (SELECT document_id AS id, max(score) AS score FROM hits GROUP BY document_id),
    fr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS fts_rank FROM fl), {_VECS}, vl AS (SELECT vec_id AS id, score FROM vsim ORDER BY score DESC, vec_id LIMIT 50),
    vr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS vector_rank FROM vl), both_lists AS (SELECT id, fts_rank, vector_rank FROM fr FULL JOIN vr USING (id))"""
_PART = "CASE WHEN {r} IS NULL THEN 0 ELSE 1.0::DOUBLE / (60 + {r}) + CASE {r} WHEN 1 THEN 0.05 WHEN 2 THEN 0.02 WHEN 3 THEN 0.02 ELSE 0 END END"
_SOURCE = "CASE WHEN vector_rank IS NULL THEN 'fts_only' WHEN fts_rank IS NULL THEN 'vector_only' ELSE 'both' END"


def _fused(spark, d):
    e, q = _vectors(spark, d)
    lexical = _hits(spark, d).groupBy(F.col("document_id").alias("chunk_id")).agg(F.max("score").alias("score"))
    near = vectors.top_k(e, q, 50).select(F.col("vec_id").alias("chunk_id"), "score")
    return ranking.fuse(lexical, near)


@query(f"WITH {_LISTS} SELECT id AS chunk_id, fts_rank::INT AS fts_rank, vector_rank::INT AS vector_rank, {_SOURCE} AS source, round({_PART.format(r='fts_rank')} + {_PART.format(r='vector_rank')}, 6) AS score FROM both_lists")
def rrf_fusion(spark, d):
    return _fused(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {_LISTS} SELECT {_SOURCE} AS source, count(*) AS n FROM both_lists GROUP BY 1")
def hit_overlap(spark, d):
    return _fused(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_HITS}, r AS (SELECT document_id, row_number() OVER (ORDER BY max(score) DESC, document_id)::INT AS rank FROM hits GROUP BY document_id)
    SELECT d.doc_id AS id, CASE WHEN lang <> 'en' THEN 'filtered_path' WHEN rank <= 10 THEN 'ranked' WHEN rank IS NOT NULL THEN 'below_cutoff' ELSE 'no_match' END AS reason, rank
    FROM documents d LEFT JOIN r ON d.doc_id = r.document_id""")
def why_not(spark, d):
    docs = b.documents(spark, d)
    ranks = ranking.ranked(_hits(spark, d).groupBy("document_id").agg(F.max("score").alias("score")), id_col="document_id")
    return ranking.why_not(docs, ranks, 10, docs.filter("doc_type = 'en'"))


@query(f"""WITH {_HITS}, g AS (SELECT document_id, row_number() OVER (ORDER BY max(score) DESC, document_id) AS rank FROM hits GROUP BY document_id), e AS (SELECT doc_id, rank FROM documents LEFT JOIN g ON doc_id = document_id WHERE doc_id % 20 = 0)
    SELECT count(*) AS n, avg(coalesce((rank <= 1)::INT::DOUBLE, 0)) AS hit_at_1, avg(coalesce((rank <= 3)::INT::DOUBLE, 0)) AS hit_at_3, avg(coalesce((rank <= 5)::INT::DOUBLE, 0)) AS hit_at_5 FROM e""")
def hit_at_k(spark, d):
    ranks = ranking.ranked(_hits(spark, d).groupBy("document_id").agg(F.max("score").alias("score")), id_col="document_id")
    expected = b.documents(spark, d).filter("id % 20 = 0").select(F.col("id").alias("document_id"))
    return ranking.hit_at(expected.join(ranks, "document_id", "left"))


@query(f"""WITH {_HITS}, {DOCS}, {ACCESS}, x AS (SELECT chunk_id, score AS fts, {RECENCY} AS recency, {_HEAT} AS heat FROM hits JOIN docs ON document_id = id LEFT JOIN access a ON a.document_id = docs.id)
    SELECT chunk_id, round(fts, 4) AS fts, round(recency, 4) AS recency, round(heat, 4) AS heat, round((0.6 * fts + 0.3 * recency + 0.1 * heat) / 1.0::DOUBLE, 4) AS score FROM x""")
def explain_components(spark, d):
    day = F.lit("2024-02-05").cast("date")
    hits = _hits(spark, d).join(b.documents(spark, d).select(F.col("id").alias("document_id"), "doc_date"), "document_id").join(b.access(spark, d), "document_id", "left")
    parts = hits.select("chunk_id", F.col("score").alias("fts"), scoring.recency_weight(F.col("doc_date"), F.lit(AS_OF).cast("date")).alias("recency"), scoring.hotness(F.col("n_access"), F.col("last_access"), day).alias("heat"))
    total = scoring.compose({"fts": (F.col("fts"), 0.6), "recency": (F.col("recency"), 0.3), "heat": (F.col("heat"), 0.1)})
    return parts.select("chunk_id", *[F.round(c, 4).alias(c) for c in ("fts", "recency", "heat")], F.round(total, 4).alias("score"))


_PREFIX = """SELECT leaf, chunk_id, f, count(*) OVER (PARTITION BY leaf) AS df FROM (
    SELECT CASE WHEN term = 'with' THEN 'with' ELSE 'stu*' END AS leaf, chunk_id, count(*) AS f FROM tokens WHERE term = 'with' OR starts_with(term, 'stu') GROUP BY ALL)"""


@query(f"WITH {_bm25_sql(_PREFIX)} SELECT chunk_id, round(raw, 6) AS raw FROM scored")
def bm25_prefix(spark, d):
    return _bm25(spark, d, {"stu*": ["stu*"], "with": ["with"]})


@query(f"WITH {_bm25_sql(_TERM_LEAVES, 'count(*) = 2')} SELECT chunk_id, round(raw, 6) AS raw FROM scored ORDER BY round(scored.raw, 9), chunk_id LIMIT 30")
def bm25_top_blocks(spark, d):
    """The best chunks that have both terms, without reading the blocks that cannot have them."""
    found = fts.top_k(b.postings(spark, d, TERMS), b.bounds(spark, d, TERMS), b.corpus(spark, d), TERMS, 30, "and")
    return spark.createDataFrame(found, "chunk_id long, raw double").withColumn("raw", F.round("raw", 6))


def _variants_sql(words: list[str], limit: int) -> str:
    """The variants of words in SQL: a phrase, all near each other, all, any; a later one counts while the earlier have fewer chunks."""
    idf = "CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END"

    def scored(name: str, leaves: str, having: str = "true") -> str:
        return f"""{name} AS (SELECT chunk_id, -sum({idf} * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))) AS raw
            FROM ({leaves}) JOIN sizes USING (chunk_id), corpus GROUP BY chunk_id HAVING {having})"""

    k, listed = len(words), ", ".join(f"'{w}'" for w in words)
    joins = " ".join(f"JOIN own t{i} ON t{i}.chunk_id = t0.chunk_id AND t{i}.term = '{w}' AND t{i}.pos = t0.pos + {i}" for i, w in enumerate(words) if i)
    phrase = f"SELECT chunk_id, f, count(*) OVER () AS df FROM (SELECT t0.chunk_id, count(*) AS f FROM own t0 {joins} WHERE t0.term = '{words[0]}' GROUP BY t0.chunk_id)"
    near = f"""SELECT term, chunk_id, f, df FROM (SELECT term, chunk_id, count(*) AS f FROM (
            SELECT a.term, a.chunk_id, a.pos FROM own a JOIN own z ON a.chunk_id = z.chunk_id AND a.term <> z.term AND abs(a.pos - z.pos) - 1 <= 10
            GROUP BY a.term, a.chunk_id, a.pos HAVING count(DISTINCT z.term) = {k - 1}) GROUP BY term, chunk_id) JOIN dfs USING (term)"""
    any_ = "SELECT term, chunk_id, count(*) AS f, any_value(df) AS df FROM own JOIN dfs USING (term) GROUP BY term, chunk_id"
    return f"""WITH {CHUNKS}, {TOKENS}, own AS (SELECT * FROM tokens WHERE term IN ({listed})), dfs AS (SELECT term, count(DISTINCT chunk_id) AS df FROM own GROUP BY term),
    {scored("v0", phrase)}, {scored("v1", near, f"count(*) = {k}")}, {scored("v2", any_, f"count(*) = {k}")}, {scored("v3", any_)},
    every AS (SELECT 0 AS v, * FROM v0 UNION ALL SELECT 1, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3),
    firsts AS (SELECT chunk_id, min(v) AS v FROM every GROUP BY chunk_id),
    pool AS (SELECT chunk_id, min(raw) AS raw FROM every WHERE (SELECT count(*) FROM firsts f WHERE f.v < every.v) < {limit} GROUP BY chunk_id ORDER BY round(min(raw), 9), chunk_id LIMIT {limit})
    SELECT chunk_id, round(raw, 6) AS raw, round(CASE WHEN max(raw) OVER () = min(raw) OVER () THEN 1.0 ELSE (max(raw) OVER () - raw) / (max(raw) OVER () - min(raw) OVER ()) END, 4) AS score FROM pool"""


@query(_variants_sql(["from", "the", "with"], 50))
def search_variants(spark, d):
    words = fts.query_terms("from the with")
    found = fts.search(b.postings(spark, d, words), b.lengths(spark, d), "from the with", 50, bounds=b.bounds(spark, d, words), corpus=b.corpus(spark, d))
    return found.select("chunk_id", F.round("raw", 6).alias("raw"), F.round("score", 4).alias("score"))


@query()
def search_stemmed(spark, d):
    stems = fts.query_terms("thing")
    return fts.search(b.stemmed(spark, d, stems), b.lengths(spark, d), "thing", 50, bounds=b.bounds(spark, d, stems, "stemmed"), corpus=b.corpus(spark, d))


# ---------------------------------------------------------------- linking


_GRAMS = r"""names AS (SELECT item_id AS entity_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')[1:2 + item_id % 5], ' ') AS gram FROM benchmark),
    t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents),
    grams AS (SELECT doc_id, array_to_string(t[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, t, n, unnest(generate_series(1, len(t) - n + 1)) AS i FROM t, generate_series(2, 6) AS lengths(n)))"""


def _names(spark, d):
    words = text.tokens(F.col("text"))
    return b.table(spark, d, "benchmark").select(F.col("item_id").alias("entity_id"), F.array_join(F.slice(words, F.lit(1), (F.col("item_id") % 5 + 2).cast("int")), " ").alias("name"))


def _linked(spark, d):
    """Stored at first use in an application: who asks twice does not have the texts looked through twice."""
    docs = b.documents(spark, d).select("id", "text")
    return b.once(spark, d, "linked", lambda: linking.name_mentions(docs, _names(spark, d)))


@query(f"WITH {_GRAMS} SELECT entity_id, doc_id AS document_id, count(*) AS hits FROM grams JOIN names USING (gram) GROUP BY entity_id, doc_id")
def mention_links(spark, d):
    return _linked(spark, d)


@query(f"WITH {_GRAMS}, m AS (SELECT entity_id, doc_id AS document_id, count(*) AS hits FROM grams JOIN names USING (gram) GROUP BY entity_id, doc_id) SELECT * FROM m WHERE NOT (document_id % 3 = 0 AND entity_id % 2 = 0)")
def suppressed_links(spark, d):
    found = _linked(spark, d)
    return linking.without_suppressed(found, found.filter("document_id % 3 = 0 and entity_id % 2 = 0").select("document_id", "entity_id")).select("entity_id", "document_id", "hits")


_CUST_MENTIONS = "m AS (SELECT o_custkey AS entity_id, o_orderkey % 400 AS document_id, 'nation' || c_nationkey AS name, o_orderstatus = 'F' AS strong FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT c_custkey AS entity_id, 'nation' || c_nationkey AS first_name FROM customer WHERE c_custkey % 2 = 0)"


@query(f"""WITH {_CUST_MENTIONS}, own AS (SELECT first_name, count(DISTINCT entity_id) AS owners FROM n GROUP BY first_name), x AS (SELECT m.*, NOT strong AND coalesce(owners, 1) >= 2 AS doubtful FROM m LEFT JOIN own ON name = first_name),
    sure AS (SELECT DISTINCT entity_id, document_id FROM x WHERE NOT doubtful)
    SELECT * FROM sure UNION SELECT entity_id, document_id FROM x SEMI JOIN sure USING (entity_id, document_id) WHERE doubtful""")
def disambiguation(spark, d):
    customers = b.table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"), F.concat(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("name"))
    orders = b.table(spark, d, "orders").select(F.col("o_custkey").alias("entity_id"), (F.col("o_orderkey") % 400).alias("document_id"), (F.col("o_orderstatus") == "F").alias("strong"))
    return linking.disambiguated(orders.join(customers, "entity_id"), customers.filter("entity_id % 2 = 0").withColumnRenamed("name", "first_name"))


@query("""WITH a AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Supplier#' || lpad((o_orderkey % 150)::VARCHAR, 9, '0') ELSE 'nobody' END AS name, 's' || (o_orderkey % 120) || '@x.org' AS email FROM orders),
    e AS (SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'S' || s_suppkey || '@X.org' END AS email FROM supplier)
    SELECT document_id, a.name, a.email, coalesce(e1.id, e2.id) AS entity_id, CASE WHEN e1.id IS NOT NULL THEN 'email' WHEN e2.id IS NOT NULL THEN 'name' ELSE 'created' END AS matched_by
    FROM a LEFT JOIN e e1 ON lower(a.email) = lower(e1.email) LEFT JOIN e e2 ON lower(a.name) = lower(e2.name)""")
def attendee_links(spark, d):
    k = F.col("o_orderkey")
    a = b.table(spark, d, "orders").select(k.alias("document_id"), F.when(k % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad((k % 150).cast("string"), 9, "0"))).otherwise("nobody").alias("name"), F.concat(F.lit("s"), (k % 120).cast("string"), F.lit("@x.org")).alias("email"))
    e = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), F.lit("@X.org"))).alias("email"))
    return linking.link_attendees(a, e)


@query("""WITH tasks AS (SELECT p_partkey AS task_id, p_name AS title, CASE WHEN p_partkey % 5 = 0 THEN 'due soon' || chr(10) || 'Project: ' || upper(p_brand) WHEN p_partkey % 7 = 0 THEN 'project: none such' ELSE 'x' END AS description FROM part),
    projects AS (SELECT row_number() OVER (ORDER BY name) AS project_id, name FROM (SELECT DISTINCT lower(p_brand) AS name FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] || ' ' || string_split(p_name, ' ')[2] FROM part WHERE p_partkey % 9 = 0 UNION SELECT 'idge' UNION SELECT 'red')),
    x AS (SELECT *, nullif(lower(trim(regexp_extract(description, '(?im)^project:[ ]*(.+)$', 1))), '') AS link FROM tasks)
    SELECT task_id, name, 1::INT AS tier FROM x JOIN projects ON link = name
    UNION SELECT task_id, name, 2::INT FROM x JOIN projects ON link IS NULL AND length(name) >= 4 AND contains(lower(title), name)
    UNION SELECT task_id, name, 2::INT FROM x JOIN projects ON link IS NULL AND length(name) < 4 AND regexp_matches(lower(title), '\\b' || name || '\\b')""")
def task_matching(spark, d):
    p = b.table(spark, d, "part")
    body = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("due soon\nProject: "), F.upper("p_brand"))).when(F.col("p_partkey") % 7 == 0, F.lit("project: none such")).otherwise(F.lit("x"))
    tasks = p.select(F.col("p_partkey").alias("task_id"), F.col("p_name").alias("title"), body.alias("description"))
    names = p.select(F.lower("p_brand").alias("name")).union(p.select(F.get(F.split("p_name", " "), F.lit(0)))).union(p.filter("p_partkey % 9 = 0").select(F.concat_ws(" ", F.slice(F.split("p_name", " "), 1, 2)))).union(spark.createDataFrame([("idge",), ("red",)], "name string")).distinct()
    projects = names.select(F.col("name").alias("project_id"), "name")
    return linking.match_tasks(tasks, projects).select("task_id", F.col("project_id").alias("name"), "tier")


@query(f"WITH {DOCS} SELECT path, len(regexp_extract_all(text, '(?i)password')) ::INT AS hits, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '(?i)password')) AS lines FROM docs WHERE regexp_matches(text, '(?i)password')")
def correction_scan(spark, d):
    return linking.correction_scan(b.documents(spark, d), "password")


@query(f"WITH {DOCS} SELECT path, sha256(regexp_replace(text, '(?i)password', 'pass$1word', 'g')) AS digest FROM docs WHERE regexp_matches(text, '(?i)password')")
def correction_apply(spark, d):
    files = b.documents(spark, d).filter(F.col("text").rlike("(?i)password"))
    return linking.corrected(files, "password", "pass$1word").select("path", F.sha2("text", 256).alias("digest"))


@query(f"WITH {DOCS} SELECT path FROM docs WHERE regexp_matches(text, '(?i)(?:AKIA[A-Z0-9]{{16}})|(?:worthless)')")
def denylist_scan(spark, d):
    return linking.denied(b.documents(spark, d), ["AKIA[A-Z0-9]{16}", "worthless"])


# Entities named by what benchmark items begin with; a tag of documents and the first word, if it is long, are aliases.
_CAST = r"""cast_ AS (SELECT item_id AS id, array_to_string(t[1:2 + item_id % 3], ' ') AS name, ['q' || (item_id % 40), t[1]] AS aliases FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS t FROM benchmark)),
    names AS (SELECT id, place, CASE WHEN place = 0 THEN name ELSE aliases[place] END AS name FROM (SELECT *, unnest([0, 1, 2]) AS place FROM cast_)),
    marked AS (SELECT *, NOT contains(name, ' ') AND length(name) >= 4 AND name NOT IN ('product', 'data', 'design', 'staff', 'security', 'core', 'sources', 'quality', 'applied', 'front', 'incidents', 'machine') AS bare FROM names WHERE trim(name) <> ''),
    known AS (SELECT *, count(DISTINCT CASE WHEN bare THEN id END) OVER (PARTITION BY name) >= 2 AS shared FROM marked)"""


MENTION_FINDER_SQL = rf"""WITH {DOCS}, {_CAST},
    fields AS (SELECT id AS doc, 'discussed' AS kind, -1 AS scope, text FROM docs UNION ALL SELECT id, 'title', -2, title FROM docs
        UNION ALL SELECT id, 'participant', unnest(generate_series(1, len(parts))), trim(unnest(parts)) FROM (SELECT id, regexp_split_to_array(title, '(?i)\s+(?:/|x|&|vs)\s+') AS parts FROM docs)),
    cut AS (SELECT doc, kind, scope, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') AS p FROM fields),
    pieces AS (SELECT doc, kind, scope, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM cut),
    ahead AS (SELECT doc, kind, scope, w AS g1, w || lead(w, 1) OVER o || lead(w, 2) OVER o AS g3, w || lead(w, 1) OVER o || lead(w, 2) OVER o || lead(w, 3) OVER o || lead(w, 4) OVER o AS g5,
        w || lead(w, 1) OVER o || lead(w, 2) OVER o || lead(w, 3) OVER o || lead(w, 4) OVER o || lead(w, 5) OVER o || lead(w, 6) OVER o AS g7
        FROM pieces WINDOW o AS (PARTITION BY doc, kind, scope ORDER BY i)),
    grams AS (SELECT DISTINCT doc, kind, scope, lower(g) AS gram, g AS raw FROM (SELECT doc, kind, scope, unnest([g1, g3, g5, g7]) AS g FROM ahead) WHERE lower(g) IN (SELECT name FROM known)),
    hits AS (SELECT doc, kind, scope, id, place, bare, shared, NOT contains(name, ' ') AS weak FROM grams JOIN known ON gram = name
        WHERE CASE kind WHEN 'title' THEN length(name) > 3 WHEN 'participant' THEN length(name) >= 4 ELSE length(name) >= 2 AND (raw = name OR name NOT IN ('product', 'data', 'design', 'staff', 'security', 'core', 'sources', 'quality', 'applied', 'front', 'incidents', 'machine')) END
        UNION ALL SELECT doc, kind, scope, id, place, bare, shared, false FROM fields JOIN known ON kind = 'participant' AND lower(text) = name),
    placed AS (SELECT doc, id, kind, scope, min(CASE WHEN NOT (bare AND shared) THEN place * 2 + weak::INT END) AS f FROM hits WHERE kind <> 'discussed' GROUP BY doc, id, kind, scope),
    said AS (SELECT doc, id, kind, scope, min(CASE WHEN NOT weak OR NOT shared THEN weak::INT END) AS f FROM hits WHERE kind = 'discussed' GROUP BY doc, id, kind, scope),
    tagged AS (SELECT DISTINCT doc, known.id, 'tagged' AS kind, -3 AS scope, 0 AS f FROM (SELECT id AS doc, unnest(tags) AS tag FROM docs) t JOIN known ON lower(trim(tag)) = name),
    every AS (SELECT * FROM placed UNION ALL SELECT * FROM said UNION ALL SELECT * FROM tagged),
    proof AS (SELECT DISTINCT doc, id FROM every WHERE f IS NOT NULL AND f % 2 = 0)
    SELECT DISTINCT id AS entity_id, doc AS document_id, kind AS mention_type FROM every LEFT JOIN proof USING (doc, id) WHERE f IS NOT NULL OR proof.doc IS NOT NULL"""


@query(MENTION_FINDER_SQL)
def mention_finder(spark, d):
    t = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    rows = b.table(spark, d, "benchmark").select(F.col("item_id").alias("id"), t.alias("t"))
    cast = rows.select("id", F.array_join(F.slice("t", F.lit(1), (F.col("id") % 3 + 2).cast("int")), " ").alias("name"), F.array(F.concat(F.lit("q"), (F.col("id") % 40).cast("string")), F.get("t", F.lit(0))).alias("aliases"))
    docs = b.documents(spark, d).select("id", "title", "tags", "text", F.lit(None).cast("array<string>").alias("attendees"))
    return mentions.find(docs, cast)


@query("""SELECT p_partkey AS id, map_from_entries(list_transform(list_filter(string_split('name=' || p_name || '; brand = ' || p_brand || ';;x', ';'), lambda x: contains(x, '=')), lambda x: {'k': trim(split_part(x, '=', 1)), 'v': trim(split_part(x, '=', 2))}))['brand'] AS brand,
    CASE WHEN length(p_name) > 20 THEN p_name[1:17] || '...' ELSE p_name END AS short FROM part""")
def key_values(spark, d):
    raw = F.concat(F.lit("name="), "p_name", F.lit("; brand = "), "p_brand", F.lit(";;x"))
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.element_at(snippets.key_values(raw), F.lit("brand")).alias("brand"), snippets.shortened(F.col("p_name")).alias("short"))


# ---------------------------------------------------------------- open metadata


@query(f"""WITH {ATTRIBUTES} SELECT id, (j->'$.budget.amount')::BIGINT AS amount, (j->'$.budget.rate')::DOUBLE AS rate, j->>'$.sources[1].id' AS tracker, json_extract_string(j, '$."a.b"') AS dotted
    FROM attributes WHERE (j->'$.budget.amount')::BIGINT >= 100000 AND list_contains(json_extract_string(j, '$.sources[*].type'), 'tracker')""")
def metadata_where(spark, d):
    found = metadata.where(b.attributes(spark, d), {"budget.amount": (">=", 100_000), "sources[*].type": "tracker"})
    at = lambda path, kind: metadata.value(F.col("attributes"), path, kind)
    return found.select("id", at("budget.amount", "long").alias("amount"), at("budget.rate", "double").alias("rate"), at("sources[1].id", "string").alias("tracker"), at('["a.b"]', "string").alias("dotted"))


@query(f"""WITH {ATTRIBUTES} SELECT id, coalesce(json_type(j, '$.level') IN ('UBIGINT', 'BIGINT') AND TRY_CAST(j->>'$.level' AS DOUBLE) > 50, false) AS number_above,
        coalesce(json_type(j, '$.level') = 'VARCHAR' AND j->>'$.level' ILIKE '%l1%', false) AS text_has, coalesce(json_type(j, '$.level') = 'NULL', false) AS is_null,
        NOT coalesce(json_exists(j, '$.sources'), false) AS no_sources, NOT coalesce(json_type(j, '$.active') = 'BOOLEAN' AND j->>'$.active' = 'true', false) AS not_active,
        coalesce(j->>'$."a.b"' IN ('BUILDING', 'MACHINERY'), false) AS one_of,
        CASE json_type(j, '$.level') WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'UBIGINT' THEN 'number' END AS level_kind FROM attributes""")
def metadata_conditions(spark, d):
    is_so = lambda path, op, x=None: metadata.condition(F.col("attributes"), path, op, x)
    told = metadata.kind(F.try_variant_get("attributes", "$.level", "variant"))
    return b.attributes(spark, d).select("id", is_so("level", ">", 50).alias("number_above"), is_so("level", "~", "l1").alias("text_has"), is_so("level", "type", "null").alias("is_null"), is_so("sources", "missing").alias("no_sources"),
                                         is_so("active", "!=", True).alias("not_active"), is_so('["a.b"]', "in", ["BUILDING", "MACHINERY"]).alias("one_of"), told.alias("level_kind"))


@query(f"""WITH {ATTRIBUTES}, t AS (SELECT replace(replace(regexp_replace(regexp_replace(fullkey, '\\[\\d+\\]', '[*]', 'g'), '^\\$\\.?', ''), '"a.b"', '["a.b"]'), ' ', '') AS path, type, value FROM attributes, json_tree(j) WHERE j IS NOT NULL)
    SELECT path, CASE type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' WHEN 'ARRAY' THEN 'array' ELSE 'number' END AS kind, count(*) AS n_values,
        min(CASE WHEN type NOT IN ('NULL', 'ARRAY') THEN value->>'$' END) AS least, max(CASE WHEN type NOT IN ('NULL', 'ARRAY') THEN value->>'$' END) AS most
    FROM t WHERE type <> 'OBJECT' AND (type <> 'ARRAY' OR json_array_length(value) = 0) GROUP BY ALL""")
def metadata_paths(spark, d):
    return metadata.inventory(b.attributes(spark, d))


# ---------------------------------------------------------------- incremental, chunking, transcripts


@query(f"WITH {DOCS}, old AS (SELECT path, CASE WHEN id % 7 = 0 THEN 'x' ELSE content_hash END AS old FROM docs WHERE id % 5 <> 0) SELECT path, CASE WHEN old IS NULL THEN 'new' ELSE 'changed' END AS status FROM docs LEFT JOIN old USING (path) WHERE old IS NULL OR old <> content_hash")
def incremental_diff(spark, d):
    docs = b.documents(spark, d)
    stored = docs.filter("id % 5 <> 0").select("path", F.when(F.col("id") % 7 == 0, F.lit("x")).otherwise(F.col("content_hash")).alias("content_hash"))
    return incremental.changes(docs, stored)


@query("""WITH s AS (SELECT user_id, max(ts) AS ts FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id), i AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_id % 3 = 0 GROUP BY user_id)
    SELECT user_id, i.ts, CASE WHEN s.ts IS NULL THEN 'created' WHEN i.ts > s.ts THEN 'updated' ELSE 'skipped' END AS status FROM i LEFT JOIN s USING (user_id)""", times=("ts",))
def upsert_latest(spark, d):
    e = b.table(spark, d, "events")
    stored = e.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp")).groupBy("user_id").agg(F.max("ts").alias("ts"))
    return incremental.upsert_latest(stored, e.filter("event_id % 3 = 0").select("user_id", "ts"), "user_id", "ts")


@query("""WITH e AS (SELECT event_id AS id, 'ev' || (event_id % 900) || CASE WHEN event_id % 2 = 0 THEN '_R20240101T000000Z' ELSE '' END || '@host' || (event_id % 3) AS uid, CASE WHEN event_id % 4 <> 0 THEN ts END AS start FROM events),
    g AS (SELECT *, regexp_replace(regexp_replace(uid, '@.*$', ''), '_R?[0-9]{8}(T[0-9]{6}Z?)?$', '') AS event_group FROM e)
    SELECT id, event_group, count(*) OVER w AS group_size, coalesce(start, min(start) OVER w) AS start FROM g WINDOW w AS (PARTITION BY event_group)""", times=("start",))
def duplicate_events(spark, d):
    i = F.col("event_id")
    uid = F.concat(F.lit("ev"), (i % 900).cast("string"), F.when(i % 2 == 0, "_R20240101T000000Z").otherwise(""), F.lit("@host"), (i % 3).cast("string"))
    events = b.table(spark, d, "events").select(i.alias("id"), uid.alias("uid"), F.when(i % 4 != 0, F.col("ts")).alias("start"))
    return incremental.duplicate_events(events).select("id", "event_group", "group_size", "start")


@query("""WITH r AS (SELECT event_id AS id, user_id AS event_group, event_type = 'purchase' AND event_id % 2 = 0 AS diarised, ts AS seen_at FROM events)
    SELECT id, CASE WHEN (CASE WHEN max(diarised::INT) OVER (PARTITION BY event_group) = 1 THEN diarised ELSE row_number() OVER (PARTITION BY event_group ORDER BY diarised DESC, seen_at, id) = 1 END) THEN 'primary' ELSE 'mic' END AS variant FROM r""")
def recording_variants(spark, d):
    r = b.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("event_group"), ((F.col("event_type") == "purchase") & (F.col("event_id") % 2 == 0)).alias("diarised"), F.col("ts").alias("at"))
    return incremental.elected(r).select("id", "variant")


@query("""WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE length(trim(coalesce(text, ''))) > 0),
    c AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(role) OVER w IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS change FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, sum(change) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS run FROM c)
    SELECT conv_id, run, any_value(role) AS role, string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS n FROM r GROUP BY conv_id, run""")
def speaker_merge(spark, d):
    return chunking.merged_turns(b.table(spark, d, "conversations"))


@query(f"""WITH {CHUNKS}, m AS (SELECT document_id, chunk_index, content, regexp_matches(content, '^#{{2,3}} +[^ ]') AS header FROM chunks),
    s AS (SELECT *, sum(header::INT) OVER (PARTITION BY document_id ORDER BY chunk_index)::BIGINT AS section FROM m)
    SELECT document_id, section, max(CASE WHEN header THEN trim(regexp_replace(content, '^#{{2,3}} +', '')) END) AS heading,
        trim(coalesce(string_agg(content, chr(10) ORDER BY chunk_index) FILTER (NOT header), '')) AS body FROM s GROUP BY document_id, section""")
def header_sections(spark, d):
    lines = b.chunks(spark, d).select("document_id", F.col("chunk_index").alias("line_no"), F.col("content").alias("line"))
    return chunking.sections(lines)


@query(f"WITH {DOCS} SELECT id AS document_id, '__document__' AS heading, CASE WHEN doc_type = 'fr' AND length(text) > 4500 THEN substr(text, 1, 3000) || '...' || substr(text, length(text) - 1499, 1500) ELSE text END AS content FROM docs WHERE doc_type <> 'es'")
def summary_chunks(spark, d):
    kind = F.when(F.col("doc_type") == "fr", "transcript").when(F.col("doc_type") == "es", "glossary").otherwise(F.col("doc_type"))
    return chunking.summaries(b.documents(spark, d).withColumn("doc_type", kind))


@query()
def note_chunks(spark, d):
    return chunking.chunked(b.documents(spark, d))


@query()
def transcript_chunks(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("**"), "role", F.lit(":** "), F.replace("text", F.lit("\n"), F.lit(" "))).alias("line"))))
    talks = b.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(turns, lambda t: t["line"]), "\n").alias("text"))
    return chunking.chunked(talks.withColumns({"title": F.lit("talk"), "doc_type": F.lit("transcript")}))


@query()
def abstracts(spark, d):
    docs = b.documents(spark, d)
    return docs.select("id", text.first_sentence(F.col("text"), F.col("title")).alias("abstract"), text.first_paragraph(F.col("text")).alias("overview"))
