"""Full-text search: a positional index, BM25 over two weighted columns, top hits by block bounds, and query variants.

A term that ends with `*` stands for the range of the vocabulary that begins with it."""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.session import ready

# Fixed values of the ranking contract.
K1, B = 1.2, 0.75
WEIGHTS = {"content": 1.0, "heading": 2.0}
MIN_IDF = 1e-6
NEAR_GAP = 10


def _any_of(term, wanted: list[str]):
    """Whether a token is one of the terms, or in the range of one with a star."""
    plain, stars = [t for t in wanted if not t.endswith("*")], [t[:-1] for t in wanted if t.endswith("*")]
    fits = term.isin(*plain) if plain else F.lit(False)
    for p in stars:
        fits = fits | term.startswith(p)
    return fits


def looked_up(index: DataFrame, terms: list[str]) -> DataFrame:
    """The index's rows of a query's terms; those of a range come under the term with the star."""
    plain, columns = [t for t in terms if not t.endswith("*")], ["term", "chunk_id", "col", "tf", "positions"]
    found = index.filter(F.col("term").isin(*plain)).select(*columns) if plain or not terms else None
    for t in dict.fromkeys(t for t in terms if t.endswith("*")):
        one = index.filter(F.col("term").startswith(t[:-1])).groupBy("chunk_id", "col").agg(
            F.sum("tf").cast("int").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
        one = one.select(F.lit(t).alias("term"), *columns[1:])
        found = one if found is None else found.unionByName(one)
    return found


def postings(chunks: DataFrame, terms: list[str] | None = None, sized: bool = False) -> DataFrame:
    """(term, chunk_id, col, tf, positions) of chunks (chunk_id, content, heading); of some terms only, if given, for a
    query on text that has no stored index. With sized also dl, the tokens of both columns. A chunk is one row, so its
    tokens are grouped where they are, and nothing is shuffled."""
    if terms is not None:  # texts that lack the letters of every term are not cut into tokens
        low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in WEIGHTS]
        chunks = chunks.filter(reduce(or_, [x.contains(t.rstrip("*")) for t in terms for x in low], F.lit(False)))
    size = sum((F.size(T.tokens(F.col(c))) for c in WEIGHTS), F.lit(0)).cast("long").alias("dl")
    columns = F.array(*[F.struct(F.lit(c).alias("col"), T.tokens(F.col(c)).alias("tokens")) for c in WEIGHTS])
    own = ["chunk_id", *["dl"] * sized]
    texts = chunks.select("chunk_id", *[size] * sized, F.explode(columns).alias("c")).filter(F.size("c.tokens") > 0).select(*own, "c.col", "c.tokens")
    places = F.transform("tokens", lambda t, i: F.struct(t.alias("term"), i.alias("at")))
    texts = texts.withColumn("hits", F.sort_array(places if terms is None else F.filter(places, lambda h: _any_of(h["term"], terms))))
    last = F.size("hits") - 1
    begins = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get("hits", i)["term"] != F.get("hits", i - 1)["term"])))
    texts = texts.select(*own, "col", "hits", begins.alias("begins"))
    run = lambda at, k: F.slice("hits", at + 1, F.coalesce(F.get("begins", k + 1), F.size("hits")) - at)
    groups = F.transform("begins", lambda at, k: F.struct(F.get("hits", at)["term"].alias("term"), F.transform(run(at, k), lambda h: h["at"]).alias("positions")))
    found = texts.select(*own, "col", F.explode(groups).alias("g"))
    return found.select("g.term", "chunk_id", "col", F.size("g.positions").alias("tf"), "g.positions", *own[1:])


def vocabulary(chunks: DataFrame) -> DataFrame:
    """(term) of all chunks; a task sends each of its terms once."""
    return chunks.select(F.explode(F.concat(*[F.array_distinct(T.tokens(F.col(c))) for c in WEIGHTS])).alias("term")).distinct()


def query_terms(query: str, expansions: list[str] = ()) -> list[str]:
    """All tokens that the variants of a query look up, those with a star as they are."""
    return sorted({w for _, leaves in variants(query, list(expansions)) for words in leaves.values() for w in words})


def _stems(words: DataFrame) -> DataFrame:
    """(term, stem) of distinct terms, with folded letters."""
    from noteloom.functions.stem import stem

    ready(words.sparkSession)

    @F.pandas_udf("string")
    def stems(s: pd.Series) -> pd.Series:
        return s.map(lambda t: stem(T.fold(t) or t))

    return words.withColumn("stem", stems("term"))


def stemmed(index: DataFrame) -> DataFrame:
    """The index on stems and folded letters, with the lengths that it has; each distinct term is stemmed once."""
    sized = [F.first("dl").alias("dl")] * ("dl" in index.columns)
    joined = index.join(_stems(index.select("term").distinct()), "term").groupBy(F.col("stem").alias("term"), "chunk_id", "col")
    return joined.agg(F.sum("tf").cast("int").alias("tf"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"), *sized)


def words_of(words: DataFrame, stems: list[str]) -> list[str]:
    """The words of a vocabulary (term) that have one of some stems: the forms of a query's words."""
    return sorted(r["term"] for r in _stems(words).filter(F.col("stem").isin(*stems)).select("term").collect())


def lengths(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl): tokens of a chunk, both columns."""
    size = sum((F.size(T.tokens(F.col(c))) for c in WEIGHTS), F.lit(0))
    return chunks.select("chunk_id", size.cast("long").alias("dl"))


def _corpus(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avg_dl"))


def leaf_frequencies(index: DataFrame, leaves: dict[str, list[str]]) -> DataFrame:
    """(leaf, chunk_id, f, hits): weighted and plain occurrences of terms and phrases, a leaf being a list of tokens.

    A phrase is found by its places: each token's positions, moved back by its place in the phrase, agree."""
    spark = index.sparkSession
    rows = [(leaf, i, t, len(tokens)) for leaf, tokens in leaves.items() for i, t in enumerate(tokens)]
    wanted = F.broadcast(spark.createDataFrame(rows, "leaf string, at int, term string, n int"))  # the query's words
    index = looked_up(index, sorted({r[2] for r in rows}))
    matched = index.join(wanted, "term")
    # A term alone is found where its row says; only phrases bring rows together.
    found = matched.filter("n = 1").select("leaf", "chunk_id", "col", F.size("positions").cast("long").alias("hits"), F.col("positions").alias("starts"))
    if any(len(tokens) > 1 for tokens in leaves.values()):
        places = matched.filter("n > 1").select("leaf", "n", "chunk_id", "col", "at", F.explode("positions").alias("p"))
        starts = places.groupBy("leaf", "n", "chunk_id", "col", (F.col("p") - F.col("at")).alias("start")).agg(F.count(F.lit(1)).alias("matched"))
        phrases = starts.filter("matched = n").groupBy("leaf", "chunk_id", "col").agg(F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_list("start")).alias("starts"))
        found = found.unionByName(phrases)
    weight = F.when(F.col("col") == "heading", WEIGHTS["heading"]).otherwise(WEIGHTS["content"])
    return found.withColumn("f", F.col("hits") * weight)


def _score(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(chunk_id, raw, n_leaves) from (leaf, chunk_id, f, df)."""
    idf = F.log((F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, MIN_IDF).otherwise(idf)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    scored = found.join(sizes, "chunk_id").crossJoin(F.broadcast(_corpus(sizes)))  # one row
    return scored.groupBy("chunk_id").agg((-F.sum(F.when(F.col("f") > 0, part).otherwise(0.0))).alias("raw"), F.count_if(F.col("f") > 0).alias("n_leaves"))


def bm25(index: DataFrame, sizes: DataFrame, leaves: dict[str, list[str]], mode: str = "or", gap: int = NEAR_GAP) -> DataFrame:
    """(chunk_id, raw) of the chunks that match; raw is negative, the best lowest.

    mode `or`: any leaf; `and`: all, in any column; `near`: all in one column with at most `gap` tokens between, and
    only occurrences inside such groups count."""
    per_column = leaf_frequencies(index, leaves)
    df = per_column.groupBy("leaf").agg(F.countDistinct("chunk_id").alias("df"))
    if mode == "near":
        per_column = _near(per_column, leaves, gap)
    found = per_column.groupBy("leaf", "chunk_id").agg(F.sum("f").alias("f")).join(F.broadcast(df), "leaf")  # a row for each leaf
    scored = _score(found, sizes)
    if mode in ("and", "near"):
        scored = scored.filter(F.col("n_leaves") == len(leaves))
    return scored.select("chunk_id", "raw")


def _near(per_column: DataFrame, leaves: dict[str, list[str]], gap: int) -> DataFrame:
    """Keeps the occurrences in groups: for two or more leaves, those with every other leaf within the gap. One pass over
    the occurrences of a column in order: the nearest of another leaf is the last before or the first behind."""
    size = F.create_map(*[F.lit(x) for k, v in leaves.items() for x in (k, len(v))])
    own = per_column.select("leaf", "chunk_id", "col", F.explode("starts").alias("s")).withColumn("e", F.col("s") + size[F.col("leaf")])
    w = Window.partitionBy("chunk_id", "col")
    # What is behind is what came before in the other direction: frames that only grow, each row is looked at once.
    before, behind = [w.orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (("s", "leaf"), (F.desc("s"), F.desc("leaf")))]
    together = F.lit(True)
    for k, leaf in enumerate(leaves):
        is_leaf = F.col("leaf") == leaf
        own = own.withColumns({f"_b{k}": F.max(F.when(is_leaf, F.col("e"))).over(before), f"_a{k}": F.min(F.when(is_leaf, F.col("s"))).over(behind)})
        within = (F.coalesce(F.col("s") - F.col(f"_b{k}"), F.lit(gap + 1)) <= gap) | (F.coalesce(F.col(f"_a{k}") - F.col("e"), F.lit(gap + 1)) <= gap)
        together = together & (is_leaf | within)
    weight = F.when(F.col("col") == "heading", WEIGHTS["heading"]).otherwise(WEIGHTS["content"])
    return own.filter(together).groupBy("leaf", "chunk_id", "col").agg((F.count(F.lit(1)) * F.first(weight)).alias("f"))


# ---------------------------------------------------------------- top hits by block bounds

#: Chunks of about one length are in blocks together, by their ids in so many for each length.
SPREAD = 64


def block_of(chunk_id, dl):
    """The block of a chunk; lengths within a block differ by a fifth at most, so its bound is near its scores."""
    return (F.floor(4 * F.log2(dl + 1)) * SPREAD + F.pmod(F.xxhash64(chunk_id), F.lit(SPREAD))).cast("int")


def blocked(index: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The index with the length and the block of each row's chunk; sizes are for an index without lengths."""
    index = index.select("chunk_id", "term", "col", "tf", "positions", "dl") if sizes is None else index.join(sizes.select("chunk_id", "dl"), "chunk_id")
    return index.withColumn("block", block_of(F.col("chunk_id"), F.col("dl")))


def impacts(index: DataFrame) -> DataFrame:
    """(term, block, n, most, least): for each term and block the number of chunks, the greatest weighted frequency and the
    least length, from which no score in the block is greater than a bound."""
    weight = F.when(F.col("col") == "heading", WEIGHTS["heading"]).otherwise(WEIGHTS["content"])
    each = index.groupBy("term", "block", "chunk_id").agg(F.sum(F.col("tf") * weight).alias("f"), F.first("dl").alias("dl"))
    return each.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("f").alias("most"), F.min("dl").alias("least"))


def _part(idf, f, dl, avg_dl):
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avg_dl))


def top_k(index: DataFrame, bounds: DataFrame, corpus: tuple[int, float], leaves: list[str], k: int, mode: str = "or", gap: int = NEAR_GAP, told: dict | None = None) -> list[tuple[int, float]]:
    """The k best (chunk_id, raw) for some terms, as bm25() gives them: blocks with the greatest bounds are scored first,
    then those whose bound reaches the k-th score; others are never read.

    index: with dl and block; bounds: (term, block, n, most, least), rows of one block add up; corpus: number of chunks and
    average length. The bounds of a query, at most some thousand for a term, come to the driver. told: gets the numbers of
    blocks that have the terms, and that were read."""
    n_chunks, avg_dl = corpus
    rows = bounds.filter(F.col("term").isin(*leaves)).groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.min("least").alias("least")).filter("n > 0").collect()
    df = dict.fromkeys(leaves, 0)
    for r in rows:
        df[r["term"]] += r["n"]
    idf = {t: max(math.log((n_chunks - n + 0.5) / (n + 0.5)), MIN_IDF) for t, n in df.items()}
    best, chunks, terms = {}, {}, {}
    for r in rows:
        b = r["block"]
        best[b] = best.get(b, 0.0) + _part(idf[r["term"]], r["most"], r["least"], avg_dl)
        chunks[b] = chunks.get(b, 0) + r["n"]
        terms[b] = terms.get(b, 0) + 1
    if mode in ("and", "near"):
        best = {b: x for b, x in best.items() if terms[b] == len(leaves)}
    order, found, at, least = sorted(best, key=lambda b: (-best[b], b)), [], 0, 0.0
    while at < len(order) and (len(found) < k or best[order[at]] >= least - 1e-6):
        stop, seen = at, 0
        if len(found) < k:
            while stop < len(order) and seen < 4 * k:
                seen += chunks[order[stop]]
                stop += 1
        else:
            while stop < len(order) and best[order[stop]] >= least - 1e-6:
                stop += 1
        # One expression for all blocks: some thousand numbers at most, and quick to hand over.
        part = index.filter(F.col("term").isin(*leaves)).filter(f"block in ({', '.join(map(str, order[at:stop]))})")
        found += _scored_blocks(part, idf, avg_dl, leaves, k, mode, gap)
        found = sorted(found, key=lambda h: (round(h[1], 9), h[0]))[:k]
        at, least = stop, -found[-1][1] if len(found) == k else 0.0
    if told is not None:
        told["blocks"], told["read"] = told.get("blocks", 0) + len(order), told.get("read", 0) + at
    return found


def _scored_blocks(part: DataFrame, idf: dict[str, float], avg_dl: float, leaves: list[str], k: int, mode: str, gap: int) -> list[tuple[int, float]]:
    weight = F.when(F.col("col") == "heading", WEIGHTS["heading"]).otherwise(WEIGHTS["content"])
    per_column = part.select(F.col("term").alias("leaf"), "chunk_id", "col", F.col("positions").alias("starts"), (F.col("tf") * weight).alias("f"), "dl")
    if mode == "near":
        dls = per_column.select("chunk_id", "dl").distinct()
        per_column = _near(per_column, {t: [t] for t in leaves}, gap).join(dls, "chunk_id")
    each = per_column.groupBy("leaf", "chunk_id").agg(F.sum("f").alias("f"), F.first("dl").alias("dl"))
    of = F.create_map(*[F.lit(x) for kv in idf.items() for x in kv])
    scored = each.groupBy("chunk_id").agg((-F.sum(_part(of[F.col("leaf")], F.col("f"), F.col("dl"), F.lit(avg_dl)))).alias("raw"), F.count(F.lit(1)).alias("n"))
    if mode in ("and", "near"):
        scored = scored.filter(F.col("n") == len(leaves))
    return [(r["chunk_id"], r["raw"]) for r in scored.orderBy(F.round("raw", 9), "chunk_id").limit(k).collect()]


def expand_prefix(index: DataFrame, prefix: str) -> DataFrame:
    """(term, df) of the range of the vocabulary that starts with a prefix."""
    return index.filter(F.col("term").startswith(prefix)).groupBy("term").agg(F.countDistinct("chunk_id").alias("df"))


def document_frequency(index: DataFrame, chunks: DataFrame, terms: list[str]) -> DataFrame:
    """(term, n_docs): documents with a term, 0 for terms that none has."""
    spark = index.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))  # the query's words
    found = index.select("term", "chunk_id").join(wanted, "term", "left_semi").join(chunks.select("chunk_id", "document_id"), "chunk_id").groupBy("term").agg(F.countDistinct("document_id").alias("n"))
    return wanted.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).cast("long").alias("n_docs"))


def clean_query(query: str) -> str:
    """Drops boolean words, operators of the match syntax, and stars that end no word."""
    out = re.sub(r"\b(?:AND|OR|NOT|NEAR)\b", " ", query, flags=re.IGNORECASE)
    out = re.sub(r'[\^():"]', " ", out)
    out = re.sub(r"(?<![^\W_])\*|\*(?=\w)", " ", out)
    return " ".join(out.split())


def variants(query: str, expansions: list[str] = ()) -> list[tuple[str, dict[str, list[str]]]]:
    """(mode, leaves) in the order in which they are tried: one word, or phrase, near, all, any; then any with expansions.
    A star at the end of a word stays, but not in the phrase, which is of whole words."""
    words = []
    for part in clean_query(query).split():
        found = re.findall(r"[^\W_]+", part.lower())
        words += [*found[:-1], found[-1] + "*" * part.endswith("*")] if found else []
    leaves = {w: [w] for w in dict.fromkeys(words)}
    if not words:
        return []
    whole = [w.rstrip("*") for w in words]
    found = [("or", leaves)] if len(words) == 1 else [("or", {" ".join(whole): whole}), ("near", leaves), ("and", leaves), ("or", leaves)]
    extra = [w for e in expansions for w in re.findall(r"[^\W_]+", e.lower())]
    return found + ([("or", leaves | {w: [w] for w in extra})] if extra else [])


def search(index: DataFrame, sizes: DataFrame, query: str, limit: int = 50, expansions: list[str] = (), bounds: DataFrame | None = None, corpus: tuple[int, float] | None = None, told: dict | None = None) -> DataFrame:
    """(chunk_id, raw, score): the best hits of the variants, each chunk with its least raw score, scaled over the pool. A
    variant runs only if those before it found fewer than `limit` chunks; the `limit` best of each come to the driver.
    With bounds, variants of plain terms read only the blocks that they need (see top_k)."""
    from noteloom.functions.scoring import minmax_bm25

    pool: dict[int, float] = {}
    for mode, leaves in variants(query, list(expansions)):
        if len(pool) >= limit:
            break
        if told is not None:
            told.setdefault("variants", []).append(mode)
        if bounds is not None and all(len(w) == 1 and not w[0].endswith("*") for w in leaves.values()):
            hits = top_k(index, bounds, corpus, list(leaves), limit, mode, told=told)
        else:
            rows = bm25(index, sizes, leaves, mode).orderBy(F.round("raw", 9), "chunk_id").limit(limit).collect()
            hits = [(r["chunk_id"], r["raw"]) for r in rows]
        for chunk, raw in hits:
            pool[chunk] = min(raw, pool.get(chunk, 0.0))
    top = sorted(pool.items(), key=lambda h: (round(h[1], 9), h[0]))[:limit]
    return index.sparkSession.createDataFrame(top, "chunk_id long, raw double").withColumn("score", minmax_bm25(F.col("raw")))
