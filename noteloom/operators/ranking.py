"""Fusion and re-weighting of search hits; every step keeps its component as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions import scoring


def ranked(hits: DataFrame, score: str = "score", id_col: str = "chunk_id", name: str = "rank") -> DataFrame:
    """1-based rank of a bounded hit list."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), id_col)))


def fuse(fts: DataFrame, vectors: DataFrame, fts_weight: float = 1.0, vector_weight: float = 1.0) -> DataFrame:
    """(chunk_id, fts_rank, vector_rank, source, score): weighted reciprocal-rank fusion of two hit lists."""
    a = ranked(fts, name="fts_rank").select("chunk_id", "fts_rank")
    b = ranked(vectors, name="vector_rank").select("chunk_id", "vector_rank")
    both = a.join(b, "chunk_id", "full")
    part = lambda c, w: F.when(F.col(c).isNull(), 0.0).otherwise(scoring.rrf(F.col(c), w))
    source = F.when(F.col("vector_rank").isNull(), "fts_only").when(F.col("fts_rank").isNull(), "vector_only").otherwise("both")
    return both.withColumns({"source": source, "score": part("fts_rank", fts_weight) + part("vector_rank", vector_weight)})


def hybrid(fts: DataFrame, vectors: DataFrame | None, fts_weight: float = 1.0, vector_weight: float = 1.0) -> DataFrame:
    """Fusion, or the one list that has hits with its own scores."""
    if vectors is None or vectors.isEmpty():
        return fts.select("chunk_id", F.lit("fts_only").alias("source"), "score")
    if fts.isEmpty():
        return vectors.select("chunk_id", F.lit("vector_only").alias("source"), "score")
    return fuse(fts, vectors, fts_weight, vector_weight).select("chunk_id", "source", "score")


def strong_signal(hits: DataFrame) -> DataFrame:
    """One row: number of hits, best score, gap to the next, and whether vectors may be skipped."""
    top = F.sort_array(F.collect_list("score"), asc=False)
    row = hits.orderBy(F.desc("score")).limit(3).agg(top.alias("top"), F.count(F.lit(1)).alias("n"))
    gap = F.get("top", F.lit(0)) - F.coalesce(F.get("top", F.lit(1)), F.lit(0.0))
    strong = (F.col("n") > 0) & ((F.col("n") <= scoring.STRONG_FEW) | ((F.get("top", F.lit(0)) >= scoring.STRONG_TOP) & (gap >= scoring.STRONG_GAP)))
    return row.select("n", F.get("top", F.lit(0)).alias("top"), gap.alias("gap"), strong.alias("strong"))


def best_per_document(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """The best chunk of each document and how many of its chunks match."""
    w = Window.partitionBy("document_id")
    best = hits.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("score"), "chunk_id")), "matching_chunks": F.count(F.lit(1)).over(w)})
    best = best.filter("_r = 1").drop("_r").orderBy(F.desc("score"), "chunk_id")
    return best if limit is None else best.limit(limit)


def merged_content(hits: DataFrame) -> DataFrame:
    """(document_id, content): the matching chunks of a document in order, a blank line between them."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "content")))
    return hits.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n\n").alias("content"))


def with_recency(hits: DataFrame, as_of, weight: float = scoring.RECENCY_WEIGHT) -> DataFrame:
    day = F.lit(as_of).cast("date")
    return hits.withColumns({"recency": scoring.recency_weight(F.col("doc_date"), day), "score": scoring.recency_blend(F.col("score"), F.col("doc_date"), day, weight)})


def with_entity_boost(hits: DataFrame, query_words: list[str]) -> DataFrame:
    """Boosts hits whose entities (array of names) share a word with the query."""
    words = F.transform(F.flatten(F.transform("entities", lambda e: F.split(F.lower(e), " "))), lambda w: w)
    hit = F.arrays_overlap(words, F.array(*[F.lit(w.lower()) for w in query_words])) if query_words else F.lit(False)
    return hits.withColumn("boosted", F.coalesce(hit, F.lit(False))).withColumn("score", scoring.entity_boost(F.col("score"), F.col("boosted")))


def with_hotness(hits: DataFrame, access: DataFrame, as_of, weight: float = scoring.HOTNESS_WEIGHT) -> DataFrame:
    """access: (document_id, n_access, last_access)."""
    joined = hits.join(access, "document_id", "left")
    heat = scoring.hotness(F.col("n_access"), F.col("last_access"), F.lit(as_of).cast("date"))
    return joined.withColumn("hotness", heat).withColumn("score", scoring.hotness_blend(F.col("score"), F.col("hotness"), F.col("last_access").isNotNull(), weight))


def parent_scores(entity_hits: DataFrame, mentions: DataFrame) -> DataFrame:
    """(document_id, parent): the best score of an entity that the document mentions."""
    return mentions.join(entity_hits.select("entity_id", "score"), "entity_id").groupBy("document_id").agg(F.max("score").alias("parent"))


def with_hierarchy(hits: DataFrame, parents: DataFrame, alpha: float = scoring.HIERARCHY_ALPHA) -> DataFrame:
    """Keeps documents with a parent, and blends its score in."""
    return hits.join(parents, "document_id").withColumn("score", alpha * F.col("score") + (1 - alpha) * F.col("parent"))


def why_not(docs: DataFrame, ranks: DataFrame, limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """(id, reason, rank) of documents asked for: ranked, below_cutoff, filtered_path or no_match."""
    out = docs.select("id").join(ranks.select(F.col("document_id").alias("id"), "rank"), "id", "left")
    if allowed is None:
        inside = F.lit(True)
    else:
        out = out.join(allowed.select("id").distinct().withColumn("inside", F.lit(True)), "id", "left")
        inside = F.coalesce("inside", F.lit(False))
    reason = F.when(~inside, "filtered_path").when(F.col("rank") <= limit, "ranked").when(F.col("rank").isNotNull(), "below_cutoff").otherwise("no_match")
    return out.select("id", reason.alias("reason"), "rank")


def hit_at(results: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Share of queries whose expected document is among the first k; results: (query_id, rank), rank null if absent."""
    return results.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"hit_at_{k}") for k in ks])
