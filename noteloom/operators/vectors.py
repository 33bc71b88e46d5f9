"""Nearest neighbours by exact cosine. The query is a literal, so a search is one scan with a top-k, no join."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def vector_of(vectors: DataFrame, vec_id: int, id_col: str = "vec_id") -> list[float]:
    """One stored vector, as a query."""
    row = vectors.filter(F.col(id_col) == vec_id).select("embedding").first()
    return list(row[0]) if row else []


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", threshold: float | None = None) -> DataFrame:
    """The k rows most similar to the query, score rounded to 4 places, ties by id. Filters belong before the call,
    so that they cut candidates and not results."""
    scored = vectors.withColumn("score", F.round(cosine(F.col("embedding"), literal(query)), 4))
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def top_k_blas(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id") -> DataFrame:
    """As top_k, by one matrix product for each Arrow batch, for wide vectors."""
    q = np.asarray(query, float)
    q = q / (np.linalg.norm(q) or 1.0)

    def scores(batches):
        for batch in batches:
            m = np.vstack(batch["embedding"]).astype(float) if len(batch) else np.zeros((0, len(q)))
            size = np.linalg.norm(m, axis=1)
            s = np.round((m @ q) / np.where(size > 0, size, 1.0), 4)
            best = np.lexsort((batch[id_col], -s))[:k]
            yield pd.DataFrame({id_col: batch[id_col].iloc[best], "score": s[best]})

    return vectors.select(id_col, "embedding").mapInPandas(scores, f"{id_col} long, score double").orderBy(F.desc("score"), id_col).limit(k)


def model_embedding(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 32, most: int = 8_000) -> Callable[[Column], Column]:
    """An embedding by a model, for KnowledgeBase(embed=...): `load` is called once in each worker and gives a function from
    texts to a matrix of one row each; a text's first `most` characters are read, null as empty. Vectors get unit length."""
    from pyspark.ml.functions import predict_batch_udf

    def make():
        model = load()

        def predict(texts: np.ndarray) -> np.ndarray:
            found = np.asarray(model([(t or "")[:most] for t in texts]), float)
            size = np.linalg.norm(found, axis=1, keepdims=True)
            return found / np.where(size > 0, size, 1.0)

        return predict

    return predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch)


def hash_embedding(tokens: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for a model: signed counts of hashed tokens, unit length."""
    slots = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(2 * dim)).cast("int"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.size(F.filter(slots, lambda s: s == 2 * i)) - F.size(F.filter(slots, lambda s: s == 2 * i + 1))).cast("double"))
    size = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.when(size > 0, x / size).otherwise(0.0))
