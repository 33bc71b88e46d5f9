"""Mixing sources to target weights.

Tokens are summed by source; each source's target is its share by weight of all tokens, capped at a largest
repetition rate, what the capped ones leave being shared among the others by weight. A document is emitted
floor(rate) times, plus once more by a Bernoulli draw, seeded by a hash of its id, with the fraction as probability;
so reruns agree, and a document's copies don't depend on other documents of its source.

Null text has size 0, and so does a text without words; a source of size 0 has target 0. Null is a source of its
own, last in order. Repeated rows draw alike, sources of equal cap and weight go by name. Very long texts are counted
whole. An empty table gives no rows; other columns pass unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm import common

#: Weights of the sources in order, repeated.
WEIGHTS = (5, 2, 1)
#: Times that a source is repeated at most.
MAX_RATE = 3
SEED = "mix-1"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size in words): short rows; the text is read once."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), common.word_count(common.whole_text(text_col)).alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target): one row per source.

    Sources whose cap is small for their weight fill up first: in the order of cap/weight, the first source whose
    cap is above its share of what is left, and all after it, share that by weight. One task orders the sources: a few
    numbers each, summed before, so a million of them still are some dozens of MB."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.get(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    weighted = by_source.withColumn("w", w).withColumn("cap", max_rate * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    left = weighted.withColumns({
        "left_tokens": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "left_weight": F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    free = F.col("cap") * F.col("left_weight") > F.col("left_tokens") * F.col("w")
    first = left.withColumn("free", free).withColumn("level", F.max(F.when(F.col("free"), F.struct("left_weight", "left_tokens"))).over(whole))
    target = F.when(F.col("free"), F.col("level.left_tokens").cast("double") * F.col("w") / F.col("level.left_weight")).otherwise(F.col("cap").cast("double"))
    return first.select("source", "source_size", target.alias("target"))


def draw(id_col: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id, the same on any engine: 52 bits of its SHA-256."""
    bits = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")), 256), 1, 13), 16, 10)
    return bits.cast("long").cast("double") / F.lit(float(1 << 52))


def rated(sizes: DataFrame, rates: DataFrame, seed: str = SEED) -> DataFrame:
    """Adds source_size, target, copies to (doc_id, source, size). Rates are small, but of no fixed number:
    their size is checked before they are broadcast."""
    rates = common.small(common.materialize(rates, "rates", narrow=True), common.BROADCAST_ROWS).withColumnRenamed("source", "_s")
    joined = sizes.join(rates, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(draw("doc_id", seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long"))


def plan(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken."""
    sizes = common.materialize(sized(docs), "sizes")
    done = rated(sizes, targets(sizes, weights, max_rate), seed)
    return done.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """The documents of the mix with all their columns, each as many times as it is taken. Only the few rows by
    source are joined to the texts."""
    sizes = common.materialize(sized(docs), "sizes")
    _s, _rate, _copy = common.fresh(docs, "_s", "_rate", "_copy")
    rates = targets(sizes, weights, max_rate)
    rates = rates.select(F.col("source").alias(_s), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(_rate))
    rates = common.small(common.materialize(rates, "rates", narrow=True), common.BROADCAST_ROWS)
    joined = docs.join(rates, F.col("source").cast("string").eqNullSafe(F.col(_s)))
    copies = F.floor(F.col(_rate)) + F.when(draw("doc_id", seed) < F.col(_rate) - F.floor(F.col(_rate)), 1).otherwise(0)
    return joined.withColumn(_copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).drop(_s, _rate, _copy)
