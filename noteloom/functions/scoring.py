"""Score arithmetic as column expressions. Dates are compared with an `as_of` that the caller gives."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Half-lives in days, weights, and boosts of the ranking contract.
RECENCY_HALF_LIFE = 90.0
HOTNESS_HALF_LIFE = 7.0
RECENCY_WEIGHT = 0.15
HOTNESS_WEIGHT = 0.2
ENTITY_BOOST = 1.15
RRF_K = 60
RANK_BONUS = {1: 0.05, 2: 0.02, 3: 0.02}
HIERARCHY_ALPHA = 0.5
STRONG_TOP, STRONG_GAP, STRONG_FEW = 0.85, 0.15, 2
NEUTRAL_RECENCY = 0.5


def _decay(days: Column, half_life: float) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * days / half_life)


def recency_weight(date: Column, as_of: Column, half_life: float = RECENCY_HALF_LIFE) -> Column:
    """1 for today and the future, half after each half-life, 0.5 without a date."""
    days = F.datediff(as_of, date)
    return F.when(date.isNull(), NEUTRAL_RECENCY).when(days <= 0, 1.0).otherwise(_decay(days, half_life))


def recency_blend(score: Column, date: Column, as_of: Column, weight: float = RECENCY_WEIGHT) -> Column:
    """Part of the score is scaled by recency; undated rows keep theirs."""
    return F.when(date.isNull(), score).otherwise((1 - weight) * score + weight * recency_weight(date, as_of) * score)


def hotness(count: Column, last: Column, as_of: Column, half_life: float = HOTNESS_HALF_LIFE) -> Column:
    """sigmoid(log1p(count)) decayed by the age of the last access; 0 if never accessed."""
    days = F.greatest(F.datediff(as_of, last), F.lit(0))
    return F.when(last.isNull() | (F.coalesce(count, F.lit(0)) <= 0), 0.0).otherwise(1 / (1 + F.exp(-F.log1p(count))) * _decay(days, half_life))


def hotness_blend(score: Column, heat: Column, accessed: Column, weight: float = HOTNESS_WEIGHT) -> Column:
    return F.when(accessed, (1 - weight) * score + weight * heat).otherwise(score)


def minmax_bm25(raw: Column, *partition: Column) -> Column:
    """Negative scores, best lowest, to 0..1 over the pool; a pool of equals is all 1."""
    w = Window.partitionBy(*(partition or (F.lit(0),)))
    top, low = F.max(raw).over(w), F.min(raw).over(w)
    return F.when(top == low, 1.0).otherwise((top - raw) / (top - low))


def rrf(rank: Column, weight: float = 1.0, k: int = RRF_K) -> Column:
    """Reciprocal rank with bonuses for the first ranks."""
    bonus = F.lit(0.0)
    for r, b in RANK_BONUS.items():
        bonus = F.when(rank == r, b).otherwise(bonus)
    return weight / (k + rank) + bonus


def entity_boost(score: Column, hit: Column) -> Column:
    return F.when(hit, score * ENTITY_BOOST).otherwise(score)


def compose(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of components, a missing one counting 0."""
    total = sum(w for _, w in parts.values())
    out = F.lit(0.0)
    for column, w in parts.values():
        out = out + F.coalesce(column, F.lit(0.0)) * w
    return out / total if total else F.lit(0.0)


def similarity_of_distance(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def freshness(last: Column, as_of: Column) -> Column:
    """Badge by age: within 30 days, within 90, older or unknown."""
    age = F.datediff(as_of, last)
    return F.when(age <= 30, "fresh").when(age <= 90, "aging").otherwise("stale")
