"""Hard negatives against every product, in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from noteloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, row string, pivot int"


def brute(rows, every=100, k=5, n=10, low=30, high=90):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label, *_ in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for at, (anchor, v, label) in enumerate(kept):
        if anchor % every:
            continue
        scored = sorted(((-dot(v, w), i, other) for j, (i, w, other) in enumerate(kept) if j != at), key=lambda t: t[:2])
        for p, positive, _ in [t for t in scored if t[2] == label][:k]:
            fits = [(-s, i) for s, i, other in scored if other != label and low * -p <= 100 * -s <= high * -p][:n]
            out += [(anchor, positive, rank, i, -p, s) for rank, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, every=100, **more):
    got = hn.mine(df, F.col("id") % every == 0, **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def vectors(rng, n, dim=8, labels=3):
    """float32 values, as a float column holds."""
    return [(i, [rng.randint(-300, 300) / 256 for _ in range(dim)], rng.randrange(labels), "x", 1) for i in range(n)]


def test_same_as_brute_force_over_several_rounds_blocks_and_groups(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("GROUP", 3), ("CHUNK", 2), ("STEP", 0.05), ("SAMPLE", 100)):
        monkeypatch.setattr(hn, name, value)
    rng = random.Random(1)
    rows = vectors(rng, 400)
    rows += [(400 + i, [1.0] * 8, i % 2, "x", 1) for i in range(120)]  # one common vector
    rows += [(600 + i, [0.5 + i % 4 / 8] * 8, 7, "x", 1) for i in range(10)]  # a rare label
    rng.shuffle(rows)
    assert mined(spark.createDataFrame(rows, SCHEMA), 20) == brute(rows, 20)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rng = random.Random(2)
    rows = vectors(rng, 60, 4)
    rows += rows[:10] + [rows[0]] * 3  # repeated rows
    rows += [(1000 + i, rows[5][1], i % 3, None, None) for i in range(8)]  # ties
    rows += [(None, [1.0] * 4, 1, "x", 1), (2000, None, 1, "x", 1), (2001, [1.0] * 4, None, "x", 1), (2002, [1.0, None, 1.0, 1.0], 1, "x", 1),
             (2003, [1.0, float("nan"), 1.0, 1.0], 1, "x", 1), (2004, [float("-inf"), 1.0, 1.0, 1.0], 1, "x", 1),
             (3000, [], 1, "x", 1), (3010, [1.5], 2, "x", 1), (3020, [0.0] * 4, 2, "x", 1)]
    assert mined(spark.createDataFrame(rows, SCHEMA), 10) == brute(rows, 10)


def test_few_rows_no_anchor_no_row(spark):
    few = [(0, [1.0, 0.0], 1, "x", 1), (1, [0.9, 0.1], 1, "x", 1), (2, [0.5, 0.1], 2, "x", 1)]
    assert mined(spark.createDataFrame(few, SCHEMA)) == brute(few) != []
    for rows in ([], few[1:], few[:2]):
        assert mined(spark.createDataFrame(rows, SCHEMA)) == []


def test_other_numbers_and_names(spark):
    rows = [(i, v, label) for i, v, label, *_ in vectors(random.Random(3), 80, 5, 2)]
    df = spark.createDataFrame(rows, "key long, v array<double>, class int")
    assert mined(df, 8, positives=2, negatives=3, low=10, high=70, id_col="key", vector_col="v", label="class") == brute(rows, 8, 2, 3, 10, 70)


def test_too_long_vectors_are_refused(spark):
    with pytest.raises(ValueError):
        hn.Index(spark.createDataFrame([(1, [1e9], 1)], "vec_id long, embedding array<double>, label int"))


def test_every_row_is_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 16)
    rows = vectors(random.Random(4), 150) + [(500 + i, [0.25] * 8, 1, "x", 1) for i in range(100)]
    blocks = hn.Index(spark.createDataFrame(rows, SCHEMA)).blocks.collect()
    assert sum(len(b.ids) // 8 for b in blocks) == 250 and max(len(b.ids) // 8 for b in blocks) == 16
    assert all(b.low <= b.high for b in blocks) and len({b.block for b in blocks}) == len(blocks)
