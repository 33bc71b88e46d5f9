"""Runs against a search of every period, and the whole query on the smallest tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from noteloom.llm import periodic_runs as pr
from noteloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words):
    numbers: dict = {}
    c = np.array([numbers.setdefault(w, len(numbers)) for w in words])
    out = []
    for q in range(1, len(c) // 4 + 1):
        edge = np.diff(np.concatenate([[0], c[:-q] == c[q:], [0]]).astype(int))
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            n = e - s + q
            if n >= max(6, 4 * q) and not any(q % p == 0 and (c[s : s + n - p] == c[s + p : s + n]).all() for p in range(1, q)):
                out.append((int(s), int(n), int(q)))
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    """What the query returns for a document, from the words on."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.text("ab", min_size=1, max_size=7), st.integers(1, 9)), max_size=5), min_size=1, max_size=4))
def test_runs_of_words_by_every_period(parts):
    texts = [[c for u, k in doc for c in u * k] for doc in parts]
    assert pr.runs_of(texts) == [brute(w) for w in texts]


def test_larger_random_texts():
    rng = random.Random(5)
    for size in (2, 3, 30):
        texts = []
        for _ in range(8):
            w = [f"w{rng.randrange(size)}" for _ in range(rng.randint(0, 900))]
            for _ in range(5):
                u = [f"w{rng.randrange(size)}" for _ in range(rng.randint(1, 60))]
                w[rng.randint(0, len(w)) :0] = (u * 9)[: rng.randint(1, 9 * len(u))]
            texts.append(w)
        assert pr.runs_of(texts) == [brute(w) for w in texts]


def test_long_texts_take_seconds():
    words = [f"w{i % 5000}" for i in range(20_000)]
    assert pr.runs_of([["a"] * 20_000, words, [str(i) for i in range(300_000)]]) == [[(0, 20_000, 1)], [(0, 20_000, 5000)], []]


def test_whole_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()]
    want = [digest(*r) for r in rows]
    assert sorted(got) == sorted(want) and any(r[1] for r in want)


def test_nulls_repeats_and_an_empty_table(spark):
    schema = "doc_id long, text string, runs string, n_words int"
    rows = [(None, "a " * 20, "x", 1), (1, None, None, None), (2, "", "x", 2), (3, " \t\n", "x", 3), (4, "b\x0bb b  b\tb b", "x", 4), (4, "b\x0bb b  b\tb b", "x", 4),
            (5, "é x " * 8, "x", 5), (11, "one two three four five six seven eight nine ten " * 9, "x", 6)]
    rows += [(i, " ".join(f"t{k % 7}" for k in range(i % 50)), "x", 0) for i in range(100, 200)]
    got = [tuple(r) for r in pr.digests(pr.find(pr.planted(spark.createDataFrame(rows, schema)))).collect()]
    assert sorted(got, key=str) == sorted((digest(i, t) for i, t, *_ in rows), key=str)
    assert pr.digests(pr.find(pr.planted(spark.createDataFrame([], schema)))).collect() == []
