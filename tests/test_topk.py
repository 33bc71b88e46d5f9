"""Top hits by block bounds equal those of all hits; near by a sweep; prefixes; variants that stop."""

import random

import pytest
from pyspark.sql import functions as F

from noteloom.operators import fts

WORDS = ["ash", "birch", "birches", "cedar", "elm", "fir", "the", "of"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    rows = []
    for i in range(600):
        n = rng.choice([1, 3, 8, 20, 60, 150])
        rows.append((i, " ".join(rng.choices(WORDS, [1, 1, 1, 2, 1, 1, 12, 8], k=n)), rng.choice([None, "elm", "the cedar"])))
    return [*rows, (600, "", None), (601, None, None)]


@pytest.fixture(scope="module")
def index(spark, texts):
    chunks = spark.createDataFrame(texts, "chunk_id long, content string, heading string")
    sizes = fts.lengths(chunks).cache()
    return fts.blocked(fts.postings(chunks), sizes).cache(), sizes


def exhaustive(index, sizes, leaves, mode, k):
    rows = fts.bm25(index, sizes, leaves, mode).orderBy(F.round("raw", 9), "chunk_id").limit(k).collect()
    return [(r.chunk_id, round(r.raw, 8)) for r in rows]


@pytest.mark.parametrize("mode", ["or", "and", "near"])
@pytest.mark.parametrize("leaves", [["cedar", "elm"], ["ash", "the", "of"]])
def test_same_top_hits_as_the_exhaustive_plan(spark, index, mode, leaves):
    index, sizes = index
    corpus = sizes.agg(F.count(F.lit(1)), F.avg("dl")).first()
    told = {}
    got = fts.top_k(index, fts.impacts(index), tuple(corpus), leaves, 8, mode, told=told)
    assert [(c, round(raw, 8)) for c, raw in got] == exhaustive(index, sizes, {t: [t] for t in leaves}, mode, 8) != []
    assert 0 < told["read"] <= told["blocks"]
    if mode == "or" and leaves == ["cedar", "elm"]:
        assert told["read"] < told["blocks"] * 2 / 3


def test_terms_that_none_has(index):
    index, sizes = index
    corpus = tuple(sizes.agg(F.count(F.lit(1)), F.avg("dl")).first())
    assert fts.top_k(index, fts.impacts(index), corpus, ["zzz"], 5) == []
    assert fts.top_k(index, fts.impacts(index), corpus, ["zzz", "elm"], 5, "and") == []
    assert len(fts.top_k(index, fts.impacts(index), corpus, ["zzz", "elm"], 5)) == 5


def near_brute(texts, leaves, gap):
    out = {}
    for chunk, content, heading in texts:
        for col, text in (("content", content), ("heading", heading)):
            tokens = (text or "").split()
            at = {k: [i for i in range(len(tokens)) if tokens[i : i + len(v)] == v] for k, v in leaves.items()}
            for k, v in leaves.items():
                fits = [i for i in at[k] if all(any(max(j - i - len(v), i - j - len(leaves[o])) <= gap for j in at[o]) for o in leaves if o != k)]
                if fits:
                    out[k, chunk, col] = len(fits) * (2.0 if col == "heading" else 1.0)
    return out


@pytest.mark.parametrize("leaves", [{"ash": ["ash"], "elm": ["elm"]}, {"ash": ["ash"], "elm": ["elm"], "fir": ["fir"]}, {"of the": ["of", "the"], "cedar": ["cedar"]}])
def test_near_by_a_sweep(index, texts, leaves):
    for gap in (0, 2, 10):
        rows = fts._near(fts.leaf_frequencies(index[0], leaves), leaves, gap).collect()
        assert {(r.leaf, r.chunk_id, r.col): r.f for r in rows} == near_brute(texts, leaves, gap)


def test_a_prefix_is_a_range_of_terms(spark, index, texts):
    index, sizes = index
    got = {(r.chunk_id, r.col): r.hits for r in fts.leaf_frequencies(index, {"bir*": ["bir*"]}).collect()}
    want = {(i, "content"): n for i, t, _ in texts if (n := sum(w.startswith("bir") for w in (t or "").split()))}
    assert got == want
    phrase = {r.chunk_id for r in fts.leaf_frequencies(index, {"elm bir*": ["elm", "bir*"]}).filter("col = 'content'").collect()}
    assert phrase == {i for i, t, _ in texts if any(a == "elm" and b.startswith("bir") for a, b in zip((t or "").split(), (t or "").split()[1:]))}
    seen = {r.chunk_id for r in fts.search(index, sizes, "bir*", 1000).collect()}
    assert seen == {i for i, _ in want} and "StartsWith" in fts.looked_up(index, ["bir*"])._jdf.queryExecution().toString()


def test_prefixes_in_variants():
    assert fts.variants("Migr*") == [("or", {"migr*": ["migr*"]})]
    kinds = fts.variants("data-base migr*")
    assert kinds[0] == ("or", {"data base migr": ["data", "base", "migr"]})
    assert kinds[1:] == [(m, {"data": ["data"], "base": ["base"], "migr*": ["migr*"]}) for m in ("near", "and", "or")]


def test_a_variant_runs_only_if_needed(index, monkeypatch):
    index, sizes = index
    asked = []
    plain = fts.bm25
    monkeypatch.setattr(fts, "bm25", lambda i, s, leaves, mode="or", gap=10: asked.append(mode) or plain(i, s, leaves, mode, gap))
    few = fts.search(index, sizes, "of the", 5).collect()
    assert asked == ["or"] and len(few) == 5  # the phrase found enough
    asked.clear()
    many = fts.search(index, sizes, "elm cedar", 590).collect()
    assert asked == ["or", "near", "and", "or"] and max(r.score for r in many) == 1.0
    corpus = tuple(sizes.agg(F.count(F.lit(1)), F.avg("dl")).first())
    bounded = fts.search(index, sizes, "elm cedar", 590, bounds=fts.impacts(index), corpus=corpus).collect()
    assert [(r.chunk_id, round(r.raw, 8)) for r in bounded] == [(r.chunk_id, round(r.raw, 8)) for r in many]


def test_an_index_is_made_where_its_texts_are(spark, texts):
    """Postings need no shuffle, of all terms or of some, and have every place; near looks at each place once."""
    chunks = spark.createDataFrame(texts, "chunk_id long, content string, heading string")
    want, sizes = {}, {}
    for chunk, *columns in texts:
        for col, text in zip(("content", "heading"), columns):
            for i, t in enumerate((text or "").split()):
                want.setdefault((t, chunk, col), []).append(i)
                sizes[chunk] = sizes.get(chunk, 0) + 1
    for terms in (None, ["elm", "bir*"]):
        found = fts.postings(chunks, terms, sized=True)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
        assert all(r.tf == len(r.positions) and r.dl == sizes[r.chunk_id] for r in rows)
        kept = {k: v for k, v in want.items() if terms is None or k[0] == "elm" or k[0].startswith("bir")}
        assert {(r.term, r.chunk_id, r.col): list(r.positions) for r in rows} == kept and len(rows) == len(kept)
    one = fts.leaf_frequencies(fts.postings(chunks), {"elm": ["elm"]})
    assert "Exchange hashpartitioning" not in one._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in fts._near(one, {"elm": ["elm"], "ash": ["ash"]}, 3)._jdf.queryExecution().analyzed().toString().lower()


def test_forms_of_a_stem_are_looked_up(spark):
    chunks = spark.createDataFrame([(1, "Running runs run ran", "run"), (2, "ash", None), (3, None, "Rúns")], "chunk_id long, content string, heading string")
    words = fts.words_of(fts.vocabulary(chunks), ["run"])
    assert words == ["run", "running", "runs", "rúns"]
    index = {(r.term, r.chunk_id, r.col): (r.tf, list(r.positions), r.dl) for r in fts.stemmed(fts.postings(chunks, words, sized=True)).collect()}
    assert index == {("run", 1, "content"): (3, [0, 1, 2], 5), ("run", 1, "heading"): (1, [0], 5), ("run", 3, "heading"): (1, [0], 1)}
