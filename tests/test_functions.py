import datetime as dt
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from noteloom.functions import dates, scoring, text
from noteloom.functions.stem import stem
from noteloom.operators import chunking, fts, vectors

AS_OF = dt.date(2026, 2, 10)


@pytest.mark.parametrize("query,cleaned,first,last", [
    ("budget January 2025", "budget", "2025-01-01", "2025-01-31"),
    ("2024-02 notes", "notes", "2024-02-01", "2024-02-29"),
    ("yesterday standup", "standup", "2026-02-09", "2026-02-09"),
    ("last week", "", "2026-02-02", "2026-02-08"),
    ("x last 3 months", "x", "2025-11-10", "2026-02-10"),
    ("this year plans", "plans", "2026-01-01", "2026-02-10"),
    ("no dates", "no dates", None, None),
])
def test_date_filters(query, cleaned, first, last):
    got = dates.date_filters(query, AS_OF)
    assert (got[0], got[1] and str(got[1]), got[2] and str(got[2])) == (cleaned, first, last)


@given(st.text(max_size=60))
def test_date_filters_never_fail(query):
    _, first, last = dates.date_filters(query, AS_OF)
    assert first is None or first <= last


def test_since():
    assert [str(dates.since(x, AS_OF)) for x in ("7d", "2w", "3m", "2026-01-01")] == ["2026-02-03", "2026-01-27", "2025-11-10", "2026-01-01"]


@pytest.mark.parametrize("word,expected", [
    ("running", "run"), ("runs", "run"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("sky", "sky"), ("happy", "happi"),
    ("agreed", "agre"), ("probate", "probat"), ("rate", "rate"), ("controlling", "control"), ("adoption", "adopt"), ("generalizations", "gener")])
def test_stem(word, expected):
    assert stem(word) == expected


def test_scores(spark):
    row = spark.range(1).select(
        scoring.recency_weight(F.lit("2024-10-02").cast("date"), F.lit("2024-12-31").cast("date")).alias("r"),
        scoring.recency_weight(F.lit(None).cast("date"), F.lit("2024-12-31").cast("date")).alias("none"),
        scoring.rrf(F.lit(1)).alias("first"), scoring.rrf(F.lit(5)).alias("fifth"),
        scoring.hotness(F.lit(3), F.lit("2024-12-24").cast("date"), F.lit("2024-12-31").cast("date")).alias("hot")).first()
    assert row["r"] == pytest.approx(0.5) and row["none"] == 0.5
    assert row["first"] == pytest.approx(1 / 61 + 0.05) and row["fifth"] == pytest.approx(1 / 65)
    assert row["hot"] == pytest.approx(0.5 / (1 + math.exp(-math.log(4))))


def test_text_columns(spark):
    df = spark.createDataFrame([("See [[Atlas|the plan]] and **bold** [x](http://y). Then more text follows here.", "a.b-c@x.org", "Ünusual  Title!")], "t string, e string, n string")
    row = df.select(text.strip_markdown(F.col("t")).alias("plain"), text.name_from_email(F.col("e")).alias("name"), text.slug(F.col("n")).alias("slug"), text.first_sentence(F.col("t"), F.col("n")).alias("abstract")).first()
    assert row["plain"] == "See the plan and bold x. Then more text follows here."
    assert row["name"] == "A B C" and row["slug"] == "unusual-title" and row["abstract"] == "See the plan and bold x."
    fields = spark.createDataFrame([("# T\n**Role:** Lead\n**Team:** A\n**Role:** B",)], "t string").select(text.fields(F.col("t")).alias("m")).first()["m"]
    assert fields == {"role": "Lead", "team": "A"}


def test_chunkers():
    assert chunking.note_chunks("T", "intro\n## A\nx\n## B\n---\n") == [(None, "T\nintro"), ("A", "T\nx")]
    turns = chunking.speaker_turns("**Me:** hello\nagain\n**System**: hi")
    assert turns == [("Me", "hello again"), ("System", "hi")]
    assert chunking.named_system(turns, ["Ann"])[1][0] == "Ann"
    windows = chunking.transcript_windows([(str(i % 10), "x" * 90) for i in range(100)], 1000, 200)
    assert [w.count("\n") + 1 for w in windows[:-1]] == [11] * (len(windows) - 1)  # 94 characters a turn: the eleventh reaches 1000
    assert [w[0] for w in windows[:4]] == ["0", "8", "6", "4"]  # three turns reach 200
    assert chunking.transcript_windows([("a", "y" * 5000), ("b", "z")]) == ["a: " + "y" * 5000, "b: z"]
    assert chunking.transcript_chunks("Me / Ann", "**Me:** hi\n**System:** yes") == [(None, "Me / Ann\nMe: hi\nAnn: yes")]
    assert chunking.transcript_chunks("A x B", "**System:** yes")[0][1].endswith("Other: yes") and chunking.transcript_chunks("T", "plain") == [(None, "T\nplain")]
    assert chunking.note_chunks("T", "## A\n---\n") == [(None, "T\n## A\n---")]


def test_fts_matches_sqlite(spark):
    """The same scores as SQLite's own index gives, over two columns."""
    import sqlite3

    rows = [(1, "alpha beta gamma beta", "status"), (2, "beta alpha", "alpha notes"), (3, "gamma delta epsilon zeta", None), (4, "alpha x x x x x x x x x x x x beta", "plan"), (5, "nothing here", "other"), (6, "more of nothing", None), (7, "still nothing at all", "x")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(content, heading, tokenize='unicode61')")
    db.executemany("insert into f(rowid, content, heading) values (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "chunk_id long, content string, heading string")
    index, sizes = fts.postings(df), fts.lengths(df)
    both = {"alpha": ["alpha"], "beta": ["beta"]}
    for match, leaves, mode in (("alpha OR beta", both, "or"), ("alpha AND beta", both, "and"), ('"beta alpha"', {"p": ["beta", "alpha"]}, "or"), ("NEAR(alpha beta, 10)", both, "near"), ("gamma", {"gamma": ["gamma"]}, "or")):
        want = {r[0]: round(r[1], 6) for r in db.execute("select rowid, bm25(f, 1.0, 2.0) from f where f match ?", (match,))}
        assert {r["chunk_id"]: round(r["raw"], 6) for r in fts.bm25(index, sizes, leaves, mode).collect()} == want, match


def test_query_variants():
    assert fts.clean_query('what (is) the "plan" and run* not x^2') == "what is the plan run* x2" or fts.clean_query('a AND b') == "a b"
    assert [m for m, _ in fts.variants("one two")] == ["or", "near", "and", "or"] and len(fts.variants("one")) == 1 and fts.variants("") == []


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in vectors.top_k(df, [2.0, 0.0], 3).select("vec_id", "score").collect()] == [(1, 1.0), (3, 0.6), (2, 0.0)]
    assert vectors.top_k_blas(df, [2.0, 0.0], 3).collect() == vectors.top_k(df, [2.0, 0.0], 3).select("vec_id", "score").collect()
