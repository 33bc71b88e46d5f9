"""Distances, features and scores against one process that compresses window by window."""

import random

import numpy as np
import pytest
import zstandard

from noteloom.llm import toxicity

CALM = [f"{a}{b}" for a in ("mel", "tor", "sa", "quin", "ve", "lo", "bra", "ni") for b in ("dor", "lin", "ta", "ru", "mes", "po")]
RUDE = ["zzyxgrob", "krumpfwatz", "vexhuzzle"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(CALM) for _ in range(rng.randint(20, 200))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(max(3, len(words) // 15)):
                words[rng.randrange(len(words))] = rng.choice(RUDE)
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(spark.createDataFrame(corpus(1500, 1), "doc_id long, text string, toxic int"))


def test_scores_against_window_by_window_compression(spark, model):
    distance, weights = model

    def compressor(dictionary):
        return zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)

    ordinary, toxic = compressor(distance.ordinary), compressor(distance.ordinary + distance.segments)
    texts = [t for _, t, _ in corpus(40, 2)] + [None, "", " .,! 12 ", "x", "Zzyxgrob!", "é\U0001f600 " * 100, "word " * 5000, "a" * 100_000]
    for text, far in zip(texts, distance(texts)):
        data = toxicity.normal(text)
        windows = [data[i : i + 48] for i in range(0, max(1, len(data) - 24), 24)] if data else []
        assert b"".join(w[:24] for w in windows[:-1]) + (windows[-1] if windows else b"") == data
        assert far.tolist() == [len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", toxicity.score(model, toxicity.F.col("text")).alias("score")).collect()
    want = toxicity.probability(weights, np.array([toxicity.features(far) for far in distance(texts)]))
    assert {r["i"]: r["score"] for r in got} == pytest.approx(dict(enumerate(want)))


def test_words_of_toxic_rows_are_learnt(spark, model):
    rows = corpus(300, 3)
    got = toxicity.probability(model[1], np.array([toxicity.features(x) for x in model[0]([t for _, t, _ in rows])]))
    assert sum((p >= 0.3) == y for p, (_, _, y) in zip(got, rows)) >= 0.95 * len(rows)


def test_repeated_ids_and_labels(spark):
    rows = corpus(400, 4)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(0, "another text"), (0, rows[0][1]), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (0, None), (1, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == 403 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 0}) == 2


def test_a_line_of_all_documents_comes_in_proportion(spark):
    line = "the very same line that every single document has at its beginning and which is long enough to be many windows "
    rows = [(i, line * 3 + text, y) for i, text, y in corpus(3000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").filter("toxic = 0")
    cuts = [toxicity.cut(toxicity.normal(text)) for _, text, y in rows if not y]
    first, every = cuts[0][2], sum(map(len, cuts))
    size = sum(len(text.encode()) for _, text, y in rows if not y)
    for most in (5000, 20_000):
        got = toxicity._windows(docs, None, most)
        share = most * toxicity.STEP / size
        assert 0.9 * share * every < len(got) < 1.1 * share * every
        assert 0.7 * share * len(cuts) < sum(w == first for w in got) < 1.3 * share * len(cuts)
        assert got == toxicity._windows(docs.repartition(5), None, most)
