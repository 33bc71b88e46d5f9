"""Scores against models in memory that keep every gram."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from noteloom.llm import url_filter


def test_rare_grams_count_among_many_examples(spark):
    common = "https://www.example.net/en/page/of/many"  # 1.6 million characters of examples with it
    rare = [f"http://{w}.example.net/en/{w}" for w in ("quark", "zephyr", "jinx", "vortex", "ozymandias", "kiwi")]
    bad = [f"http://{w}.net/{w[::-1]}" for w in ("spam", "cheap", "pills", "bingo", "lotto", "crypt", "free")]
    others = ["http://quark.com/zephyr", "http://pills.com/bingo", "http://unseen.io/"]
    urls = [common] * 40_000 + rare + bad + others
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    text = url_filter.normal(F.col("url"))
    rows = url_filter.with_rules(pages).select("url", "ruled", text.alias("text"), (F.pmod(F.xxhash64(F.lit("calibrate"), text), F.lit(url_filter.CALIBRATE)) == 0).alias("apart")).collect()
    grams = {"allow": Counter(), "block": Counter()}
    for (_, ruled, t, apart), n in Counter(map(tuple, rows)).items():
        if ruled and not apart:
            padded = "\x02" * url_filter.ORDER + t + "\x03"
            for i in range(url_filter.ORDER, len(padded)):
                for k in range(url_filter.ORDER + 1):
                    grams[ruled][padded[i - k : i + 1]] += n
    models = {v: url_filter.Markov(dict(g)) for v, g in grams.items()}
    assert sum(n for g, n in grams["allow"].items() if len(g) == 1) > 1_000_000 and min(grams["allow"].values()) == 1
    want = {u: url_filter.difference(models["allow"], models["block"], t) for u, _, t, _ in set(map(tuple, rows))}
    for r in url_filter.judge(pages).join(pages, "page_id").select("url", "score").distinct().collect():
        assert r.score == pytest.approx(want[r.url], abs=1e-8), r.url


def test_one_kind_of_examples_allows_the_rest(spark):
    pages = spark.createDataFrame([(i, f"http://{w}.net/") for i, w in enumerate("abcdefgh")] + [(8, "http://z.io/"), (9, "")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.score) for r in url_filter.judge(pages).collect()}
    assert got[8] == ("allow", 0.0) and got[9] == ("block", 0.0) and got[0] == ("block", 0.0)
