"""Held-out accuracy of what is trained."""

from noteloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_language(spark):
    got = QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op10_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    bad, good = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    above = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert above > 0.85  # some 250 toxic documents to learn from; more labels do better, see README


def test_urls_without_a_rule(spark):
    rows = QUERIES["op5_url_filter"](spark, SF).collect()
    ruled = {r["rule"]: r["verdict"] for r in rows if r["rule"]}
    assert ruled == {k: v for k, v in {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}.items() if k in ruled}
    assert {r["verdict"] for r in rows if not r["rule"]} <= {"allow", "block"}
