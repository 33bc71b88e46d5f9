import pytest
from pyspark.sql import functions as F

from noteloom.functions import snippets as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_snippet(spark):
    words = " ".join(f"w{i}" for i in range(200))
    got = one(spark, S.snippet(F.lit(words), ["zzz", "w100"], 60))
    assert got.startswith("...w") and got.endswith("...") and " w100 " in got and len(got) <= 66
    assert one(spark, S.snippet(F.lit(words), [], 20)) == "w0 w1 w2 w3 w4 w5..."
    assert one(spark, S.snippet(F.lit("[Meeting: a | b] see [[Atlas|plan]]"), ["see"])) == "see Atlas"
    assert one(spark, S.snippet(F.lit(None).cast("string"), ["a"])) is None


def test_highlighted(spark):
    assert one(spark, S.highlighted(F.lit('<b> Amp & amp "x" ampere'), ["amp", "b*"])) == "&lt;<mark>b</mark>&gt; <mark>Amp</mark> &amp; <mark>amp</mark> &quot;x&quot; ampere"
    assert one(spark, S.highlighted(F.lit("mark a"), ["a", "mark"])) == "<mark>mark</mark> <mark>a</mark>"
    assert one(spark, S.highlighted(F.lit("<"), [])) == "&lt;"


def test_suggested(spark):
    names = spark.createDataFrame([("Linnea Holm",), ("Omar Aziz",), ("Linus",), (None,), ("Linnea Holm",)], "name string")
    assert [r["name"] for r in S.suggested(names, "linea").collect()] == ["Linnea Holm", "Linus"]
    assert [r["likeness"] for r in S.suggested(names, "omar aziz the second").collect()][0] == 1.0


def test_parsers(spark):
    assert S.keywords(["A ", ""]) == ["a"] and S.keywords("['AI', 'x']") == ["ai", "x"] and S.keywords("infra, Deploy,") == ["infra", "deploy"] and S.keywords(None) == [] and S.keywords("[a") == ["[a"]
    meta = {"sources": [{"type": "t", "id": "ab", "key": "abc"}, {"id": "zzz"}, 3, {"type": "u", "id": "abc", "channel": "C1234"}]}
    assert S.source_ids(meta) == ["abc", "C1234"] and S.source_entries({"sources": "x"}) == []
    assert S.source_argument("slack:channel=C1,name=#a") == {"type": "slack", "channel": "C1", "name": "#a"} and S.source_argument("t:https://a/b,c") == {"type": "t", "url": "https://a/b,c"}
    for bad in ("x", ":a=b", "t:"):
        with pytest.raises(ValueError):
            S.source_argument(bad)
    assert S.source_line({"type": "t", "name": "n", "url": "u"}) == "  t: n — u" and S.source_line({"type": "t"}) == "  t: (no details)" and S.source_line({"type": "slack", "id": "i", "channel": "c"}) == "  slack: i (c)"
    assert one(spark, S.key_values(F.lit("a=1, 2; b = x=y; c; a=3"))) == {"a": "3", "b": "x=y"}
    assert one(spark, S.key_values(F.lit("a=1,b=2"))) == {"a": "1", "b": "2"} and one(spark, S.key_values(F.lit("a=1,2"))) == {"a": "1,2"} and one(spark, S.key_values(F.lit(""))) == {}


def test_names(spark):
    aliases = F.array(F.lit("Anna"), F.lit("anna-lind"), F.lit("AL"), F.lit("src:C1"), F.lit("x"))
    assert one(spark, S.short_name(F.lit("Anna Lind"), aliases)) == "AL"
    assert one(spark, S.own_aliases(F.lit("Anna Lind"), aliases)) == ["AL", "x"]
    assert one(spark, S.shortened(F.lit("x" * 21))) == "x" * 17 + "..." and one(spark, S.linked(F.lit("A"))) == "[[A]]" and one(spark, S.linked(F.lit("[[A]] b"))) == "[[A]] b"
    assert [one(spark, S.path_category(F.lit(p))) for p in ("meetings/a", "people/b", "notes/c", "x")] == ["meeting", "entity", "note", "other"]
