"""Byte-level BPE against the library itself, on whole tables and where long texts are cut."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from noteloom.llm import byte_bpe
from noteloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PIECES = ["a", "Z", "é", "ß", "中", "1", "9", "٣", "'s", "'", "'ll", "!", "-", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x00", "😀", "the ", " don't", "\r\n", "<|endoftext|>"]


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(byte_bpe.default_ranks(), byte_bpe.default_pattern())


def digest(codec, doc_id, text):
    ids = codec.library.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())


def test_whole_query(spark, codec):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = [tuple(r) for r in QUERIES["op13_byte_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(digest(codec, *r) for r in rows)


@pytest.mark.parametrize("part", [2, 5, 16])
def test_cuts_change_nothing(codec, monkeypatch, part):
    monkeypatch.setattr(byte_bpe, "PART", part)
    rng = random.Random(part)
    for _ in range(4000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 50)))
        text += rng.choice(PIECES) * rng.randint(0, 90) + rng.choice(PIECES) * rng.randint(0, 3)
        assert codec.encode(text).tolist() == codec.library.encode_ordinary(text), repr(text)


def test_long_runs(codec):
    """The library itself gives up on the runs of whitespace."""
    for text in ("\n" * 1_500_000 + "x", " " * 1_500_000, "x" + " " * 1_200_000 + " y", "ab" * 500_000, "a1!" * 300_000, "中文字" * 100_000, "'" * 400_000 + "s"):
        ids = codec.encode(text)
        assert codec.decode(ids.tolist()) == text.encode() and ids.dtype == np.dtype("<u4")
    assert codec.encode(" " * 200_001 + "x").tolist() == codec.library.encode_ordinary(" " * 200_001 + "x")


def test_nulls_repeats_names_and_an_empty_table(spark, codec):
    schema = "doc_id string, text string, n_tokens string, ids int"
    rows = [("a", None, "x", 1), (None, "", "x", 1), ("c", "hello  world\n", "x", None), ("c", "hello  world\n", "x", None), ("d", "é😀\x00", None, 2), ("e", "word " * 60_000, "x", 3)]
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in byte_bpe.digests(df).collect()]
    assert sorted(got, key=str) == sorted((digest(codec, i, t) for i, t, *_ in rows), key=str)
    assert byte_bpe.digests(df.limit(0)).collect() == []
    both = byte_bpe.decode(byte_bpe.encode(df)).select("text", "ids", F.col("decoded").cast("string").alias("decoded")).collect()
    assert all((r.text or "") == r.decoded for r in both) and byte_bpe.encode(df).columns == df.columns
    cut = spark.createDataFrame([(codec.encode("😀").tolist()[:1],), (None,)], "ids array<int>")
    assert [r.decoded for r in byte_bpe.decode(cut).collect()] == [codec.decode(codec.encode("😀").tolist()[:1]), None]
