"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The library splits a text by a pattern and merges the bytes of each match. Its pattern engine gives up on very long
runs of whitespace, and a long text would be one call that holds all its ids as Python numbers. So long texts are cut
first, only where a match of the pattern ends whatever stands around it:

* between a character that isn't whitespace and one that is: no match goes on from one into the other, and none that
  ends there looks ahead;
* before the last character of a run of whitespace that something follows: the run's match stops there by itself;
* inside a run without whitespace, between an ASCII letter and an ASCII digit, either way, and before a digit that
  follows an ASCII mark (not before a letter after a mark, as an apostrophe begins a contraction).

A single match is never cut; a run of whitespace that is one match is merged without the pattern. Decoding joins the
bytes of the ids, so ids that end inside a character are decoded as well.

Null text counts as empty: no ids, and the digests of nothing. Very long texts and matches are encoded whole. Repeated
rows get a row each, an empty table no rows; further columns are not read by digests(), whatever their names, and
passed through by encode() and decode(). doc_id keeps its type, null included.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm import common

#: Characters from which on a text is cut, and about as long are its parts.
PART = 1 << 16
# Where a match ends in any surroundings.
_AFTER_WORD = r"(?<=\P{White_Space})(?=\p{White_Space})"
_INSIDE_WORD = r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[!-/:-@\[-`{-~])(?=[0-9])"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _cut(text: str, edge) -> Iterator[str]:
    """Parts of about PART characters that end at an edge; longer ones where none comes."""
    at = 0
    while len(text) - at > PART:
        found = edge.search(text, at + PART)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Codec:
    """Encodes texts to ids and ids to bytes, with one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.after_word, self.inside_word, self.space = regex.compile(_AFTER_WORD), regex.compile(_INSIDE_WORD), regex.compile(r"\p{White_Space}+")

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text, and whether each is one match for certain (a run of whitespace)."""
        for part in _cut(text, self.after_word):
            if len(part) <= 2 * PART:
                yield part, False
                continue
            # Runs of at least PART characters are left: of whitespace, then of others.
            at = 0
            for run in self.space.finditer(part):
                if run.end() - run.start() > PART:
                    stop = run.end() if run.end() == len(part) else run.end() - 1
                    if run.start() > at:
                        yield part[at : run.start()], False
                    yield part[run.start() : stop], True
                    at = stop
            for piece in _cut(part[at:], self.inside_word):
                yield piece, False

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, "<u4")
        if len(text) <= PART:
            return np.array(self.library.encode_ordinary(text), "<u4")
        parts = []
        for part, whole in self._parts(text):
            ids = self.library._encode_single_piece(part) if whole else self.library.encode_ordinary(part)
            parts.append(np.array(ids, "<u4"))
        return np.concatenate(parts)

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the ids; they need not end where a character does."""
        return self.library.decode_bytes(list(ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """A worker's codec for a rank file."""
    return Codec(path, pattern)


def digests(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every whole text encoded, and its ids decoded again."""
    path, pattern = ranks or default_ranks(), pattern or default_pattern()
    common.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            numbers, encoded, decoded = [], [], []
            for text in batch.column("text"):
                ids = own.encode(text.as_py())
                numbers.append(len(ids))
                encoded.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(numbers, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        common.release()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of the text, an array of int, to the columns (in place of one of that name)."""
    path, pattern = ranks or default_ranks(), pattern or default_pattern()
    common.ready(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([codec(path, pattern).encode(t).astype("int32") for t in batch], dtype=object)

    return docs.withColumn(out, ids_of(F.col(text_col)))


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes of the ids, as binary; null ids give null. cast(out, string) makes a text of them."""
    path, pattern = ranks or default_ranks(), pattern or default_pattern()
    common.ready(encoded.sparkSession)

    @F.pandas_udf("binary")
    def bytes_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else codec(path, pattern).decode(int(i) for i in x) for x in batch], dtype=object)

    return encoded.withColumn(out, bytes_of(F.col(ids_col)))
