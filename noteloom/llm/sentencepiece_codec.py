"""SentencePiece encoding and decoding by a table of distinct chunks.

In this vocabulary a whitespace marker stands at the start of a piece or in a run of markers only, so no piece, and
no merge, reaches from a character that isn't a marker to a marker after it. A text, with its markers written out,
therefore falls into chunks (markers, then other characters) that are segmented apart. Each distinct chunk is
segmented once per worker, and the ids of a text are those of its chunks joined by position. `fits` checks the
condition on the vocabulary, so that another model that breaks it is refused.

Null text counts as empty: the begin and end ids alone. Very long texts and chunks are encoded whole. Repeated rows
get a row each, an empty table no rows, and other columns pass through or are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm import common

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Chunks in a worker's table before it is begun anew; longer chunks than MAX_KEY are not kept.
TABLE_CHUNKS = 150_000
MAX_KEY = 48
#: Chunks that go to the library at once.
GROUP = 200


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fits(processor) -> bool:
    """Whether no piece has a marker after another character."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return not any(MARK in p.lstrip(MARK) for p in pieces)


class ChunkTable:
    """Encodes texts with one model; keeps the ids of distinct chunks as little-endian 32-bit integers."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if not fits(self.sp):
            raise ValueError("pieces of this model cross whitespace markers")
        self.bos, self.eos = (np.array([i], "<u4").tobytes() for i in (self.sp.bos_id(), self.sp.eos_id()))
        self.marked = np.array([self.sp.id_to_piece(i).startswith(MARK) for i in range(self.sp.get_piece_size())])
        self.table: dict[str, bytes] = {}

    def _segment(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """Chunks and their ids. Chunks with one marker go in joined, GROUP at a time, and are told apart by the
        markers that their first pieces begin with; the library writes a marker before what it gets."""
        plain = [c for c in chunks if c[1:2] != MARK and len(c) > 1]
        for at in range(0, len(plain), GROUP):
            part = plain[at : at + GROUP]
            ids = np.array(self.sp.encode("".join(part)[1:], num_threads=1), "<u4")
            cuts = [*np.flatnonzero(self.marked[ids]).tolist(), len(ids)]
            raw = ids.tobytes()
            yield from zip(part, (raw[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:])))
        for c in chunks:
            if c[1:2] == MARK:
                rest = c.lstrip(MARK)
                yield c, np.array(self.sp.encode(" " * (len(c) - len(rest) - 1) + rest), "<u4").tobytes()
            elif len(c) == 1:
                yield c, np.array([self.sp.piece_to_id(MARK)], "<u4").tobytes()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text, begin and end included, as bytes."""
        split = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.table) > TABLE_CHUNKS:
            self.table.clear()
        new = list({c for chunks in split for c in chunks} - self.table.keys())
        extra = {}
        for c, ids in self._segment(new):
            (self.table if len(c) <= MAX_KEY else extra)[c] = ids
        look = (lambda c: self.table.get(c) or extra[c]) if extra else self.table.__getitem__
        return [b"".join((self.bos, *map(look, chunks), self.eos)) for chunks in split]

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def table(path: str) -> ChunkTable:
    """A worker's table for a model."""
    return ChunkTable(path)


def digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the string columns `keep`, n_tokens, ids_sha256, decoded_sha256: every whole text encoded, and decoded again."""
    path = model or default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = table(path)
        for batch in batches:
            texts = batch["text"].tolist()
            for s in common.slices(texts):
                ids = t.encode(texts[s])
                yield batch.drop(columns="text").iloc[s].assign(
                    n_tokens=[len(x) // 4 for x in ids],
                    ids_sha256=[hashlib.sha256(x).hexdigest() for x in ids],
                    decoded_sha256=[hashlib.sha256(t.decode(x).encode()).hexdigest() for x in ids])
        t.table.clear()  # workers live on, for other operators
        common.release()

    kept = [F.col(c).cast("string").alias(c) for c in keep]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *kept, F.col(text_col).alias("text"))
    return rows.mapInPandas(run, ", ".join(["doc_id long", *[f"`{c}` string" for c in keep], "n_tokens long, ids_sha256 string, decoded_sha256 string"]))


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of the text, an array of int, to the columns (in place of one of that name)."""
    path = model or default_model()

    @F.pandas_udf("array<int>")
    def ids_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts, found = batch.tolist(), []
            for s in common.slices(texts):
                found += [np.frombuffer(x, "<u4").astype("int32") for x in table(path).encode(texts[s])]
            yield pd.Series(found, dtype=object)

    return docs.withColumn(out, ids_of(F.col(text_col)))


def decode(encoded: DataFrame, model: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of the ids; null ids give null."""
    path = model or default_model()

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else table(path).sp.decode([int(i) for i in x]) for x in batch], dtype=object)

    return encoded.withColumn(out, text_of(F.col(ids_col)))
