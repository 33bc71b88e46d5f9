"""Language identification by segmentation-marginalised unigrams.

The vocabulary is fixed and public; each language has a probability for each of its pieces. They come from the words of
its labelled documents: from one cut of each at first, then from how often each piece is expected over all segmentations
(a round of expectation and maximisation). To score a word, a forward algorithm sums over all of its
segmentations into pieces, for all languages at once; a text's log-likelihood is the sum over its words.

The model is fitted on about SAMPLE_DOCS labelled rows of each language; piece counts are summed in the cluster, and
what reaches the driver is a number for each language and piece. Null texts and texts without letters get `und` and
score 0; a table without labels gives `und` for all. Ties go to the first language by name. Very long texts and words are scored whole;
repeated rows get a row each; an empty table gives no rows; columns other than id, text and lang are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteloom.llm import common
from noteloom.llm.sentencepiece_codec import MARK, default_model, table

UND = "und"
#: Pseudo-counts, spread over the vocabulary as all languages together use it.
SMOOTHING = 200.0
#: Probability of a character that is no piece, the same in every language.
UNKNOWN = 1e-7
#: Words in a worker's table before it is begun anew; longer words are not kept.
TABLE_WORDS = 300_000
#: Rounds in which pieces are counted over all segmentations, after the first count over one cut of each word.
ROUNDS = 1
#: Labelled rows of a language that the model is fitted on, about; rows are chosen by hash of their id.
SAMPLE_DOCS = 3000
TABLE_BITS = 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def fold(id_col: str = "doc_id"):
    """crc32(doc_id as text) mod 4; fold 2 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 4


def count_words(labelled: DataFrame) -> DataFrame:
    """(word, langs, counts) of (lang, text): how often each language has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def told() -> pa.RecordBatch:
            langs, found = zip(*words) if words else ((), ())
            return pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "word": pa.array(found, pa.string()), "n": pa.array(list(words.values()), pa.int64())})

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words.update((lang, w) for w in text.lower().split())
            if len(words) > TABLE_WORDS:
                yield told()
                words.clear()
        yield told()

    seen = labelled.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    pairs = seen.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("lang", "n"))).alias("by"))  # one for each language at most
    return pairs.select("word", F.col("by.lang").alias("langs"), F.col("by.n").alias("counts"))


def count_pieces(words: DataFrame, path: str, shared=None) -> DataFrame:
    """(lang, piece, n) of counted words: of the cut that the vocabulary's merges make, or with a shared model of all
    segmentations, each as often as the model expects it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, counts = table(path), {}
        for batch in batches:
            found, by_lang, numbers = (batch.column(c).to_pylist() for c in ("word", "langs", "counts"))
            langs = sorted({x for xs in by_lang for x in xs})
            weights = np.zeros((len(found), len(langs)))
            for i, (xs, ns) in enumerate(zip(by_lang, numbers)):
                weights[i, [langs.index(x) for x in xs]] = ns
            if not found:
                continue
            if shared is None:
                ids = [np.frombuffer(x, "<u4")[1:-1] for x in t.encode(found)]
                into = np.zeros((t.sp.get_piece_size(), len(langs)))
                np.add.at(into, np.concatenate(ids), np.repeat(weights, [len(x) for x in ids], axis=0))
            else:
                m = shared.value
                columns = [m.langs.index(x) for x in langs]
                every = np.zeros((len(found), len(m.langs)))
                every[:, columns] = weights
                into = m.expected(found, every)[:, columns]
            for k, lang in enumerate(langs):
                counts[lang] = counts.get(lang, 0) + into[:, k]
        t.table.clear()
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "piece": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.float64())})

    return words.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def _hashes(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of a matrix of characters."""
    h = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        h = (h ^ column) * _PRIME
    return h


class Model:
    """Languages in order and, for each piece of the vocabulary, its probability in each.

    Pieces are found by hash in two tables, the second for those whose place in the first was taken."""

    def __init__(self, langs: list[str], counts: np.ndarray, pieces: list[str]):
        pooled = counts.sum(axis=0) + 1.0
        smooth = counts + SMOOTHING * pooled / pooled.sum()
        p = (smooth / smooth.sum(axis=1, keepdims=True)).T
        self.langs = langs
        used = [i for i, piece in enumerate(pieces) if piece]
        self.used, self.n_pieces = used, len(pieces)
        self.p = np.vstack([p[used], np.zeros(len(langs))])  # the last row is of what is no piece
        self.longest = max((len(pieces[i]) for i in used), default=1)
        keys = np.array([_hashes(np.array([[ord(c) for c in pieces[i]]], np.uint64))[0] for i in used], np.uint64)
        self.keys = np.append(keys, np.uint64(0))
        self.bits = TABLE_BITS
        while not self._placed(keys):  # two pieces meet in one place of both tables
            self.bits += 1
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, len(langs)))

    def _placed(self, keys: np.ndarray) -> bool:
        self.first = np.full(1 << self.bits, len(keys), np.int32)
        self.second = self.first.copy()
        for i, at in enumerate(self._slot(keys)):
            if self.first[at] != len(keys):
                at = self._slot(keys[i : i + 1] * _PRIME)[0]
                if self.second[at] != len(keys):
                    return False
                self.second[at] = i
            else:
                self.first[at] = i
        return True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pieces(self, h: np.ndarray) -> np.ndarray:
        """Rows of p for hashes of strings."""
        i = self.first[self._slot(h)]
        miss = self.keys[i] != h
        if miss.any():
            j = self.second[self._slot(h[miss] * _PRIME)]
            i[miss] = np.where(self.keys[j] == h[miss], j, len(self.keys) - 1)
        return i

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each marked word in each language, summed over all its segmentations: words of one
        length go through the forward algorithm together."""
        out = np.zeros((len(words), len(self.langs)))
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths).tolist():
            every = np.flatnonzero(lengths == n)
            step = max(1, min(400_000 // n, 4_000_000 // ((self.longest + 1) * max(1, len(self.langs)))))
            for at in (every[k : k + step] for k in range(0, len(every), step)):
                text = MARK.join(["", *[words[i] for i in at]])
                codes = np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(at), n + 1).astype(np.uint64)
                out[at] = self._forward(codes)
        return out

    def _forward(self, codes: np.ndarray) -> np.ndarray:
        m, n = codes.shape
        width = self.longest + 1
        ahead = np.zeros((width, m, len(self.langs)))  # sums of the next places, in a ring
        ahead[0] = 1.0
        log = np.zeros((m, 1))
        for i in range(n):
            here = ahead[i % width].copy()
            ahead[i % width] = 0.0
            top = here.max(axis=1, keepdims=True)
            if i % 16 == 15:  # keeps long words from vanishing
                here /= top
                ahead /= top
                log += np.log(top)
            h = np.zeros(m, np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = (h ^ codes[:, j - 1]) * _PRIME
                at = self._pieces(h)
                p = self.p[at]
                if j == i + 1:
                    p[at == len(self.keys) - 1] = UNKNOWN
                ahead[j % width] += here * p
        return log + np.log(np.maximum(ahead[n % width], 1e-300))

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """How often each piece (by its id) is expected in each language, over all segmentations of the words: forward
        and backward sums, scaled at each place. weights: how often each language has a word."""
        out = np.zeros((len(self.keys), len(self.langs)))
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths).tolist():
            every = np.flatnonzero(lengths == n)
            step = max(1, 2_000_000 // ((n + 1) * (self.longest + 2 * len(self.langs))))
            for at in (every[k : k + step] for k in range(0, len(every), step)):
                text = MARK.join(["", *[words[i] for i in at]])
                self._expect(np.frombuffer(text.encode("utf-32-le"), "<u4").reshape(len(at), n + 1).astype(np.uint64), weights[at], out)
        told = np.zeros((self.n_pieces, len(self.langs)))
        told[self.used] = out[:-1]
        return told

    def _expect(self, codes: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
        m, n = codes.shape
        ahead, back = np.zeros((n + 1, m, len(self.langs))), np.zeros((n + 1, m, len(self.langs)))
        ahead[0] = back[n] = 1.0
        log_ahead, log_back = np.zeros((n + 1, m, 1)), np.zeros((n + 1, m, 1))
        at = np.empty((n, self.longest, m), np.int32)  # the piece from i to j at [i, j - i - 1]: 4 bytes a place and length

        def chance(i: int, j: int) -> np.ndarray:
            p = self.p[at[i, j - i - 1]]
            if j == i + 1:
                p[at[i, 0] == len(self.keys) - 1] = UNKNOWN
            return p

        for i in range(n + 1):
            top = ahead[i].max(axis=1, keepdims=True)
            ahead[i : i + self.longest + 1] /= top
            log_ahead[i] = np.log(top) + (log_ahead[i - 1] if i else 0)
            h = np.zeros(m, np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = (h ^ codes[:, j - 1]) * _PRIME
                at[i, j - i - 1] = self._pieces(h)
                ahead[j] += ahead[i] * chance(i, j)
        for j in range(n, -1, -1):
            top = back[j].max(axis=1, keepdims=True)
            first = max(0, j - self.longest)
            back[first : j + 1] /= top
            log_back[j] = np.log(top) + (log_back[j + 1] if j < n else 0)
            for i in range(first, j):
                back[i] += back[j] * chance(i, j)
        total = np.log(np.maximum(ahead[n], 1e-300)) + log_ahead[n]
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                # A share is 1 at most; where a language's sums vanish in a long word, the bound stands in for it.
                scale = np.exp(np.minimum(log_ahead[i] + log_back[j] - total, 700.0))
                share = np.minimum(ahead[i] * chance(i, j) * back[j] * scale, 1.0)
                np.add.at(out, at[i, j - i - 1], share * weights)

    def batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its posterior probability, all being as likely before."""
        split = [t.lower().split() if t and self.langs and any(map(str.isalpha, t)) else [] for t in texts]
        if len(self.rows) > TABLE_WORDS:
            self.rows = {}
        new = list({w for ws in split for w in ws} - self.rows.keys())
        if new:
            first, last = len(self.rows), len(self.rows) + len(new)
            if last > len(self.table):  # by doubling, so that it is not copied for every batch
                grown = np.zeros((max(last, 2 * len(self.table)), len(self.langs)))
                grown[:first] = self.table[:first]
                self.table = grown
            self.table[first:last] = self.words(new)
            self.rows.update(zip(new, range(first, last)))
        found = []
        for ws in split:
            if not ws:
                found.append((UND, 0.0))
                continue
            total = self.table[list(map(self.rows.__getitem__, ws))].sum(axis=0)
            best = int(total.argmax())
            found.append((self.langs[best], float(1.0 / np.exp(total - total[best]).sum())))
        return found


def bounded(labelled: DataFrame, per_lang: int = SAMPLE_DOCS, id_col: str = "doc_id") -> DataFrame:
    """About per_lang rows of each language, or all where it has fewer, chosen by a hash of the id."""
    (share,) = common.fresh(labelled, "_share")
    shares = labelled.groupBy("lang").agg((F.lit(float(per_lang)) / F.count(F.lit(1))).alias(share))
    u = F.pmod(F.xxhash64(F.lit("lang"), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.join(F.broadcast(shares), "lang").filter(u < F.col(share)).select(*[F.col(f"`{c}`") for c in labelled.columns])  # a row for each language


def train(labelled: DataFrame, model: str | None = None, rounds: int = ROUNDS) -> Model:
    """A model of the (lang, text) rows; null langs and texts are left out."""
    spark = labelled.sparkSession
    path = model or default_model()
    words = common.materialize(count_words(labelled.filter("lang is not null and text is not null")), "words")
    sp = table(path).sp
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
    pieces = ["" if special(i) else sp.id_to_piece(i) for i in range(sp.get_piece_size())]

    def fitted(shared=None) -> Model:
        rows = count_pieces(words, path, shared).toPandas()  # languages times pieces at most
        langs = sorted(rows["lang"].unique())
        counts = np.zeros((len(langs), len(pieces)))
        counts[[langs.index(x) for x in rows["lang"]], rows["piece"].to_numpy(int)] = rows["n"]
        return Model(langs, counts, pieces)

    found = fitted()
    for _ in range(rounds if found.langs else 0):
        shared = spark.sparkContext.broadcast(found)  # languages times pieces
        found = fitted(shared)
        shared.destroy()
    return found


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages times pieces, fixed by the vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            texts = batch["text"].tolist()
            for s in common.slices(texts, 2_000_000):
                found = m.batch(texts[s])
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[s].astype("Int64"), "lang_pred": [x for x, _ in found], "score": [y for _, y in found]})
        m.rows, m.table = {}, m.table[:0].copy()
        common.release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, lang_pred string, score double")
