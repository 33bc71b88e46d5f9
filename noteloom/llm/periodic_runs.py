"""Periodic runs of words by Crochemore's partition refinement.

Positions of a text are in one class of level L when the factors of L words that begin there are equal. Level L + 1
comes from level L by splitting classes by the class of the next position. Only the members of small classes are
looked at: where a class fell apart, all its parts but the largest. A position is in a small class at most log2(n)
times, so all levels of a text of n words cost O(n log n) moves. Each position knows its neighbours in its class; a
neighbour at a distance that equals the level shows a square, two equal factors in a row, whose period is the
smallest. Squares of one period at consecutive positions are a run.

The moves of one level are array operations for a slice of documents together; classes never mix documents. A run of
period q that spans four periods has at least three members in each of its classes up to level q, so smaller classes,
and texts too short for the level, are closed: what they hold cannot be part of a run that counts.

Null text has no words, so no runs and an empty collapsed text. Very long texts are read whole, and words may be of any
length. Among runs with one start the shorter period comes first. Repeated rows get a row each, an empty table no rows;
further columns are not read, whatever their names. doc_id keeps its type, null included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm import common

#: A run has at least so many words and spans at least so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Levels after which the neighbours within reach are listed anew.
STRIDE = 64
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_TYPE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _firsts(key: np.ndarray) -> np.ndarray:
    """Places where a new value begins."""
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return new.nonzero()[0]


def _sizes(firsts: np.ndarray, n: int) -> np.ndarray:
    """Lengths of the stretches that begin at firsts, of n in all."""
    sizes = np.full(len(firsts), n)
    sizes[:-1] = firsts[1:]
    return sizes - firsts


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    if len(sizes) == 1:
        return np.arange(starts[0], starts[0] + sizes[0])
    ends = sizes.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Classes:
    """The classes of one level. Members of a class fill a stretch of `order`; neighbours are linked by place in the text."""

    def __init__(self, code: np.ndarray):
        """Level 1: equal codes make a class; negative codes, and classes of fewer than three, are closed (class 0)."""
        n = len(code)
        by_code = np.argsort(code, kind="stable")
        first = _firsts(code[by_code])
        sizes = _sizes(first, n)
        kept = (sizes >= LEAST_PERIODS - 1) & (code[by_code[first]] >= 0)
        self.order = by_code[np.repeat(kept, sizes)].astype(np.int32)
        self.size = np.concatenate([[0], sizes[kept]])
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.count = len(self.size)
        self.of = np.zeros(n, np.int32)
        self.of[self.order] = np.repeat(np.arange(1, self.count, dtype=np.int32), self.size[1:])
        self.place = np.zeros(n, np.int32)
        self.place[self.order] = np.arange(len(self.order), dtype=np.int32)
        self.next, self.prev = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self._link(self.order, np.concatenate([[0], np.cumsum(self.size[1:])[:-1]]).astype(int))
        self.moved = np.zeros(n, bool)

    def _link(self, members: np.ndarray, firsts: np.ndarray) -> None:
        """Links members, in groups that begin at firsts, with their neighbours in the group."""
        if len(members):
            self.next[members[:-1]], self.prev[members[1:]] = members[1:], members[:-1]
            self.prev[members[firsts]] = -1
            self.next[members[firsts[1:] - 1]] = -1
            self.next[members[-1]] = -1

    def _number(self, k: int) -> np.ndarray:
        """Numbers for k new classes."""
        new = np.arange(self.count, self.count + k, dtype=np.int32)
        self.count += k
        if self.count > len(self.size):
            more = np.zeros(max(self.count, 2 * len(self.size)) - len(self.size), self.size.dtype)
            self.size, self.start = np.concatenate([self.size, more]), np.concatenate([self.start, more])
        return new

    def refine(self, touched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next level. touched: open positions whose next position changed its class. Returns the positions that
        changed theirs, but for the largest part of each class, and the positions with a new right neighbour."""
        none = np.zeros(0, np.int32)
        touched.sort()
        mine, then = self.of[touched], self.of[touched + 1]
        key = mine.astype(np.int64) * self.count + then
        by = key.argsort(kind="stable")
        first = _firsts(key[by])
        sizes = _sizes(first, len(by))
        split = (sizes < self.size[mine[by[first]]]) | (then[by[first]] == 0)
        if not split.any():
            return none, none
        by = by[np.repeat(split, sizes)]
        sizes = sizes[split]
        first = np.cumsum(sizes) - sizes
        part, parent = touched[by], mine[by]  # by class, class of the next position, place
        part_class, part_next = parent[first], then[by[first]]
        # Parents, with the number that leaves each.
        p_first = _firsts(part_class)
        parents = part_class[p_first]
        leaving = np.add.reduceat(sizes, p_first)
        rest = self.size[parents] - leaving
        tail = self.start[parents] + rest
        slots = _ranges(tail, leaving)
        # Neighbours of chains that leave are linked with each other.
        by_place = (parent.astype(np.int64) * len(self.of) + part).argsort()
        chain, owner = part[by_place], parent[by_place]
        ends = np.ones(len(chain) + 1, bool)
        ends[1:-1] = (self.prev[chain[1:]] != chain[:-1]) | (owner[1:] != owner[:-1])
        left, right = self.prev[chain[ends[:-1]]], self.next[chain[ends[1:]]]
        has_left, has_right = left >= 0, right >= 0
        self.next[left[has_left]] = right[has_left]
        self.prev[right[has_right]] = left[has_right]
        # Those that stay move to the front of their class's stretch.
        self.moved[part] = True
        at_end = self.order[slots]
        staying = at_end[~self.moved[at_end]]
        self.moved[part] = False
        places = self.place[chain]
        holes = places[places < np.repeat(tail, leaving)]
        self.order[holes], self.place[staying] = staying, holes
        self.order[slots], self.place[part] = part, slots
        # New classes.
        self.size[parents] = rest
        opened = (sizes >= LEAST_PERIODS - 1) & (part_next > 0)
        number = np.zeros(len(sizes), np.int32)
        number[opened] = self._number(int(opened.sum()))
        self.size[number[opened]], self.start[number[opened]] = sizes[opened], slots[first[opened]]
        self.of[part] = np.repeat(number, sizes)
        self._link(part, first)
        closing = (rest > 0) & (rest < LEAST_PERIODS - 1)
        closed = self.order[_ranges(self.start[parents[closing]], rest[closing])]
        self.of[closed] = 0
        self.size[parents[closing]] = 0
        # All parts but the largest are looked at next.
        weight = np.where(opened, sizes, 0)
        largest = np.maximum.reduceat(weight, p_first)
        of_parent = np.repeat(np.arange(len(parents)), _sizes(p_first, len(sizes)))
        candidates = np.flatnonzero(opened & (weight == largest[of_parent]) & (rest < largest)[of_parent])
        skipped = np.zeros(len(sizes), bool)
        skipped[candidates[_firsts(of_parent[candidates])]] = True
        small_rest = (rest < largest) & ~closing & (rest > 0)
        remaining = self.order[_ranges(self.start[parents[small_rest]], rest[small_rest])]
        small = np.concatenate([part[np.repeat(~skipped, sizes)], closed, remaining])
        return small, np.concatenate([part, left[has_left]])


def squares(code: np.ndarray, words_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the squares of runs that count (and some others), sorted by period, then start. code: a
    number for each document and word, negative for what stands before, between and after documents; words_of: the
    number of words of the position's document."""
    classes = Classes(code)
    last = int(words_of.max(initial=0)) // LEAST_PERIODS
    starts, periods = [], []
    open_, near = classes.order.copy(), np.zeros(0, np.int32)
    touched, until = open_, 0
    for level in range(1, last + 1):
        if level > until:
            open_ = open_[classes.of[open_] > 0]
            short = words_of[open_] < LEAST_PERIODS * level
            classes.of[open_[short]] = 0
            open_, until = open_[~short], level + STRIDE
            gaps = classes.next[open_] - open_
            near = open_[(gaps >= level) & (gaps <= until)]
            if not len(open_):
                break
        hit = near[(classes.next[near] - near == level) & (classes.of[near] > 0)]
        if len(hit):
            starts.append(hit)
            periods.append(np.full(len(hit), level))
        touched = touched[classes.of[touched] > 0]
        if len(touched):
            small, changed = classes.refine(touched)
            touched = small - 1
            gaps = classes.next[changed] - changed
            near = np.concatenate([near, changed[(gaps > level) & (gaps <= until)]])
        if not len(touched) and not len(near) and not (classes.next[open_] - open_ > level).any():
            break
    if not starts:
        return np.zeros(0, int), np.zeros(0, int)
    pairs = np.unique(np.stack([np.concatenate(periods), np.concatenate(starts).astype(int)], axis=1), axis=0)
    return pairs[:, 1], pairs[:, 0]


def runs_of(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lengths = np.array([len(w) for w in texts])
    if not lengths.max(initial=0) >= LEAST_WORDS:
        return found
    numbers, distinct = pd.factorize(np.array([w for words in texts for w in words], dtype=object))
    doc = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(doc)) + doc + 1  # a position before each document, and one after the last
    n = len(doc) + len(texts) + 1
    code, words_of, base = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.cumsum(lengths) - lengths + np.arange(len(texts)) + 1
    code[at], words_of[at] = doc * max(1, len(distinct)) + numbers, lengths[doc]
    start, period = squares(code, words_of)
    if not len(start):
        return found
    first = np.flatnonzero((np.diff(period, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    ends = np.append(first[1:], len(start)) - 1
    s, q = start[first], period[first]
    length = start[ends] - s + 2 * q
    kept = (length >= LEAST_WORDS) & (length >= LEAST_PERIODS * q)
    s, q, length = s[kept], q[kept], length[kept]
    owner = np.searchsorted(base, s, side="right") - 1
    for k in np.lexsort((q, s)):
        found[owner[k]].append((int(s[k] - base[owner[k]]), int(length[k]), int(q[k])))
    return found


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words joined by a space, without those that a run contains after its first period."""
    if not runs:
        return " ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    dropped = np.cumsum(edges[:-1]) > 0
    return " ".join([w for w, gone in zip(words, dropped.tolist()) if not gone])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (by start, then period; word numbers from 0) and the collapsed text of every whole text."""
    common.ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for s in common.slices(texts):
                words = [_WORD.findall(t) if t else [] for t in texts[s]]
                runs = runs_of(words)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[s], pa.array([len(w) for w in words], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs], pa.list_(_RUN_TYPE)),
                    pa.array([collapsed(w, r) for w, r in zip(words, runs)], pa.string()),
                ], ["doc_id", "n_words", "runs", "collapsed"])
        common.release()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where one text in ten repeats some of its words to its end: with h the crc32 of the decimal
    doc_id, g = floor(h/10), n words, a = g % n and p = 1 + floor((n-a)/(3+g%8)), word i >= a becomes word a + (i-a)%p
    if h%10 = 0. Words are then joined by a space. A null doc_id leaves the text alone."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10).cast("long")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")

        def from_place(a):
            def with_period(p):
                places = F.sequence(F.lit(0), F.size(w) - 1)
                return F.array_join(F.transform(places, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

            return common.let(F.lit(1) + F.floor((n - a) / (3 + g % 8)), with_period)

        return F.when(n > 0, common.let(g % n, from_place)).otherwise(F.lit(""))

    text = common.whole_text(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.when(h % 10 == 0, common.let(common.words(text), repeated)).otherwise(text).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run that spans most periods (of equals the first by start, then period; nulls if there is
    none) with exponent_milli, and the digests of the runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
