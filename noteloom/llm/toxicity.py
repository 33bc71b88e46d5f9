"""Toxicity by compression distance.

Texts, in lower case and without marks and digits, are read in overlapping windows of WINDOW bytes. The zstandard trainer
makes a dictionary of windows of ordinary texts, and dictionaries of windows of toxic texts that the first one compresses
badly. The latter come in segments; a segment stays where it makes toxic windows shorter much more often than ordinary
ones, as measured by compressing both. That is done in rounds: each trains on the windows of toxic documents in which the
segments so far shorten nothing. The toxic dictionary is the ordinary one with all segments behind it, so that what both
kinds of text share costs the same by either; a window's distance is its length by the ordinary dictionary less that by
the toxic one. Windows have the same length, so distances need no norm. A document's score comes from its distances and
how many of its windows reach thresholds, calibrated by logistic regression on training rows kept apart from the rounds.

Training takes a bounded sample of labelled rows (SAMPLE_DOCS of each label) and of their windows (SAMPLE_WINDOWS); ids,
languages and sources are no inputs of a score. Of several labels of an id the largest counts, and rows that share an id
all have it. Null and empty texts have no windows and score by the intercept alone, or 0 without a model; tables without
labels of both kinds, or with too little text to train on, give score 0 for all. Equal texts score alike. Very long texts
are read whole, repeated rows get a row each, an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm import common

#: Labelled rows of each label that training takes, about, and windows of each label that it looks at in a round.
SAMPLE_DOCS, SAMPLE_WINDOWS = 8000, 60_000
#: Of those, windows of toxic and ordinary text that a segment is measured on, if it does well on the first of them.
MEASURE, SCREEN = (20_000, 48_000), (2_500, 6_000)
#: Bytes of a window, and their step.
WINDOW, STEP = 48, 24
LEVEL = 3
#: Bytes of the ordinary dictionary and of what a round trains; the trainer's segment lengths, and its unit.
ORDINARY_BYTES, ROUND_BYTES = 32_000, 16_384
ORDINARY_SEGMENT, SEGMENT, UNIT = 32, 10, 6
#: A round trains on this share of its windows, those that the ordinary dictionary compresses worst.
HARD = 0.3
ROUNDS = 4
#: A segment shortens a window by GAIN bytes at least; it stays if RATIO times as many toxic windows get shorter.
GAIN, RATIO, LEAST = 2, 5.0, 4
#: A document tells something once this share of its windows, and two at least, is shortened.
TOLD = 0.02
#: One training row in so many is kept for the calibration.
CALIBRATE = 4
_EDGE = re.compile(r"[\W\d_]+")
#: About the bytes before a trained dictionary's content: its tables.
_HEADER = 256


def normal(text: str | None) -> bytes:
    """The text in lower case, its words apart by single spaces, with a space at either end; or nothing."""
    found = _EDGE.sub(" ", (text or "").lower()).strip()
    return f" {found} ".encode("utf-8", "surrogatepass") if found else b""


def starts(n: int) -> range:
    """Where the windows of a text of n bytes begin."""
    return range(0, max(1, n - WINDOW + STEP), STEP) if n else range(0)


def cut(text: bytes) -> list[bytes]:
    return [text[i : i + WINDOW] for i in starts(len(text))]


class Lengths:
    """Compressed lengths of many windows by one dictionary."""

    def __init__(self, dictionary: bytes):
        import zstandard

        made = zstandard.ZstdCompressionDict(dictionary)
        made.precompute_compress(LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, data: bytes, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        import zstandard

        out = np.empty(len(begin), np.int64)
        for a in range(0, len(begin), 20_000):
            part = np.stack([begin[a : a + 20_000], size[a : a + 20_000]], axis=1).astype(np.uint64)
            if len(part):
                found = self.compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, part.tobytes()), threads=1)
                out[a : a + len(part)] = [len(x) for x in found]
        return out

    def of(self, windows: list[bytes]) -> np.ndarray:
        size = np.array([len(w) for w in windows], np.int64)
        return self(b"".join(windows), np.cumsum(size) - size, size)


class Distance:
    """Distances of windows by two dictionaries: that of ordinary text, and with toxic segments behind it."""

    def __init__(self, ordinary: bytes, segments: bytes = b""):
        self.ordinary, self.segments, self._made = ordinary, segments, None

    def __reduce__(self):
        return Distance, (self.ordinary, self.segments)

    def lengths(self) -> tuple[Lengths, Lengths]:
        if self._made is None:
            self._made = Lengths(self.ordinary), Lengths(self.ordinary + self.segments)
        return self._made

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The distances of each text's windows."""
        data = [normal(t) for t in texts]
        each = [np.arange(0, max(1, len(d) - WINDOW + STEP), STEP) if d else np.zeros(0, np.int64) for d in data]
        before = np.cumsum([0, *map(len, data)])
        begin = np.concatenate([x + b for x, b in zip(each, before)] or [np.zeros(0, np.int64)])
        stop = np.repeat(before[1:], [len(x) for x in each]) if data else begin
        size = np.minimum(WINDOW, stop - begin)
        whole = b"".join(data)
        by_ordinary, by_toxic = self.lengths()
        far = by_ordinary(whole, begin, size) - by_toxic(whole, begin, size) if self.segments else np.zeros(len(begin), np.int64)
        return np.split(far, np.cumsum([len(x) for x in each])[:-1]) if data else []


def features(far: np.ndarray) -> list[float]:
    """Of a document's distances: the three largest, how many reach two, three and four bytes and what share does, how
    many there are, their positive sum for the root of that number, and their mean."""
    n = len(far)
    if not n:
        return [0.0] * 11
    top = np.sort(far)[::-1]
    hot = [int((far >= k).sum()) for k in (2, 3, 4)]
    return [*map(float, [*top[:3], 0, 0, 0][:3]), *map(float, hot), hot[0] / n, hot[1] / n, float(np.log1p(n)), float(np.maximum(far, 0).sum() / np.sqrt(n)), float(far.mean())]


def bounded(labelled: DataFrame, per_label: int = SAMPLE_DOCS) -> DataFrame:
    """About per_label rows of each label, chosen by a hash of the id."""
    (share,) = common.fresh(labelled, "_share")
    shares = labelled.groupBy("toxic").agg((F.lit(float(per_label)) / F.count(F.lit(1))).alias(share))
    u = F.pmod(F.xxhash64(F.lit("toxic"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.join(F.broadcast(shares), "toxic").filter(u < F.col(share)).select(*[F.col(f"`{c}`") for c in labelled.columns])  # a row for each label


def _windows(texts: DataFrame, distance: Distance | None, most: int = SAMPLE_WINDOWS) -> list[bytes]:
    """About `most` windows of the (doc_id, text) rows, in a random order that reruns repeat; with a distance, only of
    texts that it tells nothing of. They are chosen by a hash of id and place, so that a passage that many documents share
    comes in proportion, not in all its copies."""
    import xxhash

    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, most * STEP / max(1, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            ranks: list[int] = []
            out: list[bytes] = []
            for s in common.slices(found):
                far = distance(found[s]) if distance else [None] * (s.stop - s.start)
                for name, text, x in zip(ids[s], found[s], far):
                    if x is None or not ((hot := int((x >= GAIN).sum())) >= 2 and hot >= TOLD * len(x)):
                        for k, w in enumerate(cut(normal(text))):
                            rank = xxhash.xxh32_intdigest(name, k)
                            if rank < share * 2**32:
                                ranks.append(rank)
                                out.append(w)
            yield pa.RecordBatch.from_pydict({"rank": pa.array(ranks, pa.int64()), "w": pa.array(out, pa.binary())})

    named = texts.select(F.col("doc_id").cast("string").alias("id"), "text")
    found = named.mapInArrow(run, "rank long, w binary").toArrow().to_pylist()  # `most`, about
    return [r["w"] for r in sorted(found, key=lambda r: (r["rank"], r["w"]))]


def _trained(size: int, windows: list[bytes], segment: int) -> bytes | None:
    """A dictionary that the zstandard library trains on the windows; None where they are too few for it."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, windows, k=segment, d=UNIT).as_bytes()
    except zstandard.ZstdError:
        return None


def _gains(spark, ordinary: bytes, segments: list[bytes], toxic: list[bytes], other: list[bytes]) -> list[tuple[bytes, int, int]]:
    """For each segment that the first windows don't speak against, how many of the windows get shorter by it."""
    shared = spark.sparkContext.broadcast((ordinary, toxic, other))  # MEASURE windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, *both = shared.value
        plain = Lengths(base)
        alone = [plain.of(w) for w in both]

        def shorter(by: Lengths, kind: int, a: int, b: int) -> int:
            return int((alone[kind][a:b] - by.of(both[kind][a:b]) >= GAIN).sum()) if a < len(both[kind]) else 0

        for batch in batches:
            found, hits = [], []
            for s in batch.column("segment").to_pylist():
                by = Lengths(base + s)
                t, o = (shorter(by, k, 0, SCREEN[k]) for k in (0, 1))
                if t * min(len(both[1]), SCREEN[1]) >= 2 * (o + 0.5) * min(len(both[0]), SCREEN[0]):
                    found.append(s)
                    hits.append([n + shorter(by, k, SCREEN[k], len(both[k])) for k, n in enumerate((t, o))])
            yield pa.RecordBatch.from_pydict({"segment": pa.array(found, pa.binary()), "t": pa.array([h[0] for h in hits], pa.int64()), "o": pa.array([h[1] for h in hits], pa.int64())})
        common.release()

    rows = spark.createDataFrame(list(enumerate(map(bytearray, segments))), "at int, segment binary").repartition(2 * spark.sparkContext.defaultParallelism, "at")
    found = [(bytes(r["segment"]), r["t"], r["o"]) for r in rows.select("segment").mapInArrow(run, "segment binary, t long, o long").collect()]  # ROUND_BYTES
    shared.destroy()
    return found


def segments(sample: DataFrame) -> Distance | None:
    """The two dictionaries, from (text, toxic) rows; None where there is too little ordinary text."""
    spark = sample.sparkSession
    other = _windows(sample.filter("toxic = 0"), None)
    ordinary = _trained(ORDINARY_BYTES, other, ORDINARY_SEGMENT)
    if ordinary is None:
        return None
    distance, by = Distance(ordinary), Lengths(ordinary)
    toxic = sample.filter("toxic = 1")
    measure = _windows(toxic, None)[: MEASURE[0]], other[: MEASURE[1]]
    for _ in range(ROUNDS):
        left = _windows(toxic, distance if distance.segments else None)
        long = [w for w in left if len(w) >= WINDOW // 2]
        if not long:
            break
        cost = by.of(long) / np.array([len(w) for w in long])
        hard = [w for w, c in zip(long, cost) if c >= np.quantile(cost, 1 - HARD)]
        made = _trained(ROUND_BYTES, hard, SEGMENT)
        if made is None:
            break
        content = made[_HEADER:]
        cuts = [content[i : i + 2 * SEGMENT] for i in range(0, len(content) - SEGMENT, SEGMENT)]  # overlapping, as the trainer's own cuts are not told
        kept = []
        for s, t, o in _gains(spark, ordinary, cuts, *measure):
            ratio = (t / len(measure[0])) / ((o + 2) / len(measure[1]))
            if t >= LEAST and ratio >= RATIO:
                kept.append((ratio, s))
        distance = Distance(ordinary, distance.segments + b"".join(s for _, s in sorted(kept)))
    return distance


def train(sample: DataFrame) -> tuple[Distance, np.ndarray] | None:
    """Dictionaries, and the weights of the calibration, from (doc_id, text, toxic) rows; None without both labels."""
    n = {int(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    apart = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("doc_id")), F.lit(CALIBRATE)) == 0
    distance = segments(sample.filter(~apart))
    if distance is None:
        return None
    rows = sample.filter(apart).select("toxic", _features(distance)(F.col("text")).alias("x")).toArrow()  # SAMPLE_DOCS rows of a few numbers
    x, y = np.array(rows["x"].to_pylist(), float).reshape(len(rows), -1), rows["toxic"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _logistic((x - mean) / spread, y)
    return distance, np.append(w[0] - (w[1:] * mean / spread).sum(), w[1:] / spread)


def _features(distance: Distance):
    @F.arrow_udf("array<double>")
    def found(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        return pa.array([features(x) for s in common.slices(texts) for x in distance(texts[s])], pa.list_(pa.float64()))

    return found


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, intercept first, by Newton's method with a little shrinkage."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))


def score(model: tuple[Distance, np.ndarray] | None, text: Column) -> Column:
    """The score of a text, 0 to 1."""
    if model is None:
        return F.lit(0.0)
    distance, weights = model

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        x = np.array([features(far) for s in common.slices(texts) for far in distance(texts[s])], float).reshape(len(texts), -1)
        return pa.array(probability(weights, x) if len(texts) else [], pa.float64())

    return scored(text)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic): the bounded sample that training takes; fold 2 of crc32(doc_id as text) mod 4 is held out."""
    marked = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", "text").filter((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("text").isNotNull())
    ids = bounded(texts.select("doc_id").join(marked, "doc_id").distinct())
    return common.materialize(texts.join(common.small(ids), "doc_id").select("doc_id", "text", "toxic"), "labelled")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per document."""
    held = (F.crc32(F.col("doc_id").cast("string")) % 4) == 2
    model = train(labelled(docs, labels))
    return docs.select("doc_id", held.alias("held_out"), score(model, F.col("text")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
