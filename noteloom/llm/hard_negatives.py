"""Hard negatives by one-dimensional distance keys.

Vectors get one more component so that all have the length M of the longest; then the vector with the greatest inner
product with an anchor is the nearest one, as |anchor - vector|^2 = |anchor|^2 + M^2 - 2 * product. Each is filed under
its nearest pivot and stored sorted by (pivot, distance to the pivot), in blocks. A vector at distance D from an anchor
has a key within D of the anchor's own distance to the pivot. So a search scans the key intervals of one radius, goes
on with those between it and a wider one, and ends when the radius reaches the distance of the k-th hit: no other key
can beat it. A greatest product, as for negatives that must stay below their positive, makes a hole around the anchor:
the search begins at its rim and skips what lies inside as a whole.

Pivots are taken from a sample of SAMPLE rows (those with the least hashes of their ids; all if fewer); every row is
indexed and the results are exact, whatever the pivots. Products are sums of whole numbers, exact in any order. Blocks
hold BLOCK rows at most, wherever many rows have one key, and a task compares one block with CHUNK groups of GROUP
anchors, so neither a common vector nor a common anchor makes a task larger.

Rows without an id, a label or a vector, or with a component that is null or not finite, take no part. Shorter vectors
count as if zeros followed. Repeated rows each count; equal scores are ordered by the smaller id. An empty table, one
without anchors, and anchors without positives or fitting negatives give no rows. Further columns are not read. Vectors
so long that products may pass 2**50 are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.llm import common

#: Rows whose vectors may become pivots; pivots are the root of their number.
SAMPLE = 2048
#: Rows of a block, anchors of a group, groups that meet a block in one task.
BLOCK, GROUP, CHUNK = 4096, 256, 16
#: The first radius, in lengths of the longest vector.
STEP = 0.5
#: A component x counts as floor(SCALE * x).
SCALE = 256.0
#: Distances are known this well, in lengths of the longest vector.
SLACK = 1e-6
_EXACT = 2.0**50
_INDEX = "block long, pivot int, low double, high double, center binary, ids binary, rows binary, labels binary, distances binary, vectors binary"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A binary column of 32-bit integers as a matrix of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(float)


def _array(table, name: str) -> np.ndarray:
    column = table.column(name)
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)


def distances(x: np.ndarray, pivots: np.ndarray, square: float) -> np.ndarray:
    """Distances between vectors and pivots, lengthened so that all have the same squared length."""
    more, pivot_more = (np.sqrt(np.maximum(square - (v * v).sum(axis=1), 0)) for v in (x, pivots))
    return np.sqrt(np.maximum(2 * square - 2 * (x @ pivots.T) - 2 * np.outer(more, pivot_more), 0))


def from_anchors(anchors: np.ndarray, pivots: np.ndarray, square: float) -> np.ndarray:
    """Distances of anchors, which are not lengthened, to pivots: roots of whole numbers, the same in every task."""
    return np.sqrt(np.maximum((anchors * anchors).sum(axis=1)[:, None] + square - 2 * (anchors @ pivots.T), 0))


class Index:
    """Vectors stored by (pivot, distance), in blocks."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: str | Column = "label"):
        self.spark = common.ready(vectors.sparkSession)
        x = F.col(vector_col)
        label = F.col(label) if isinstance(label, str) else label
        finite = F.forall("x", lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
        rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x")).filter(
            F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
        rows = rows.withColumn("x", F.transform("x", lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("double")))
        square = F.aggregate("x", F.lit(0.0).cast("double"), lambda s, c: s + c * c)
        most = rows.agg(F.max(F.size("x")).alias("dim"), F.max(square).alias("square")).first()
        self.dim, self.square = max(1, most["dim"] or 0), float(most["square"] or 0.0)
        if self.square > _EXACT:
            raise ValueError("vectors are too long for exact products")
        x = F.concat("x", F.array_repeat(F.lit(0.0).cast("double"), F.lit(self.dim) - F.size("x")))
        rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform(x, lambda c: c.cast("int")).alias("x"))
        self.pivots = self._pivots(rows)
        self.blocks = self._stored(rows)

    def _pivots(self, rows: DataFrame) -> np.ndarray:
        """Vectors far from each other: each next pivot is the one farthest from those before."""
        sample = rows.orderBy(F.xxhash64("id"), "id", F.hash("x")).limit(SAMPLE).select("x").toPandas()["x"]
        if not len(sample):
            return np.zeros((1, self.dim))
        x = np.array(sample.tolist(), float).reshape(-1, self.dim)
        best, chosen = np.full(len(x), np.inf), [0]
        while True:
            best = np.minimum(best, distances(x, x[chosen[-1:]], self.square)[:, 0])
            if len(chosen) >= len(x) ** 0.5 or best.max() <= 0:
                return x[chosen]
            chosen.append(int(best.argmax()))

    def _stored(self, rows: DataFrame) -> DataFrame:
        pivots, dim, square = self.pivots, self.dim, self.square

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column("x").flatten().to_numpy().reshape(-1, dim)
                d = distances(x.astype(float), pivots, square)
                nearest = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("id"), batch.column("label"), pa.array(nearest, pa.int32()), pa.array(d[np.arange(len(x)), nearest]),
                     pa.array([v.tobytes() for v in np.ascontiguousarray(x, "<i4")], pa.binary())],
                    ["row", "id", "label", "pivot", "distance", "x"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            number = TaskContext.get().partitionId() << 33

            def block(part: pa.Table) -> pa.RecordBatch:
                nonlocal number
                number += 1
                distances, pivot = _array(part, "distance"), part.column("pivot")[0].as_py()
                raw = [_array(part, c).astype(t).tobytes() for c, t in (("id", "<i8"), ("row", "<i8"), ("label", "<i8"), ("distance", "<f8"))]
                values = [number - 1, pivot, distances[0], distances[-1], pivots[pivot].astype("<i4").tobytes(), *raw, b"".join(part.column("x").to_pylist())]
                kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 6]
                return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], [c.split()[0] for c in _INDEX.split(", ")])

            def flush(last: bool) -> Iterator[pa.RecordBatch]:
                """Full blocks, and those whose pivot is done; the rest is held back unless it is the last."""
                if not held:
                    return
                table = pa.Table.from_batches(held)
                held.clear()
                which = _array(table, "pivot")
                edges = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
                for start, stop in zip(edges, edges[1:]):
                    while start < stop and (stop < len(which) or last or stop - start >= BLOCK):
                        take = min(BLOCK, stop - start)
                        yield block(table.slice(start, take))
                        start += take
                    if start < stop:
                        held.extend(table.slice(start, stop - start).to_batches())

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                if sum(b.num_rows for b in held) >= BLOCK:
                    yield from flush(False)
            yield from flush(True)

        table = rows.mapInArrow(keyed, "row long, id long, label long, pivot int, distance double, x binary")
        table = table.repartitionByRange("pivot", "distance", "row").sortWithinPartitions("pivot", "distance", "row")
        return common.materialize(table.mapInArrow(packed, _INDEX), "vectors-by-distance", narrow=True)

    def anchors(self, chosen: Column) -> DataFrame:
        """Rows whose id the condition holds for, in groups of neighbours: gid, row, id, label, x."""
        dim = self.dim

        def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    part = batch.slice(k, 1)
                    ids, rows, labels = (np.frombuffer(part.column(c)[0].as_py(), "<i8") for c in ("ids", "rows", "labels"))
                    x = part.column("vectors")[0].as_py()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(ids), part.column("block")[0].as_py())), pa.array(np.arange(len(ids), dtype="int32")), pa.array(rows), pa.array(ids), pa.array(labels),
                         pa.array([x[4 * dim * i : 4 * dim * (i + 1)] for i in range(len(ids))], pa.binary())], ["block", "place", "row", "id", "label", "x"])

        def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, done = TaskContext.get().partitionId() << 33, 0
            for batch in batches:
                gid = first + (done + np.arange(batch.num_rows)) // GROUP
                done += batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(gid), *[batch.column(c) for c in ("row", "id", "label", "x")]], ["gid", "row", "id", "label", "x"])

        rows = self.blocks.select("block", "ids", "rows", "labels", "vectors").mapInArrow(unpacked, "block long, place int, row long, id long, label long, x binary")
        # Block numbers and places are in the order of the keys, so neighbours come together.
        ordered = rows.filter(chosen).repartitionByRange("block", "place").sortWithinPartitions("block", "place")
        return common.materialize(ordered.mapInArrow(grouped, "gid long, row long, id long, label long, x binary"), "anchors", narrow=True)

    def _plan(self, open_: DataFrame) -> DataFrame:
        """The blocks that each group of anchors has to scan now: (gid, block)."""
        pivots, dim, square = self.pivots, self.dim, self.square

        def hulls(table: pa.Table) -> pa.Table:
            d = from_anchors(_matrix(table.column("x"), dim), pivots, square)
            reach, seen, inner = (_array(table, c)[:, None] for c in ("reach", "seen", "inner"))
            values = [(d - reach).min(axis=0), (d + reach).max(axis=0), (d - seen).max(axis=0), (d + seen).min(axis=0), (inner - d).min(axis=0)]
            gid = np.full(len(pivots), table.column("gid")[0].as_py())
            return pa.table([pa.array(gid), pa.array(np.arange(len(pivots), dtype="int32")), *map(pa.array, values)], names=["gid", "pivot", "a", "b", "c", "d", "e"])

        slack = SLACK * max(1.0, self.square**0.5)
        wanted = open_.groupBy("gid").applyInArrow(hulls, "gid long, pivot int, a double, b double, c double, d double, e double")
        blocks = common.small(self.blocks.select("block", "pivot", "low", "high"), common.BROADCAST_ROWS)
        fits = (F.col("high") >= F.col("a") - slack) & (F.col("low") <= F.col("b") + slack) & ((F.col("low") < F.col("c") + slack) | (F.col("high") > F.col("d") - slack)) & (F.col("high") >= F.col("e") - slack)
        return wanted.join(blocks, "pivot").filter(fits).select("gid", "block")

    def _scan(self, open_: DataFrame, visits: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best new hits of every search in every block: sid, score, id."""
        dim, square, slack = self.dim, self.square, SLACK * max(1.0, self.square**0.5)
        out = ["sid", "score", "id"]

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            found = []
            if left.num_rows and right.num_rows:
                ids, rows, labels, distances = (np.frombuffer(right.column(c)[0].as_py(), t) for c, t in (("ids", "<i8"), ("rows", "<i8"), ("labels", "<i8"), ("distances", "<f8")))
                x, center = _matrix(right.column("vectors").slice(0, 1), dim), _matrix(right.column("center").slice(0, 1), dim)
                by_id = np.empty(len(ids), np.int64)
                by_id[np.argsort(ids, kind="stable")] = np.arange(len(ids))[::-1]
                searches = left.column("searches").combine_chunks()
                owner = np.repeat(np.arange(left.num_rows), np.diff(searches.offsets.to_numpy()))
                search = searches.flatten()
                sid, seen, reach, low, high, worst = (search.field(c).to_numpy(zero_copy_only=False) for c in ("sid", "seen", "reach", "low", "high", "worst"))
                row, label = _array(left, "row"), _array(left, "label")
                anchors = _matrix(left.column("x"), dim)
                d = from_anchors(anchors, center, square)[:, 0]
                for start in range(0, left.num_rows, 64):
                    part = np.arange(start, min(start + 64, left.num_rows))
                    gap = np.abs(d[part, None] - distances) - slack
                    fits = (labels == label[part, None]) == same
                    if same:
                        fits &= rows != row[part, None]
                    score = (anchors[part] @ x.T).astype(np.int64)
                    order = score * len(ids) + by_id  # by score, then the smaller id; no two are equal
                    for s in np.flatnonzero((owner >= part[0]) & (owner <= part[-1])):
                        i = owner[s] - start
                        hit = np.flatnonzero(fits[i] & (gap[i] <= reach[s]) & (gap[i] > seen[s]) & (score[i] >= max(low[s], worst[s])) & (score[i] <= high[s]))
                        if len(hit) > k:
                            hit = hit[np.argpartition(order[i][hit], len(hit) - k)[len(hit) - k :]]
                        if len(hit):
                            found.append((np.full(len(hit), sid[s]), score[i][hit], ids[hit]))
            if not found:
                return pa.table([pa.array([], pa.int64())] * 3, names=out)
            return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], names=out)

        # Each anchor travels once to a block, with all its searches (at most as many as it has positives).
        gathered = open_.groupBy("gid", "row").agg(
            F.first("label").alias("label"), F.first("x").alias("x"),
            F.collect_list(F.struct("sid", "seen", "reach", "low", "high", "worst")).alias("searches"))
        visits = visits.withColumn("chunk", F.expr(f"gid div {CHUNK}"))
        left = gathered.join(visits, "gid").select("block", "chunk", "row", "label", "x", "searches")
        right = self.blocks.join(visits.select("block", "chunk").distinct(), "block").select("block", "chunk", "center", "ids", "rows", "labels", "distances", "vectors")
        left, right = (t.toDF(*t.columns).groupBy("block", "chunk") for t in (left, right))  # both come from the visits
        return left.cogroup(right).applyInArrow(compare, "sid long, score long, id long")

    def search(self, searches: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best rows for each search, as (sid, rank, score, id), of the anchor's label (but not its own row) or of
        the others. searches: sid, gid, row, label, x of an anchor, low and high (bounds of the score; null: none)."""
        dim, square = self.dim, self.square
        longest = square**0.5

        def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("x"), dim)
                own = (x * x).sum(axis=1)
                low, high = (_array(batch, c) for c in ("low", "high"))
                ball = np.sqrt(own)
                inner = np.where(high < 2**62, np.sqrt(np.maximum(own + square - 2 * np.minimum(high, _EXACT), 0)), longest - ball)
                outer = np.where(low > -(2**62), np.sqrt(np.maximum(own + square - 2 * np.maximum(low, -_EXACT), 0)), longest + ball)
                columns = {"own": own, "inner": inner, "outer": outer, "seen": np.full(len(x), -1.0), "reach": np.minimum(outer, inner + STEP * longest), "worst": np.full(len(x), -(2**63))}
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns.values())], [*batch.schema.names, *columns])

        kinds = "sid long, gid long, row long, label long, x binary, low long, high long"
        bounded = searches.select("sid", "gid", "row", "label", "x", F.coalesce("low", F.lit(-(2**63))).alias("low"), F.coalesce("high", F.lit(2**63 - 1)).alias("high"))
        state = bounded.mapInArrow(begun, f"{kinds}, own double, inner double, outer double, seen double, reach double, worst long")
        open_ = common.materialize(state, "searches", narrow=True)
        best = None
        first_best = Window.partitionBy("sid").orderBy(F.col("score").desc(), "id")
        while True:
            hits = self._scan(open_, self._plan(open_), k, same)
            hits = hits if best is None else best.select("sid", "score", "id").unionByName(hits)
            best = common.materialize(hits.withColumn("rank", F.row_number().over(first_best)).filter(F.col("rank") <= k), "hits", narrow=True)
            # Sure when the k-th hit is no farther than what was scanned, or nothing is left to scan.
            kth = best.filter(F.col("rank") == k).select("sid", F.col("score").alias("kth"))
            far = F.sqrt(F.greatest(F.col("own") + square - 2 * F.col("kth"), F.lit(0.0))) + SLACK * longest
            wider = F.least("outer", F.when(F.col("kth").isNotNull(), far).otherwise(F.col("inner") + 2 * (F.col("reach") - F.col("inner")) + SLACK))
            rest = open_.join(kth, "sid", "left").filter((F.col("reach") < F.col("outer")) & (F.col("kth").isNull() | (far > F.col("reach"))))
            rest = rest.select(*bounded.columns, "own", "inner", "outer", F.col("reach").alias("seen"), wider.alias("reach"), F.coalesce("kth", F.lit(-(2**63))).alias("worst"))
            open_ = common.materialize(rest, "searches", narrow=True)
            if open_.isEmpty():
                return best.select("sid", "rank", "score", "id")


def mine(vectors: DataFrame, chosen: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         id_col: str = "vec_id", vector_col: str = "embedding", label: str | Column = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for every anchor (a row whose `id` the
    condition holds for) and each of its first `positives` rows of the same label, the first `negatives` rows of other
    labels whose score is between low and high percent of the positive's."""
    index = Index(vectors, id_col, vector_col, label)
    anchors = index.anchors(chosen)
    unbounded = F.lit(None).cast("long")
    first = index.search(anchors.select(F.col("row").alias("sid"), "gid", "row", "label", "x", unbounded.alias("low"), unbounded.alias("high")), positives, True)
    pairs = first.select(F.col("sid").alias("row"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    # Positives with one score share a search; below zero no score is between the bounds.
    bands = pairs.select("row", "positive_score").distinct().filter(F.col("positive_score") >= 0).withColumn("low", F.expr(f"({low} * positive_score + 99) div 100")).withColumn("high", F.expr(f"({high} * positive_score) div 100"))
    bands = common.materialize(anchors.join(bands.filter(F.col("low") <= F.col("high")), "row").withColumn("sid", F.monotonically_increasing_id()), "bands", narrow=True)
    found = index.search(bands, negatives, False)
    found = bands.select("sid", "row", F.col("id").alias("anchor_id"), "positive_score").join(found, "sid")
    return found.join(pairs, ["row", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
