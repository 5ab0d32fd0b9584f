"""Hard negatives by a vector-approximation file.

Each dimension's range is parted into at most 256 cells of equal width, and a row's
approximation is a byte a dimension.  An anchor has a table with the least that a cell
can add to its score; the sum of a row's table entries is a lower bound of the score, and
a constant of the anchor's above it lies the upper bound.  Rows whose bounds can't enter
a window are passed over; all others are scored exactly.

Anchors are worked in blocks of a fixed size, each against all rows where they lie: first
for an anchor's positives, then for the windows that those open.  Tasks return their best
rows for a window, at most `negatives` each, which are merged by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import scratch_path, settle

CELLS = 256
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score that a hard negative has at least and at most.
LOW, HIGH = 30, 90
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 100, 7, 10
#: Anchors worked against all rows in one pass; their vectors go to every task.
BLOCK_ANCHORS = 2048
#: Rows in one part of the approximations; each part returns its best rows, so there should not be too many.
PART_ROWS = 1 << 18
#: Rows and anchors whose bounds are worked out at a time.
ROWS, ANCHORS = 1024, 256
#: Stands for a null vec_id: below every other.
NO_ID = -(1 << 63)
_LARGEST = (1 << 63) - 1
#: Exact whole numbers in 64-bit arithmetic end here.
_EXACT = 1 << 62


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding): rows with a label and a finite vector, labels as the mining has them."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    id_, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    moved = F.coalesce(F.col("vec_id").cast("long") % RELABEL_EVERY == 0, F.lit(False))
    return rows.select(id_.alias("vec_id"), F.when(moved, (label + 1) % LABELS).otherwise(label).alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


def _matrix(column, width: int) -> np.ndarray:
    """Floored components of an Arrow list column; vectors shorter than `width` end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(column.offsets)
    flat = np.floor(np.asarray(column.values, float) * SCALE)
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == width).all():
        return flat[offsets[0] : offsets[-1]].reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lengths)] = flat[offsets[0] : offsets[-1]]
    return out


@dataclass
class Grid:
    """Each dimension's least value and cell width, in whole numbers (Python's, of any size)."""

    low: list[int]
    width: list[int]

    @classmethod
    def over(cls, rows: DataFrame, cells: int = CELLS) -> Grid:
        """The grid that holds every row: one row a dimension reaches the driver."""

        def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high = np.zeros(0), np.zeros(0)
            for batch in batches:
                own = _matrix(batch.column(0), max(len(low), int(np.diff(np.asarray(batch.column(0).offsets)).max(initial=0))))
                more = np.zeros(own.shape[1] - len(low))
                # 0 is in every range, as shorter vectors count as ending in zeros.
                low = np.minimum(np.append(low, more), own.min(0, initial=0.0))
                high = np.maximum(np.append(high, more), own.max(0, initial=0.0))
            yield pa.record_batch([pa.array(range(len(low)), pa.int32()), pa.array(low, pa.float64()), pa.array(high, pa.float64())], names=["dim", "low", "high"])

        found = rows.select("embedding").mapInArrow(ends, "dim int, low double, high double").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
        low, high = [int(r["low"]) for r in found], [int(r["high"]) for r in found]
        return cls(low, [max(1, -(-(b - a + 1) // cells)) for a, b in zip(low, high, strict=True)])

    @property
    def dims(self) -> int:
        return len(self.low)

    def cells(self, floors: np.ndarray) -> np.ndarray:
        """A byte a dimension for rows of floored components."""
        if max([1, *(abs(x) for x in self.low), *(w * CELLS for w in self.width)]) < 1 << 52:
            return ((floors - np.asarray(self.low, float)) // np.asarray(self.width, float)).astype(np.uint8)
        out = np.zeros(floors.shape, np.uint8)
        for d, (low, width) in enumerate(zip(self.low, self.width, strict=True)):
            out[:, d] = [(int(x) - low) // width for x in floors[:, d]]
        return out

    def largest(self) -> int:
        """No component is larger, without its sign."""
        return max([1, *(max(abs(a), abs(a + w * CELLS)) for a, w in zip(self.low, self.width, strict=True))])


def whole(floors: np.ndarray, largest: int) -> np.ndarray:
    """Floored components as whole numbers: 64-bit ones if their products stay exact in these, else Python's."""
    dims = max(1, floors.shape[1]) if floors.ndim == 2 else 1
    if dims * largest * largest < _EXACT:
        return floors.astype(np.int64)
    return np.vectorize(int, otypes=[object])(floors) if floors.size else floors.astype(object)


class Bounds:
    """Lookup tables of some anchors: `low[d, c]` has what cell c of dimension d adds to each anchor's score at least."""

    def __init__(self, grid: Grid, anchors: np.ndarray):
        exact = grid.dims * grid.largest() * grid.largest() < 1 << 31
        kind = anchors.dtype if anchors.dtype == object else np.int32 if exact else np.int64
        anchors = anchors.astype(kind)
        first = np.asarray([[a + w * c for c in range(CELLS)] for a, w in zip(grid.low, grid.width, strict=True)], kind).reshape(grid.dims, CELLS)
        last = first + np.asarray(grid.width, kind).reshape(-1, 1) - 1
        self.low = np.zeros((grid.dims, CELLS, len(anchors)), kind)
        for d in range(grid.dims):
            self.low[d] = np.minimum(first[d][:, None] * anchors[:, d], last[d][:, None] * anchors[:, d])
        #: Between a row's bounds, the same for all rows of an anchor as cells are equally wide.
        self.gap = abs(anchors) @ (np.asarray(grid.width, kind) - 1) if grid.dims else np.zeros(len(anchors), kind)

    def lower(self, cells: np.ndarray) -> np.ndarray:
        """(rows, anchors) lower bounds."""
        found = np.zeros((len(cells), self.low.shape[2]), self.low.dtype)
        for d in range(cells.shape[1]):
            found += self.low[d].take(cells[:, d], axis=0)
        return found


def first_rows(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first rows by score, higher first, then by id."""
    if scores.dtype == object:
        return np.asarray(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:most], np.int64)
    return np.lexsort((ids, -scores))[:most]


@dataclass
class Block:
    """Some anchors and, by turns, the windows their rows must enter: (anchor, key, least score, greatest score or None)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    same: bool
    windows: list[list[tuple[int, int, int | None]]]
    most: int


def _scan(rows: DataFrame, grid: Grid, sent: Broadcast[Block]) -> DataFrame:
    """(anchor, key, vec_id, score) of every task's first rows in each window of a block's anchors."""
    largest = grid.largest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        held = [[(np.zeros(0, own.vectors.dtype), np.zeros(0, np.int64)) for _ in w] for w in own.windows]
        bounds: dict[int, Bounds] = {}
        for batch in batches:
            every_id = batch.column("vec_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            every_label = batch.column("label").to_numpy(zero_copy_only=False)
            cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(batch.num_rows, grid.dims)
            exact = whole(_matrix(batch.column("embedding"), grid.dims), largest)
            for at in range(0, batch.num_rows, ROWS):
                ids, labels, vectors = (x[at : at + ROWS] for x in (every_id, every_label, exact))
                for first in range(0, len(own.ids), ANCHORS):
                    if first not in bounds:
                        if len(bounds) * grid.dims * CELLS * ANCHORS * 8 > 1 << 28:
                            bounds.clear()  # tables of large blocks or vectors are made anew
                        bounds[first] = Bounds(grid, own.vectors[first : first + ANCHORS])
                    table = bounds[first]
                    lower = table.lower(cells[at : at + ROWS])
                    for k in range(lower.shape[1]):
                        a = first + k
                        if own.windows[a]:
                            _enter(own, a, held[a], lower[:, k], table.gap[k], ids, labels, vectors)
        out = [(a, key, i, s) for a, windows in enumerate(own.windows) for (key, _, _), (scores, found) in zip(windows, held[a], strict=True) for s, i in zip(scores.tolist(), found.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        clamped = [max(-_LARGEST, min(_LARGEST, s)) for s in columns[3]]
        yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(clamped, pa.int64())], names=["anchor", "key", "vec_id", "score"])

    return rows.mapInArrow(run, "anchor int, key int, vec_id long, score long")


def _enter(own: Block, a: int, held: list, lower: np.ndarray, gap, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
    """Score the rows that may enter a window of anchor `a` and keep each window's first rows."""
    fits = labels == own.labels[a]
    fits = fits & (ids != own.ids[a]) if own.same else ~fits
    # What a row must reach to be among a window's first, if it has enough rows already.
    floors = [least if len(scores) < own.most else scores[-1] for (_, least, _), (scores, _) in zip(own.windows[a], held, strict=True)]
    least = min(f for f in floors if f is not None) if None not in floors else None
    if least is not None:
        fits &= lower >= least - gap
    tops = [top for _, _, top in own.windows[a]]
    if None not in tops:
        fits &= lower <= max(tops)
    at = np.flatnonzero(fits)
    if not len(at):
        return
    scores, found = vectors[at] @ own.vectors[a], ids[at]
    for w, ((_, _, top), floor) in enumerate(zip(own.windows[a], floors, strict=True)):
        inside = np.ones(len(at), bool)
        if floor is not None:
            inside &= scores >= floor
        if top is not None:
            inside &= scores <= top
        if inside.any():
            s, i = np.concatenate([held[w][0], scores[inside]]), np.concatenate([held[w][1], found[inside]])
            best = first_rows(s, i, own.most)
            held[w] = s[best], i[best]


def _merged(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each window out of all tasks' first rows, with `rank`; a window's rows are `most` a task."""
    order = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def approximate(vectors: DataFrame) -> tuple[DataFrame, Grid]:
    """The vector-approximation file: (vec_id, label, embedding, cells), written in even parts, and its grid."""
    spark = vectors.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-vectors.count() // PART_ROWS))
    rows = settle(usable(vectors).repartition(parts), "vectors")
    grid = Grid.over(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = grid.cells(_matrix(batch.column("embedding"), grid.dims))
            yield pa.record_batch([*batch.columns, pa.array([c.tobytes() for c in cells], pa.binary())], names=[*batch.schema.names, "cells"])

    return settle(rows.mapInArrow(run, "vec_id long, label long, embedding array<double>, cells binary"), "approximations"), grid


def _windows(positives: dict[int, list[tuple[int, int]]], anchors: int) -> list[list[tuple[int, int, int | None]]]:
    """The scores that satisfy LOW * p <= 100 * s <= HIGH * p for each positive's score p, if any does."""
    out: list[list[tuple[int, int, int | None]]] = []
    for a in range(anchors):
        own = [(key, -(-LOW * p // 100), HIGH * p // 100) for key, (_, p) in enumerate(positives.get(a, []))]
        out.append([w for w in own if w[1] <= w[2]])
    return out


def mine(vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label, a null vector or any component that is null or not finite take
    no part; an empty table gives none.  A null vec_id is below every other and is no
    anchor.  Rows are told apart by vec_id: rows with the anchor's own id are no positives
    of it; an anchor's id that is there repeatedly is mined for each of its rows, and
    other repeated rows are rows of their own.  Tied scores go to the smaller vec_id.  A
    vector shorter than others counts as ending in zeros, so one without components
    scores 0.  Scores beyond 64 bits are told as the nearest 64-bit number.  Other
    columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows, grid = approximate(vectors)
    largest = grid.largest()
    anchors = rows.where(F.col("vec_id") % ANCHOR_EVERY == 0).select("vec_id", "label", "embedding")
    anchors = settle(anchors.withColumn("row", F.monotonically_increasing_id()), "anchors")
    blocks = -(-anchors.count() // block_anchors)
    path = scratch_path(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    # Dealt by their number, so repeated ids are spread; the driver holds one block at a time.
    for block in range(blocks):
        found = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").toArrow()
        ids, labels = found.column("vec_id").to_numpy(), found.column("label").to_numpy()
        own = whole(_matrix(found.column("embedding"), grid.dims), largest)
        first = Block(ids, labels, own, True, [[(0, None, None)] for _ in ids], positives)
        near: dict[int, list[tuple[int, int]]] = {}
        sent = spark.sparkContext.broadcast(first)  # some BLOCK_ANCHORS vectors
        for r in _merged(_scan(rows, grid, sent), positives).orderBy("anchor", "rank").collect():  # `positives` rows an anchor
            near.setdefault(r["anchor"], []).append((r["vec_id"], r["score"]))
        sent.destroy()
        sent = spark.sparkContext.broadcast(Block(ids, labels, own, False, _windows(near, len(ids)), negatives))
        best = _merged(_scan(rows, grid, sent), negatives)
        told = [(a, key, int(ids[a]), None if i == NO_ID else i, p) for a, pairs in near.items() for key, (i, p) in enumerate(pairs)]
        pairs = spark.createDataFrame(told, "anchor int, key int, anchor_id long, positive_id long, positive_score long")
        named = F.when(F.col("vec_id") != NO_ID, F.col("vec_id"))
        best.join(F.broadcast(pairs), ["anchor", "key"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), named.alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(path)
        sent.destroy()
    return spark.read.schema(schema).parquet(path)
