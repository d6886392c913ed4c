"""Radius joins: all pairs of vectors within a distance, where pivots and the triangle inequality decide what need not meet.

Each row of the right side belongs to the cell of its nearest pivot and there to a ring of distances from it. A row of the left
side is sent to the cells and rings that may hold something within the radius: not to those that its distance from their pivot
rules out, nor to cells whose pivot is farther from it than its own nearest one by more than twice the radius. Cells and rings of
many rows are cut into blocks, so that a task holds bounded numbers of rows at every size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.operators.blocks import ITEM_ROWS, QUERY_ROWS
from vicinal.operators.knn import _distances, _matrix
from vicinal.schema import parse_metric

#: How many pivots there are, and out of how many rows they are chosen.
PIVOTS, SAMPLE = 64, 2048
#: Metrics that obey the triangle inequality, or, for cosine, have one of the same order that does.
_TRIANGLE = {"euclidean": "euclidean", "manhattan": "manhattan", "hamming": "hamming", "cosine": "euclidean"}
_COUNTS = "cell int, ring bigint, n bigint, low double, high double"


@dataclass(frozen=True)
class Cells:
    """Pivots and the least and largest distance of the right side's rows from each; without pivots all rows are in one cell."""

    metric: str
    pivots: np.ndarray
    reach: float
    unit: bool
    low: np.ndarray
    high: np.ndarray

    def from_pivots(self, x: np.ndarray) -> np.ndarray:
        return _distances(self.metric, x / np.linalg.norm(x, axis=1)[:, None] if self.unit else x, self.pivots)

    def rings(self, d: np.ndarray) -> np.ndarray:
        """Rings are twice as wide as the radius, so that a row meets two of them in a cell, or one."""
        return np.floor(d / max(2 * self.reach, 1e-9)).astype(np.int64)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, ring, distance from the pivot) of each row of the right side."""
        if not len(self.pivots):
            none = np.zeros(len(x))
            return none.astype(np.int32), none.astype(np.int64), none
        d = self.from_pivots(x)
        cell = d.argmin(axis=1)
        d = d[np.arange(len(x)), cell]
        return cell.astype(np.int32), self.rings(d), d

    def asked(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, ring) of all that rows of the left side have to meet."""
        if not len(self.pivots):
            return np.arange(len(x)), np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
        d = self.from_pivots(x)
        reach = self.reach + 1e-9 * (1 + np.linalg.norm(x, axis=1))[:, None]  # room for rounding
        first, last = np.maximum(d - reach, self.low - 1e-9), np.minimum(d + reach, self.high + 1e-9)
        row, cell = np.nonzero((first <= last) & (d - d.min(axis=1)[:, None] <= 2 * reach))
        first, last = (self.rings(np.maximum(v[row, cell], 0)) for v in (first, last))
        times = last - first + 1
        ring = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return np.repeat(row, times), np.repeat(cell, times).astype(np.int32), ring


def spread(x: np.ndarray, n: int, metric: str) -> np.ndarray:
    """Up to ``n`` rows, each farthest from those before it; no two are equal."""
    chosen, d = [0], _distances(metric, x[:1], x)[0]
    while len(chosen) < n and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, _distances(metric, x[chosen[-1] :][:1], x)[0])
    return x[chosen]


def _finite(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def _slim(rows: DataFrame, unit: bool) -> DataFrame:
    rows = rows.select("id", F.col("vector").cast("array<double>").alias("v")).filter(_finite(F.col("v")))
    return rows.filter(F.exists("v", lambda x: x != 0)) if unit else rows


def _per_batch(rows: DataFrame, run, schema) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v")
                yield run(batch, _matrix(v, len(v[0])))

    return rows.mapInArrow(each, schema)


def _counted(cell: np.ndarray, ring: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((ring, cell))
    cell, ring, d = cell[order], ring[order], d[order]
    start = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (ring[1:] != ring[:-1])))) if len(cell) else np.empty(0, np.int64)
    n = np.diff(np.append(start, len(cell)))
    low, high = (f.reduceat(d, start) if len(cell) else d for f in (np.minimum, np.maximum))
    columns = [cell[start], ring[start], n, low, high]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["cell", "ring", "n", "low", "high"])


def _planned(left: DataFrame, right: DataFrame, radius: float, metric: str, pivots: int) -> tuple[DataFrame, DataFrame, Cells, DataFrame]:
    """(left, right, cells, meets: cell, ring, nl, nr of cells and rings in which both sides have rows)."""
    triangle = _TRIANGLE.get(metric)
    if metric == "cosine" and radius >= 1:  # zero vectors are at a distance of 1 from all
        triangle = None
    unit = metric == "cosine" and triangle is not None
    left, right = _slim(left, unit), _slim(right, unit)
    chosen, none = np.empty((0, 0)), np.empty(0)
    if triangle and pivots > 0:
        sample = right.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
        if len(sample):
            x = np.stack(sample.to_numpy())
            chosen = spread(x / np.linalg.norm(x, axis=1)[:, None] if unit else x, pivots, triangle)
    reach = float(np.sqrt(2 * radius) if unit else radius)
    cells = Cells(triangle or metric, chosen, reach, unit, none, none)
    homes = _per_batch(right, lambda _, x: _counted(*cells.home(x)), _COUNTS)
    homes = homes.groupBy("cell", "ring").agg(F.sum("n").alias("nr"), F.min("low").alias("low"), F.max("high").alias("high")).persist()
    if len(chosen):  # one row a pivot
        low, high = np.full(len(chosen), np.inf), np.full(len(chosen), -np.inf)
        for r in homes.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            low[r["cell"]], high[r["cell"]] = r["low"], r["high"]
        cells = Cells(cells.metric, chosen, reach, unit, low, high)

    def ask(_batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        row, cell, ring = cells.asked(x)
        return _counted(cell, ring, np.zeros(len(row)))

    asks = _per_batch(left, ask, _COUNTS).groupBy("cell", "ring").agg(F.sum("n").alias("nl"))
    return left, right, cells, asks.join(homes.select("cell", "ring", "nr"), ["cell", "ring"]).persist()


def pruned(left: DataFrame, right: DataFrame, radius: float, metric: str = "euclidean", pivots: int = PIVOTS) -> DataFrame:
    """One row: n_left and n_right rows that can meet, how many pairs are compared, and the share of all pairs that are not."""
    left, right, _, meets = _planned(left, right, radius, parse_metric(metric), pivots)
    sums = meets.agg(F.coalesce(F.sum(F.col("nl") * F.col("nr")), F.lit(0)).alias("compared"))
    all_ = left.agg(F.count("*").alias("n_left")).crossJoin(right.agg(F.count("*").alias("n_right"))).crossJoin(sums)  # one row each
    share = 1 - F.try_divide(F.col("compared"), F.col("n_left") * F.col("n_right"))
    return all_.withColumn("share", F.coalesce(share, F.lit(0.0)))


def radius_join(left: DataFrame, right: DataFrame, radius: float, metric: str = "euclidean", pivots: int = PIVOTS) -> DataFrame:
    """All pairs (left_id, right_id, distance) of two tables (id, vector) that are within ``radius``; a row meets itself, too.

    Vectors that are null or empty or hold null or non-finite components meet nothing; repeated rows each give their pairs; a
    negative radius gives none. The dot product, Jaccard and a cosine radius of 1 and more have no triangle inequality to use, so
    that blocks of one side meet all blocks of the other there, as they do without pivots.
    """
    metric = parse_metric(metric)
    schema = T.StructType([T.StructField("left_id", left.schema["id"].dataType), T.StructField("right_id", right.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    if radius < 0 and metric != "dot_product":
        return left.sparkSession.createDataFrame([], schema)
    left, right, cells, meets = _planned(left, right, radius, metric, pivots)
    meets.count()  # held now, so that its size is known where the plan asks for it
    meets = meets.select("cell", "ring", F.ceil(F.col("nl") / QUERY_ROWS).alias("qbs"), F.ceil(F.col("nr") / ITEM_ROWS).alias("ibs"))
    where = [T.StructField("cell", T.IntegerType()), T.StructField("ring", T.LongType())]

    def ask(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        row, cell, ring = cells.asked(x)
        return pa.RecordBatch.from_arrays([*batch.take(pa.array(row, pa.int64())).columns, pa.array(cell), pa.array(ring)], names=["id", "v", "cell", "ring"])

    def place(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        cell, ring, _ = cells.home(x)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(ring)], names=["id", "v", "cell", "ring"])

    def dealt(rows: DataFrame, run, own: str, other: str) -> DataFrame:
        met = _per_batch(rows, run, T.StructType([*rows.schema.fields, *where])).join(meets, ["cell", "ring"])
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}s") - 1))
        return met.withColumn(own, F.pmod(F.xxhash64("id"), f"{own}s")).withColumn(other, every).drop("qbs", "ibs")

    def within(asked: pa.Table, known: pa.Table) -> pa.Table:
        parts = [pa.table({"left_id": asked["id"].slice(0, 0), "right_id": known["id"].slice(0, 0), "distance": pa.array([], pa.float64())})]
        if asked.num_rows and known.num_rows:
            dimension = len(known["v"][0])
            q, x = (_matrix(t["v"].combine_chunks(), dimension) for t in (asked, known))
            for lo in range(0, len(q), 256):
                d = _distances(metric, q[lo : lo + 256], x)
                a, b = np.nonzero(d <= radius)
                parts.append(pa.table({"left_id": asked["id"].take(pa.array(lo + a)), "right_id": known["id"].take(pa.array(b)), "distance": pa.array(d[a, b])}))
        return pa.concat_tables(parts)

    keys = ("cell", "ring", "qb", "ib")
    return dealt(left, ask, "qb", "ib").groupBy(*keys).cogroup(dealt(right, place, "ib", "qb").groupBy(*keys)).applyInArrow(within, schema)
