"""Lloyd steps shared by clustering and inverted files: assignment, update, seeding."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.functions.distance import distance, normalize, vec
from vicinal.operators.knn import _distances, _matrix

Centroids = Sequence[Sequence[float]]


def nearest(metric: str, v: Column, centroids: Centroids) -> Column:
    """Struct (d, c) of the nearest centroid, the first among equals. For few centroids; see ``assign`` for many."""
    ds = F.array(*[F.struct(distance(metric, v, c).alias("d"), F.lit(i).alias("c")) for i, c in enumerate(centroids)])
    return F.array_min(ds)


def assign(items: DataFrame, centroids: Centroids, metric: str, vector: str = "vector") -> DataFrame:
    """``items`` plus cluster and cluster_distance, by block matrix products; the centroids (a bounded list) are sent to all tasks.

    Rows whose vector is null or holds a null get neither.
    """
    schema = T.StructType([*items.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("cluster_distance", T.DoubleType())])
    sent = items.sparkSession.sparkContext.broadcast(np.array(centroids, float))
    at = items.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            if not len(batch):
                continue
            fine, vectors = vectors_of(batch.column(at), c.shape[1])
            d = np.round(_distances(metric, vectors, c), 12)
            cluster, far = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            cluster[fine], far[fine] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, mask=~fine), pa.array(far, mask=~fine)], names=schema.names)

    return items.mapInArrow(run, schema)


def vectors_of(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have a vector without nulls, their vectors)."""
    fine = np.ones(len(column), bool)
    if column.null_count or column.flatten().null_count:
        fine = np.array([v.is_valid and not v.values.null_count for v in column])
    return fine, _matrix(column.filter(pa.array(fine)), dimension)


def summed(items: DataFrame, place: Callable[[np.ndarray], np.ndarray], dimension: int, vector: str = "vector") -> DataFrame:
    """(place, n, total): how many vectors ``place`` puts at each number, and their sum. Negative places do not count.

    Each task adds up its own batches and gives a row a place, so what is shuffled follows the tasks and places, not the items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = vectors_of(batch.column(0), dimension)[1]
            if not len(vectors):
                continue
            at = place(vectors)
            order = np.argsort(at, kind="stable")
            numbers, starts, n = np.unique(at[order], return_index=True, return_counts=True)
            for number, many, total in zip(numbers.tolist(), n.tolist(), np.add.reduceat(vectors[order], starts, axis=0)):
                if number >= 0:
                    counts[number] = counts.get(number, 0) + many
                    totals[number] = totals[number] + total if number in totals else total
        numbers = sorted(counts)
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([counts[i] for i in numbers], pa.int64()), pa.array([totals[i] for i in numbers], pa.list_(pa.float64()))], names=["place", "n", "total"])

    parts = items.select(F.col(vector).cast("array<double>").alias("vector")).mapInArrow(run, "place bigint, n bigint, total array<double>")
    cells = parts.select("place", "n", F.posexplode("total").alias("pos", "x")).groupBy("place", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return cells.groupBy("place").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("total"))


def step(items: DataFrame, centroids: Centroids, metric: str, unit: bool | None = None, vector: str = "vector") -> DataFrame:
    """(cluster, centroid, n) of one Lloyd round: items go to their nearest centroid and each cluster's mean is its next.

    Means are made unit vectors if ``unit`` (by default under cosine). A cluster without items has no row.
    """
    c = np.array(centroids, float)
    sent = items.sparkSession.sparkContext.broadcast(c)
    found = summed(items, lambda v: np.round(_distances(metric, v, sent.value), 12).argmin(axis=1), c.shape[1], vector)
    mean = F.transform("total", lambda x: x / F.col("n"))
    return found.select(F.col("place").cast("int").alias("cluster"), normalize(mean).alias("centroid") if (metric == "cosine" if unit is None else unit) else mean.alias("centroid"), "n")


def pick(items: DataFrame, vector: str, draw: int, order: str) -> list[float]:
    """The vector of the row whose id and ``draw`` have the least hash: a draw at random in one pass."""
    row = items.orderBy(F.xxhash64(F.lit(draw), F.col(order).cast("string")), order).select(vec(F.col(vector))).first()
    return [float(x) for x in row[0]]


def seed_plus_plus(items: DataFrame, k: int, metric: str, seed: int, vector: str = "vector", order: str = "id") -> list[list[float]]:
    """k-means++: each next centroid is drawn by squared distance to those chosen.

    The draw is a race: a row of weight w gets the key -ln(u) / w with u from a hash of its id, and the least key wins, which happens
    with a chance in proportion to w. So a draw is one pass that moves one row a task, and depends on the seed alone.
    """
    rng = random.Random(seed)
    n = items.count()
    if not n:
        return []
    chosen = [pick(items, vector, rng.randrange(n), order)]
    rows = items.select(F.col(order).alias("o"), vec(F.col(vector)).alias("v"))
    while len(chosen) < min(k, n):
        d = nearest(metric, F.col("v"), chosen)["d"]
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(len(chosen)), F.col("o").cast("string")), F.lit(1 << 52)) + 1) / float(1 << 52)
        raced = rows.withColumn("w", d * d).filter(F.col("w") > 1e-12).withColumn("key", -F.log(u) / F.col("w"))
        row = raced.orderBy("key", "o").first()
        if row is None:  # only copies of what is chosen are left
            seen = F.array(*[vec(c) for c in chosen])
            row = rows.filter(~F.array_contains(seen, F.col("v"))).orderBy("o").first()
            if row is None:
                chosen.append(chosen[-1])
                continue
        chosen.append([float(x) for x in row["v"]])
    return chosen
