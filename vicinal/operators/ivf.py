"""Inverted-file search: a table laid out by nearest centroid, of which a query reads the nearest lists only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.operators.knn import _distances, _matrix, _nearest, top_k, usable
from vicinal.operators.lloyd import assign, seed_plus_plus, step
from vicinal.schema import IvfConfig

#: Rows that centroids are trained on, at most; all rows are indexed.
TRAIN_ROWS = 200_000
#: Items of one part of a list, about, that one task holds against its queries.
PART_ROWS = 16_384


def train(items: DataFrame, metric: str, config: IvfConfig = IvfConfig(), start: Sequence[Sequence[float]] | None = None, vector: str = "vector", order: str = "id") -> list[list[float]]:
    """Centroids after ``max_iterations`` Lloyd rounds from k-means++ seeds (or ``start``). Empty lists keep their centroid; none is made a unit vector."""
    n = items.count()
    sample = items if n <= TRAIN_ROWS else items.filter(F.pmod(F.xxhash64(F.col(order).cast("string")), F.lit(1 << 20)) < int((1 << 20) * TRAIN_ROWS / n))
    sample = sample.select(F.col(order).alias("id"), F.col(vector).cast("array<double>").alias("vector")).persist()
    try:
        centroids = [list(c) for c in start] if start is not None else seed_plus_plus(sample, config.nlist, "euclidean", config.seed)
        for _ in range(config.max_iterations):
            moved = False
            for r in step(sample, centroids, metric, unit=False).collect():  # nlist rows
                new = [float(x) for x in r["centroid"]]
                moved |= new != centroids[r["cluster"]]
                centroids[r["cluster"]] = new
            if not moved:
                break
        return centroids
    finally:
        sample.unpersist()


def layout(items: DataFrame, centroids: Sequence[Sequence[float]], metric: str, vector: str = "vector") -> DataFrame:
    """``items`` plus centroid_id."""
    return assign(items, centroids, metric, vector).withColumnRenamed("cluster", "centroid_id").drop("cluster_distance")


def write(items: DataFrame, centroids: Sequence[Sequence[float]], metric: str, path: str) -> None:
    """One folder per list; large lists are spread over several files."""
    _written(layout(items, centroids, metric), path, "static")


def _written(rows: DataFrame, path: str, mode: str) -> None:
    dealt = rows.repartition(F.col("centroid_id"), F.pmod(F.xxhash64("id"), F.lit(8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("centroid_id").parquet(path)


def upkeep(spark: SparkSession, path: str, centroids: Sequence[Sequence[float]], added: DataFrame, removed: DataFrame, metric: str) -> list[int]:
    """Puts changes into the lists that ``write`` has written: the ids of ``removed`` go, then the rows of ``added`` come.

    Only folders of lists that held such an id, or get such a row, are written anew, by dynamic partition overwrite; lists that lose
    all rows lose their folder. Returns the touched lists (there are as many as centroids, at most). Centroids stay as they are.
    """
    stored = read(spark, path)
    new = layout(added, centroids, metric).select(*stored.columns).persist()
    try:
        gone = removed.select("id").distinct()
        hit = stored.select("id", "centroid_id").join(gone, "id", "left_semi").select("centroid_id")
        touched = sorted(r[0] for r in hit.unionAll(new.select("centroid_id")).distinct().collect() if r[0] is not None)
        if touched:
            left = stored.filter(F.col("centroid_id").isin(touched)).join(gone, "id", "left_anti").select(*stored.columns).unionByName(new)
            there = {r[0] for r in left.select("centroid_id").distinct().collect()}
            _written(left, path, "dynamic")
            for number in touched:
                if number not in there:
                    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/centroid_id={number}")
                    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        return touched
    finally:
        new.unpersist()


def probes(query: Sequence[float], centroids: Sequence[Sequence[float]], nprobe: int, metric: str) -> list[int]:
    """The nearest lists, ties by number."""
    import numpy as np

    if not len(centroids):
        return []
    d = _distances(metric, np.array([query], float), np.array(centroids, float))[0].round(12)
    return [int(i) for i in np.argsort(d, kind="stable")[: max(1, nprobe)]]


def search(indexed: DataFrame, centroids: Sequence[Sequence[float]], query: Sequence[float], k: int, metric: str = "cosine", where: Column | None = None, nprobe: int = 4, id_col: str = "id", vector_col: str = "vector", include_vector: bool = False) -> DataFrame:
    """Top k of the ``nprobe`` nearest lists (partition pruning on centroid_id). A filtered result of fewer than k rows is searched again over all lists."""
    if not len(centroids):
        return top_k(indexed, query, k, metric, where, id_col, vector_col, include_vector)
    near = indexed.filter(F.col("centroid_id").isin(probes(query, centroids, nprobe, metric)))
    if where is not None and near.filter(where).limit(k).count() < k:
        near = indexed
    return top_k(near, query, k, metric, where, id_col, vector_col, include_vector)


def knn_join(indexed: DataFrame, centroids: Sequence[Sequence[float]], queries: DataFrame, k: int, metric: str = "cosine", nprobe: int = 4, same_table: bool = False) -> DataFrame:
    """query_id, rank, id, distance of each query's k nearest items in its ``nprobe`` nearest lists; queries: query_id, vector.

    Queries are dealt to their lists, lists are split into parts of about ``PART_ROWS`` items, and each part's queries meet it in
    a task. The centroids (a bounded list) are in the tasks' closures.
    """
    c, probed = np.array(centroids, float), min(nprobe, len(centroids))
    asked = queries.select(F.col("query_id").alias("id"), F.col("vector").cast("array<double>").alias("v")).filter(usable(F.col("v")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.round(_distances(metric, _matrix(batch.column(1), c.shape[1]), c), 12)
            lists = np.argsort(d, axis=1, kind="stable")[:, :probed].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(lists), pa.list_(pa.int32()))], names=["id", "v", "lists"])

    asked = asked.mapInArrow(near, T.StructType([*asked.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))]))
    parts = F.broadcast(list_sizes(indexed).select(F.col("centroid_id").cast("int").alias("list"), F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")))
    asked = asked.select("id", "v", F.explode("lists").alias("list")).join(parts, "list")
    asked = asked.select("id", "v", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    known = indexed.select("id", F.col("vector").cast("array<double>").alias("v"), F.col("centroid_id").cast("int").alias("list")).join(parts, "list")
    known = known.select("id", "v", "list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", indexed.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    found = asked.groupBy("list", "part").cogroup(known.groupBy("list", "part")).applyInArrow(_nearest(k, metric, same_table), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def list_sizes(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("centroid_id").agg(F.count("*").alias("n"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
