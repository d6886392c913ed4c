"""Nearest neighbours: exact top-k for one query, and k-NN joins of query sets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.functions.distance import distance, score
from vicinal.operators.blocks import grid
from vicinal.schema import METRICS, parse_metric

#: Digits behind the point by which joins compare distances: sums of other orders differ beyond, and copies are to tie.
DIGITS = 12
#: Queries of a cell of the join, about; they are compared 256 at once.
ASKED_ROWS = 16_384

def check_dimension(query: Sequence[float], dimension: int) -> None:
    if len(query) != dimension:
        raise ValueError(f"query has {len(query)} dimensions, the collection {dimension}")


def ranked(df: DataFrame, k: int, id_col: str = "id", by: str = "distance", ascending: bool = True) -> DataFrame:
    """The first k rows by (``by``, id) with their rank from 1."""
    order = [F.col(by).asc() if ascending else F.col(by).desc(), F.col(id_col)]
    top = df.orderBy(*order).limit(max(k, 0))
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("bigint"))


def top_k(items: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", where: Column | None = None, id_col: str = "id", vector_col: str = "vector", include_vector: bool = False) -> DataFrame:
    """rank, id, distance, score of the k nearest items, ties by id. The predicate runs before any distance; k <= 0 gives no rows.

    The plan is a scan, a projection and a bounded heap per task; nothing is shuffled but k rows a task.
    """
    rows = items.filter(where) if where is not None else items
    rows = rows.withColumn("distance", distance(metric, F.col(vector_col), query))
    top = ranked(rows.select(F.col(id_col).alias("id"), "distance", *([F.col(vector_col).alias("vector")] if include_vector else [])), k)
    return top.select("rank", "id", "distance", score(metric, F.col("distance")).alias("score"), *(["vector"] if include_vector else []))


def _distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All distances (queries, rows), in double precision."""
    match parse_metric(metric):
        case "cosine":
            nq, nx = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
            scale = np.outer(nq, nx)
            sim = np.divide(q @ x.T, scale, out=np.zeros_like(scale), where=scale > 0)
            return np.maximum(0.0, 1.0 - np.clip(sim, -1, 1))
        case "dot_product":
            return -(q @ x.T)
        case "euclidean":
            square = (q * q).sum(axis=1)[:, None] - 2 * (q @ x.T) + (x * x).sum(axis=1)
            rough = np.sqrt(np.maximum(square, 0))
            close = np.nonzero(square < 1e-6 * (1 + (q * q).sum(axis=1)[:, None]))  # cancellation: anew, by differences
            rough[close] = np.linalg.norm(q[close[0]] - x[close[1]], axis=1)
            return rough
        case "manhattan":
            return np.stack([np.abs(x - row).sum(axis=1) for row in q])
        case "hamming":
            return np.stack([(x != row).mean(axis=1) for row in q]) if q.shape[1] else np.zeros((len(q), len(x)))
        case _:
            low = np.stack([np.minimum(x, row).sum(axis=1) for row in q])
            high = np.stack([np.maximum(x, row).sum(axis=1) for row in q])
            sim = np.divide(low, high, out=np.zeros_like(low), where=high > 0)
            equal = (high == 0) & np.stack([(x == row).all(axis=1) for row in q])
            return 1.0 - np.where(equal, 1.0, np.clip(sim, 0, 1))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """(rows, dimension); the column has no nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: not null, nor any of its components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull()), F.lit(False))


def knn_join(queries: DataFrame, items: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "vector", same_table: bool = False) -> DataFrame:
    """query_id, rank, id, distance of each query's k nearest items (ties by id; distances are compared by ``DIGITS`` digits); ``same_table`` leaves out the query's own id.

    Blocks of queries meet blocks of items in tasks, each of which keeps k candidates a query; a group-limited window merges
    them. Work is queries x items by nature; nothing is collected. Null vectors and vectors with null components meet nothing.
    """
    metric = parse_metric(metric)
    schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("id", items.schema[id_col].dataType), T.StructField("distance", T.DoubleType())])
    slim = lambda df, key, v: df.select(F.col(key).alias("id"), F.col(v).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    asked, known = grid(slim(queries, query_id, query_vector), slim(items, id_col, vector_col), "id", "id", ASKED_ROWS)
    found = asked.groupBy("qb", "ib").cogroup(known.groupBy("qb", "ib")).applyInArrow(_nearest(k, metric, same_table), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", DIGITS), "id"))
    return found.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _nearest(k: int, metric: str, same_table: bool):
    def run(queries: pa.Table, items: pa.Table) -> pa.Table:
        """A cell's k candidates of each query."""
        empty = pa.table({"query_id": queries["id"].slice(0, 0), "id": items["id"].slice(0, 0), "distance": pa.array([], pa.float64())})
        if not queries.num_rows or not items.num_rows or k <= 0:
            return empty
        asked, first = queries["id"].to_pylist(), queries["v"].combine_chunks()
        dimension = len(first[0])
        q, x = _matrix(first, dimension), _matrix(items["v"].combine_chunks(), dimension)
        own = np.array(items["id"].to_pylist(), dtype=object)
        order = np.argsort(own, kind="stable")
        x, own = x[order], own[order]
        keep = min(len(own), k + same_table)
        parts = [empty]
        for lo in range(0, len(q), 256):
            d = _distances(metric, q[lo : lo + 256], x)
            who, at = _least(d, keep)
            who += lo
            if same_table:
                other = np.array([asked[w] != own[a] for w, a in zip(who, at)])
                who, at = who[other], at[other]
            parts.append(pa.table({"query_id": pa.array([asked[w] for w in who], queries["id"].type), "id": pa.array(own[at].tolist(), items["id"].type), "distance": pa.array(d[who - lo, at])}))
        return pa.concat_tables(parts)

    return run


def _least(d: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``keep`` least distances, ties by column; without sorting what is farther."""
    far = np.partition(d, keep - 1, axis=1)[:, keep - 1 :][:, :1]
    who, at = np.nonzero(~(d > far + 2 * 10.0**-DIGITS))
    order = np.lexsort((at, np.round(d[who, at], DIGITS), who))
    who, at = who[order], at[order]
    place = np.arange(len(who)) - np.searchsorted(who, np.arange(len(d)))[who]
    return who[place < keep], at[place < keep]


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: n_queries and recall, the share of true neighbours (query_id, id, rank <= k) that were found."""
    want = truth.filter(F.col("rank") <= k).select("query_id", "id").distinct()
    hit = found.filter(F.col("rank") <= k).select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    return want.join(hit, ["query_id", "id"], "left").agg(F.countDistinct("query_id").cast("bigint").alias("n_queries"), (F.sum(F.coalesce("hit", F.lit(0))) / (F.countDistinct("query_id") * k)).alias("recall"))


__all__ = ["METRICS", "check_dimension", "knn_join", "ranked", "recall_at_k", "top_k", "usable"]
