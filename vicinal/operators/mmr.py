"""Maximal marginal relevance over a bounded pool."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.operators.knn import _distances, top_k
from vicinal.schema import parse_metric

#: Pool size and weight of relevance.
FETCH_K, LAMBDA = 50, 0.5


def similarities(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = _distances(metric, q, x)
    match parse_metric(metric):
        case "dot_product":
            return -d
        case "euclidean" | "manhattan":
            return 1 / (1 + d)
        case "cosine":  # below 0 the distance is cut, not the similarity
            n = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
            return np.clip(np.divide(q @ x.T, n, out=np.zeros_like(n), where=n > 0), -1, 1)
        case _:
            return 1 - d


def select(relevance: np.ndarray, among: np.ndarray, k: int, lam: float) -> list[tuple[int, float]]:
    """Greedy choice of k rows: (place, value). The first is the most relevant and has its relevance as value; ties go to the first place."""
    lam = min(1.0, max(0.0, lam))
    left, worst, out = np.ones(len(relevance), bool), np.full(len(relevance), -np.inf), []
    for step in range(min(k, len(relevance))):
        value = np.round(relevance if step == 0 else lam * relevance - (1 - lam) * worst, 12)  # sums of one value are one value
        at = int(np.argmax(np.where(left, value, -np.inf)))
        out.append((at, float(value[at])))
        left[at] = False
        worst = np.maximum(worst, among[at])
    return out


def _rows(pool: pd.DataFrame, query: np.ndarray, k: int, metric: str, lam: float) -> pd.DataFrame:
    pool = pool.sort_values(["distance", "id"], kind="stable")
    x = np.stack(pool["vector"].to_list()).astype(float) if len(pool) else np.empty((0, len(query)))
    chosen = select(similarities(metric, query[None], x)[0], similarities(metric, x, x), k, lam) if len(pool) else []
    at = [i for i, _ in chosen]
    return pd.DataFrame({"rank": np.arange(1, len(at) + 1, dtype=np.int64), "id": pool["id"].to_numpy()[at], "score": [v for _, v in chosen], "distance": pool["distance"].to_numpy()[at]})


def diverse_top_k(items: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", where: Column | None = None, fetch_k: int = FETCH_K, lam: float = LAMBDA, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """rank, id, score (the MMR value), distance. The pool holds max(fetch_k, k) rows; the greedy choice over it runs in one task."""
    pool = top_k(items.filter(F.col(vector_col).isNotNull()), query, max(fetch_k, k), metric, where, id_col, vector_col, include_vector=True)
    q = np.array(query, float)
    kind = pool.schema["id"].dataType.simpleString()
    one = pool.select("id", "distance", "vector", F.lit(0).alias("__one")).groupBy("__one")
    return one.applyInPandas(lambda pdf: _rows(pdf, q, k, metric, lam), f"rank bigint, id {kind}, score double, distance double")
