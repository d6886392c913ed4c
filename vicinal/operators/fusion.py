"""Fusion of a dense and a sparse ranking: reciprocal ranks, or min-max scaled scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.operators import bm25
from vicinal.operators.knn import ranked, top_k

#: The rank constant and the dense side's weight.
RRF_K = 60
ALPHA = 0.5
FLAT = 1e-12


def _sides(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    d = dense.select("id", F.col("score").alias("d_score"), F.col("rank").alias("d_rank"))
    s = sparse.select("id", F.col("score").alias("s_score"), F.col("rank").alias("s_rank"))
    return d.join(s, "id", "full_outer")


def _every():
    """The whole pool as one window: pools hold a few times k rows."""
    return Window.partitionBy(F.lit(1))


def _shown(joined: DataFrame, combined: Column, k: int) -> DataFrame:
    n = F.greatest(F.count("d_rank").over(_every()), F.count("s_rank").over(_every())) + 1
    rows = joined.select("id", combined.alias("combined_score"), F.coalesce("d_score", F.lit(0.0)).alias("dense_score"), F.coalesce("s_score", F.lit(0.0)).alias("sparse_score"), F.coalesce("d_rank", n).alias("dense_rank"), F.coalesce("s_rank", n).alias("sparse_rank"))
    return ranked(rows, k, by="combined_score", ascending=False).select("rank", "id", "combined_score", "dense_score", "sparse_score", "dense_rank", "sparse_rank")


def fuse_rrf(dense: DataFrame, sparse: DataFrame, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (rrf_k + rank) over the rankings that hold the id; a missing rank is shown as one past the longer ranking."""
    part = lambda rank: F.coalesce(1.0 / (rrf_k + F.col(rank)), F.lit(0.0))
    return _shown(_sides(dense, sparse), part("d_rank") + part("s_rank"), k)


def fuse_linear(dense: DataFrame, sparse: DataFrame, k: int, alpha: float = ALPHA) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse over scores scaled to 0 .. 1 within each ranking; equal scores scale to 1, missing ones to 0."""
    alpha = min(1.0, max(0.0, alpha))

    def scaled(name: str) -> Column:
        lo, hi = F.min(name).over(_every()), F.max(name).over(_every())
        return F.when(F.col(name).isNull(), 0.0).when(hi - lo <= FLAT, 1.0).otherwise((F.col(name) - lo) / (hi - lo))

    return _shown(_sides(dense, sparse), alpha * scaled("d_score") + (1 - alpha) * scaled("s_score"), k)


def hybrid(items: DataFrame, query: Sequence[float], text: str, k: int, metric: str = "cosine", where: Column | None = None, fusion: str = "rrf", alpha: float = ALPHA, rrf_k: int = RRF_K, id_col: str = "id", vector_col: str = "vector", text_col: str = "document") -> DataFrame:
    """Both rankings over pools of max(3k, 20) rows under one filter, fused."""
    _known(fusion)
    pool = pool_rows(k)
    dense = top_k(items.filter(F.col(vector_col).isNotNull()), query, pool, metric, where, id_col, vector_col)
    return fuse(dense, bm25.search(items, text, pool, where, id_col, text_col), k, fusion, alpha, rrf_k)


def pool_rows(k: int) -> int:
    """How many of each ranking are fused."""
    return max(3 * k, 20)


def fuse(dense: DataFrame, sparse: DataFrame, k: int, fusion: str = "rrf", alpha: float = ALPHA, rrf_k: int = RRF_K) -> DataFrame:
    _known(fusion)
    return fuse_rrf(dense, sparse, k, rrf_k) if fusion == "rrf" else fuse_linear(dense, sparse, k, alpha)


def _known(fusion: str) -> None:
    if fusion not in ("rrf", "linear"):
        raise ValueError(f"unknown fusion {fusion!r}")
