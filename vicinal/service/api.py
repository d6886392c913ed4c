"""What the adapters share: a store of collections and plain-data answers."""

from __future__ import annotations

import json
import math
import platform
import time
import uuid
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from vicinal.functions.text import embed_text
from vicinal.schema import CollectionConfig, HnswConfig, IvfConfig
from vicinal.sources.collection import Collection
from vicinal.sources.files import ensure_dir


class Store:
    """Collections below one folder."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, ensure_dir(root)

    def create(self, name: str, dimension: int, metric: str = "cosine", index_type: str = "hnsw", hnsw: Mapping[str, Any] | None = None, ivf: Mapping[str, Any] | None = None) -> dict[str, Any]:
        config = CollectionConfig.from_dict({"name": name, "dimension": dimension, "metric": metric, "index_type": index_type, "hnsw": hnsw, "ivf": ivf})
        Collection.create(self.spark, self.root, config)
        return config.to_dict()

    def open(self, name: str) -> Collection:
        return Collection.open(self.spark, self.root, name)

    def list(self, contains: str = "") -> list[dict[str, Any]]:
        return Collection.discover(self.root, contains)

    def delete(self, name: str) -> None:
        self.open(name).drop()

    def put(self, name: str, rows: Sequence[Mapping[str, Any]], insert: bool = False) -> list[str]:
        """Upsert (or insert) dicts. A row without a vector is embedded from its document; one without either is an error."""
        c = self.open(name)
        full = []
        for row in rows:
            doc = row.get("document", row.get("text"))
            vector = row.get("vector")
            if vector is None:
                if not doc:
                    raise ValueError("an item needs a vector or a document")
                vector = embed_text(doc, c.config.dimension)
            full.append({**row, "id": str(uuid.uuid4()) if row.get("id") is None else row["id"], "document": doc, "vector": vector})
        frame = c.from_rows(full)
        (c.insert if insert else c.upsert)(frame)
        return [str(r["id"]) for r in full]

    def vector(self, c: Collection, vector: Sequence[float] | None, text: str | None) -> list[float]:
        if vector is not None:
            return [float(x) for x in vector]
        if text:
            return embed_text(text, c.config.dimension)
        raise ValueError("a query needs a vector or a text")

    def query(self, name: str, vector=None, text=None, k: int = 10, where=None, include_vector: bool = False, ef_search: int | None = None, diversity: float | None = None, fetch_k: int = 50) -> list[dict[str, Any]]:
        c = self.open(name)
        q = self.vector(c, vector, text)
        found = c.query(q, k, where, include_vector, ef_search=ef_search) if diversity is None else c.diverse_query(q, k, where, fetch_k, diversity)
        return plain(found.collect())

    def hybrid(self, name: str, text: str, vector=None, k: int = 10, where=None, fusion: str = "rrf", alpha: float = 0.5, rrf_k: int = 60) -> list[dict[str, Any]]:
        c = self.open(name)
        return plain(c.hybrid(self.vector(c, vector, text), text, k, where, fusion, alpha, rrf_k).collect())

    def cluster(self, name: str, k: int = 3, method: str = "kmeans", where=None, max_iter: int = 50, seed: int = 42) -> dict[str, Any]:
        found = self.open(name).cluster(k, method, where, max_iter, seed)
        clusters = [{**r, "centroid": [round(x, 6) for x in r.get("centroid") or []]} for r in plain(found.clusters.orderBy("cluster").collect())]
        return found.summary | {"clusters": clusters}


def plain(rows) -> list[dict[str, Any]]:
    """Rows as dicts, metadata parsed."""
    out = []
    for r in rows:
        d = r.asDict(recursive=True)
        if isinstance(d.get("metadata"), str):
            d["metadata"] = json.loads(d["metadata"])
        out.append(d)
    return out


def quantize(vector: Sequence[float], mode: str = "sq8", bits: int = 8) -> dict[str, Any]:
    """One vector's code, on the driver, with the same rules as the column functions."""
    v = [float(x) for x in vector]
    if mode == "binary":
        code = bytes(sum((1 << (7 - j)) for j in range(8) if b + j < len(v) and v[b + j] > 0) for b in range(0, len(v), 8))
        back, lo, hi, mse = [1.0 if x > 0 else -1.0 for x in v], None, None, None
    elif mode in ("sq8", "scalar8", "scalar"):
        lo, hi, top = (min(v), max(v), 2**bits - 1) if v else (0.0, 0.0, 1)
        code = bytes(0 if hi - lo <= 1e-12 else round((x - lo) / (hi - lo) * top) for x in v)
        back = [lo + c * (hi - lo) / top for c in code]
        mse = round(sum((a - b) ** 2 for a, b in zip(v, back)) / max(1, len(v)), 8)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    n = lambda a: math.sqrt(sum(x * x for x in a))
    norms = n(v) * n(back)
    cosine = sum(a * b for a, b in zip(v, back)) / norms if norms else 0.0
    return {"mode": mode, "dimension": len(v), "n_bytes": len(code), "ratio": len(v) * 4 / max(1, len(code)), "code_hex": code.hex(), "min_value": lo, "max_value": hi, "mse": mse, "cosine_reconstruction": round(cosine, 6)}


def diagnostics(spark: SparkSession) -> dict[str, Any]:
    began = time.perf_counter()
    spark.range(1000).selectExpr("sum(id)").first()
    return {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "master": spark.sparkContext.master, "job_ms": round((time.perf_counter() - began) * 1000, 2)}


def benchmark(spark: SparkSession, n: int = 1000, dimension: int = 64, queries: int = 100, k: int = 10, metric: str = "cosine", seed: int = 42, config: HnswConfig = HnswConfig()) -> dict[str, Any]:
    """Graph search against the exact join on random unit vectors: build and query seconds, queries a second, recall."""
    from pyspark.sql import functions as F

    from vicinal.operators import hnsw, knn, stats

    base = stats.with_random_vectors(spark.range(n + queries), dimension, seed).persist()
    items, asked = base.filter(F.col("id") < n), base.filter(F.col("id") >= n).withColumnRenamed("id", "query_id")
    base.count()
    t = time.perf_counter()
    truth = knn.knn_join(asked, items, k, metric).persist()
    truth.count()
    exact = time.perf_counter() - t
    t = time.perf_counter()
    graphs = hnsw.build(items, metric, config).persist()
    graphs.count()
    build = time.perf_counter() - t
    t = time.perf_counter()
    found = hnsw.knn_join(graphs, asked, k, max(k, config.ef_search), metric, config).persist()
    found.count()
    ann = time.perf_counter() - t
    recall = knn.recall_at_k(found, truth, k).first()["recall"]
    for df in (base, truth, graphs, found):
        df.unpersist()
    return {"n": n, "dimension": dimension, "queries": queries, "k": k, "metric": metric, "build_s": round(build, 4), "exact_s": round(exact, 4), "ann_s": round(ann, 4), "exact_qps": round(queries / exact, 2), "ann_qps": round(queries / ann, 2), "recall": round(recall, 4)}


__all__ = ["HnswConfig", "IvfConfig", "Store", "benchmark", "diagnostics", "plain", "quantize"]
