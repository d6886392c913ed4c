"""Collections: keyed items in immutable Parquet versions, with dense, sparse and fused queries over them.

A change writes a new version folder and then flips the ``CURRENT`` file, so readers see the old or the new version. Inverted
lists and graphs are built on demand and kept up by later changes: only the folders of lists and shards that a change touches
are replaced. A mark beside each says which version it is of; it is taken away before an upkeep and set after, so an index whose
upkeep broke off is built anew. Postings belong to a version.
"""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions.filters import compile_filter
from vicinal.operators import bm25, cluster, fusion, hnsw, ivf, knn, mmr
from vicinal.schema import ITEM, CollectionConfig, HnswConfig, IvfConfig, parse_index
from vicinal.sources import dml, files, jsonl, vdb

#: Growth since training, or beyond a shard's size, at which an index is built anew instead of kept up.
GROWTH = 4


class Collection:
    """One collection below ``root``. All queries return DataFrames."""

    def __init__(self, spark: SparkSession, config: CollectionConfig, root: str | Path):
        self.spark, self.config = spark, config
        self.path = files.safe_path(root, files.safe_name(config.name))

    # versions

    @classmethod
    def create(cls, spark: SparkSession, root: str | Path, config: CollectionConfig) -> Collection:
        made = cls(spark, config, root)
        if (made.path / "CURRENT").exists():
            raise ValueError(f"collection {config.name!r} exists")
        made._commit(spark.createDataFrame([], ITEM))
        return made

    @classmethod
    def open(cls, spark: SparkSession, root: str | Path, name: str) -> Collection:
        path = files.safe_path(root, files.safe_name(name))
        config = files.safe_json_read(path / "config.json")
        if config is None:
            raise KeyError(f"no collection {name!r}")
        return cls(spark, CollectionConfig.from_dict(config), root)

    @staticmethod
    def discover(root: str | Path, contains: str = "") -> list[dict[str, Any]]:
        """Configurations of the collections below ``root``; broken ones are left out."""
        found = [files.safe_json_read(p) for p in sorted(Path(root).glob("*/config.json"))]
        return [c for c in found if isinstance(c, dict) and "name" in c and contains in c["name"]]

    def version(self) -> int:
        return int((self.path / "CURRENT").read_text())

    def _folder(self, version: int, what: str = "items") -> str:
        return str(self.path / f"v{version}" / what)

    def _commit(self, items: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Writes a version. ``added`` (items) and ``removed`` (ids) say what has changed, so that indexes can follow; else they are built anew when asked for."""
        version = self.version() + 1 if (self.path / "CURRENT").exists() else 1
        kept = [kind for kind in ("ivf", "hnsw") if self._is_fresh(kind)] if added is not None or removed is not None else []
        items.select(*[f.name for f in ITEM]).write.mode("overwrite").parquet(self._folder(version))
        files.atomic_write(self.path / "config.json", json.dumps(self.config.to_dict(), indent=2))
        files.atomic_write(self.path / "CURRENT", str(version))
        for kind in kept:
            self._keep_up(kind, version, added, removed)

    def _index(self, kind: str) -> Path:
        return self.path / "index" / kind

    def _mark(self, kind: str) -> Path:
        return self.path / "index" / f"{kind}.version"

    def _is_fresh(self, kind: str) -> bool:
        """Whether the index is there and of this version."""
        mark = self._mark(kind)
        return mark.exists() and mark.read_text() == str(self.version())

    def _keep_up(self, kind: str, version: int, added: DataFrame | None, removed: DataFrame | None) -> None:
        added = self.items().limit(0) if added is None else added
        removed = self.items().limit(0) if removed is None else removed
        self._mark(kind).unlink()
        if kind == "ivf":
            trained = files.safe_json_read(self._index(kind) / "centroids.json") or {}
            if not trained.get("centroids") or self.count() > GROWTH * trained["n"]:
                return  # of too few rows: trained anew on the next search
            ivf.upkeep(self.spark, str(self._index(kind) / "lists"), trained["centroids"], added, removed, self.config.metric)
        elif not any(self._index(kind).glob("shard=*")):
            return  # nothing has been written of no items
        else:
            hnsw.upkeep(self.spark, str(self._index(kind)), added, removed, self.config.metric, self.config.hnsw)
            if (hnsw.read(self.spark, str(self._index(kind))).agg(F.max("n")).first()[0] or 0) > GROWTH * hnsw.SHARD_ROWS:
                return  # shards have outgrown their size: dealt anew on the next search
        files.atomic_write(self._mark(kind), str(version))

    def items(self) -> DataFrame:
        return self.spark.read.schema(ITEM).parquet(self._folder(self.version()))

    # changes

    def _checked(self, rows: DataFrame) -> DataFrame:
        """Rows in the item schema; a vector of another length is an error."""
        for name, kind in (("metadata", "string"), ("document", "string"), ("created_at", "double")):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        if "ord" not in rows.columns:
            rows = rows.withColumn("ord", F.monotonically_increasing_id())
        right = F.size("vector") == self.config.dimension
        vector = F.when(right, F.col("vector").cast("array<double>")).otherwise(F.raise_error(F.concat(F.lit(f"expected {self.config.dimension} dimensions, got "), F.size("vector").cast("string"))).cast("array<double>"))
        rows = rows.select(F.col("id").cast("string").alias("id"), vector.alias("vector"), F.coalesce(F.col("metadata"), F.lit("{}")).alias("metadata"), "document", F.coalesce("created_at", F.lit(time.time())).alias("created_at"), F.col("ord").cast("bigint").alias("ord"))
        start = self.items().agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
        return rows.withColumn("ord", F.col("ord") + start)

    def from_rows(self, rows: Sequence[Mapping[str, Any]]) -> DataFrame:
        """Items of Python dicts: id, vector, metadata (a dict), document, created_at."""
        now = time.time()
        data = [(str(r["id"]), [float(x) for x in r["vector"]], json.dumps(r.get("metadata") or {}, default=str), r.get("document", r.get("text")), float(r.get("created_at") or now), n) for n, r in enumerate(rows)]
        return self.spark.createDataFrame(data, ITEM)

    def insert(self, rows: DataFrame) -> None:
        """Append; an id that is there already, or twice in ``rows``, is an error and nothing is written."""
        rows = self._checked(rows)
        twice = dml.duplicates(self.items(), rows).select("id").union(rows.groupBy("id").count().filter("count > 1").select("id")).first()
        if twice:
            raise ValueError(f"id {twice[0]!r} exists")
        self._commit(self.items().unionByName(rows), rows)

    def upsert(self, rows: DataFrame) -> None:
        rows = self._checked(rows)
        self._commit(dml.upsert(self.items(), rows), dml.newest(rows).select(*[f.name for f in ITEM]), rows.select("id"))

    def delete(self, ids: Sequence[str]) -> int:
        gone = dml.requests(self.spark, ids).select("id").distinct()
        n = self.items().join(gone, "id", "left_semi").count()
        if n:
            self._commit(dml.delete(self.items(), gone), removed=gone)
        return n

    def clear(self) -> None:
        self._commit(self.spark.createDataFrame([], ITEM))

    def drop(self) -> None:
        files.safe_delete(self.path)

    # reads

    def count(self) -> int:
        return self.items().count()

    def get(self, id_: str) -> dict[str, Any] | None:
        row = self.items().filter(F.col("id") == str(id_)).first()
        return row.asDict() if row else None

    def get_batch(self, ids: Sequence[str]) -> DataFrame:
        return dml.get_batch(self.items(), dml.requests(self.spark, ids)).orderBy("pos")

    def where(self, expr: Mapping[str, Any] | None) -> Column | None:
        return compile_filter(expr, F.parse_json(F.coalesce("metadata", F.lit("{}")))) if expr else None

    def filter(self, expr: Mapping[str, Any] | None, limit: int | None = None) -> DataFrame:
        where = self.where(expr)
        rows = self.items().filter(where) if where is not None else self.items()
        return rows.orderBy("ord").limit(limit) if limit is not None else rows

    def _payload(self, top: DataFrame, include_vector: bool) -> DataFrame:
        more = self.items().select("id", "metadata", "document", *(["vector"] if include_vector else []))
        return top.drop("vector").join(more, "id").orderBy("rank")

    def query(self, vector: Sequence[float], k: int = 10, where: Mapping[str, Any] | None = None, include_vector: bool = False, nprobe: int | None = None, ef_search: int | None = None) -> DataFrame:
        """rank, id, distance, score, metadata, document by the collection's index."""
        knn.check_dimension(vector, self.config.dimension)
        return self._payload(self._top(vector, k, self.where(where), nprobe, ef_search), include_vector)

    def _top(self, vector: Sequence[float], k: int, pred: Column | None, nprobe: int | None = None, ef_search: int | None = None) -> DataFrame:
        items, metric = self.items(), self.config.metric
        match self.config.index_type:
            case "ivf":
                indexed, centroids = self._ivf()
                return ivf.search(indexed, centroids, vector, k, metric, pred, nprobe or self.config.ivf.nprobe)
            case "hnsw":
                return hnsw.search(self._hnsw(), items, vector, k, metric, pred, ef_search, self.config.hnsw)
            case _:
                return knn.top_k(items, vector, k, metric, pred)

    def diverse_query(self, vector: Sequence[float], k: int = 10, where: Mapping[str, Any] | None = None, fetch_k: int = mmr.FETCH_K, lam: float = mmr.LAMBDA) -> DataFrame:
        knn.check_dimension(vector, self.config.dimension)
        return self._payload(mmr.diverse_top_k(self.items(), vector, k, self.config.metric, self.where(where), fetch_k, lam), False)

    def text_search(self, text: str, k: int = 10, where: Mapping[str, Any] | None = None) -> DataFrame:
        """BM25 over the stored postings of this version, which are written on the first search."""
        return self._payload(self._matching(text, k, self.where(where)), False)

    def _matching(self, text: str, k: int, pred: Column | None) -> DataFrame:
        allowed = self.items().filter(pred).select("id") if pred is not None else None
        return bm25.search_index(self.spark, self._sparse(), text, k, allowed)

    def hybrid(self, vector: Sequence[float], text: str, k: int = 10, where: Mapping[str, Any] | None = None, fusion_method: str = "rrf", alpha: float = fusion.ALPHA, rrf_k: int = fusion.RRF_K) -> DataFrame:
        """The collection's index and its stored postings, each with a pool of max(3k, 20) rows, fused."""
        knn.check_dimension(vector, self.config.dimension)
        pred, pool = self.where(where), fusion.pool_rows(k)
        return self._payload(fusion.fuse(self._top(vector, pool, pred), self._matching(text, pool, pred), k, fusion_method, alpha, rrf_k), False)

    def cluster(self, k: int = 3, method: str = "kmeans", where: Mapping[str, Any] | None = None, max_iter: int = 50, seed: int = 42) -> cluster.Clustering:
        return cluster.cluster(self.items(), k, method, self.where(where), self.config.metric, max_iter, seed)

    def _ivf(self) -> tuple[DataFrame, list[list[float]]]:
        folder, version = self._index("ivf"), self.version()
        if not self._is_fresh("ivf"):
            n = self.count()
            few = IvfConfig(**{**self.config.to_dict()["ivf"], "nlist": max(1, min(self.config.ivf.nlist, n))})
            centroids = ivf.train(self.items(), self.config.metric, few) if n else []
            if centroids:
                ivf.write(self.items(), centroids, self.config.metric, str(folder / "lists"))
            files.atomic_write(folder / "centroids.json", json.dumps({"centroids": centroids, "n": n}))
            files.atomic_write(self._mark("ivf"), str(version))
        centroids = files.safe_json_read(folder / "centroids.json")["centroids"]
        return (ivf.read(self.spark, str(folder / "lists")) if centroids else self.items().withColumn("centroid_id", F.lit(0))), centroids

    def _sparse(self) -> str:
        folder = self._folder(self.version(), "bm25")
        if not (Path(folder) / "totals" / "_SUCCESS").exists():
            bm25.write_index(self.items(), folder)
        return folder

    def _hnsw(self) -> DataFrame:
        folder, version = str(self._index("hnsw")), self.version()
        if not self._is_fresh("hnsw"):
            hnsw.write(hnsw.build(self.items(), self.config.metric, self.config.hnsw), folder)
            files.atomic_write(self._mark("hnsw"), str(version))
        # nothing has been written of no items
        return hnsw.read(self.spark, folder) if any(Path(folder).glob("shard=*")) else hnsw.build(self.items(), self.config.metric, self.config.hnsw)

    def rebuild_index(self, index_type: str, hnsw_config: HnswConfig | None = None, ivf_config: IvfConfig | None = None) -> None:
        """Switch the access path; answers of exact paths stay the same."""
        c = self.config
        self.config = CollectionConfig(c.name, c.dimension, c.metric, parse_index(index_type), hnsw_config or c.hnsw, ivf_config or c.ivf)
        self._commit(self.items())

    def stats(self) -> dict[str, Any]:
        c, s = self.config, stats_frame(self.items(), self.config.dimension).first()
        out = {"name": c.name, "count": s["count"], "dimension": c.dimension, "metric": c.metric, "index_type": c.index_type, "memory_bytes": s["memory_bytes"], "has_sparse_index": s["n_documents"] > 0, "layers_count": 0, "avg_links_per_node": 0.0}
        if c.index_type == "hnsw" and self._is_fresh("hnsw"):
            layers = hnsw.graph_stats(self._hnsw()).collect()
            out |= {"layers_count": len(layers), "avg_links_per_node": sum(r["links"] for r in layers) / max(1, sum(r["nodes"] for r in layers))}
        if c.index_type == "ivf" and self._is_fresh("ivf"):
            sizes = {r["centroid_id"]: r["n"] for r in ivf.list_sizes(self._ivf()[0]).collect()}
            out |= {"clusters": len(sizes), "cluster_sizes": dict(sorted(sizes.items()))}
        return out

    # files

    def save(self, path: str, kind: str = "json") -> None:
        """One JSON or binary file."""
        if kind == "vdb":
            rows = ((r["id"], r["vector"], r["metadata"], r["document"], r["created_at"]) for r in self.items().orderBy("ord").toLocalIterator())
            vdb.write_file(path, self.config.to_dict(), rows)
        else:
            jsonl.write_json(self.items(), self.config.to_dict(), path)

    @classmethod
    def load(cls, spark: SparkSession, root: str | Path, path: str, name: str | None = None) -> Collection:
        """A collection from a JSON or binary file, told apart by the first bytes."""
        if files.detect_format(path) == "vdb":
            with open(path, "rb") as f:
                config = vdb.unpack(f)[0]
            vdb.register(spark)
            rows = spark.read.format("vdb").load(path)
        else:
            config, rows = jsonl.read_json(spark, path)
        made = cls(spark, CollectionConfig.from_dict(config | ({"name": name} if name else {})), root)
        if not (made.path / "CURRENT").exists():
            made._commit(spark.createDataFrame([], ITEM))
        made.upsert(rows)
        return made

    def export_jsonl(self, path: str) -> int:
        jsonl.write_jsonl(self.items(), path)
        return self.count()

    def import_jsonl(self, path: str) -> int:
        rows = jsonl.read_jsonl(self.spark, path)
        self.upsert(rows)
        return rows.count()


def stats_frame(items: DataFrame, dimension: int) -> DataFrame:
    """One row: count, dimension, n_documents, memory_bytes (vectors as doubles, texts as UTF-8)."""
    size = F.sum(F.lit(8 * dimension) + F.octet_length("id") + F.coalesce(F.octet_length("document"), F.lit(0)) + F.coalesce(F.octet_length("metadata"), F.lit(0)))
    return items.agg(F.count("*").alias("count"), F.lit(dimension).cast("bigint").alias("dimension"), F.sum((F.coalesce("document", F.lit("")) != "").cast("bigint")).alias("n_documents"), F.coalesce(size, F.lit(0)).cast("bigint").alias("memory_bytes"))
