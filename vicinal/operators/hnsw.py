"""Graph search: one seeded navigable-small-world graph per hash shard, searched shard by shard and merged.

A graph over all rows would need a shuffle for each hop, so rows are spread over shards of bounded size, each shard's graph is
built and stored by one task as a row of the graph table, and a query runs over all shards at once. Changes are put into a
stored table shard by shard: new rows are inserted into their shard's graph, deleted ones taken out with their neighbours linked
anew, and only the folders of shards that a change touches are replaced.

Shards are dealt by a hash of the id, so that every query asks all of them, or by ``centroids``: a row is in the shard of its
nearest one, and in that of its second nearest too if this is hardly farther (``SLACK``). Then a query asks the ``nprobe`` shards
nearest to it, and reads their folders only. A centroid of more rows than a shard holds has several shards, numbered a round of
centroids on, and a query that asks it asks them all.
"""

from __future__ import annotations

import heapq
import io
import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.functions.distance import score
from vicinal.operators.knn import DIGITS, _distances, _matrix, ranked, recall_at_k, top_k, usable
from vicinal.operators.knn import knn_join as exact_join
from vicinal.operators.lloyd import Centroids
from vicinal.schema import HnswConfig, parse_metric

#: Rows that one shard holds, about.
SHARD_ROWS = 20_000
#: Rows below which a table is not cut into more shards for the sake of parallel building.
LEAST_SHARD = 500
#: A row is in a second shard as well if its centroid is at most so many times as far as the nearest.
SLACK = 1.15
#: Shards of a routed table that a query asks.
NPROBE = 4
#: Rows of a block of new nodes that are compared with all before them at once.
LINK_ROWS = 256
#: Queries that meet one shard in a task, about.
ASKED_ROWS = 16_384
#: ``beam_width``: queries that it tries, and the share of their true neighbours to be found.
TUNED_ROWS, TUNED = 256, 0.95


class Graph:
    """One shard's layers of neighbour lists."""

    def __init__(self, vectors: np.ndarray, metric: str, config: HnswConfig, seed: int):
        self.metric, self.config, self.seed = parse_metric(metric), config, seed
        self.rng = random.Random(seed)
        self.layers: list[dict[int, list[int]]] = []
        self.entry = -1
        self._hold(vectors[:0])
        self._extend(vectors)

    def _hold(self, vectors: np.ndarray) -> None:
        self.vectors, self.ready = vectors, self._ready(vectors)

    def _ready(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors under cosine, so that a distance is one product; zero vectors stay zero."""
        if self.metric != "cosine":
            return vectors
        n = np.linalg.norm(vectors, axis=-1, keepdims=True)
        return np.divide(vectors, n, out=np.zeros_like(vectors), where=n > 0)

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """All distances of ready vectors."""
        return np.maximum(0.0, 1.0 - np.minimum(a @ b.T, 1.0)) if self.metric == "cosine" else _distances(self.metric, a, b)

    def level(self) -> int:
        """Geometric: floor(-ln u * level_mult), below max_layers."""
        u = max(self.rng.random(), 1e-12)
        return min(int(-math.log(u) * self.config.level_mult), self.config.max_layers - 1)

    def distances(self, q: np.ndarray, nodes: Sequence[int]) -> np.ndarray:
        """Of a ready vector to nodes."""
        return self._between(q[None], self.ready[nodes])[0]

    def beam(self, q: np.ndarray, starts: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest reachable nodes of one layer, nearest first."""
        links = self.layers[layer]
        seen = {n for _, n in starts}
        todo = list(starts)
        heapq.heapify(todo)
        best = [(-d, -n) for d, n in starts]
        heapq.heapify(best)
        while len(best) > width:
            heapq.heappop(best)
        while todo:
            d, node = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            fresh = [n for n in links.get(node, ()) if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for dist, n in zip(self.distances(q, fresh).tolist(), fresh):
                if len(best) < width or dist < -best[0][0]:
                    heapq.heappush(todo, (dist, n))
                    heapq.heappush(best, (-dist, -n))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, -n) for d, n in best)

    def choose(self, near: np.ndarray, d: np.ndarray, most: int) -> list[int]:
        """Of nodes by distance: those nearer to the node than to any already chosen, then the nearest of the rest."""
        if not self.config.heuristic_pruning or len(near) <= most:
            return near[:most].tolist()
        x = self.ready[near]
        every = self._between(x, x) if len(near) <= 2 * self.config.ef_construction else None
        free, kept, at = np.ones(len(near), bool), np.zeros(len(near), bool), -1
        for _ in range(most):
            ahead = free[at + 1 :]
            step = int(ahead.argmax()) if len(ahead) else 0
            if not len(ahead) or not ahead[step]:
                break
            at += 1 + step
            kept[at] = True
            free &= (every[at] if every is not None else self._between(x[at][None], x)[0]) >= d
        chosen = near[kept].tolist()
        return chosen + near[~kept][: most - len(chosen)].tolist()

    def _extend(self, vectors: np.ndarray) -> None:
        """Inserts rows behind those there are, layer by layer; the entry is the first row of the highest layer."""
        first, high = len(self.vectors), len(self.layers)
        if not len(vectors):
            return
        self._hold(np.concatenate([self.vectors, vectors]) if first else vectors)
        tops = [self.level() for _ in vectors]
        for layer in range(max(tops) + 1):
            if layer == len(self.layers):
                self.layers.append({})
            self._link(layer, [first + i for i, top in enumerate(tops) if top >= layer])
        if max(tops) >= high:
            self.entry = first + tops.index(max(tops))

    def _link(self, layer: int, fresh: list[int]) -> None:
        """Links a layer's new nodes: each is linked with some of the ``ef_construction`` nearest before it, and these with it.

        The nearest are exact - products of blocks instead of a beam for each row - and lists that grow too long are cut once.
        """
        links, most = self.layers[layer], self.config.m0 if layer == 0 else self.config.m
        old, nodes = len(links), np.array([*links, *fresh])
        x, gained = self.ready[nodes], {}
        for lo in range(old, len(nodes), LINK_ROWS):
            d = self._between(x[lo : lo + LINK_ROWS], x[: lo + LINK_ROWS])
            d[np.arange(d.shape[1]) >= np.arange(lo, lo + len(d))[:, None]] = np.inf
            width = min(self.config.ef_construction, d.shape[1])
            near = np.argpartition(d, width - 1, axis=1)[:, :width]
            far = np.take_along_axis(d, near, axis=1)
            order = np.lexsort((near, far))
            near, far = np.take_along_axis(near, order, axis=1), np.take_along_axis(far, order, axis=1)
            counts = np.isfinite(far).sum(axis=1)
            for node, there, dist, n in zip(nodes[lo : lo + LINK_ROWS].tolist(), nodes[near], far, counts.tolist()):
                links[node] = self.choose(there[:n], dist[:n], self.config.m)
                for other in links[node]:
                    gained.setdefault(other, []).append(node)
        for other, more in gained.items():
            own = links[other] + more
            links[other] = own if len(own) <= most else self._nearest_of(other, own, most)
        self._found_again(links)

    def _nearest_of(self, node: int, others: Sequence[int], most: int) -> list[int]:
        near = np.array(others)
        d = self.distances(self.ready[node], near)
        order = np.lexsort((near, d))
        return self.choose(near[order], d[order], most)

    def add(self, vectors: np.ndarray) -> None:
        """Inserts further rows behind those there are. Levels are drawn from the seed and how many there were."""
        self.rng = random.Random(f"{self.seed}:{len(self.vectors)}")
        self._extend(vectors)

    def remove(self, gone: set[int]) -> None:
        """Takes rows out. Who was linked with one is linked with those behind it instead; rows that nothing leads to any more get a link back.

        The rows that stay move up in order. If the entry goes, one of the highest layer that is left takes its stead.
        """
        kept = [n for n in range(len(self.vectors)) if n not in gone]
        for i, links in enumerate(self.layers):
            most, left = self.config.m0 if i == 0 else self.config.m, {}
            for node, own in links.items():
                if node not in gone:
                    left[node] = self._bridged(node, own, links, gone, most) if gone.intersection(own) else own
            self._found_again(left)
            self.layers[i] = left
        while self.layers and not self.layers[-1]:
            self.layers.pop()
        if self.entry in gone:
            self.entry = min(self.layers[-1], default=-1) if self.layers else -1
        place = {n: i for i, n in enumerate(kept)}
        self.layers = [{place[n]: [place[x] for x in own] for n, own in links.items()} for links in self.layers]
        self.entry = place.get(self.entry, -1)
        self._hold(self.vectors[kept])

    def _bridged(self, node: int, own: list[int], links: dict[int, list[int]], gone: set[int], most: int) -> list[int]:
        """The node's links where some are gone: chosen among those left and what is behind the gone ones, as far as it takes to find any."""
        near, lost = {n for n in own if n not in gone}, [n for n in own if n in gone]
        seen = set(lost)
        while lost:
            behind = {n for x in lost for n in links.get(x, ())} - seen
            near |= behind - gone - {node}
            seen |= behind
            lost = [] if near else sorted(behind & gone)
        return self._nearest_of(node, sorted(near), most) if near else []

    def _found_again(self, links: dict[int, list[int]]) -> None:
        """Nodes of a layer that no other leads to are linked from their nearest neighbour, or from the nearest of all."""
        led_to = {n for node, own in links.items() for n in own if n != node}
        nodes = sorted(links)
        for node in nodes if len(nodes) > 1 else ():
            if node in led_to and links[node]:
                continue
            near = links[node] or [n for n in nodes if n != node]
            d = self.distances(self.ready[node], near)
            other = near[int(d.argmin())]
            links[node] = links[node] or [other]
            if node not in links[other]:
                links[other].append(node)

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        q = self._ready(q)
        at = [(float(self.distances(q, [self.entry])[0]), self.entry)]
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self.beam(q, at, 1, layer)
        return self.beam(q, at, max(k, ef), 0)

    def dump(self) -> bytes:
        """Vectors, layers and entry as plain arrays."""
        arrays = {"vectors": self.vectors, "head": np.array([self.entry, len(self.layers)])}
        for i, layer in enumerate(self.layers):
            arrays[f"nodes{i}"] = np.array(list(layer), np.int32)
            arrays[f"sizes{i}"] = np.array([len(v) for v in layer.values()], np.int32)
            arrays[f"links{i}"] = np.array([n for v in layer.values() for n in v], np.int32)
        out = io.BytesIO()
        np.savez(out, **arrays)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes, metric: str, config: HnswConfig) -> Graph:
        """What ``dump`` has written; nothing in it is run."""
        graph = cls(np.empty((0, 0)), metric, config, config.seed)
        with np.load(io.BytesIO(raw), allow_pickle=False) as arrays:
            graph._hold(arrays["vectors"])
            graph.entry, layers = (int(x) for x in arrays["head"])
            for i in range(layers):
                cuts = np.cumsum(arrays[f"sizes{i}"])[:-1]
                graph.layers.append({int(n): part.tolist() for n, part in zip(arrays[f"nodes{i}"], np.split(arrays[f"links{i}"], cuts))})
        return graph

    def links(self) -> list[tuple[int, int, int]]:
        """(layer, nodes, links)."""
        return [(i, len(nodes), sum(map(len, nodes.values()))) for i, nodes in enumerate(self.layers)]


def _schema(kind: str) -> str:
    return f"shard int, shards int, n bigint, graph binary, ids array<{kind}>, stats array<struct<layer int, nodes bigint, links bigint>>"


def _row(shard: int, shards: int, graph: Graph, ids: list) -> pd.DataFrame:
    stats = [{"layer": a, "nodes": b, "links": c} for a, b, c in graph.links()]
    return pd.DataFrame({"shard": [shard], "shards": [shards], "n": [len(ids)], "graph": [graph.dump()], "ids": [ids], "stats": [stats]})


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")


def routed(rows: DataFrame, centroids: Centroids, metric: str, most: int, slack: float | None = None) -> DataFrame:
    """``rows`` (vector, and others) with the ``most`` nearest centroids as shard (ties by number), a row for each, and its place as probe; with ``slack``, of those at most so many times as far as the nearest."""
    sent = rows.sparkSession.sparkContext.broadcast(np.array(centroids, float))
    at, names = rows.columns.index("vector"), [*rows.columns, "__shards"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            if not len(batch):
                continue
            d = np.round(_distances(metric, _matrix(batch.column(at), c.shape[1]), c), 12)
            near = np.argsort(d, axis=1, kind="stable")[:, :most].astype(np.int32)
            far = np.take_along_axis(d, near.astype(np.int64), axis=1)
            fine = far <= far[:, :1] * slack if slack is not None else np.ones_like(near, bool)
            fine[:, 0] = True
            lists = [row[ok].tolist() for row, ok in zip(near, fine)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=names)

    schema = T.StructType([*rows.schema.fields, T.StructField("__shards", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema).select(*rows.columns, F.posexplode("__shards").alias("probe", "shard"))


def _parted(dealt: DataFrame, centroids: Centroids, parts: int) -> DataFrame:
    """``routed`` rows with the numbers of their shards where each centroid has ``parts`` of them."""
    return dealt.drop("probe").withColumn("shard", F.col("shard") + F.lit(len(centroids)) * F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))


def build(items: DataFrame, metric: str = "cosine", config: HnswConfig = HnswConfig(), shards: int | None = None, id_col: str = "id", vector_col: str = "vector", centroids: Centroids | None = None) -> DataFrame:
    """The graph table: shard, shards (how many there are), n, graph (a ``Graph`` as arrays), ids, and stats (layer, nodes, links).

    With ``centroids`` there is a shard for each, or as many for each as the largest asks for, else ``shards`` of them, or as many
    as the rows ask for.
    """
    slim = items.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    if centroids is not None:
        dealt = routed(slim.filter(usable(F.col("vector"))), centroids, metric, 2, SLACK)
        largest = dealt.groupBy("shard").count().agg(F.max("count")).first()[0] or 1
        parts = math.ceil(largest / SHARD_ROWS)
        count, dealt = len(centroids) * parts, _parted(dealt, centroids, parts)
    else:
        n, tasks = slim.count(), slim.sparkSession.sparkContext.defaultParallelism
        count = shards or max(1, math.ceil(n / SHARD_ROWS), min(tasks, n // LEAST_SHARD))
        dealt = slim.select("*", _shard(count))
    kind = slim.schema["id"].dataType.simpleString()

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        shard = int(pdf["shard"].iloc[0])
        return _row(shard, count, Graph(np.stack(pdf["vector"].to_list()).astype(float), metric, config, config.seed + shard), pdf["id"].tolist())

    # a fixed number of partitions: small as they are, shards are not to be built one after another in one task
    return dealt.repartition(2 * count, "shard").groupBy("shard").applyInPandas(make, _schema(kind))


def write(graphs: DataFrame, path: str) -> None:
    """A folder for each shard."""
    graphs.write.mode("overwrite").partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def updated(graphs: DataFrame, added: DataFrame, removed: DataFrame, metric: str = "cosine", config: HnswConfig = HnswConfig(), centroids: Centroids | None = None) -> DataFrame:
    """The rows of a graph table that change when the ids of ``removed`` go and ``added`` (id, vector) comes: those of the shards of these ids.

    Rows go before others come, so an id that is in both is replaced; of ids that are added though they are there, or twice, the
    last by order of vectors stays. A shard that gets empty keeps a row without nodes.
    """
    first = graphs.select("shards").first()
    count, kind = (first[0] if first else 1), added.schema["id"].dataType.simpleString()
    coming = added.select("id", F.col("vector").cast("array<double>").alias("vector")).groupBy("id").agg(F.max("vector").alias("vector")).select("id", "vector")
    leaving = removed.select("id").distinct().withColumn("vector", F.lit(None).cast("array<double>"))
    if centroids is None:
        changes = coming.unionByName(leaving).select("*", _shard(count))
    else:  # where a row that goes, or that comes though it is there, has been dealt to is told by the shards' own lists of ids
        there = graphs.select(F.col("shard").cast("int").alias("shard"), F.explode("ids").alias("id"))
        out = leaving.unionByName(coming.select("id").withColumn("vector", F.lit(None).cast("array<double>"))).distinct().join(there, "id")
        dealt = _parted(routed(coming.filter(usable(F.col("vector"))), centroids, metric, 2, SLACK), centroids, max(1, count // len(centroids)))
        changes = dealt.unionByName(out.select("id", "vector", "shard"))
    touched = graphs.join(changes.select("shard").distinct(), "shard", "left_semi")

    def change(key: tuple, rows: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        ids = list(stored["ids"].iloc[0]) if len(stored) else []
        graph = Graph.load(stored["graph"].iloc[0], metric, config) if len(stored) else Graph(np.empty((0, 0)), metric, config, config.seed)
        graph.seed = config.seed + shard
        new = rows[rows["vector"].notna()].sort_values("id", kind="stable")
        out = set(rows["id"])
        gone = {i for i, x in enumerate(ids) if x in out}
        if gone:
            graph.remove(gone)
            ids = [x for i, x in enumerate(ids) if i not in gone]
        if len(new):
            graph.add(np.stack(new["vector"].to_list()).astype(float))
        return _row(shard, count, graph, ids + new["id"].tolist())

    return changes.groupBy("shard").cogroup(touched.groupBy("shard")).applyInPandas(change, _schema(kind))


def upkeep(spark: SparkSession, path: str, added: DataFrame, removed: DataFrame, metric: str = "cosine", config: HnswConfig = HnswConfig(), centroids: Centroids | None = None) -> None:
    """Puts changes into a table that ``write`` has written; only the folders of touched shards are replaced."""
    updated(read(spark, path), added, removed, metric, config, centroids).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def candidates(graphs: DataFrame, queries: DataFrame, k: int, ef: int, metric: str = "cosine", config: HnswConfig = HnswConfig(), centroids: Centroids | None = None, nprobe: int = NPROBE, most: int | None = None) -> DataFrame:
    """(query_id, probe, id, distance): beam results of the queries (query_id, vector) in a stored graph table, in every shard or, with ``centroids``, in those of the ``nprobe`` nearest; probe is a centroid's place.

    Blocks of queries meet shards in tasks. Of a routed table only shards that some query asks are read. With ``most`` a shard
    gives so many of a query's results, and those as far as the last of them.
    """
    kind, own = graphs.schema["ids"].dataType.elementType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    blocks = max(1, math.ceil(queries.count() / ASKED_ROWS))
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("qb"))
    if centroids is None:
        last = graphs.agg(F.max("shard")).first()[0] or 0
        asked = asked.withColumn("probe", F.lit(0)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))  # every block goes to every shard
        shards = graphs.select("shard", "graph", "ids").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    else:
        asked = routed(asked.filter(usable(F.col("vector"))), centroids, metric, nprobe).persist()
        numbers = [r[0] for r in asked.select("shard").distinct().collect()]  # centroids are a bounded list
        there = graphs.filter((F.col("shard") % len(centroids)).isin(numbers))
        parts = (there.agg(F.max("shard")).first()[0] or 0) // len(centroids) + 1
        asked = asked.withColumn("shard", F.explode(F.sequence(F.col("shard"), F.col("shard") + F.lit(len(centroids) * (parts - 1)), F.lit(len(centroids)))))
        shards = there.select("shard", "graph", "ids").join(asked.select(F.col("shard").alias("shard"), F.col("qb").alias("qb")).distinct(), "shard")

    def run(asked: pa.Table, shard: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for raw, ids in zip(shard["graph"].to_pylist(), shard["ids"].to_pylist()):
            graph = Graph.load(raw, metric, config)
            for q, probe, v in zip(asked["query_id"].to_pylist(), asked["probe"].to_pylist(), asked["vector"].to_pylist()):
                found = graph.search(np.array(v, float), k, ef)
                if most is not None and len(found) > most:
                    far = round(found[most - 1][0], DIGITS)
                    found = [x for x in found if round(x[0], DIGITS) <= far]
                rows += [(q, probe, ids[n], d) for d, n in found]
        columns = list(zip(*rows)) or [[], [], [], []]
        return pa.table({"query_id": pa.array(columns[0], asked["query_id"].type), "probe": pa.array(columns[1], pa.int32()), "id": pa.array(columns[2], shard["ids"].type.value_type), "distance": pa.array(columns[3], pa.float64())})

    return asked.groupBy("qb", "shard").cogroup(shards.groupBy("qb", "shard")).applyInArrow(run, f"query_id {own}, probe int, id {kind}, distance double")


def nearest(found: DataFrame, k: int, same_table: bool = False) -> DataFrame:
    """query_id, rank, id, distance of the k nearest among ``candidates``, those of a row that is in two shards taken once. Distances are compared by ``DIGITS`` digits, so that copies tie."""
    found = found.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    if same_table:
        found = found.filter("query_id <> id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", DIGITS), "id"))
    return found.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def knn_join(graphs: DataFrame, queries: DataFrame, k: int, ef: int | None = None, metric: str = "cosine", config: HnswConfig = HnswConfig(), same_table: bool = False, centroids: Centroids | None = None, nprobe: int = NPROBE) -> DataFrame:
    """query_id, rank, id, distance of the k nearest that the graphs find for each query; ``same_table`` leaves out the query's own id."""
    wide = k + same_table
    return nearest(candidates(graphs, queries, wide, max(wide, ef or config.ef_search), metric, config, centroids, nprobe, wide), k, same_table)


def beam_width(graphs: DataFrame, items: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", config: HnswConfig = HnswConfig(), same_table: bool = False, least: float = TUNED) -> int:
    """The beam by which the graphs find a share of ``least`` of the k nearest ``items`` (id, vector) of a sample of the queries.

    The larger shards are, and the more of them there are, the more a narrow beam misses: a query's neighbours are mostly in shards
    that it is no row of. At most ``TUNED_ROWS`` queries, chosen by hash, are compared with all items; the beam is doubled from the
    default on until it finds enough, or is as wide as the largest shard.
    """
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(TUNED_ROWS).persist()
    truth = exact_join(some, items, k, metric, same_table=same_table).persist()
    ef, widest = config.ef_search, graphs.agg(F.max("n")).first()[0] or 0
    while ef < widest:
        recall = recall_at_k(knn_join(graphs, some, k, ef, metric, config, same_table), truth, k).first()["recall"]
        if recall is None or recall >= least:
            break
        ef *= 2
    truth.unpersist()
    some.unpersist()
    return ef


def search(graphs: DataFrame, items: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", where: Column | None = None, ef_search: int | None = None, config: HnswConfig = HnswConfig(), id_col: str = "id", vector_col: str = "vector", centroids: Centroids | None = None, nprobe: int = NPROBE) -> DataFrame:
    """rank, id, distance, score. Filters apply to what the beams found; if fewer than k are left, the filtered table is searched exactly."""
    ef = max(k, ef_search or config.ef_search)
    asked = items.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id int, vector array<double>")
    found = candidates(graphs, asked, k, ef, metric, config, centroids, nprobe).groupBy("id").agg(F.min("distance").alias("distance"))
    allowed = items.filter(where) if where is not None else items
    found = found.join(allowed.select(F.col(id_col).alias("id")), "id", "left_semi")
    if where is not None and found.limit(k).count() < k:
        return top_k(items, query, k, metric, where, id_col, vector_col)
    top = ranked(found, k)
    return top.select("rank", "id", "distance", score(metric, F.col("distance")).alias("score"))


def graph_stats(graphs: DataFrame) -> DataFrame:
    """(layer, nodes, links, avg_links) over all shards."""
    s = graphs.select(F.explode("stats").alias("s")).select("s.*").groupBy("layer").agg(F.sum("nodes").alias("nodes"), F.sum("links").alias("links"))
    return s.withColumn("avg_links", F.col("links") / F.col("nodes"))
