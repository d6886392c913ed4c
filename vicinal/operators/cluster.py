"""k-means and hierarchical clustering, and reports on clusters."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vicinal.functions.distance import distance, normalize
from vicinal.operators.blocks import grid
from vicinal.operators.knn import _distances, _matrix, usable
from vicinal.operators.lloyd import assign, pick, seed_plus_plus, step, summed
from vicinal.schema import parse_metric

#: Sample sizes of the report.
DIAMETER_SAMPLE, SILHOUETTE_SAMPLE, TOP_VALUES = 50, 500, 5
#: Members of one part of a cluster, about, whose distances to another part are one task's work.
PART_ROWS = 1024
FLAT = 1e-12
#: Lloyd rounds of a split, and the shift below which centroids stop.
ROUNDS, TOLERANCE = 15, 1e-4


@dataclass
class Clustering:
    """What a clustering returns: rows with their cluster, a row per cluster, and a summary."""

    assignments: DataFrame
    clusters: DataFrame
    summary: dict = field(default_factory=dict)
    centroids: list[list[float]] = field(default_factory=list)
    #: Those that the assignments were made by: of the round before the last update.
    assigned_by: list[list[float]] = field(default_factory=list)


def _sampled(rows: DataFrame, by: Sequence[str], n: int, id_col: str = "id") -> DataFrame:
    """n rows of each group in an order set by a hash of the id."""
    w = Window.partitionBy(*by).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col)
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def inertia(assigned: DataFrame) -> Column:
    return F.sum(F.col("d") * F.col("d"))


def describe(members: DataFrame, centroids: DataFrame, metric: str, sample: int | None = DIAMETER_SAMPLE, by: str = "cluster") -> DataFrame:
    """(by, size, medoid_id, dispersion, diameter, inertia, centroid). ``members``: id, vector, by. ``centroids``: by, centroid.

    The medoid is the member nearest to the centroid. The diameter is over ``sample`` members of each cluster (None: all).
    """
    d = members.join(centroids.select(by, "centroid"), by).withColumn("d", distance(metric, F.col("vector"), F.col("centroid")))
    one = d.groupBy(by).agg(F.count("*").alias("size"), F.min_by("id", F.struct("d", "id")).alias("medoid_id"), F.avg("d").alias("dispersion"), F.sum(F.col("d") * F.col("d")).alias("inertia"))
    wide = diameters(members, metric, sample, by)
    return centroids.select(by, "centroid").join(one, by, "left").join(wide, by, "left").select(by, F.coalesce("size", F.lit(0)).alias("size"), "medoid_id", F.coalesce("dispersion", F.lit(0.0)).alias("dispersion"), F.coalesce("diameter", F.lit(0.0)).alias("diameter"), F.coalesce("inertia", F.lit(0.0)).alias("inertia"), "centroid")


def diameters(members: DataFrame, metric: str, sample: int | None = DIAMETER_SAMPLE, by: str = "cluster") -> DataFrame:
    """(by, diameter): the largest distance between two members; 0 for a single one.

    Clusters are split into parts of about ``PART_ROWS`` members, part meets part in a task, and each meeting yields one number.
    """
    rows = members.filter(usable(F.col("vector"))).select(by, "id", F.col("vector").cast("array<double>").alias("vector"))
    rows = _sampled(rows, [by], sample) if sample else rows
    parts = rows.groupBy(by).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    cells = rows.join(parts, by).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select(by, F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "vector")
    kind = members.schema[by].dataType

    def widest(cell: pa.Table) -> pa.Table:
        part, vectors = cell["part"].to_numpy(), cell["vector"].combine_chunks()
        x = _matrix(vectors, len(vectors[0]))
        p, q = cell["p"][0].as_py(), cell["q"][0].as_py()
        one, two = x[part == p], x[part == q]
        far = max((float(_distances(metric, one[lo : lo + 256], two).max()) for lo in range(0, len(one), 256) if len(two)), default=0.0)
        return pa.table({by: cell[by].slice(0, 1), "diameter": pa.array([far])})

    far = cells.groupBy(by, "p", "q").applyInArrow(widest, T.StructType([T.StructField(by, kind), T.StructField("diameter", T.DoubleType())]))
    return far.groupBy(by).agg(F.max("diameter").alias("diameter"))


def silhouette(members: DataFrame, metric: str, sample: int | None = SILHOUETTE_SAMPLE, by: str = "cluster") -> DataFrame:
    """One row: silhouette_score over at most ``sample`` rows against all rows; 0 for at most one row or one cluster."""
    rows = members.filter(usable(F.col("vector"))).select("id", F.col("vector").cast("array<double>").alias("vector"), F.col(by).cast("bigint").alias("c"))
    some = _sampled(rows.withColumn("__all", F.lit(0)), ["__all"], sample).drop("__all") if sample else rows
    means = _mean_distances(some, rows, metric)
    ab = means.groupBy("i").agg(F.min(F.when(F.col("ci") == F.col("cj"), F.col("m"))).alias("a"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("m"))).alias("b"))
    top = F.greatest("a", "b")
    s = F.when(F.col("a").isNull() | F.col("b").isNull() | (top <= FLAT), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return ab.agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("silhouette_score"))


def _mean_distances(some: DataFrame, rows: DataFrame, metric: str) -> DataFrame:
    """(i, ci, cj, m): mean distance of each row of ``some`` to the members of each cluster but itself; blocks meet blocks and return sums."""
    a, b = grid(some, rows, "id", "id")
    kind = rows.schema["id"].dataType.simpleString()

    def run(asked: pa.Table, members: pa.Table) -> pa.Table:
        if not asked.num_rows or not members.num_rows:
            return pa.table({"i": asked["id"].slice(0, 0), "ci": pa.array([], pa.int64()), "cj": pa.array([], pa.int64()), "s": pa.array([], pa.float64()), "n": pa.array([], pa.float64())})
        ids, first = asked["id"].to_pylist(), asked["vector"].combine_chunks()
        q, own = _matrix(first, len(first[0])), asked["c"].to_numpy()
        x, place = _matrix(members["vector"].combine_chunks(), q.shape[1]), {v: n for n, v in enumerate(ids)}
        clusters, at = np.unique(members["c"].to_numpy(), return_inverse=True)
        member = np.eye(len(clusters))[at]
        count = np.repeat(member.sum(axis=0)[None], len(q), axis=0)
        total = np.empty_like(count)
        selves = [(place[v], n) for n, v in enumerate(members["id"].to_pylist()) if v in place]
        for lo in range(0, len(q), 256):
            d = _distances(metric, q[lo : lo + 256], x)
            for i, n in selves:
                if lo <= i < lo + len(d):
                    d[i - lo, n] = 0.0
            total[lo : lo + 256] = d @ member
        for i, n in selves:
            count[i, at[n]] -= 1
        k = len(clusters)
        return pa.table({"i": pa.array([v for v in ids for _ in range(k)], asked["id"].type), "ci": np.repeat(own, k), "cj": np.tile(clusters, len(q)), "s": total.reshape(-1), "n": count.reshape(-1)})

    sums = a.groupBy("qb", "ib").cogroup(b.groupBy("qb", "ib")).applyInArrow(run, f"i {kind}, ci bigint, cj bigint, s double, n double")
    return sums.groupBy("i", "ci", "cj").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).filter("n > 0").select("i", "ci", "cj", (F.col("s") / F.col("n")).alias("m"))


def top_metadata(values: DataFrame, keys: Sequence[str], n: int = TOP_VALUES, by: str = "cluster") -> DataFrame:
    """(by, key, value, count, rank): the n most frequent values of each key in each cluster; ties by value. ``keys`` are columns."""
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]))
    counts = values.select(by, entries.alias("e")).select(by, "e.*").filter("value IS NOT NULL").groupBy(by, "key", "value").agg(F.count("*").alias("count"))
    w = Window.partitionBy(by, "key").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)


def top_variant_metadata(rows: DataFrame, metadata: str = "metadata", n: int = TOP_VALUES, by: str = "cluster") -> DataFrame:
    """As ``top_metadata`` over every scalar key of a JSON column. Booleans read True and False, as Python writes them."""
    spark = rows.sparkSession
    rows.select(by, F.expr(f"try_parse_json(`{metadata}`)").alias("m")).createOrReplaceTempView("__vicinal_meta")
    kind = F.expr("schema_of_variant(value)")
    text = F.when(kind == "BOOLEAN", F.initcap(F.expr("variant_get(value, '$', 'string')"))).otherwise(F.expr("try_variant_get(value, '$', 'string')"))
    entries = spark.sql(f"SELECT {by}, e.key, e.value FROM __vicinal_meta, LATERAL variant_explode(m) AS e").filter(~kind.startswith("ARRAY") & ~kind.startswith("OBJECT") & (kind != "VOID"))
    counts = entries.select(by, "key", text.alias("value")).groupBy(by, "key", "value").agg(F.count("*").alias("count"))
    w = Window.partitionBy(by, "key").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)


def _centroid_frame(items: DataFrame, centroids: Sequence[Sequence[float]]) -> DataFrame:
    return items.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cluster int, centroid array<double>")


def kmeans(items: DataFrame, k: int = 3, metric: str = "cosine", max_iter: int = 50, tolerance: float = TOLERANCE, seed: int = 42, start: Sequence[Sequence[float]] | None = None, report: bool = True) -> Clustering:
    """Lloyd rounds from k-means++ seeds (or ``start``) until the largest shift, in the metric, is below ``tolerance``.

    Under cosine, centroids are unit vectors. An empty cluster is given a random item and does not count for the shift. Only
    centroids (k rows) come to the driver. Under the dot product the shift is negative, so one round is usual.
    """
    began, metric = time.time(), parse_metric(metric)
    items = items.select("id", F.col("vector").cast("array<double>").alias("vector"), *[c for c in items.columns if c not in ("id", "vector")])
    n = items.count()
    if not n:
        empty = assign(items, [[0.0]], metric).filter("false")
        return Clustering(empty, items.sparkSession.createDataFrame([], "cluster int, size bigint"), {"method": "kmeans", "k": k, "metric": metric, "silhouette_score": 0.0, "inertia": 0.0, "iterations": 0, "converged": True, "duration_ms": 0.0})
    k, rng = min(k, n), random.Random(seed)
    slim = items.select("id", "vector").persist()
    centroids = [list(map(float, c)) for c in start] if start is not None else seed_plus_plus(slim, k, metric, seed)
    iterations, converged = 0, False
    for _ in range(max_iter):
        iterations += 1
        got = {r["cluster"]: [float(x) for x in r["centroid"]] for r in step(slim, centroids, metric).collect()}
        shift = max((_shift(metric, centroids[c], v) for c, v in got.items()), default=0.0)
        last = [got[c] if c in got else pick(slim, "vector", rng.randrange(n), "id") for c in range(len(centroids))]
        centroids, before = last, centroids
        if shift < tolerance:
            converged = True
            break
    last = before if iterations else centroids
    assigned = assign(items, last, metric)
    frame = _centroid_frame(items, centroids)
    clusters = describe(assigned.select("id", "vector", "cluster"), frame, metric)
    summary = {"method": "kmeans", "k": k, "metric": metric, "iterations": iterations, "converged": converged}
    if report:
        summary["inertia"] = round(clusters.agg(F.sum("inertia")).first()[0] or 0.0, 4)
        summary["silhouette_score"] = round(silhouette(assigned, metric).first()[0], 4)
    summary["duration_ms"] = round((time.time() - began) * 1000, 2)
    slim.unpersist()
    return Clustering(assigned, clusters, summary, centroids, last)


def _shift(metric: str, a: Sequence[float], b: Sequence[float]) -> float:
    return float(_distances(metric, np.array([a], float), np.array([b], float))[0, 0])


def _descended(rows: DataFrame, tree: dict[str, list[list[float]]], metric: str) -> DataFrame:
    """``rows`` plus node: the path that each takes down a tree of centroids, in one pass whatever its depth."""
    schema = T.StructType([*rows.schema.fields, T.StructField("node", T.StringType())])
    at = rows.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            node, todo = np.full(len(batch), "", object), {""} & tree.keys()
            while todo:
                path = todo.pop()
                own, c = np.flatnonzero(node == path), np.array(tree[path], float)
                if len(own):
                    d = np.round(_distances(metric, _matrix(batch.column(at).take(pa.array(own)), c.shape[1]), c), 12)
                    node[own] = [f"{path}/{i}" for i in d.argmin(axis=1)]
                    todo |= set(node[own]) & tree.keys()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node.tolist(), pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


@dataclass
class _Node:
    """A node of one level while it is split: its centroids, those its rows were last assigned by, and how many rows each got."""

    path: str
    n: int
    centroids: list[list[float]]
    before: list[list[float]]
    sizes: dict[int, int]
    done: bool = False


def _placed(tree: dict[str, list[list[float]]], ends: dict[str, tuple[int, list[list[float]]]], metric: str) -> Callable[[np.ndarray], np.ndarray]:
    """Takes vectors down the tree to ``ends``: each gets its end's number plus that of its nearest centroid there, if there are any; -1 elsewhere."""
    tree = {path: np.array(c, float) for path, c in tree.items()}

    def near(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        return np.round(_distances(metric, vectors, centroids), 12).argmin(axis=1)

    def place(vectors: np.ndarray) -> np.ndarray:
        out, path, todo = np.full(len(vectors), -1, np.int64), np.full(len(vectors), "", object), {""}
        while todo:
            at = todo.pop()
            own = np.flatnonzero(path == at)
            if at in tree:
                path[own] = [f"{at}/{i}" for i in near(vectors[own], tree[at])]
                todo |= set(path[own])
            elif at in ends:
                number, centroids = ends[at]
                out[own] = number + (near(vectors[own], np.array(centroids, float)) if centroids else 0)
        return out

    return place


def _drawn(rows: DataFrame, tree: dict[str, list[list[float]]], nodes: Sequence[_Node], metric: str, seed: int, draw: int) -> dict[str, list[float]]:
    """For each node the vector that wins a draw: at random while it has no centroid, else by squared distance to its nearest one.

    The draw is the race of ``seed_plus_plus``, run for all nodes in one pass; each task gives its best row a node.
    """
    chosen = {x.path: np.array(x.centroids, float) for x in nodes}
    schema = T.StructType([T.StructField("node", T.StringType()), T.StructField("key", T.DoubleType()), rows.schema["id"], T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple] = {}
        for batch in batches:
            ids, path = batch.column(0).to_pylist(), np.array(batch.column(3).to_pylist(), object)
            vectors, u = _matrix(batch.column(1), dimension), (np.array(batch.column(2)) % (1 << 52) + 1) / float(1 << 52)
            for node in set(path) & chosen.keys():
                own = np.flatnonzero(path == node)
                w = np.ones(len(own))
                if len(chosen[node]):
                    w = np.round(_distances(metric, vectors[own], chosen[node]), 12).min(axis=1) ** 2
                with np.errstate(divide="ignore"):
                    key = np.where(w > 1e-12, -np.log(u[own]) / w, np.inf)  # copies of what is chosen come last
                for i in np.flatnonzero(key == key.min()).tolist():
                    row = (float(key[i]), ids[own[i]], vectors[own[i]].tolist())
                    if node not in best or row[:2] < best[node][:2]:
                        best[node] = row
        yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), *[pa.array([best[n][j] for n in best], t) for j, t in enumerate((pa.float64(), arrow_id, pa.list_(pa.float64())))]], names=schema.names)

    dimension = len(rows.select("vector").first()[0])
    arrow_id = to_arrow_type(rows.schema["id"].dataType)
    hashed = rows.select("id", "vector", F.pmod(F.xxhash64(F.lit(seed), F.lit(draw), F.col("id").cast("string")), F.lit(1 << 52)).alias("u"))
    found = _descended(hashed, tree, metric).mapInArrow(run, schema)
    return {r["node"]: list(r["vector"]) for r in found.groupBy("node").agg(F.min_by("vector", F.struct("key", "id")).alias("vector")).collect()}


def hierarchical(items: DataFrame, branch_factor: int = 2, max_depth: int = 3, min_leaf_size: int = 4, metric: str = "cosine", seed: int = 42, report: bool = True, starts: Callable[[DataFrame], DataFrame] | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Clustering:
    """Splits by k-means (``rounds``, seed + 31 * depth), a level at a time; a node of ``min_leaf_size`` rows or fewer, or one that does not split, is a leaf.

    Splits are kept as a tree of centroids (at most branch_factor ** max_depth nodes), down which rows find their node. All nodes of
    a level are seeded and moved together, so passes over the table grow with depth times rounds, not with nodes: one for the sizes,
    one a seed, one a Lloyd round, in which a task gives one row a centroid. A node stops when its centroids do, and is kept out of
    further rounds; an empty cluster gets a row of its node by draw. ``starts`` gives the first centroids instead of the draws: a
    function of the rows with their node to (node, place, vector).
    """
    began, metric = time.time(), parse_metric(metric)
    rows = items.select("id", F.col("vector").cast("array<double>").alias("vector"), *[c for c in items.columns if c not in ("id", "vector")]).filter(usable(F.col("vector")))
    slim = rows.select("id", "vector").persist()
    leaves: list[str] = []
    tree: dict[str, list[list[float]]] = {}
    level, n = [""], slim.count()
    sizes = {"": n} if n else {}
    for depth in range(max_depth + 1):
        nodes = [_Node(path, sizes[path], [], [], {}) for path in level if sizes.get(path)]
        leaves += [x.path for x in nodes if depth >= max_depth or x.n <= min_leaf_size]
        nodes = [x for x in nodes if depth < max_depth and x.n > min_leaf_size]
        if not nodes:
            break
        _split_level(slim, tree, nodes, branch_factor, metric, seed + 31 * depth, starts, rounds, tolerance)
        leaves += [x.path for x in nodes if len(x.sizes) < 2]
        for x in nodes:
            if len(x.sizes) >= 2:
                tree[x.path] = x.before
        level = [f"{x.path}/{c}" for x in nodes if len(x.sizes) >= 2 for c in sorted(x.sizes)]
        sizes = {f"{x.path}/{c}": m for x in nodes for c, m in x.sizes.items()}
    slim.unpersist()
    if not leaves:
        return kmeans(rows, branch_factor, metric)
    leaves.sort(key=lambda path: [int(x) for x in path.split("/")[1:]])
    number = F.create_map(*[x for i, leaf in enumerate(leaves) for x in (F.lit(leaf), F.lit(i))])
    assigned = _descended(rows, tree, metric).withColumn("cluster", number[F.col("node")]).drop("node")
    ends = {path: (i, []) for i, path in enumerate(leaves)}
    means = summed(rows, _placed(tree, ends, metric), len(rows.select("vector").first()[0]))
    mean = F.transform("total", lambda x: x / F.col("n"))
    centroids = means.select(F.col("place").cast("int").alias("cluster"), (normalize(mean) if metric == "cosine" else mean).alias("centroid"))
    clusters = describe(assigned.select("id", "vector", "cluster"), centroids, metric, sample=None)
    summary = {"method": "hierarchical", "k": len(leaves), "metric": metric, "iterations": max_depth, "converged": True}
    if report:
        summary["inertia"] = round(clusters.agg(F.sum("inertia")).first()[0] or 0.0, 4)
        summary["silhouette_score"] = round(silhouette(assigned, metric).first()[0], 4)
    summary["duration_ms"] = round((time.time() - began) * 1000, 2)
    return Clustering(assigned, clusters, summary)


def _split_level(rows: DataFrame, tree: dict[str, list[list[float]]], nodes: list[_Node], k: int, metric: str, seed: int, starts: Callable[[DataFrame], DataFrame] | None, rounds: int, tolerance: float) -> None:
    """Seeds and Lloyd rounds of all ``nodes`` at once; leaves before and sizes in them."""
    if starts is None:
        for draw in range(k):
            won = _drawn(rows, tree, [x for x in nodes if len(x.centroids) < min(k, x.n)], metric, seed, draw)
            for x in nodes:
                x.centroids += [won[x.path]] if x.path in won else []
    else:
        for r in starts(_descended(rows, tree, metric)).orderBy("node", "place").collect():  # k rows a node
            for x in nodes:
                if x.path == r["node"]:
                    x.centroids.append([float(v) for v in r["vector"]])
    dimension = len(nodes[0].centroids[0])
    for turn in range(rounds):
        moving = [x for x in nodes if not x.done]
        if not moving:
            return
        for x in moving:
            x.before, x.sizes = x.centroids, {}
        got: dict[str, dict[int, list[float]]] = {x.path: {} for x in moving}
        ends = {x.path: (i * k, x.centroids) for i, x in enumerate(moving)}
        for r in summed(rows, _placed(tree, ends, metric), dimension).collect():  # k rows a node
            x, c = moving[r["place"] // k], r["place"] % k
            mean = np.array(r["total"]) / r["n"]
            length = np.linalg.norm(mean)
            got[x.path][c] = (mean / length if metric == "cosine" and length > 0 else mean * (metric != "cosine")).tolist()
            x.sizes[c] = r["n"]
        lost = [x for x in moving if len(got[x.path]) < len(x.centroids)]
        spare = _drawn(rows, tree, [_Node(x.path, x.n, [], [], {}) for x in lost], metric, seed, k + turn) if lost else {}
        for x in moving:
            own = got[x.path]
            shift = max((_shift(metric, x.centroids[c], v) for c, v in own.items()), default=0.0)
            x.centroids = [own[c] if c in own else spare[x.path] for c in range(len(x.centroids))]
            x.done = shift < tolerance


def cluster(items: DataFrame, k: int = 3, method: str = "kmeans", where: Column | None = None, metric: str = "cosine", max_iter: int = 50, seed: int = 42) -> Clustering:
    """``hierarchical`` splits max(2, k) ways to depth 3; every other method name is k-means."""
    rows = items.filter(where) if where is not None else items
    return hierarchical(rows, max(2, k), 3, 4, metric, seed) if method == "hierarchical" else kmeans(rows, k, metric, max_iter, seed=seed)
