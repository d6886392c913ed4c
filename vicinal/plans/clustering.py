"""Registered queries over clusters; the labels of the embeddings serve as given clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vicinal.functions.distance import centroid
from vicinal.operators import cluster as C
from vicinal.operators.lloyd import assign, step
from vicinal.plans.dense import _assign_sql, _update_sql
from vicinal.plans.registry import query
from vicinal.plans.views import ITEMS, distance, dot, first_vectors, items, joined, joined_sql, rounded, table

_MEANS = "means AS (SELECT label, list(x ORDER BY i) AS v FROM (SELECT label, i, avg(vector[i]) AS x FROM items, range(1, 65) r(i) GROUP BY label, i) GROUP BY label)"
_TO_MEAN = f"far AS (SELECT items.id, items.label, round({distance('euclidean', 'items.vector', 'means.v')}, 9) AS d FROM items JOIN means USING (label))"
STARTS, ROUNDS = 5, 3


def _to_mean(spark, sf_dir):
    from vicinal.functions.distance import distance as dist

    rows = items(spark, sf_dir)
    means = centroid(rows, "vector", ["label"])
    return rows.join(means, "label").select("id", "label", F.round(dist("euclidean", F.col("vector"), F.col("centroid")), 9).alias("d"))


@query("centroid_by_label", f"WITH {ITEMS}, {_MEANS} SELECT label, {joined_sql('v')} AS centroid FROM means")
def centroid_by_label(spark, sf_dir):
    return centroid(items(spark, sf_dir), "vector", ["label"]).select("label", joined(F.col("centroid")).alias("centroid"))


@query("cluster_inertia", f"WITH {ITEMS}, {_MEANS}, {_TO_MEAN} SELECT label, round(sum(d * d), 4) AS inertia FROM far GROUP BY label")
def cluster_inertia(spark, sf_dir):
    return rounded(_to_mean(spark, sf_dir).groupBy("label").agg(F.sum(F.col("d") * F.col("d")).alias("inertia")), "inertia", digits=4)


@query("cluster_medoid", f"WITH {ITEMS}, {_MEANS}, {_TO_MEAN}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, id) AS n FROM far) SELECT label, id AS medoid_id FROM n WHERE n = 1")
def cluster_medoid(spark, sf_dir):
    return _to_mean(spark, sf_dir).groupBy("label").agg(F.min_by("id", F.struct("d", "id")).alias("medoid_id"))


@query("cluster_dispersion", f"WITH {ITEMS}, {_MEANS}, {_TO_MEAN} SELECT label, count(*)::BIGINT AS size, round(avg(d), 6) AS dispersion FROM far GROUP BY label")
def cluster_dispersion(spark, sf_dir):
    return rounded(_to_mean(spark, sf_dir).groupBy("label").agg(F.count("*").alias("size"), F.avg("d").alias("dispersion")), "dispersion")


@query("cluster_diameter", f"WITH {ITEMS} SELECT a.label, round(max({distance('cosine', 'a.vector', 'b.vector')}), 6) AS diameter FROM items a JOIN items b ON a.label = b.label AND a.id < b.id GROUP BY a.label")
def cluster_diameter(spark, sf_dir):
    """Over all pairs, as the hierarchical report has it."""
    return rounded(C.diameters(items(spark, sf_dir), "cosine", None, "label"), "diameter")


@query("cluster_top_metadata", "WITH m AS (SELECT e.label, d.lang, d.source FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id), v AS (SELECT label, 'lang' AS key, lang AS value FROM m UNION ALL SELECT label, 'source', source FROM m), c AS (SELECT label, key, value, count(*)::BIGINT AS count FROM v WHERE value IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label, key ORDER BY count DESC, value)::BIGINT AS rank FROM c) SELECT * FROM r WHERE rank <= 5")
def cluster_top_metadata(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", "label").join(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), "id")
    return C.top_metadata(rows, ["lang", "source"], by="label")


@query("silhouette", f"""WITH {ITEMS}, m AS (SELECT a.id, a.label AS own, b.label AS other, avg({distance('cosine', 'a.vector', 'b.vector')}) AS d FROM items a JOIN items b ON a.id <> b.id GROUP BY ALL),
ab AS (SELECT id, min(CASE WHEN own = other THEN d END) AS a, min(CASE WHEN own <> other THEN d END) AS b FROM m GROUP BY id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) <= 1e-12 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_score FROM ab""")
def silhouette(spark, sf_dir):
    """Exact, over all rows; the report's default is a sample of 500."""
    return rounded(C.silhouette(items(spark, sf_dir), "cosine", None, "label"), "silhouette_score")


_STARTS = f"c0 AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS c, vector AS cv FROM (SELECT * FROM items ORDER BY id LIMIT {STARTS}))"


@query("kmeans_assign", f"WITH {ITEMS}, {_STARTS}, {_assign_sql('a0', 'c0', 'euclidean')} SELECT id, c AS cluster, round(d, 6) AS distance FROM a0")
def kmeans_assign(spark, sf_dir):
    rows = assign(items(spark, sf_dir), first_vectors(spark, sf_dir, STARTS), "euclidean")
    return rounded(rows.select("id", "cluster", F.col("cluster_distance").alias("distance")), "distance")


@query("kmeans_update", f"WITH {ITEMS}, {_STARTS}, {_assign_sql('a0', 'c0')}, {_update_sql('c1', 'a0', 'c0', True)} SELECT c AS cluster, {joined_sql('cv')} AS centroid FROM c1")
def kmeans_update(spark, sf_dir):
    """Under cosine the new centroids are unit vectors."""
    return step(items(spark, sf_dir), first_vectors(spark, sf_dir, STARTS), "cosine").select("cluster", joined(F.col("centroid")).alias("centroid"))


_ROUNDS = ", ".join(f"{_assign_sql(f'a{i}', f'c{i}')}, {_update_sql(f'c{i + 1}', f'a{i}', f'c{i}', True)}" for i in range(ROUNDS))


@query("kmeans_fixed_init", f"WITH {ITEMS}, {_STARTS}, {_ROUNDS} SELECT id, c AS cluster FROM a{ROUNDS - 1}")
def kmeans_fixed_init(spark, sf_dir):
    found = C.kmeans(items(spark, sf_dir).select("id", "vector"), STARTS, "cosine", ROUNDS, 0.0, start=first_vectors(spark, sf_dir, STARTS), report=False)
    return found.assignments.select("id", "cluster")


@query("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    """The seeded path: a row per cluster with its report."""
    found = C.kmeans(items(spark, sf_dir).select("id", "vector"), 10, "cosine", report=False)
    return rounded(found.clusters.drop("centroid"), "dispersion", "diameter", "inertia", digits=4)


@query("hierarchical_rows")
def hierarchical_rows(spark, sf_dir):
    """Leaves of the hierarchical clustering and how many rows each has."""
    found = C.hierarchical(items(spark, sf_dir).select("id", "vector"), 2, 2, report=False)
    return found.assignments.groupBy("cluster").agg(F.count("*").alias("n"))


def _of_node(n: int) -> str:
    """One more round within the nodes: rows to their node's centroids, and these to the means."""
    nearer = f"round({distance('cosine', 'i.vector', 'k.cv')}, 12)"
    assigned = f"e{n} AS (SELECT id, vector, node, c FROM (SELECT i.id, i.vector, i.node, k.c, row_number() OVER (PARTITION BY i.id ORDER BY {nearer}, k.c) AS n FROM n1 i JOIN s{n} k USING (node)) WHERE n = 1)"
    mean = f"(SELECT node, c, list(x ORDER BY i) AS v FROM (SELECT node, c, i, avg(vector[i]) AS x FROM e{n}, range(1, 65) r(i) GROUP BY node, c, i) GROUP BY node, c)"
    return f"{assigned}, s{n + 1} AS (SELECT b.node, b.c, coalesce([x / sqrt({dot('m.v', 'm.v')}) for x in m.v], b.cv) AS cv FROM s{n} b LEFT JOIN {mean} m USING (node, c))"


_HALVES = "c0 AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INT AS c, vector AS cv FROM (SELECT * FROM items ORDER BY id LIMIT 2))"
_FIRST = ", ".join(f"{_assign_sql(f'a{i}', f'c{i}')}, {_update_sql(f'c{i + 1}', f'a{i}', f'c{i}', True)}" for i in range(2))
_SECOND = "n1 AS (SELECT id, vector, c AS node FROM a1), s0 AS (SELECT node, (n - 1)::INT AS c, vector AS cv FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY id) AS n FROM n1) WHERE n <= 2)"


@query("hierarchical_fixed_init", f"WITH {ITEMS}, {_HALVES}, {_FIRST}, {_SECOND}, {_of_node(0)}, {_of_node(1)} SELECT id, (dense_rank() OVER (ORDER BY node, c) - 1)::INT AS cluster FROM e1")
def hierarchical_fixed_init(spark, sf_dir):
    """Two levels of two rounds each, every node from its first two rows; all nodes of a level move in the same passes."""

    def starts(rows):
        place = F.row_number().over(Window.partitionBy("node").orderBy("id")) - 1
        return rows.withColumn("place", place).filter("place < 2").select("node", "place", "vector")

    found = C.hierarchical(items(spark, sf_dir).select("id", "vector"), 2, 2, report=False, starts=starts, rounds=2, tolerance=0.0)
    return found.assignments.select("id", "cluster")
