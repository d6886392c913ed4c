"""Connected components of a distributed edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import durable

#: Edges a task: rounds over few edges take few tasks, whatever the session's number of shuffle partitions.
TASK_EDGES = 20_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return tuple(row)


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node's larger neighbours are hung under the smallest of its neighbourhood."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node and its smaller neighbours are hung under the smallest of them. Edges have a < b."""
    down = edges.select(F.col("b").alias("n"), F.col("a").alias("s"))
    least = down.groupBy("n").agg(F.min("s").alias("m"))
    moved = down.join(least, "n").filter("s <> m").select(F.col("m").alias("a"), F.col("s").alias("b"))
    tops = least.select(F.col("m").alias("a"), F.col("n").alias("b"))
    return moved.coalesce(tasks).unionAll(tops.coalesce(tasks)).distinct().coalesce(tasks)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component.

    ``edges`` has columns a and b of one orderable type, any direction, repeats and loops allowed; rows with a null end are
    ignored; no edges give no rows. Every half round is written to the shared checkpoint folder. A round joins edges with one
    aggregated row per node, so hot nodes are split by skew-join handling and no group is ever gathered.
    """
    edges = durable(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        if not state[0]:
            break
        tasks = 1 + state[0] // TASK_EDGES
        hung = durable(_large_star(edges.coalesce(tasks), tasks))  # read twice
        edges = durable(_small_star(hung, tasks))
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("a").alias("node")).distinct().coalesce(1 + state[0] // TASK_EDGES).select("node", F.col("node").alias("root"))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(roots)
