"""Blocks meeting blocks: every row of one table against every row of another, in cells of bounded size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of queries and of a block of items, on average, at most.
QUERY_ROWS, ITEM_ROWS = 2048, 16_384
#: Rows below which items are not cut into more blocks for the sake of parallel work.
LEAST_ROWS = 512


def block_counts(n_queries: int, n_items: int, tasks: int, query_rows: int = QUERY_ROWS, item_rows: int = ITEM_ROWS) -> tuple[int, int]:
    """Into how many blocks queries and items are cut."""
    return max(1, math.ceil(n_queries / query_rows)), max(1, math.ceil(n_items / item_rows), min(tasks, n_items // LEAST_ROWS))


def grid(queries: DataFrame, items: DataFrame, query_id: str, item_id: str, query_rows: int = QUERY_ROWS, item_rows: int = ITEM_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both tables with their cells (qb, ib): each query once for every block of items, each item once for every block of queries.

    Rows fall into blocks by a hash of their id, so a cell holds about ``query_rows`` times ``item_rows`` pairs at every size, and
    no table is sent to a task or to the driver as a whole.
    """
    tasks = items.sparkSession.sparkContext.defaultParallelism
    q_blocks, i_blocks = block_counts(queries.count(), items.count(), tasks, query_rows, item_rows)
    own = lambda c, n: F.pmod(F.xxhash64(F.lit(n), F.col(c)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return (
        queries.withColumn("qb", own(query_id, q_blocks)).withColumn("ib", every(i_blocks)),
        items.withColumn("ib", own(item_id, i_blocks)).withColumn("qb", every(q_blocks)),
    )
