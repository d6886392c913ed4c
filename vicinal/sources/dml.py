"""Keyed changes as joins: probes, upserts, deletes, point reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicates(base: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """(key, n): keys of ``batch`` that ``base`` has already."""
    return batch.join(base.select(key), key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))


def newest(batch: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """The last row of each key by ``order``."""
    last = F.max_by(F.struct(*[F.col(c) for c in batch.columns if c != key]), F.col(order))
    return batch.groupBy(key).agg(last.alias("r")).select(key, "r.*")


def upsert(base: DataFrame, batch: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """``base`` with the rows of ``batch`` put in; the last of ``batch`` by ``order`` wins and takes the old row's stead."""
    last = newest(batch, key, order)
    return base.join(last.select(key), key, "left_anti").unionByName(last.select(*base.columns))


def delete(base: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def get_batch(base: DataFrame, requests: DataFrame, key: str = "id", pos: str = "pos") -> DataFrame:
    """A row for each request (pos, key), misses as nulls."""
    return requests.select(pos, key).join(base, key, "left")


def requests(spark, ids: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(i, str(x)) for i, x in enumerate(ids)], "pos bigint, id string")


def next_order(base: DataFrame, batch: DataFrame, start: int, by: Sequence[str] = ()) -> DataFrame:
    """``batch`` numbered from ``start`` in its own order."""
    order = list(by) or ["ord"]
    return batch.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)).cast("bigint") + start - 1)
