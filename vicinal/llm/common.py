"""Shared pieces of the training-data operators: durable tables, tables of a data folder, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts are cut into blocks of about so many bytes before vectorised work, whatever Arrow's batch size.
BLOCK_BYTES = 4 << 20
#: Bytes of an Arrow batch, at most, in sessions that do not set their own limit.
BATCH_BYTES = 8 << 20

#: Rows of a slice of an Arrow batch, at most, where texts are worked on.
ARROW_ROWS = 2000
#: Rows of a side that is sent to all tasks, at most, and the salts of the join that serves beyond it.
SENT_ROWS, SALTS = 50_000, 64
#: A key with over one row in so many is hot.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only in local mode, where it is unset."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="vicinal-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def map_slices(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches cut to ``ARROW_ROWS`` rows and ``BLOCK_BYTES`` bytes, but for single longer rows.

    Spark's maxBytesPerBatch bounds what it sends at once, and the slices what a worker makes of it. Where that setting has the
    value Spark comes with, it is lowered to ``BATCH_BYTES``: an executor holds each batch twice, in the JVM and in the worker.
    """
    bound_batches(df.sparkSession)
    return df.mapInArrow(lambda batches: run(slices(batches)), schema)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` at most, unless the session has its own limit."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf
    if conf.get(name) in ("67108864b", "67108864", "64MB"):
        conf.set(name, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches halved until they are small enough, in order."""
    for batch in batches:
        todo = [batch]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and (part.num_rows > ARROW_ROWS or part.nbytes > BLOCK_BYTES):
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def join_few(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of one row per key (a source, a language) that is small as a rule.

    ``few`` is counted: up to ``SENT_ROWS`` rows it is sent to all tasks and ``rows`` stay where they are. Beyond that both sides
    are shuffled by key and salt, so that a key with a third of all rows is spread over ``SALTS`` tasks.
    """
    few = durable(few)
    if few.count() <= SENT_ROWS:
        return rows.join(F.broadcast(few), keys, how)
    salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(SALTS)).cast("int")  # of the row itself: a task run again deals alike
    return rows.withColumn("__salt", salt).join(salted, [*keys, "__salt"], how).drop("__salt")


def join_hot(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and in ``n`` how many of ``rows`` have it; both are shuffled by key.

    Keys with over one row in ``HOT_SHARE`` - there are fewer than ``HOT_SHARE`` of them at every size, so they are sent to all
    tasks - are dealt over ``SALTS`` tasks.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(durable(table.filter(F.col(n) * HOT_SHARE > total).select(key, F.lit(SALTS).alias("__n"))))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.coalesce("__n", F.lit(1))).cast("int")
    dealt = rows.join(hot, key, "left").withColumn("__salt", salt).drop("__n")
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("__n", F.lit(1)) - 1))
    each = table.drop(n).join(hot, key, "left").withColumn("__salt", salts).drop("__n")
    return dealt.join(each.hint("merge"), [key, "__salt"]).drop("__salt")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder: lineage ends here and lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``durable``, in columns: for tables that are read again in part. Removed when the session's JVM ends."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._vicinal_path = path
    return again


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def discard(df: DataFrame) -> None:
    """Remove a ``written`` table that nothing reads any more."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df._vicinal_path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def binary_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string Arrow column without copying; nulls have length 0 unless their slot holds bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, off


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes; one longer text is a block of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end
