"""Embedding near-dedup with randomised-rotation binary codes.

Vectors of one value are one class. Each class is turned by random rotations; the signs of the first ``ROTATIONS`` are its binary
code, stored with its correction factors. Runs of sign bits, ``width`` a table, name the buckets in which classes meet: ``width``
follows the logarithm of the number of classes and the number of tables follows from ``width``, so that a pair at the threshold
is met with a chance of ``recall``. Only codes go to the buckets. There they give an unbiased estimate of each pair's cosine and
a confidence bound; where a pair's bound reaches the threshold, both vectors come to the bucket as well, and what came is
recomputed exactly, in double precision.

No pair is emitted. Buckets are split into blocks of ``BLOCK`` classes at most, block meets block, and each meeting yields one
count per class and one spanning forest of its links. A pair that meets in several tables counts in the first only.

Vectors that are null, zero, or hold null or non-finite components link with nothing and are their own component; vectors of
different lengths do not meet. A null vec_id takes part as any row, but never names a component that has another id. Repeated
rows are rows of their own: each counts the other. Vectors may be of any length; a cosine of just the threshold links. An empty
table gives no rows. Extra columns are ignored by the query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.llm.common import discard, durable, join_few, join_hot, written
from vicinal.llm.components import components
from vicinal.llm.rabitq import Told, encode, estimate, pack, rotation, unpack

THRESHOLD = 0.95
RECALL = 0.98
#: Rotations of a code, and standard deviations of the confidence bound.
ROTATIONS, EPS = 3, 4.0
BLOCK = 1024
SEED = 7


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits a bucket, tables) for n classes."""
    agree = 1 - math.acos(threshold) / math.pi  # that one sign bit of a pair at the threshold agrees
    width = min(40, max(6, round(math.log2(max(n, 2))) - 3))
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**width)))


def classes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", salt: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, v, cid; one row per value: cid, cid2, v, n). ``v`` is null for vectors that link with nothing; cid is a salted hash of the value."""
    single = isinstance(vectors.schema[embedding].dataType.elementType, T.FloatType)  # kept as it is: half the size
    v = F.transform(F.col(embedding), lambda x: x.cast("float" if single else "double"))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.when(fine, F.transform(v, lambda x: x + F.lit(0).cast("float"))).alias("v"))
    rows = rows.withColumn("cid", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(salt), "v")))
    rows = rows.withColumn("cid2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(~salt), "v")))
    return rows, rows.filter("v IS NOT NULL").groupBy("cid", "cid2").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least"))


@lru_cache(maxsize=8)
def _turns(dim: int, bits: int) -> np.ndarray:
    """Rotations, (rotations, dim, dim): a code's, and as many as ``bits`` sign bits need."""
    return np.stack([rotation(dim, SEED + i) for i in range(max(ROTATIONS, -(-bits // dim)))])


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit rows in double precision; scaled first, so that very large or small numbers do no harm."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all elements, where each row's begin, how many each row has) of a column of lists without nulls."""
    lengths = np.asarray(column.value_lengths())
    return column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths, lengths


def _keys(turned: np.ndarray, width: int, tables: int) -> np.ndarray:
    """(n, tables) buckets of turned vectors (n, rotations, dim), the table's number above their bits."""
    on = turned.reshape(len(turned), -1)[:, : width * tables] >= 0
    bucket = (on.reshape(-1, tables, width) * (1 << np.arange(width, dtype=np.int64))).sum(axis=2)
    return bucket | np.arange(tables, dtype=np.int64) << 48


def coded(values: DataFrame, width: int, tables: int) -> DataFrame:
    """One row per class: cid, dim, keys (its buckets) and code."""
    schema = T.StructType([T.StructField("cid", T.LongType()), T.StructField("dim", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("code", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid = batch.column(0).to_numpy()
            flat, begin, lengths = _lists(batch.column(1))
            for dim in np.unique(lengths).tolist():
                turns = _turns(dim, width * tables)
                every = np.flatnonzero(lengths == dim)
                for at in range(0, len(every), 512):
                    own = every[at : at + 512]
                    turned = np.einsum("rde,ne->nrd", turns, _unit(flat[begin[own][:, None] + np.arange(dim)]), optimize=True)
                    keys = pa.array(list(_keys(turned, width, tables)), pa.list_(pa.int64()))
                    code = pa.array(pack(encode(turned[:, :ROTATIONS])), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(cid[own]), pa.array(np.full(len(own), dim, np.int32)), keys, code], names=schema.names)

    return values.select("cid", "v").mapInArrow(run, schema)


def _forest(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of links that connect what all of x[i] - y[i] connect."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = parent[p]
            v = parent[v]
        return v

    kept = []
    for k, (p, q) in enumerate(zip(x.tolist(), y.tolist())):
        rp, rq = root(p), root(q)
        if rp != rq:
            parent[rp] = rq
            kept.append(k)
    return kept


#: A cell: parts p and q of a bucket.
_CELL = ["key", "dim", "p", "q"]


def _by_cells(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table, list[tuple[int, int]]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What ``work`` makes of runs of whole cells, given where those of two rows or more begin and end; rows come sorted by cell."""
    rest: pa.Table | None = None
    for batch in _with_end(batches):
        table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if table is None or not table.num_rows:
            continue
        table = table.combine_chunks()
        ids = np.stack([table[c].to_numpy().astype(np.int64) for c in _CELL])
        starts = np.flatnonzero(np.concatenate(([True], (ids[:, 1:] != ids[:, :-1]).any(axis=0))))
        ends = [*starts[1:].tolist(), table.num_rows]
        last = len(starts) if batch is None else len(starts) - 1  # the last cell may go on in the next batch
        cells = [(s, e) for s, e in zip(starts[:last].tolist(), ends) if e - s > 1]
        rest = table.slice(int(starts[-1])) if batch is not None else None
        if cells:
            yield from work(table, cells)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a cell's two sides: those of part p and of part q, or all twice."""
    p, q, part = table["p"][0].as_py(), table["q"][0].as_py(), table["part"].to_numpy()
    every = np.arange(table.num_rows)
    return (every, every) if p == q else (np.flatnonzero(part == p), np.flatnonzero(part == q))


def _maybe(table: pa.Table, cells: list[tuple[int, int]], bits: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows that some other's bound lets reach the threshold in their cell, by their codes."""
    some = np.zeros(table.num_rows, bool)
    dims, p, q, part = (table[c].to_numpy() for c in ("dim", "p", "q", "part"))
    for dim in np.unique(dims).tolist():
        own = np.flatnonzero(dims == dim)
        place = np.cumsum(dims == dim) - 1
        codes = unpack(table["code"].take(pa.array(own)).to_pylist(), dim, ROTATIONS)
        told = Told(codes, _turns(dim, bits)[:ROTATIONS], threshold)
        for s, e in cells:
            if dims[s] != dim:
                continue
            every = np.arange(s, e)
            same = p[s] == q[s]
            one, two = (every, every) if same else (every[part[s:e] == p[s]], every[part[s:e] == q[s]])
            right = told.take(place[two])
            for at in range(0, len(one), 256):
                rows = one[at : at + 256]
                guess, bound = estimate(told.take(place[rows]), right, EPS)
                near = guess >= threshold - bound
                if same:
                    near &= two[None, :] > rows[:, None]
                some[rows[near.any(axis=1)]] = True
                some[two[near.any(axis=0)]] = True
    if some.any():
        yield from table.select([*_CELL, "part", "cid"]).filter(pa.array(some)).combine_chunks().to_batches()


_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "n")])


def _linked(table: pa.Table, width: int, tables: int, threshold: float) -> pa.RecordBatch | None:
    """The links of a cell's vectors, each recomputed, that meet here first: rows of ``link_rows``."""
    dim, t = table["dim"][0].as_py(), table["key"][0].as_py() >> 48
    flat, begin, _ = _lists(table["v"].combine_chunks())
    u = _unit(flat[begin[:, None] + np.arange(dim)])
    keys = _keys(np.einsum("rde,ne->nrd", _turns(dim, width * tables), u, optimize=True), width, tables)
    cid, weight = table["cid"].to_numpy(), table["n"].to_numpy()
    one, two = _sides(table)
    same = len(one) == len(two) == table.num_rows
    xs, ys = [], []
    for at in range(0, len(one), 256):
        rows = one[at : at + 256]
        near = u[rows] @ u[two].T >= threshold - 1e-9
        if same:
            near &= two[None, :] > rows[:, None]
        i, j = np.nonzero(near)
        for lo in range(0, len(i), 1 << 15):
            x, y = rows[i[lo : lo + (1 << 15)]], two[j[lo : lo + (1 << 15)]]
            good = np.einsum("ij,ij->i", u[x], u[y]) >= threshold
            good &= ~(keys[x, :t] == keys[y, :t]).any(axis=1)
            xs.append(x[good])
            ys.append(y[good])
    x, y = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (xs, ys))
    if not len(x):
        return None
    gain = np.bincount(x, weight[y], len(u)) + np.bincount(y, weight[x], len(u))
    some = np.flatnonzero(gain)
    tree = _forest(cid[x], cid[y])
    a = np.concatenate((cid[some], cid[x[tree]]))
    b = pa.array([*[None] * len(some), *cid[y[tree]].tolist()], pa.int64())
    n = np.concatenate((gain[some].astype(np.int64), np.zeros(len(tree), np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], names=_FOUND.names)


def link_rows(values: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Two kinds of rows over class ids: (a, null, n) adds n linked rows to class a; (a, b, 0) is a link of a spanning forest.

    Cells come sorted through the tasks and are worked off one after another, so that small buckets cost no more than their pairs.
    """
    width, tables = plan_tables(values.count(), threshold, recall)
    codes = written(coded(values, width, tables))
    rows = codes.select(F.explode("keys").alias("key"), "dim", "cid", "code")
    hot = rows.groupBy("key", "dim").count().filter(F.col("count") > block).select("key", "dim", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    # a class of part x of a bucket of k parts goes to the cells (x, 0..k-1), on one side or the other
    cells = join_few(rows, hot, ["key", "dim"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cells = cells.withColumn("part", F.pmod(F.xxhash64("cid", "key"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.select("key", "dim", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "cid", "code")
    bits = width * tables
    near = cells.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(lambda batches: _by_cells(batches, lambda table, at: _maybe(table, at, bits, threshold)), cells.drop("code").schema)
    near = written(near)
    discard(codes)
    met = near.join(values.select("cid", "v", "n").hint("merge"), "cid").select(*_CELL, "part", "cid", "v", "n")
    met = met.repartition(*_CELL).sortWithinPartitions(*_CELL)

    def linked(table: pa.Table, at: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        made = [_linked(table.slice(s, e - s), width, tables, threshold) for s, e in at]
        if made := [m for m in made if m is not None]:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return met.mapInArrow(lambda batches: _by_cells(batches, linked), _FOUND)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    for salt in range(8):  # another one in the rare case that two values share a hash
        rows, values = classes(vectors, salt=salt)
        rows, values = durable(rows.drop("v")), written(values)
        if values.groupBy("cid").count().filter("count > 1").isEmpty():
            break
        discard(values)
    else:
        raise RuntimeError("values share hashes under every salt")
    found = durable(link_rows(values, threshold, recall, block))
    gains = found.filter("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("gain"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b"))
    named = durable(values.select("cid", "n", "least").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("c"))
    result = join_hot(named, least, "root", "c").join(gains, "cid", "left").select("cid", "n", (F.col("n") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"), "component_id")
    none = rows.filter("cid IS NULL").select("vec_id", "cid", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    out = join_hot(rows.filter("cid IS NOT NULL").select("vec_id", "cid"), durable(result), "cid", "n").select("vec_id", "cid", "n_links", "component_id").unionAll(none).select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("bigint").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, [x::DOUBLE for x in embedding] AS e FROM embeddings
), good AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_inner_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT vec_id, vec_id AS other FROM v
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN least c USING (vec_id)
"""
