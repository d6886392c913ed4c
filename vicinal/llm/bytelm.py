"""Interpolated modified Kneser-Ney n-grams of bytes, in sharded tables that grow with the text.

A gram is ``order`` bytes read as a number; a text begins after ``order - 1`` zero bytes. Texts are cut into pieces of at most
``PIECE_BYTES``, each with the bytes that its first grams begin with, and pieces are dealt into buckets of about ``BUCKET_BYTES``,
packed. Each bucket is reduced to its distinct grams and their counts in trusted texts before anything is joined: the tables of
counts of all orders are sharded by gram, every bucket's distinct grams meet them in one join, and the log probabilities return to
the bucket. Nothing of the model comes to the driver or to all tasks but the discounts of each order, and no gram is dropped or
folded: the tables hold as many rows as there are different grams.

One plan does it all, so that the texts are shuffled once and read twice. A task holds one bucket: its packed pieces, and distinct
grams that are merged as they come, so that memory follows ``BUCKET_BYTES`` and not the lengths of texts. Rows of a doc_id that
over one row in ``HOT_SHARE`` has are spread over as many places as they have pieces' bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.llm.common import HOT_SHARE, durable, map_slices

ORDER = 5
#: Bytes of the pieces of a bucket, on average, and of one piece at most.
BUCKET_BYTES, PIECE_BYTES = 16 << 20, 1 << 20
#: Bytes of texts whose grams are sorted at once.
_BLOCK = 1 << 20


def gram_codes(pieces: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(code, piece's number) of every gram of pieces that each begin with the ``order - 1`` bytes before them."""
    a = np.frombuffer(b"".join(pieces), np.uint8)
    owner = np.repeat(np.arange(len(pieces)), [len(x) - order + 1 for x in pieces])
    at = np.arange(len(owner)) + (order - 1) * (owner + 1)
    code = a[at].astype(np.int64)
    for back in range(1, order):
        code |= a[at - back].astype(np.int64) << (8 * back)
    return code, owner


def cut(text: bytes, order: int = ORDER) -> list[bytes]:
    """The pieces of a text, each after the ``order - 1`` bytes before it, the first after as many zero bytes."""
    led = b"\0" * (order - 1) + text
    return [led[i : i + PIECE_BYTES + order - 1] for i in range(0, len(text), PIECE_BYTES)]


def _blocks(packed: list[bytes] | pa.ChunkedArray) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, pieces) of runs of packed pieces of about ``_BLOCK`` bytes."""
    first, held, size = 0, [], 0
    for i, z in enumerate(packed):
        held.append(zlib.decompress(z if isinstance(z, bytes) else z.as_buffer()))
        size += len(held[-1])
        if size >= _BLOCK or i == len(packed) - 1:
            yield first, held
            first, held, size = i + 1, [], 0


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, where = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(where, np.concatenate(counts), len(code)).astype(np.int64)


def bucketed(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(pieces: p, doc_id, lang, rid, z; labels: p, doc_id): the bucket of each piece of a text, and the buckets of each trusted doc_id's pieces.

    rid tells rows apart that are cut into pieces.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    places = lambda bytes_: F.greatest(F.lit(1), F.ceil(bytes_ / PIECE_BYTES)).cast("int")
    n, total, longest = docs.agg(F.count("*"), F.sum(size.cast("bigint")), F.max(size)).first()
    buckets = max(1, -(-(total or 0) // BUCKET_BYTES))
    often = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("c"), F.sum(size.cast("bigint")).alias("w"))
    often = often.filter((F.col("c") * HOT_SHARE > n) & (F.col("c") > 1))
    hot = F.broadcast(durable(often.select("doc_id", places(F.col("w")).alias("__n"))))  # fewer than HOT_SHARE
    place = lambda *of: F.pmod(F.xxhash64(*of), F.lit(buckets)).cast("int").alias("p")
    rid = F.monotonically_increasing_id()  # deals out rows of one doc_id or of none, and means nothing else
    salt = F.pmod(F.col("rid"), F.coalesce("__n", F.lit(1)).cast("bigint")).cast("int").alias("salt")
    rows = docs.select("doc_id", "lang", F.col("text").cast("binary").alias("z"), rid.alias("rid")).filter("length(z) > 0")
    rows = rows.join(hot, "doc_id", "left").select("doc_id", "lang", "rid", salt, "z")
    schema = T.StructType([*rows.drop("z").schema.fields, T.StructField("piece", T.IntegerType()), T.StructField("z", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [[zlib.compress(x, 1) for x in cut(t, order)] for t in batch.column(4).to_pylist()]
            owner = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
            piece = pa.array([i for c in cuts for i in range(len(c))], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(owner)).columns[:4], piece, pa.array([z for c in cuts for z in c], pa.binary())], names=schema.names)

    packed = map_slices(rows, pack, schema).select(place(F.coalesce("doc_id", "rid"), "salt", "piece"), "doc_id", "lang", "rid", "z")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(c, F.lit(1)) - 1))
    labels = trusted.join(hot, "doc_id", "left").withColumn("salt", upto("__n")).withColumn("piece", F.lit(0))
    if (longest or 0) > PIECE_BYTES:
        long = docs.filter(size > PIECE_BYTES).groupBy("doc_id").agg(F.max(places(size)).alias("__pieces"))
        labels = labels.join(long, "doc_id", "left").withColumn("piece", upto("__pieces"))
    return packed, labels.select(place(F.col("doc_id"), "salt", "piece"), "doc_id")


def bucket_grams(texts: pa.Table, labels: pa.Table, order: int = ORDER) -> pa.Table:
    """(p, g, c) of one bucket's pieces ``texts`` (p, doc_id, z), by the trusted doc_ids of ``labels``."""
    if not texts.num_rows:
        return pa.table({"p": pa.array([], pa.int32()), "g": pa.array([], pa.int64()), "c": pa.array([], pa.int64())})
    trusted = np.isin(texts["doc_id"].fill_null(0).to_numpy(), labels["doc_id"].to_numpy()) & ~np.asarray(texts["doc_id"].is_null())
    codes, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    waiting = 0
    for first, block in _blocks(texts["z"]):
        code, owner = gram_codes(block, order)
        distinct, where = np.unique(code, return_inverse=True)
        codes.append(distinct)
        counts.append(np.bincount(where, trusted[first + owner], len(distinct)).astype(np.int64))
        waiting += len(distinct)
        if waiting > max(_BLOCK, len(codes[0])):
            (codes, counts), waiting = ([x] for x in _summed(codes, counts)), 0
    g, c = _summed(codes, counts)
    return pa.table({"p": pa.array(np.full(len(g), texts["p"][0].as_py(), np.int32)), "g": pa.array(g), "c": pa.array(c)})


def count_grams(texts: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """(p, g, c): the distinct grams of each bucket, and how often trusted texts have them."""

    def count(_key: tuple, texts: pa.Table, labels: pa.Table) -> pa.Table:
        return bucket_grams(texts, labels, order)

    return texts.groupBy("p").cogroup(labels.groupBy("p")).applyInArrow(count, "p int, g bigint, c bigint")


def _discounts(counts: DataFrame) -> DataFrame:
    """One row: modified Kneser-Ney discounts d1, d2, d3 for counts of 1, 2 and more, from how many grams have counts 1 to 4."""
    n = [F.coalesce(F.sum((F.col("c") == i).cast("double")), F.lit(0.0)) for i in (1, 2, 3, 4)]
    of = counts.agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)])
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.0)
    ds = [F.when(F.col(f"n{i}") > 0, i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(i * 0.5) for i in (1, 2, 3)]
    return of.select(*[F.least(F.greatest(d, F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{i}") for i, d in enumerate(ds, 1)])


def _off() -> Column:
    c = F.col("c")
    return F.when(c == 0, 0.0).when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))


def probabilities(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, prob) of all ``grams`` (g, c; c may be 0): the probability of the last byte after the others."""
    counts = [grams]
    for n in range(order - 1, 0, -1):  # in how many different ways a gram goes on to the left
        counts.append(counts[-1].groupBy(F.col("g").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("g")).agg(F.sum((F.col("c") > 0).cast("bigint")).alias("c")))
    lower = None
    for n, table in enumerate(reversed(counts), 1):
        context = Window.partitionBy("context")  # of 256 grams at most
        rows = table.crossJoin(F.broadcast(_discounts(table)))  # one row
        rows = rows.select("g", "c", _off().alias("off"), F.shiftright("g", 8).alias("context"))
        rows = rows.withColumns({"total": F.sum("c").over(context), "freed": F.sum("off").over(context)})
        if lower is None:
            rows = rows.withColumn("low", F.lit(1 / 256))
        else:
            rows = rows.withColumn("suffix", F.col("g").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(lower.hint("merge"), "suffix")
        prob = F.when(F.col("total") > 0, (F.col("c") - F.col("off") + F.col("freed") * F.col("low")) / F.col("total")).otherwise(F.col("low"))
        lower = rows.select(F.col("g").alias("suffix"), prob.alias("low"))
    return lower.select(F.col("suffix").alias("g"), F.col("low").alias("prob"))


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, lang, perplexity), per byte, of all ``docs`` (doc_id bigint, lang string, text) that are not empty, by a model of those whose doc_id is in ``trusted`` (doc_id).

    Without trusted text every perplexity is 256.
    """
    texts, labels = bucketed(docs, trusted, order)
    grams = count_grams(texts, labels, order)
    scores = probabilities(grams.groupBy("g").agg(F.sum("c").alias("c")), order)
    told = grams.select("p", "g").join(scores.hint("merge"), "g").select("p", "g", F.log2("prob").alias("bits"))

    def score(_key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        bits = np.zeros(texts.num_rows)
        size = np.ones(texts.num_rows, np.int64)
        order_of = np.argsort(told["g"].to_numpy())
        known, worth = told["g"].to_numpy()[order_of], told["bits"].to_numpy()[order_of]
        for first, block in _blocks(texts["z"]):
            code, owner = gram_codes(block, order)
            both = np.sort(owner << 40 | code)  # near grams are looked up together
            row = first + (both >> 40)
            bits += np.bincount(row, worth[np.searchsorted(known, both & (1 << 40) - 1)], len(bits))
            size[first : first + len(block)] = [len(x) - order + 1 for x in block]
        return pa.table({**{c: texts[c] for c in ("rid", "doc_id", "lang")}, "bits": pa.array(bits), "size": pa.array(size)})

    pieces = texts.groupBy("p").cogroup(told.groupBy("p")).applyInArrow(score, "rid bigint, doc_id bigint, lang string, bits double, size bigint")
    whole = pieces.groupBy("rid", "doc_id", "lang").agg(F.sum("bits").alias("bits"), F.sum("size").alias("size"))
    return whole.select("doc_id", "lang", F.pow(F.lit(2.0), -F.col("bits") / F.col("size")).alias("perplexity"))
