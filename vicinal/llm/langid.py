"""Language identification with a bidirectional gated recurrent network over bytes.

The network (``bytegru``) is trained in numpy on a bounded sample of labelled rows: at most ``SAMPLE`` documents of every
language and ``MOST`` of all, the least by a hash of doc_id and text over the whole table, ``CROPS`` crops of ``SEGMENT`` characters
from each. It then labels every position of every whole text, and a document's probabilities are the mean over its positions.
Documents whose crc32(doc_id as text) is a multiple of ``FOLDS`` are held out: never learnt from, but predicted as all others.

A null text, or one without a letter, is ``und`` with score 0, and so is everything if there is nothing to learn from. Null
languages are not learnt from; null doc_ids are predicted, not learnt from, and not held out. Repeated rows are returned as
often as they come in; an empty table gives no rows; extra columns are ignored by the query and kept by ``accepted``. Very long
texts are labelled in blocks, at every position. Of equally likely languages the first in order of code points is named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.llm.bytegru import HIDDEN, SEGMENT, Net, new_net, pool, train
from vicinal.llm.common import binary_views, blocks, durable, join_few, map_slices

FOLDS = 5
#: Documents learnt from: of each language, and of all together (but one of each), at most.
SAMPLE, MOST = 600, 60_000
CROPS = 4
STEPS, BATCH, RATE, SEED = 300, 192, 0.03, 42
UNKNOWN = "und"
#: Documents scored below this are rejected by the pipeline's stage.
LEAST_SCORE = 0.35


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_crops(docs: DataFrame, sample: int = SAMPLE, most: int = MOST) -> list[tuple[str, bytes]]:
    """(language, crop) pairs, in an order that does not depend on partitions: ``CROPS`` of at most ``sample`` documents a language.

    ``most`` bounds the documents of all languages together; each language keeps one at least. Repeated rows are drawn once.
    """
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    counts = durable(rows.groupBy("lang").agg(F.count("*").alias("n")))
    each = max(1, min(sample, most // max(1, counts.count())))
    shares = counts.select("lang", F.least(F.lit(1.0), F.lit(1.2 * each) / F.col("n")).alias("share"))
    drawn = F.pmod(F.col("h"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    room = F.greatest(F.lit(1), F.length("text") - SEGMENT)
    starts = [F.pmod(F.xxhash64(F.lit(i), "h"), room) + 1 for i in range(CROPS)]
    crops = F.array(*[F.substr("text", at.cast("int"), F.lit(SEGMENT)) for at in starts])
    hashed = rows.select("lang", "text", F.xxhash64(F.lit("sample"), "doc_id", "text").alias("h"))
    found = join_few(hashed, shares, ["lang"]).filter(drawn).select("lang", "h", crops.alias("crops"))
    least = Window.partitionBy("lang").orderBy("h")  # after one row a hash; every task sends its least ``each`` rows a language only
    found = found.dropDuplicates(["lang", "h"]).withColumn("place", F.row_number().over(least)).filter(F.col("place") <= each)
    return sorted((r["lang"], c.encode()) for r in found.collect() for c in r["crops"])


def fit(docs: DataFrame, hidden: int = HIDDEN, sample: int = SAMPLE, steps: int = STEPS) -> Net | None:
    """A network trained on ``docs`` (doc_id, text, lang), None where nothing can be learnt."""
    crops = training_crops(docs, sample)
    if not crops:
        return None
    labels = sorted({lang for lang, _ in crops})
    x = np.full((len(crops), SEGMENT), 32, np.uint8)
    for i, (_, crop) in enumerate(crops):
        cut = np.frombuffer(crop, np.uint8)[:SEGMENT]
        x[i, : len(cut)] = cut
    y = np.array([labels.index(lang) for lang, _ in crops])
    net = new_net(labels, hidden, SEED)
    by_label = [np.flatnonzero(y == i) for i in range(len(labels))]
    most = max(map(len, by_label))
    even = np.concatenate([np.resize(rows, most) for rows in by_label])  # each language as often as the others
    train(net, x[even], y[even], steps, BATCH, RATE, SEED)
    return net


def predict(docs: DataFrame, net: Net | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` plus lang_pred and score, without ``text`` unless ``keep_text``. Only the text is an input of a prediction."""
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    letters = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"), letters.alias("__letters"))
    n = len(keep)
    shown = n + keep_text
    schema = T.StructType([*frame.schema.fields[:shown], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(n + 1).to_numpy(zero_copy_only=False).astype(bool)
            labels, scores = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
            if net is not None:
                raw, off = binary_views(batch.column(n))
                for a, b in blocks(off, 1 << 20):
                    p = pool(net, raw[off[a] : off[b]], off[a : b + 1] - off[a])
                    best = p.argmax(axis=1)
                    labels[a:b] = np.array(net.labels, object)[best]
                    scores[a:b] = p[np.arange(b - a), best].clip(0, 1)
                labels[~letters], scores[~letters] = UNKNOWN, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns[:shown], pa.array(labels.tolist(), pa.string()), pa.array(scores)], names=schema.names)

    return map_slices(frame, run, schema)


def accepted(docs: DataFrame, net: Net | None, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, whole, whose language is recognised with a score of at least ``least``."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), "text")
    kept = predict(rows, net, keep_text=True).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs.select("doc_id", "text", "lang"))
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(slim, net)
