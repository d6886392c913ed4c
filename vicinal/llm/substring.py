"""Substring dedup by De Bruijn compaction.

Token k-mers of ``window`` words are the edges of a De Bruijn graph over all texts. An edge that starts in a document with a
smaller doc_id is a repeat, and the words under it are removed.

Edges are compacted before anything moves: consecutive edges of a text that share a minimiser form a path fragment, one row of
fixed width for some twenty edges, and equal edges always fall under equal minimisers. Fragments whose minimiser occurs in one
document only cannot hold repeats and drop out by a join. What is left is compacted in the graph whose nodes are the contents of
repeated fragments: a join on places finds each one's successors and predecessors in all texts, those that have one of each only
are linked, and pointer doubling joins the links to maximal nonbranching paths (``unitigs``). Every occurrence of a path's first
content is the whole path, so a path's copies are one row each, and point to the source coordinates (smallest doc_id, text,
place) of the path. The words at the source coordinates are read again and digested, and a copy is cut only where its own words
have the same digest.

Where fragments branch - several contents under one minimiser - the source occurrence of each content is opened again into its
single edges, which are compared edge by edge. Contents and edges are told apart by 128-bit cryptographic digests of their words.

No occurrence list of a key is ever gathered: contents and edges are reduced to their smallest document before they are joined
back, and hot keys are salted or split by skew handling. Spans are gathered per text; they are distinct, and so bounded by its
length, however often its row repeats.

Nulls: null texts have no words; rows with a null doc_id neither give nor lose words. Rows that repeat a doc_id do not count as
smaller than one another. Texts shorter than the window are returned whole, very long ones are worked off in chunks; an empty
table gives no rows. Extra columns are kept by ``dedup_substrings`` (whatever their names) and ignored by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.llm.common import discard, durable, join_hot, map_slices, written
from vicinal.llm.tokenruns import Words, fragments, word_hashes, words_of

WINDOW = 50
#: Words of a minimiser. Fragments of differing content under one minimiser are opened, so it is long enough to be rare.
MINIMISER = 16


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th (names the text among rows of one doc_id) and the text as bytes."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(c, k) for c, k in kinds.items()])


_LONG, _BYTES = T.LongType(), T.BinaryType()


def path_fragments(keyed: DataFrame, window: int, k: int) -> DataFrame:
    """One row per fragment: doc_id, th, start, n (edges), m (minimiser) and key (digest of its words)."""
    schema = _fields(doc_id=_LONG, th=_LONG, start=_LONG, n=_LONG, m=_LONG, key=_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            rows, parts, keys = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = words_of(text)
                found = fragments(word_hashes(np.frombuffer(words.joined, np.uint8)), window, k)
                keys += words.digests(found.start, found.windows + window - 1)
                rows.append(np.full(len(found.start), i))
                parts.append(found)
            at = np.concatenate(rows) if rows else np.empty(0, np.int64)
            if not len(at):
                continue
            columns = [ids[at], ths[at], *[np.concatenate([getattr(p, c) for p in parts]) for c in ("start", "windows", "minimiser")]]
            yield pa.RecordBatch.from_arrays([*[pa.array(c.view(np.int64)) for c in columns], pa.array(keys, pa.binary())], names=schema.names)

    rows = keyed.filter("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return map_slices(rows, run, schema)


def _recurring(which: np.ndarray, off: np.ndarray, edge: np.ndarray) -> tuple:
    """(which, off, n, step, row of edge): equal edges of one fragment in even steps as one row each, others one by one. ``edge`` (rows, 2)."""
    order = np.lexsort((off, edge[:, 0], edge[:, 1], which))
    which, off, edge = which[order], off[order], edge[order]
    new = np.concatenate(([True], (which[1:] != which[:-1]) | (edge[1:] != edge[:-1]).any(axis=1)))
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    count = np.diff(np.concatenate((starts, [len(off)])))
    gap = np.concatenate(([0], np.diff(off)))
    step = np.where(count > 1, gap[np.minimum(starts + 1, len(off) - 1)], 1)
    uneven = np.add.reduceat((~new & (gap != step[group])).astype(np.int64), starts) > 0
    kept = new | uneven[group]
    times = np.where(uneven[group], 1, count[group])[kept]
    return which[kept], off[kept], times, np.where(uneven[group], 1, step[group])[kept], order[kept]


def _with_wanted(texts: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, wanted, text); outer, as the spans' join is: all read one exchange of the texts."""
    by_text = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct(*columns)).alias("wanted"))
    return texts.join(by_text, ["doc_id", "th"], "left").select("doc_id", "wanted", "text")


def _opened(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The single edges of the wanted fragments: key, doc_id, off (place within the fragment), n, step, edge (digest of the window).

    An edge that recurs n times in a fragment, ``step`` words apart, as in a phrase repeated over and over, is one row.
    """
    schema = _fields(key=_BYTES, doc_id=_LONG, off=_LONG, n=_LONG, step=_LONG, edge=_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in np.flatnonzero(~np.asarray(batch.column(1).is_null())).tolist():
                wanted = batch.column(1)[i].values
                start, n = (wanted.field(c).to_numpy(zero_copy_only=False) for c in ("start", "n"))
                words = words_of(batch.column(2)[i].as_py())
                which = np.repeat(np.arange(len(n)), n)
                off = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                edge = words.digests(start[which] + off, np.full(len(which), window))
                pairs = np.frombuffer(b"".join(edge), np.uint64).reshape(-1, 2)
                at, off, times, step, row = _recurring(which, off, pairs)
                longs = [pa.array(c) for c in (np.full(len(at), batch.column(0)[i].as_py()), off, times, step)]
                yield pa.RecordBatch.from_arrays([wanted.field("key").take(pa.array(at)), *longs, pa.array(edge, pa.binary()).take(pa.array(row))], names=schema.names)

    return map_slices(_with_wanted(texts, wanted, "start", "n", "key"), run, schema)


def _source_digests(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(key, digest) of the words at source coordinates: ``wanted`` has doc_id, th, start, n (edges) and the path's key."""
    schema = _fields(key=_BYTES, digest=_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, digests = [], []
            for wanted, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                if wanted:
                    words = words_of(text.as_py())
                    keys += [w["key"] for w in wanted]
                    digests += [_digest(words, w["start"], w["n"], window) for w in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.binary())], names=schema.names)

    return map_slices(_with_wanted(texts, wanted, "start", "n", "key"), run, schema).dropDuplicates(["key"])


def _digest(words: Words, start: int, n: int, window: int) -> bytes:
    return hashlib.sha256(words.run(start, n + window - 1)).digest()


def unitigs(places: DataFrame) -> DataFrame:
    """(key, n) of the first content of every maximal nonbranching path, n edges long in all.

    ``places`` (doc_id, th, start, n, key) are the occurrences of repeated contents; one follows another where its edges go on.
    A text that begins, ends or leaves the repeated contents is a branch as well, so paths never close.
    """
    here = places.select("doc_id", "th", (F.col("start") + F.col("n")).alias("start"), F.col("key").alias("u"))
    follows = here.join(places.select("doc_id", "th", "start", F.col("key").alias("v")), ["doc_id", "th", "start"], "full_outer")
    follows = written(follows.groupBy("u", "v").agg(F.count("*").alias("times")))
    after = follows.filter("u IS NOT NULL").groupBy("u").agg(F.count("*").alias("c"), F.max("v").alias("v")).filter("c = 1 AND v IS NOT NULL").drop("c")
    before = follows.filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("c"), F.max("u").alias("u")).filter("c = 1 AND u IS NOT NULL").drop("c")
    lengths = places.groupBy("key").agg(F.any_value("n").alias("n"))
    # (key, up, d): d edges lie between the beginnings of up and key
    links = after.join(before, ["u", "v"]).join(lengths.withColumnRenamed("key", "u"), "u").select(F.col("v").alias("key"), F.col("u").alias("up"), F.col("n").alias("d"))
    links = written(links)
    discard(follows)
    while True:
        further = links.select(F.col("key").alias("up"), F.col("up").alias("top"), F.col("d").alias("more"))
        step = written(links.join(further, "up", "left").select("key", F.coalesce("top", "up").alias("up"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.col("top").isNotNull().alias("moved")))
        discard(links)
        links = step.drop("moved")
        links._vicinal_path = step._vicinal_path
        if step.filter("moved").isEmpty():
            break
    inner = links.join(lengths, "key").groupBy(F.col("up").alias("key")).agg(F.sum("n").alias("more"))
    heads = lengths.join(links.select("key"), "key", "left_anti").join(inner, "key", "left")
    out = written(heads.select("key", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    discard(links)
    return out


def repeated_spans(keyed: DataFrame, texts: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, th, spans): edges s, s + step, ... (n of them) that start in a smaller document as well, and the digest of the source's words where they are one run."""
    every = written(path_fragments(keyed, window, k))
    shared = every.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("c")).filter("hi > lo").select("m", "c")
    candidates = written(join_hot(every, shared, "m", "c").dropDuplicates(["doc_id", "th", "start"]))
    discard(every)
    found = candidates.groupBy("m", "key").agg(F.min(F.struct("doc_id", "th", "start", "n")).alias("src"), F.max("doc_id").alias("hi"), F.count("*").alias("c"))
    contents = written(found.select("m", "key", "src.*", "hi", "c"))
    repeated = contents.filter("hi > doc_id")

    places = written(join_hot(candidates.drop("m"), repeated.select("key", "c"), "key", "c"))
    paths = unitigs(places)
    heads = repeated.drop("m", "n", "hi").join(paths, "key")
    copies = join_hot(places.drop("n"), heads.select("key", "n", F.col("doc_id").alias("src_doc"), "c"), "key", "c").filter("doc_id > src_doc")
    copies = durable(copies.select("doc_id", "th", F.col("start").alias("s"), "n", "key"))
    verified = copies.join(_source_digests(texts, heads.drop("c"), window), "key")
    whole = verified.select("doc_id", "th", "s", "n", F.lit(1).cast("bigint").alias("step"), "digest")

    branching = contents.groupBy("m").agg(F.count("*").alias("c"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("c > 1 AND hi > lo").select("m", "c")
    wanted = durable(join_hot(contents.select("m", "key", "doc_id", "th", "start", "n"), branching, "m", "c").drop("m"))
    edges = _opened(texts, wanted, window)
    first = edges.groupBy("edge").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("last > first").drop("last")
    hit = edges.join(first, "edge").filter("doc_id > first").select("key", F.col("doc_id").alias("src_doc"), "off", F.col("n").alias("times"), "step")
    single = candidates.drop("n").join(hit, "key").filter("doc_id = src_doc")
    single = single.select("doc_id", "th", (F.col("start") + F.col("off")).alias("s"), F.col("times").alias("n"), "step", F.lit(None).cast("binary").alias("digest"))
    return whole.unionAll(single).groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "n", "step", "digest")).alias("spans"))


def _covered(words: Words, spans: list, window: int) -> np.ndarray:
    """Which words lie under a flagged edge. A run is flagged only if its words are the source's."""
    step = np.zeros(len(words.start) + 1, np.int64)
    for x in spans:
        if x["digest"] is not None and x["digest"] != _digest(words, x["s"], x["n"], window):
            continue
        if x["step"] <= window:  # one stretch
            step[x["s"]] += 1
            step[x["s"] + (x["n"] - 1) * x["step"] + window] -= 1
            continue
        for s in range(x["s"], x["s"] + x["n"] * x["step"], x["step"]):
            step[s] += 1
            step[s + window] -= 1
    return np.cumsum(step[:-1]) > 0


def _cut(text: bytes | None, spans: list | None, window: int) -> tuple[int, int, bytes]:
    """(words, words removed, kept words joined by one space)."""
    words = words_of(text)
    if not spans:
        return len(words.start), 0, words.joined
    gone = _covered(words, spans, window)
    kept = [words.joined[a:b] for a, b in zip(words.start[~gone].tolist(), words.end[~gone].tolist())]
    return len(words.start), int(gone.sum()), b" ".join(kept)


def _cut_texts(docs: DataFrame, window: int, k: int, digest: bool) -> DataFrame:
    """doc_id, ``row`` (a struct of docs' further columns, if any), n_words, n_removed, and kept: the sha256 of the kept words if ``digest``, else the text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    more = [F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")] if others else []
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"), *more)
    spans = repeated_spans(_keyed(docs), texts, window, k)
    shown = ["row"] if others else []
    rows = texts.join(spans, ["doc_id", "th"], "left").select("doc_id", *shown, "text", "spans")
    schema = T.StructType([rows.schema["doc_id"], *[rows.schema[c] for c in shown], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    at = 1 + len(shown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            done = [_cut(t, s, window) for t, s in zip(texts, batch.column(at + 1).to_pylist())]
            if digest:
                kept = [hashlib.sha256(d[2]).hexdigest() for d in done]
            else:
                kept = [d[2].decode() if d[1] else t if t is None else t.decode() for t, d in zip(texts, done)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    return map_slices(rows, run, schema)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, k: int = MINIMISER) -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` (kept words joined by one space; other texts unchanged), and n_chars, where there is one, anew."""
    names = docs.columns
    cut = _cut_texts(docs, window, k, digest=False)
    shown = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in names:
        shown["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))
    return cut.select(*[shown[c].cast(docs.schema[c].dataType).alias(c) if c in shown else F.col(f"row.`{c}`").alias(c) for c in names])


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _cut_texts(docs, WINDOW, MINIMISER, digest=True).withColumnRenamed("kept", "kept_sha256")


OP2_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), edges AS (
  SELECT doc_id, i, md5(array_to_string(words[i : i + 49], ' ')) AS edge
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts WHERE len(words) >= 50)
), firsts AS (
  SELECT edge, min(doc_id) AS first FROM edges GROUP BY edge
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM edges JOIN firsts USING (edge), range(0, 50) AS r(k) WHERE doc_id > first
), placed AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM texts
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS words, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, (len(t.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""
