"""SimHash near-dedup by multi-index hashing.

A fingerprint's 64 bits are cut into segments, each with a radius. Two fingerprints that differ in at most ``distance`` bits
differ in no more bits than the radius in some segment, so each distinct fingerprint enumerates the small Hamming ball around each
of its segments, fetches the fingerprints stored under those segment values, and verifies the complete distance inside the join.

Equal fingerprints collapse to one row first. Large groups of near copies are contracted before the full search: in each bucket
every fingerprint is tried against the bucket's most frequent one, and the full search then returns only links between
fingerprints that are not yet known to be connected. Links inside a group are thus never listed pair by pair, a large group is
not held against itself, and no link that connects two components is lost. The segments follow from how many fingerprints there
are, so that buckets stay small.

Nulls: a null text has fingerprint zero, as an empty one; rows with a null doc_id keep their fingerprint, get the component of
their fingerprint, and never name one (a component of such rows only has a null id). Repeated rows are returned as often as they
come in. A bit set in just half of the hashes is 0. Texts of any length are read whole. An empty table gives no rows. Extra columns
are ignored by the query and kept by ``near_dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import durable, join_hot, map_slices
from vicinal.llm.components import components
from vicinal.llm.simfinger import fingerprint

DISTANCE = 4
Segments = tuple[tuple[int, int], ...]
#: (bits, radius of the balls) of each segment, for up to ``MANY`` distinct fingerprints and beyond. Radii and segments add up to
#: more than the distance, so that two fingerprints cannot differ in more bits than the radius in every segment.
SEGMENTS, WIDE_SEGMENTS, MANY = ((22, 1), (22, 1), (20, 0)), ((34, 2), (30, 1)), 1 << 25


def fingerprints(docs: DataFrame, width: int = 4, text: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` without its text column plus ``out``: the signed 64-bit SimHash of the whole text."""
    keep = [c for c in docs.columns if c not in (text, out)]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0).cast("bigint").alias(out)).schema
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, width) for t in batch.column(len(keep)).to_pylist()]
            signed = pa.array([v - (1 << 64) if v >> 63 else v for v in values], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], signed], names=[*keep, out])

    return map_slices(frame, run, schema)


def _segment(fp: Column, i: int, segments: Segments) -> Column:
    """The i-th segment's bits, tagged with i above them."""
    shift, width = sum(w for w, _ in segments[:i]), segments[i][0]
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(i << 40))


def _ball(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` bits."""
    masks = {0}
    for _ in range(radius):
        masks |= {m ^ (1 << b) for m in masks for b in range(width)}
    return sorted(masks)


def _stored(fps: DataFrame, segments: Segments, *more: str) -> DataFrame:
    keys = F.explode(F.array(*[_segment(F.col("fp"), i, segments) for i in range(len(segments))]))
    return fps.select("fp", *more, keys.alias("key"))


def _flip(own: Column):
    return lambda mask: own.bitwiseXOR(mask)


def _probes(fps: DataFrame, segments: Segments, *more: str) -> DataFrame:
    around = []
    for i, (width, radius) in enumerate(segments):
        own = _segment(F.col("fp"), i, segments)
        masks = F.array(*[F.lit(m).cast("bigint") for m in _ball(width, radius)])
        around.append(F.transform(masks, _flip(own)))
    keys = F.flatten(F.array(*around))
    return fps.select("fp", *more, F.explode(keys).alias("key"))


def plan_segments(n: int) -> Segments:
    """Segments for n distinct fingerprints: buckets of some 2**22 values until they hold too many of them, then of 2**30 and more."""
    return SEGMENTS if n <= MANY else WIDE_SEGMENTS


def meet(probes: DataFrame, grouped: DataFrame, stored: DataFrame, near: Column) -> DataFrame:
    """(a, b), a < b, that meet under a key, are ``near``, and are not known to be connected.

    ``probes`` has key, a, ra and ``stored`` key, b, rb; ra and rb name what is known to be connected with a and b, null where
    nothing is; ``near`` may use further columns of both. ``grouped`` are the probes of what is connected with something. Those of
    a key's largest group meet the others under it only, so that a large group is never held against itself.
    """
    ra, rb = F.coalesce("ra", "a"), F.coalesce("rb", "b")
    sizes = stored.groupBy("key", rb.alias("d")).agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max_by("d", F.struct("n", "d")).alias("d")).hint("merge")
    new = probes.join(largest, "key").filter(ra != F.col("d")).drop("d").join(stored.hint("merge"), "key")
    rest = stored.join(largest, "key").filter(rb != F.col("d"))
    own = grouped.join(rest.hint("merge"), "key").filter(ra == F.col("d")).drop("d")
    found = new.filter((ra != rb) & near).select("a", "b").unionByName(own.filter(near).select("a", "b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(fps: DataFrame, distance: int = DISTANCE, segments: Segments | None = None) -> DataFrame:
    """(a, b) pairs of distinct fingerprints of ``fps`` (fp, n) that connect everything that links at ``distance`` bits connect.

    ``n`` is how many documents have the fingerprint. Not every link within a component is listed.
    """
    segments = segments or plan_segments(fps.count())
    if sum(w for w, _ in segments) != 64 or sum(r + 1 for _, r in segments) <= distance:
        raise ValueError("segments must hold 64 bits, and their balls must reach the distance")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    stored = _stored(fps, segments, "n")
    hubs = durable(stored.groupBy("key").agg(F.max_by("fp", F.struct("n", "fp")).alias("b"), F.count("*").alias("c")))
    first = join_hot(stored.select("key", F.col("fp").alias("a")), hubs.filter("c > 1"), "key", "c")
    first = durable(first.filter(near & F.expr("a <> b")).select("a", "b").distinct())
    known = components(first)
    tagged = durable(fps.join(known.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "root"))
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each row becomes a whole ball: no few tasks may hold them
    p = _probes(tagged.repartition(tasks, "fp"), segments, "root").select("key", F.col("fp").alias("a"), F.col("root").alias("ra"))
    members = known.select(F.col("node").alias("fp"), "root")
    g = _probes(members.repartition(tasks, "fp"), segments, "root").select("key", F.col("fp").alias("a"), F.col("root").alias("ra"))
    s = _stored(tagged, segments, "root").select("key", F.col("fp").alias("b"), F.col("root").alias("rb"))
    return durable(first.unionAll(meet(p, g, s, near)))


def near_groups(docs: DataFrame, width: int = 4, distance: int = DISTANCE, segments: Segments | None = None) -> DataFrame:
    """``docs`` without text, plus fp and component_id: the smallest doc_id reachable over linked fingerprints."""
    marked = durable(fingerprints(docs, width))
    classes = marked.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    classes = durable(classes)
    roots = components(links(classes.select("fp", "n"), distance, segments))
    joined = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    joined = durable(joined)
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("c"))
    by_fp = join_hot(joined.select("fp", "n", "root"), named, "root", "c").select("fp", "n", "component_id")
    return join_hot(marked, by_fp, "fp", "n")


def near_dedup(docs: DataFrame, width: int = 4, distance: int = DISTANCE) -> DataFrame:
    """One document of each group: that of the smallest doc_id (and text hash), texts whole, all columns. Rows without a doc_id stay."""
    slim = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    groups = near_groups(slim, width, distance)
    keepers = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "th")).alias("k")).select("k.doc_id", "k.th")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(keepers, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]).unionByName(docs.filter("doc_id is null"))


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
