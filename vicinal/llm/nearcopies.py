"""Near-dedup by SimHash candidates and exact similarity: five-word shingles, Jaccard similarity of 0.8 and more.

At that similarity 64 bits differ in ten, too many for Hamming balls that are the same for all. So fingerprints are wider, cut
into as many segments as ``plan`` asks for, and each segment's ball is directed: a bit is unsure where about as many shingles
have it set as not, and the ball flips the least sure bits of the segment only. A document probes its own balls and is stored
under its segments, so that a pair meets if either finds the other. What meets is held against further bits of the fingerprints in
the same join, then verified by the whole shingle sets. ``plan`` gives a pair at the threshold a chance of ``RECALL`` to meet; more similar ones
have a better one. Sets of at most ``SMALL`` shingles, whose bits say little, also meet under the set and under all that lack one shingle,
which is exact for up to nine.

Documents of equal shingle sets are one class. Each class is tried against the smallest classes of its fullest buckets first; what
passes there is a family. Hubs leave families open whose texts are about half alike, as few of them pass against any one; so buckets
of over ``FULL`` classes then meet whole, in cells, and a spanning forest of what passes goes out: no more rows than the cells have.
The full search tries only classes of different families, so that no large family is listed pair by pair. Families are verified
in cells too, where each whole shingle set comes once and a spanning forest is what goes out.

Null texts and texts without words are one class. Rows without a doc_id stay, and so does one row of each group: that of the
smallest doc_id, then the smallest text hash. Texts of any length are read whole. Repeated rows are one; an empty table gives no
rows; extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.llm.common import SENT_ROWS, binary_views, bound_batches, discard, durable, join_few, join_hot, map_slices, written
from vicinal.llm.components import components
from vicinal.llm.simfinger import ascii_words, bit_counts, shingle_hashes, widened
from vicinal.llm.simhash import meet

WIDTH, LEAST, RECALL = 5, 0.8, 0.98
#: Bits that only verify, and how many of them may differ: 3.6 standard deviations above the mean at the threshold.
CHECK_BITS, CHECK_MOST = 128, 34
SMALL = 16
#: Buckets whose smallest class each class is tried against before the full search.
HUBS = 3
#: Buckets of more classes meet whole, those of fewer pair by pair.
FULL = 16
#: Bytes of shingle sets in a cell, and how many sets it may hold at most.
BLOCK, CELL_ROWS = 16 << 20, 4096
_SMALL_TAG = 1 << 62


@lru_cache(maxsize=16)
def plan(n: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int, int]:
    """(segments, bits of each, unsure bits of each) for n documents: the fewest rows by which a pair at ``least`` meets with chance ``recall``.

    Chances come from drawing sums of shingle bits as normal variables that share what the two documents share.
    """
    width = min(36, max(12, round(np.log2(max(n, 2))) - 2))
    rng, trials, common = np.random.default_rng(42), 20_000, 2 * least / (1 + least)
    shared = rng.normal(size=(trials, width)) * np.sqrt(common)
    a, b = (shared + rng.normal(size=(trials, width)) * np.sqrt(1 - common) for _ in range(2))
    differ = (a > 0) != (b > 0)
    found = []
    for unsure in range(7):
        sure = [np.argsort(np.argsort(np.abs(x), axis=1), axis=1) >= unsure for x in (a, b)]
        met = 1 - np.mean((differ & sure[0]).any(axis=1) & (differ & sure[1]).any(axis=1))
        segments = int(np.ceil(np.log(1 - recall) / np.log(1 - met)))
        found.append((segments * (2**unsure + 1), segments, unsure))
    _, segments, unsure = min(found)
    return segments, width, unsure


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(ascii_words(text), width))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _small_keys(shingles: np.ndarray) -> list[int]:
    """Keys of a small set and of all that lack one of its shingles; none of others."""
    if not 0 < len(shingles) <= SMALL:
        return []
    lacking = [shingles, *[np.delete(shingles, i) for i in range(len(shingles))]]
    return [xxhash.xxh64_intdigest(x.tobytes()) >> 2 | _SMALL_TAG for x in lacking if len(x)]


def signatures(docs: DataFrame, shape: tuple[int, int, int], salt: int = 0) -> DataFrame:
    """(doc_id, th, cls, cls2, segs, unsure, c1, c2, small) of ``docs`` (doc_id, th, text).

    cls and cls2 are hashes of the shingle set, both 0 without words; segs holds the segments' bits, unsure the bits that the
    balls flip, c1 and c2 the bits that verify, small the keys of small sets.
    """
    segments, width, unsure = shape
    words = -(-(CHECK_BITS + segments * width) // 64)
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    schema = T.StructType([*docs.select("doc_id", "th").schema.fields, *[T.StructField(c, k) for c, k in (("cls", long), ("cls2", long), ("segs", longs), ("unsure", longs), ("c1", long), ("c2", long), ("small", longs))]])
    arrow_longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            cls, cls2 = ([_signed(xxhash.xxh64_intdigest(s.tobytes(), seed)) if len(s) else 0 for s in sets] for seed in (salt, ~salt & (1 << 63) - 1))
            margin = np.stack([2 * bit_counts(widened(s, words)) - len(s) for s in sets])
            bits = margin > 0
            checks = np.packbits(bits[:, :CHECK_BITS], axis=1, bitorder="little").view("<i8")
            own = slice(CHECK_BITS, CHECK_BITS + segments * width)
            segs = bits[:, own].reshape(-1, segments, width) @ (1 << np.arange(width, dtype=np.int64))
            least = np.argsort(np.abs(margin[:, own]).reshape(-1, segments, width), axis=2, kind="stable")[:, :, :unsure]
            flips = (1 << least.astype(np.int64)).reshape(len(sets), -1)
            some = [len(s) > 0 for s in sets]
            lists = [pa.array([r.tolist() if x else [] for r, x in zip(a, some)], arrow_longs) for a in (segs, flips)]
            columns = [*batch.columns[:2], *[pa.array(c, pa.int64()) for c in (cls, cls2)], *lists, *[pa.array(checks[:, i].copy()) for i in (0, 1)], pa.array([_small_keys(s) for s in sets], arrow_longs)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_slices(docs.select("doc_id", "th", "text"), run, schema)


def _tagged(segment: Column, i: Column) -> Column:
    return segment.bitwiseOR(F.shiftleft(i.cast("bigint"), 40))


def _bits(end: str) -> list[Column]:
    """What a pair is checked by, named for the pair's ``end``."""
    return [F.col("c1").alias(f"{end}1"), F.col("c2").alias(f"{end}2"), (F.size("small") > 0).alias(f"{end}_small")]


def _stored(classes: DataFrame, end: str, *more: str) -> DataFrame:
    """key, the class as ``end``, its check bits and ``more``, for each segment and small key."""
    keys = F.concat(F.transform("segs", _tagged), F.col("small"))
    return classes.select(F.explode(keys).alias("key"), F.col("cls").alias(end), *_bits(end), *more)


def _probes(classes: DataFrame, shape: tuple[int, int, int], *more: str) -> DataFrame:
    """As ``_stored``, for each value of each segment's ball."""
    segments, _, unsure = shape

    def value(j: Column) -> Column:
        i = F.shiftright(j, unsure)
        out = F.get("segs", i)
        for t in range(unsure):
            flip = F.when(j.bitwiseAND(F.lit(1 << t)) != 0, F.get("unsure", i * unsure + t)).otherwise(F.lit(0).cast("bigint"))
            out = out.bitwiseXOR(flip)
        return _tagged(out, i)

    ball = F.transform(F.sequence(F.lit(0), F.lit(segments * 2**unsure - 1)), value)
    keys = F.concat(F.when(F.size("segs") > 0, ball).otherwise(F.array().cast("array<bigint>")), F.col("small"))
    return classes.select(F.explode(keys).alias("key"), F.col("cls").alias("a"), *_bits("a"), *more)


def _near() -> Column:
    """What all check bits let pass; small sets pass anyway."""
    differ = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    return (differ <= CHECK_MOST) | (F.col("a_small") & F.col("b_small"))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(cls, set) of ``texts`` (cls, text), the set as bytes."""
    schema = T.StructType([T.StructField("cls", T.LongType()), T.StructField("set", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=schema.names)

    return map_slices(texts.select("cls", "text"), run, schema)


_CELL = ("fam", "p", "q")
_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b")])


def _forest(sets: list[np.ndarray] | None, bits: np.ndarray, small: np.ndarray, part: np.ndarray, known: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Places of similar sets, as few as connect what all similar pairs of the cell connect with what is ``known`` to be.

    ``bits`` has two words of check bits a set. Where a cell has two parts, only sets of different parts are compared. A set marks
    its shingles in a table of the cell's, and those of all others that may be similar are counted there at once. Without ``sets``
    all that the check bits let pass is similar.
    """
    known, two = known.copy(), part.min() != part.max()
    if sets is not None:
        size = np.array([len(x) for x in sets])
        start = np.cumsum(size) - size
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        mark = np.zeros(int(ids.max()) + 1, np.int32)
    for i in range(len(bits) - 1):
        rest = slice(i + 1, None)
        near = np.bitwise_count(bits[rest] ^ bits[i]).sum(axis=1) <= CHECK_MOST
        near |= small[rest] & small[i]
        near &= known[rest] != known[i]
        if sets is not None:
            near &= np.minimum(size[rest], size[i]) >= least * np.maximum(size[rest], size[i])
        if two:
            near &= part[rest] != part[i]
        hits = others = np.flatnonzero(near) + i + 1
        if not len(others):
            continue
        if sets is not None:
            own = ids[start[i] : start[i] + size[i]]
            mark[own] = 1
            lengths = size[others]
            begin = np.cumsum(lengths) - lengths
            common = np.add.reduceat(mark[ids[np.repeat(start[others] - begin, lengths) + np.arange(lengths.sum())]], begin)
            mark[own] = 0
            hits = others[common >= least * (size[i] + lengths - common)]
        groups, first = np.unique(known[hits], return_index=True)
        for j in hits[first].tolist():
            yield i, j
        if len(groups):
            known[np.isin(known, groups)] = known[i]


def _by_cells(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The forests of cells, which come sorted and are held one at a time."""
    rest: pa.Table | None = None
    for batch in _with_end(batches):
        table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if table is None or not table.num_rows:
            continue
        ids = np.stack([table[c].to_numpy().astype(np.int64) for c in _CELL])
        starts = np.flatnonzero(np.concatenate(([True], (ids[:, 1:] != ids[:, :-1]).any(axis=0))))
        ends = [*starts[1:].tolist(), table.num_rows]
        last = len(starts) if batch is None else len(starts) - 1  # the last cell may go on in the next batch
        rest = table.slice(int(starts[-1])) if batch is not None else None
        if not last:
            continue
        done = table.slice(0, ends[last - 1]).combine_chunks()
        raw, off = binary_views(done["set"]) if "set" in done.column_names else (None, None)
        cls, known, part, small = (done[c].to_numpy() for c in ("cls", "root", "part", "small"))
        bits = np.stack([done[c].to_numpy().view(np.uint64) for c in ("c1", "c2")], axis=1)
        found = []
        for s, e in zip(starts[:last].tolist(), ends):
            if e - s > 1:
                sets = None if raw is None else [raw[off[i] : off[i + 1]].view(np.uint64) for i in range(s, e)]
                found += [(cls[s + i], cls[s + j]) for i, j in _forest(sets, bits[s:e], small[s:e], part[s:e], known[s:e], least)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=_FOUND.names)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _worked(cells: DataFrame, least: float) -> DataFrame:
    bound_batches(cells.sparkSession)
    rows = cells.select(*_CELL, "part", "cls", "root", "c1", "c2", "small", *[c for c in cells.columns if c == "set"])
    return durable(rows.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(lambda batches: _by_cells(batches, least), _FOUND))


def _apart(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(``rows`` in cells of about ``block`` bytes of a family, each part with itself only; the families of several parts)."""
    many = durable(rows.groupBy("fam").agg(F.sum("weight").alias("w")).filter(F.col("w") > block).select("fam", F.ceil(F.col("w") / block).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("cls"), F.coalesce("parts", F.lit(1))).cast("int")
    return join_few(rows, many, ["fam"], "left").withColumns({"part": part, "p": part, "q": part}), many


def _rooted(rows: DataFrame, edges: DataFrame, how: str) -> DataFrame:
    roots = components(edges).withColumnRenamed("node", "cls")
    return rows.drop("root").join(roots.hint("merge"), "cls", how).withColumn("root", F.coalesce("root", "cls"))


def _across(rows: DataFrame, block: int) -> DataFrame:
    """Cells in which each row of a family meets all that have another root: parts of the largest root meet the other parts only."""
    sums = rows.groupBy("fam", "root").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    largest = sums.groupBy("fam").agg(F.max_by("root", F.struct("w", "root")).alias("largest"), F.max("w").alias("wl"), F.sum("w").alias("w"), F.sum("n").alias("n"))
    parts = lambda w: F.ceil(w / block).cast("int")
    split = largest.filter("w > wl").select("fam", "n", "largest", parts(F.col("w") - F.col("wl")).alias("others"), parts(F.col("wl")).alias("own"))
    split = durable(split.withColumn("in_all", F.col("others") + F.col("own")))
    dealt = join_few(rows, split.drop("n"), ["fam"]) if split.count() <= SENT_ROWS else join_hot(rows, split, "fam", "n")
    is_largest, h = F.col("root") == F.col("largest"), F.xxhash64("cls", F.lit("across"))
    part = F.when(is_largest, F.col("others") + F.pmod(h, "own")).otherwise(F.pmod(h, "others")).cast("int")
    dealt = dealt.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(is_largest, F.col("others")).otherwise(F.col("in_all")) - 1)))
    return dealt.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})


def similar(pairs: DataFrame, classes: DataFrame, texts: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(a, b) links between classes that connect what all ``pairs`` (a, b) with a Jaccard similarity of at least ``least`` connect.

    What pairs connect is a family. A family's shingle sets are dealt to cells of about ``block`` bytes, in which all sets meet whose
    check bits let them: a set moves once, however many pairs it is in, and only a spanning forest comes out. Families of several
    cells then let the least set of each group found meet those of other cells, and last whole cells meet cells, but for those of
    the family's largest group. Only the last step moves a set more than once: as often as the family has cells.
    """
    families = components(pairs).select(F.col("node").alias("cls"), F.col("root").alias("fam"))
    named = classes.select("cls", "k.doc_id", "k.th", "c1", "c2", (F.size("small") > 0).alias("small"))
    named = durable(named.join(families.hint("merge"), "cls"))
    ends = named.select("cls", "doc_id", "th")
    found = texts.join(F.broadcast(ends) if ends.count() <= SENT_ROWS else ends.hint("merge"), ["doc_id", "th"]).select("cls", "text")
    sets = shingle_sets(found).dropDuplicates(["cls"]).join(named.drop("doc_id", "th").hint("merge"), "cls")
    sets = written(sets.withColumns({"weight": F.greatest(F.length("set"), F.lit(block // CELL_ROWS)), "root": F.col("cls")}))
    cells, many = _apart(sets, block)
    edges = _worked(cells, least)
    if not many.isEmpty():
        rows = join_few(sets, many.select("fam"), ["fam"])
        leasts = _rooted(rows, edges, "inner").filter("cls = root")
        edges = durable(edges.unionAll(_worked(_apart(leasts, block)[0], least)))
        edges = durable(edges.unionAll(_worked(_across(_rooted(rows, edges, "left"), block), least)))
    discard(sets)
    return edges


def _in_full_buckets(marked: DataFrame, hubs: DataFrame, block: int) -> DataFrame:
    """(a, b) pairs that connect what the check bits let pass in buckets of over ``FULL`` classes; ``marked`` are classes with their root.

    Only a bucket's largest group is not held against itself. A bucket of k cells moves its rows, which are check bits, k times.
    """
    full = hubs.filter(F.col("c") > FULL).select("key", "c")
    rows = join_hot(_stored(marked, "b", "root"), full, "key", "c")
    rows = rows.select(F.col("key").alias("fam"), F.col("b").alias("cls"), F.coalesce("root", "b").alias("root"), F.col("b1").alias("c1"), F.col("b2").alias("c2"), F.col("b_small").alias("small"), F.lit(block // CELL_ROWS).alias("weight"))
    return _worked(_across(durable(rows), block), LEAST)


def links(classes: DataFrame, texts: DataFrame, shape: tuple[int, int, int], least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(a, b) pairs of classes that connect what all similar pairs that meet connect."""
    stored = _stored(classes, "a")
    b = F.min(F.struct(*[F.col(c).alias(c.replace("a", "b", 1)) for c in ("a", "a1", "a2", "a_small")])).alias("hub")
    hubs = durable(stored.groupBy("key").agg(b, F.count("*").alias("c")).filter("c > 1").select("key", "c", F.col("c").alias("full"), "hub.*"))
    tried = join_hot(stored, hubs, "key", "c").filter(_near() & F.expr("a <> b")).groupBy("a", "b").agg(F.max("full").alias("full"))
    fullest = F.slice(F.sort_array(F.collect_list(F.struct("full", "b")), asc=False), 1, HUBS)  # of one a segment and small key
    first = durable(tried.groupBy("a").agg(fullest.alias("hub")).select("a", F.explode("hub.b").alias("b")))
    marks = lambda edges: classes.drop("k").join(components(edges).withColumnRenamed("node", "cls").hint("merge"), "cls", "left")
    first = durable(first.unionAll(_in_full_buckets(marks(first), hubs, block)))
    marked = written(marks(first).withColumn("grouped", F.col("root").isNotNull()))
    root = F.col("root").alias("ra")
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # each row becomes many: no few tasks may hold them
    dealt = marked.repartition(tasks, "cls")
    found = meet(_probes(dealt, shape, root), _probes(dealt.filter("grouped"), shape, root), _stored(marked, "b", F.col("root").alias("rb")), _near())
    pairs = durable(first.unionAll(found))
    discard(marked)
    return similar(pairs, classes, texts, least, block)


def near_dedup(docs: DataFrame, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id (and text hash), texts whole, all columns."""
    slim = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("th"), "text")
    shape = plan(docs.count(), least)
    for salt in range(8):  # another one in the rare case that two sets share a hash
        marked = signatures(slim, shape, salt)
        like = [F.any_value(c).alias(c) for c in ("segs", "unsure", "c1", "c2", "small")]
        classes = written(marked.groupBy("cls", "cls2").agg(F.min(F.struct("doc_id", "th")).alias("k"), *like).drop("cls2"))
        if classes.groupBy("cls").count().filter("count > 1").isEmpty():
            break
        discard(classes)
    else:
        raise RuntimeError("shingle sets share hashes under every salt")
    roots = components(links(classes, slim, shape, least, block))
    groups = classes.select("cls", "k").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    keepers = groups.groupBy("root").agg(F.min("k").alias("k")).select("k.doc_id", "k.th")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(durable(keepers).hint("merge"), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    discard(classes)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]).unionByName(docs.filter("doc_id is null"))
