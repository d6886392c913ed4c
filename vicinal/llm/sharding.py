"""Sharding by a two-pass external shuffle, in DataFrame operations alone.

Pass one scatters whole records uniformly over buckets of a size that fits in memory, by a seeded hash of the record. Pass two
puts each bucket in the order of a Fisher-Yates shuffle and writes it. A bucket's shuffle draws from hashes of (seed, bucket,
step), so that a task run again shuffles alike. Buckets follow one another in one shuffled order of all records; that order is cut
into ``shards`` runs whose lengths differ by one at most, the law ``rows``. A record's slot is its place in its shard.

A shuffle has the permutation of a bucket as bytes, four an index: a step swaps two of them, and only the permutation - not the
records - is held by an expression. Records are sorted and windowed by bucket, which spills. Where more than ``COPIES`` rows are
equal in every column, one of them stands for all and is multiplied by its count after the scatter, so that repeated rows spread
over all buckets like any others. Rows that are equal in text only are no group here: they are shuffled one by one.

Nulls: a null text has size 1 and the checksum of no bytes; nulls of any column take part in the hash as a word of their own. Very
long texts count by their bytes when buckets are sized. Ties: records of equal hashes are ordered by all columns' hashes; rows
equal in all columns may change places with each other only. An empty table gives no rows. Extra columns are kept; those named
bucket, shard or slot are replaced. The input must read the same when read again, as a table does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.llm.common import SENT_ROWS, durable, new_folder

SHARDS, SEED = 16, 7
#: Rows and bytes that one bucket holds on average, at most.
BUCKET_ROWS, BUCKET_BYTES = 1024, 32 << 20
#: Rows equal in every column that are dealt one by one, at most, and of how many copies a row is multiplied at once.
COPIES = 64
COPY_ROWS = 4096
#: Bytes that one task scatters or shuffles, about.
TASK_BYTES = 128 << 20
#: Buckets whose counts are summed before the sums are.
RUN = 1024
#: Bytes of an index in a permutation.
_WIDE = 4


def size_of(text: Column) -> Column:
    """UTF-8 bytes plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def _key(columns: list[str], seed: int) -> Column:
    """The record's seeded hash, as 32 hex digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null")) for c in columns]))


def _number(digest: Column) -> Column:
    """60 bits of a hex digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def permutation(n: Column, bucket: Column, seed: int = SEED) -> Column:
    """A Fisher-Yates shuffle of 0 .. n - 1, drawn from (seed, bucket, step), as ``_WIDE`` bytes an index, high byte first."""
    one = F.lit(1).cast("bigint")
    start = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(n, one) - 1), lambda i: F.lpad(F.hex(i), 2 * _WIDE, "0")), "")
    last = F.greatest(n, one + 1) - 1
    at = lambda p, i: F.substring(p, (i * _WIDE + 1).cast("int"), F.lit(_WIDE))
    put = lambda p, x, i: F.overlay(p, x, (i * _WIDE + 1).cast("int"), F.lit(_WIDE))

    def step(p: Column, i: Column) -> Column:
        j = _number(F.md5(F.concat_ws("|", F.lit(str(seed)), bucket.cast("string"), i.cast("string")))) % (i + 1)
        return put(put(p, at(p, j), i), at(p, i), j)

    return F.when(n < 2, F.unhex(start)).otherwise(F.aggregate(F.sequence(last, one, -one), F.unhex(start), step))


def index_at(permuted: Column, place: Column) -> Column:
    return F.conv(F.hex(F.substring(permuted, (place * _WIDE + 1).cast("int"), F.lit(_WIDE))), 16, 10).cast("bigint")


def scattered(docs: DataFrame, seed: int, bucket_rows: int, bucket_bytes: int) -> tuple[DataFrame, int, int]:
    """(row, key, bucket) of every record, how many records there are, and about how many bytes."""
    names = [c for c in docs.columns if c not in ("bucket", "shard", "slot")]
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = docs.select(whole, _key(names, seed).alias("key"), size_of(F.col("text")).alias("size"))
    keys = rows.groupBy("key").agg(F.count("*").alias("copies"), F.sum("size").alias("size"))
    n, held, most = keys.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)), F.max("copies")).first()
    if n and most > COPIES:
        rows = _multiplied(rows, durable(keys.filter(F.col("copies") > COPIES).select("key")), seed)
    buckets = max(1, -(-n // bucket_rows), -(-held // bucket_bytes))
    return rows.select("row", "key", (_number(F.col("key")) % buckets).alias("bucket")), n, held


def _multiplied(rows: DataFrame, many: DataFrame, seed: int) -> DataFrame:
    """``rows`` with those of the keys of ``many`` counted, and each of the copies given a hash of its own."""
    many = F.broadcast(many) if many.count() <= SENT_ROWS else many.hint("merge")
    counted = rows.join(many, "key", "left_semi").groupBy("row", "key").agg(F.count("*").alias("copies"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPY_ROWS).cast("bigint"))))
    last = F.least(F.col("block") + COPY_ROWS, F.col("copies")) - 1
    copies = blocks.repartition("key", "block").withColumn("copy", F.explode(F.sequence("block", last)))
    own = F.md5(F.concat_ws("|", F.lit(str(seed)), "key", F.col("copy").cast("string")))
    return rows.join(many, "key", "left_anti").select("row", "key").unionByName(copies.select("row", own.alias("key")))


def bucket_plan(rows: DataFrame, seed: int) -> DataFrame:
    """(bucket, start, order): where a bucket starts in the order of all records, and its shuffle."""
    counts = durable(rows.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("run", F.floor(F.col("bucket") / RUN)))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    runs = counts.groupBy("run").agg(F.sum("n").alias("n"))
    runs = runs.select("run", F.coalesce(F.sum("n").over(upto(Window.partitionBy(F.lit(1)).orderBy("run"))), zero).alias("before"))
    inside = F.coalesce(F.sum("n").over(upto(Window.partitionBy("run").orderBy("bucket"))), zero)
    found = counts.withColumn("inside", inside).join(runs, "run")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(found.select("bucket", "n", (F.col("before") + F.col("inside")).alias("start")).repartition(tasks, "bucket").select("bucket", "start", permutation(F.col("n"), F.col("bucket"), seed).alias("order")))


def assigned(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` plus bucket, shard (0 to ``shards`` - 1) and slot (0 on, without gaps, in each shard)."""
    rows, n, held = scattered(docs, seed, bucket_rows, bucket_bytes)
    plan = bucket_plan(rows, seed)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // TASK_BYTES))
    in_bucket = Window.partitionBy("bucket").orderBy("key", F.xxhash64("row"))
    ranked = rows.repartition(tasks, "bucket").withColumn("rank", F.row_number().over(in_bucket) - 1)
    ranked = ranked.join(plan.repartition(tasks, "bucket").hint("merge"), "bucket")
    position = F.col("start") + index_at(F.col("order"), F.col("rank"))
    placed = ranked.select("row", "bucket", position.alias("position"))
    placed = placed.withColumn("shard", F.expr(f"cast(position * {shards} div {max(n, 1)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
    names = [c for c in docs.columns if c not in ("bucket", "shard", "slot")]
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "bucket", "shard", (F.col("position") - first).alias("slot"))


def write_shards(docs: DataFrame, path: str, **how: int) -> DataFrame:
    """Shards of ``docs`` as Parquet under ``path``, a folder each, records in slot order within a file; returns them as read again."""
    out = assigned(docs, **how)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write_shards(docs, new_folder(spark, "shards"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return shards.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP12_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, text,
         md5('7|' || coalesce('=' || doc_id::VARCHAR, 'null') || '|' || coalesce('=' || text, 'null') || '|' || coalesce('=' || lang, 'null')
             || '|' || coalesce('=' || source, 'null') || '|' || coalesce('=' || n_chars::VARCHAR, 'null')) AS key
  FROM documents
), total AS (
  SELECT count(*) AS n, greatest(1, (count(*) + 1023) // 1024, (coalesce(sum(size), 0)::BIGINT + 33554431) // 33554432) AS buckets FROM keyed
), dealt AS (
  SELECT k.*, ('0x' || key[1:15])::BIGINT % t.buckets AS bucket FROM keyed k, total t
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY key) AS rank FROM dealt
), counts AS (
  SELECT bucket, count(*) AS n, sum(count(*)) OVER (ORDER BY bucket) - count(*) AS start FROM dealt GROUP BY bucket
), shuffled(bucket, start, i, p) AS (
  SELECT bucket, start, n - 1, range(n) FROM counts
  UNION ALL
  SELECT bucket, start, i - 1, list_transform(p, lambda x, k: CASE k WHEN i + 1 THEN p[j + 1] WHEN j + 1 THEN p[i + 1] ELSE x END)
  FROM (SELECT *, ('0x' || md5('7|' || bucket || '|' || i)[1:15])::BIGINT % (i + 1) AS j FROM shuffled WHERE i > 0)
), placed AS (
  SELECT r.doc_id, r.size, coalesce(r.text, '') AS text, (s.start + s.p[r.rank])::BIGINT AS position, t.n FROM ranked r JOIN shuffled s ON r.bucket = s.bucket AND s.i < 1, total t
)
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32, 'rows' AS law, (position * 16 // n)::INTEGER AS shard,
       (position - ((position * 16 // n) * n + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed, (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE c & 1 WHEN 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)
"""
