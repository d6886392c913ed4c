import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from vicinal.llm import sharding


def holds_the_law(rows, shards, n):
    """Shard sizes differ by one at most, and slots have no gaps."""
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def content(rows, names):
    return Counter(tuple(str(r[c]) for c in names) for r in rows)


@pytest.mark.parametrize("shards,bucket_rows", [(16, 4), (3, 1), (1, 1024), (50, 7)])
def test_law_and_content(messy, shards, bucket_rows):
    """Nulls, repeated rows, clashing columns: every row once, whole, in its place."""
    docs = messy.withColumn("bucket", F.lit("x")).withColumn("slot", F.lit("y"))
    out = sharding.assigned(docs, shards, bucket_rows=bucket_rows)
    rows = out.collect()
    holds_the_law(rows, shards, docs.count())
    assert content(rows, messy.columns) == content(docs.collect(), messy.columns)


def test_same_whatever_the_partitions(messy):
    once = {(str(r["doc_id"]), r["text"], r["shard"], r["slot"]) for r in sharding.assigned(messy, bucket_rows=5).collect()}
    again = {(str(r["doc_id"]), r["text"], r["shard"], r["slot"]) for r in sharding.assigned(messy.repartition(1), bucket_rows=5).collect()}
    assert once == again


def test_sql(spark, messy, tmp_path):
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding.op12_sharding(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(out.columns)} FROM ({sharding.OP12_SQL})").fetchall()
    rows = out.collect()
    key = lambda r: (r["doc_id"], r["size"], r["text_crc32"])  # noqa: E731  rows equal in all columns may change places
    twice = {k for k, n in Counter(map(key, rows)).items() if n > 1}
    assert sorted(str(tuple(r)) for r in rows if key(r) not in twice) == sorted(str(r) for r in want if r[:3] not in twice)
    assert Counter((r["shard"], r["slot"]) for r in rows) == Counter(r[4:6] for r in want)
    assert Counter(map(key, rows)) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())


def test_permutation_is_fisher_yates(spark):
    """Step by step, and every permutation of four about equally often."""
    import hashlib

    frame = spark.range(2400).select(F.lit(4).cast("bigint").alias("n"), F.col("id").alias("bucket"))
    got = {r["bucket"]: [int(r["p"][i : i + 8], 16) for i in range(0, 32, 8)] for r in frame.select("bucket", F.hex(sharding.permutation(F.col("n"), F.col("bucket"))).alias("p")).collect()}
    for bucket, p in got.items():
        want = [0, 1, 2, 3]
        for i in (3, 2, 1):
            j = int(hashlib.md5(f"7|{bucket}|{i}".encode()).hexdigest()[:15], 16) % (i + 1)
            want[i], want[j] = want[j], want[i]
        assert p == want
    times = Counter(map(tuple, got.values()))
    assert len(times) == 24 and all(60 < n < 145 for n in times.values())


def test_rows_that_repeat_without_end(spark):
    """A row that is a third of all spreads over all buckets."""
    rows = [(None, None, 1)] * 700 + [(i, f"text {i}", 2) for i in range(1300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, other int").repartition(3)
    out = sharding.assigned(docs, bucket_rows=100).collect()
    holds_the_law(out, 16, 2000)
    assert content(out, docs.columns) == content(docs.collect(), docs.columns)
    sizes = Counter(r["bucket"] for r in out)
    assert len(sizes) == 20 and max(sizes.values()) < 160
    assert len({r["shard"] for r in out if r["doc_id"] is None}) == 16


def test_long_texts_size_the_buckets(spark):
    docs = spark.createDataFrame([(i, "w" * 10_000) for i in range(40)], "doc_id bigint, text string")
    assert len({r["bucket"] for r in sharding.assigned(docs, 4, bucket_bytes=20_000).collect()}) > 8


def test_written_shards(spark, messy, tmp_path):
    """Files hold a shard each, in slot order."""
    out = sharding.write_shards(messy, str(tmp_path / "out"), shards=4)
    holds_the_law(out.collect(), 4, messy.count())
    import pyarrow.parquet as pq

    folders = sorted((tmp_path / "out").glob("shard=*"))
    assert [f.name for f in folders] == [f"shard={i}" for i in range(4)]
    for file in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = pq.ParquetFile(file).read()["slot"].to_pylist()
        assert slots == sorted(slots)


def test_native(spark, messy):
    plan = sharding.assigned(messy.filter("doc_id is not null"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark, no_docs, tmp_path):
    assert sharding.assigned(no_docs).collect() == []
    no_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert sharding.op12_sharding(spark, str(tmp_path)).collect() == []
