"""Registered queries over keyed tables: reads, changes, round trips through files, statistics, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vicinal.functions.filters import column_resolver, compile_filter
from vicinal.plans.registry import query
from vicinal.plans.views import ITEMS, documents, items, table
from vicinal.session import shared_folder
from vicinal.sources import dml, jsonl, vdb
from vicinal.sources.collection import stats_frame
from vicinal.sources.files import ensure_dir


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.lit(-1).cast("bigint").alias("ord"))


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("ord"))


@query("get_batch", "SELECT e.event_id AS pos, e.user_id AS id, c.c_name AS name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id")
def get_batch(spark, sf_dir):
    """Every event asks for its user's row; misses are null."""
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("id"))
    return dml.get_batch(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), asked)


@query("insert_dup_probe", "SELECT o_custkey AS id, count(*)::BIGINT AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey")
def insert_dup_probe(spark, sf_dir):
    return dml.duplicates(_customers(spark, sf_dir), _orders(spark, sf_dir))


@query("upsert_merge", "WITH last AS (SELECT o_custkey AS id, arg_max(o_totalprice, o_orderkey) AS value, max(o_orderkey) AS ord FROM orders GROUP BY o_custkey) SELECT id, value, ord FROM last UNION ALL SELECT c_custkey, c_acctbal, -1 FROM customer WHERE c_custkey NOT IN (SELECT id FROM last)")
def upsert_merge(spark, sf_dir):
    """Orders put into the customers' table: the last order of a customer wins."""
    batch = _orders(spark, sf_dir).withColumn("at", F.col("ord"))
    return dml.upsert(_customers(spark, sf_dir).withColumn("at", F.lit(-1).cast("bigint")), batch, order="at").drop("at")


@query("delete_anti", "SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def delete_anti(spark, sf_dir):
    """Customers with urgent orders are deleted."""
    gone = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return dml.delete(_customers(spark, sf_dir), gone).select("id", "value")


@query("filter_limit", "SELECT doc_id AS id, lang FROM documents WHERE lang = 'fr' ORDER BY doc_id LIMIT 20")
def filter_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.filter(compile_filter({"lang": "fr"}, column_resolver(rows))).orderBy("doc_id").limit(20).select(F.col("doc_id").alias("id"), "lang")


@query("collection_stats", "SELECT count(*)::BIGINT AS count, 64::BIGINT AS dimension, sum((coalesce(d.text, '') <> '')::INT)::BIGINT AS n_documents FROM embeddings e LEFT JOIN documents d ON e.vec_id = d.doc_id")
def collection_stats(spark, sf_dir):
    docs = documents(spark, sf_dir).select("id", "document")
    rows = items(spark, sf_dir).join(docs, "id", "left").select(F.col("id").cast("string").alias("id"), "vector", "document", F.lit(None).cast("string").alias("metadata"))
    return stats_frame(rows, 64).drop("memory_bytes")


def _as_items(spark, sf_dir):
    rows = items(spark, sf_dir)
    meta = F.to_json(F.struct("label"))
    return rows.select(F.col("id").cast("string").alias("id"), "vector", meta.alias("metadata"), F.concat(F.lit("item "), F.col("id").cast("string")).alias("document"), F.lit(1.5).alias("created_at"), F.col("id").alias("ord"))


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_BACK = f"WITH {ITEMS} SELECT id::VARCHAR AS id, label, round(list_sum(vector), 4) AS total, 'item ' || id AS document FROM items"


def _shown(rows):
    label = F.try_variant_get(F.parse_json("metadata"), "$.label", "int")
    return rows.select("id", label.alias("label"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), "document")


@query("jsonl_roundtrip", _BACK)
def jsonl_roundtrip(spark, sf_dir):
    path = _folder(spark, "jsonl")
    jsonl.write_jsonl(_as_items(spark, sf_dir), path)
    return _shown(jsonl.read_jsonl(spark, path))


@query("vdb_roundtrip", f"WITH {ITEMS} SELECT id::VARCHAR AS id, label, round(list_sum([x::FLOAT::DOUBLE for x in vector]), 4) AS total, 'item ' || id AS document FROM items")
def vdb_roundtrip(spark, sf_dir):
    """Through binary files, one per task; vectors come back in single precision."""
    vdb.register(spark)
    path = _folder(spark, "vdb").removeprefix("file://").removeprefix("file:")
    ensure_dir(path)
    _as_items(spark, sf_dir).drop("ord").write.format("vdb").mode("append").option("config", '{"name": "t", "dimension": 64}').save(path)
    return _shown(spark.read.format("vdb").load(path))


@query("window_counts", "SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def window_counts(spark, sf_dir):
    """The streaming aggregation, run as a batch."""
    from vicinal.streaming.ingest import window_counts as counted

    rows = counted(table(spark, sf_dir, "events"))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("percentiles", "WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(n)::BIGINT AS n, max(CASE WHEN rn = least(floor(n * 0.5) + 1, n) THEN value END) AS p50, max(CASE WHEN rn = least(floor(n * 0.95) + 1, n) THEN value END) AS p95, max(CASE WHEN rn = least(floor(n * 0.99) + 1, n) THEN value END) AS p99 FROM o GROUP BY event_type")
def percentiles(spark, sf_dir):
    """Percentiles by place, as the benchmark reports them."""
    from vicinal.operators.stats import percentiles as by_place

    return by_place(table(spark, sf_dir, "events"), "value", "event_type")
