from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from vicinal.llm import mixing


def slow_targets(sizes, weights=(1, 2, 3), most=3):
    """Share, cut at the caps, share the excess again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = sum(sizes.values())
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("bucket_rows", [1, 4096])
def test_budgets(messy, bucket_rows):
    out = mixing.mix(mixing.sizes(messy), bucket_rows=bucket_rows).collect()
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = slow_targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_bucket_count_does_not_matter(messy):
    key = lambda df: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in df.collect())
    sized = mixing.sizes(messy)
    assert key(mixing.mix(sized, bucket_rows=1)) == key(mixing.mix(sized.repartition(1), bucket_rows=1 << 20))


def test_sql(messy, spark, tmp_path):
    messy.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(map(str, r)) for r in mixing.op8_mixing(spark, str(tmp_path)).select("doc_id", "size", "source_size", F.round("target", 6), "taken").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(tuple(map(str, r)) for r in con.sql(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({mixing.OP8_SQL})").fetchall())
    assert got == want


def taken_words(rows, plan):
    """(source, doc_id) -> words, of a mix and of its plan."""
    got, want = Counter(), Counter()
    for r in rows:
        got[r["source"], r["doc_id"]] += len(r["text"].encode().split())
    for r in plan:
        want[r["source"], r["doc_id"]] += r["taken"]
    return got, +want


def test_mixed_documents(messy):
    plan = mixing.mix(mixing.sizes(messy)).collect()
    out = mixing.mixed_documents(messy)
    assert out.columns == messy.columns and out.dtypes == messy.dtypes
    got, want = taken_words(out.collect(), plan)
    assert got == want


@pytest.mark.parametrize("doc_id", [None, 7])
def test_cut_among_repeated_rows(spark, doc_id):
    """A budget that ends among rows of one doc_id, of equal texts and of others, is met to the word."""
    rows = [(doc_id, "a b c d e f g h i j", "a", i % 3) for i in range(100)] + [(doc_id, f"x{i} y", "a", 0) for i in range(9)]
    rows += [(1000 + i, " ".join("w" * (i + 3)), "b", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, other int").repartition(3)
    plan = mixing.mix(mixing.sizes(docs)).collect()
    assert len(plan) == len(rows)
    out = mixing.mixed_documents(docs).collect()
    got, want = taken_words(out, plan)
    assert got == want
    assert sum(w for (s, _), w in got.items() if s == "a") == round(next(r["target"] for r in plan if r["source"] == "a"))
    assert all(n <= 3 * 34 for n in Counter(r["other"] for r in out if r["source"] == "a" and len(r["text"].split()) == 10).values())


def test_many_copies_of_a_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPY_ROWS", 7)
    docs = spark.createDataFrame([(1, "a b", "a")] * 50 + [(2, "c", "b")] * 20, "doc_id bigint, text string, source string")
    out = mixing.mix(mixing.sizes(docs)).collect()
    assert len(out) == 70 and sum(r["taken"] for r in out) == 120 and sum(r["taken"] for r in out if r["doc_id"] == 2) == 60


def test_empty(no_docs):
    assert mixing.mix(mixing.sizes(no_docs)).collect() == []
    assert mixing.mixed_documents(no_docs).collect() == []
