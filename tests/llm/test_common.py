import numpy as np
import pyarrow as pa
import pytest

from vicinal.llm import common


@pytest.mark.parametrize("sent", [0, 100])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_few_both_ways(spark, monkeypatch, sent, how):
    monkeypatch.setattr(common, "SENT_ROWS", sent)
    rows = spark.createDataFrame([(i, f"k{i % 7}" if i % 5 else "hot", f"text {i}") for i in range(200)] + [(900, None, "n")], "id int, key string, text string")
    few = spark.createDataFrame([(f"k{i}", i) for i in range(5)] + [("hot", 99)], "key string, v int")
    got = sorted((r["id"], r["key"], r["v"]) for r in common.join_few(rows, few, ["key"], how).collect())
    want = sorted((r["id"], r["key"], r["v"]) for r in rows.join(few, "key", how).collect())
    assert got == want and len(got) >= 100


def test_written_tables_can_go(spark):
    import os

    df = common.written(spark.range(5))
    path = df._vicinal_path.removeprefix("file:")
    assert df.count() == 5 and os.path.isdir(path)
    common.discard(df)
    assert not os.path.exists(path)


def test_views_and_blocks():
    column = pa.array([b"abc", None, b"", b"defg"], pa.binary()).slice(1)
    raw, off = common.binary_views(column)
    assert [bytes(raw[a:b]) for a, b in zip(off, off[1:])] == [b"", b"", b"defg"]
    assert list(common.blocks(np.array([0, 3, 3, 100, 101, 104]), 5)) == [(0, 2), (2, 3), (3, 5)]
    assert list(common.blocks(np.array([0]), 5)) == []


def test_hot_keys_are_salted_and_nothing_is_lost(spark):
    rows = spark.createDataFrame([(7 if i % 3 else i, i) for i in range(3000)], "k bigint, v int")
    table = rows.groupBy("k").count().withColumn("w", common.F.col("k") * 2)
    got = common.join_hot(rows, table, "k", "count")
    assert got.columns == ["k", "v", "w"] and got.count() == 3000 and got.filter("w <> 2 * k").count() == 0
    assert common.join_hot(rows.limit(0), table.limit(0), "k", "count").count() == 0
