import json
import re

import pytest
from pyspark.sql import functions as F

from vicinal.functions.filters import column_resolver, compile_filter, parse_metadata, parse_vector

VALUES = [{}, *[{"f": v} for v in (None, "12", 12, 12.0, True, False, ["a", 1], [], {"x": 1}, "abc", 0, -1.5, 2**53, 2**53 + 1, -(2**53) - 1, 2.0**53, 2**63 + 1, 10**37, 1e300, "a[b", "aXbXb", "line\n", "é1")], {"a.b": 1, "f": "q"}]
BIG = [2**53, 2**53 + 1, 2.0**53, -(2**53) - 1, 2**63 + 1, 10**37, 10**400, 1e300]
PATTERNS = ["(?P<y>b)", "[[]", "(?P<first_one>X)b(?P=first_one)b$", r"e\Z", r"\Ae", "[]x]", "[^]a]b", "[a&&b]X", "[[:a]b", "(?P<n>", "(?<n", "[", "*", r"[\]\[]b"]
OPERANDS = {
    "$eq": [None, "12", 12, 12.0, True, 1, 0, "abc"], "$ne": [None, "12", 12, True], "$gt": [5, "1", 0.5], "$gte": [12, "12"], "$lt": [13, "b"], "$lte": [0, -1.5],
    "$in": [[12, "abc"], [None], [], "abc", [True], [2**53 + 1]], "$nin": [[12, "abc"], [None], [], "abc", [2**53 + 1, 10**37]], "$exists": [True, False], "$contains": ["a", "b", 1, "12"],
    "$all": [["a"], ["a", 1], [], "a", ["a", "z"]], "$regex": ["^a", "b", "(", 5, *PATTERNS], "$what": [1],
}
for _op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte"):
    OPERANDS[_op] = [*OPERANDS[_op], *BIG]


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool) or isinstance(a, (int, float)) or isinstance(b, (int, float)):
        number = lambda x: isinstance(x, (bool, int, float))
        return number(a) and number(b) and a == b
    return a == b


def leaf(meta, key, op, x):
    v = meta.get(key)
    match op:
        case "$eq":
            return same(v, x)
        case "$ne":
            return not same(v, x)
        case "$gt" | "$gte" | "$lt" | "$lte":
            if v is None or isinstance(v, str) != isinstance(x, str) or isinstance(v, (list, dict)):
                return False
            return {"$gt": v > x, "$gte": v >= x, "$lt": v < x, "$lte": v <= x}[op]
        case "$in":
            return isinstance(x, list) and any(same(v, y) for y in x)
        case "$nin":
            return isinstance(x, list) and not any(same(v, y) for y in x)
        case "$exists":
            return x == (key in meta)
        case "$contains":
            return any(same(y, x) for y in v) if isinstance(v, list) else isinstance(v, str) and isinstance(x, str) and x in v
        case "$all":
            return isinstance(v, list) and isinstance(x, list) and all(any(same(y, z) for y in v) for z in x)
        case "$regex":
            try:
                return isinstance(v, str) and isinstance(x, str) and re.search(x, v) is not None
            except re.error:
                return False
    return False


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, json.dumps(m)) for i, m in enumerate(VALUES)]
    return spark.createDataFrame(data, "i int, j string").withColumn("m", F.parse_json("j")).cache()


def test_truth_table(rows):
    checks = [(op, x) for op, xs in OPERANDS.items() for x in xs]
    columns = [compile_filter({"f": {op: x}}, F.col("m"), two_valued=True).alias(f"c{n}") for n, (op, x) in enumerate(checks)]
    for r in rows.select("i", *columns).collect():
        for n, (op, x) in enumerate(checks):
            assert r[f"c{n}"] == leaf(VALUES[r["i"]], "f", op, x), (VALUES[r["i"]], op, x)


def test_combinations(rows):
    every = len(VALUES)
    count = lambda expr: rows.filter(compile_filter(expr, F.col("m"))).count()
    assert count(None) == count({}) == count({"f": {}}) == count({"$and": []}) == count({"$nor": []}) == every
    assert count({"$or": []}) == count({"$not": {}}) == count({"$or": "x"}) == count({"$not": 3}) == count({"f": {"$not": {"$eq": 1}}}) == 0
    assert count({"f": 12}) + count({"$not": {"f": 12}}) == every
    assert count({"f": {"$gte": 0, "$lt": 12}}) == count({"$and": [{"f": {"$gte": 0}}, {"f": {"$lt": 12}}]}) == 3
    assert count({"a.b": 1, "f": "q"}) == 1
    assert count({"$nor": [{"f": 12}, {"f": {"$exists": False}}]}) == every - 3


def test_pushdown_and_typed_columns(spark, tmp_path):
    df = spark.createDataFrame([("en", 5, ["a", "b"], True), ("fr", 50, ["c"], False), (None, 7, None, None)], "lang string, n bigint, tags array<string>, ok boolean")
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    run = lambda expr: df.filter(compile_filter(expr, column_resolver(df)))
    assert run({"lang": "en"}).count() == 1 and run({"lang": {"$ne": "en"}}).count() == 2 and run({"tags": {"$contains": "b"}}).count() == 1
    assert run({"ok": 1}).count() == 1 and run({"nope": None}).count() == 3 and run({"n": "5"}).count() == 0 and run({"tags": {"$all": ["a", "b"]}}).count() == 1
    plan = run({"n": {"$gte": 10}})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n,10)" in plan


def test_parsers():
    assert parse_metadata('{"a": 1}') == {"a": 1} and parse_metadata(None) == {} and parse_metadata("a=1, b=x,c=true,d=1.5,e") == {"a": 1, "b": "x", "c": True, "d": 1.5, "e": True}
    assert parse_vector("[1, 2]") == parse_vector("1,2") == [1.0, 2.0]
    with pytest.raises(ValueError):
        parse_metadata("{broken")
