import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vicinal.llm import fim

ODD = ["<P>", "a<S>b", "x<M", "<", "<<P", "P>S>M>", "é漢\U0001f600‍\U0001f469", "\x00\n\r\n", "a b\n\nc, d.", "x" * 300_000]


def slow_units(text, units):
    """Units of a text, point by point."""
    kind = lambda c: 0 if c in " \t\n\x0b\x0c\r" else 1 if c.isascii() and (c.isalnum() or c == "_") or ord(c) > 127 else 2
    if units == "chars":
        return list(text)
    out = []
    for i, c in enumerate(text):
        new = i == 0 or (text[i - 1] == "\n" if units == "lines" else kind(c) != kind(text[i - 1]))
        if new:
            out.append("")
        out[-1] += c
    return out


def slow(doc_id, text, units="chars"):
    text = text or ""
    parts = slow_units(text, units)
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(parts)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return text, n, "plain", None, None
    if h4 % 100 < 20:
        return f"<S>{suffix}<P>{prefix}<M>{middle}", n, "spm", len(prefix), len(middle)
    return f"<P>{prefix}<S>{suffix}<M>{middle}", n, "psm", len(prefix), len(middle)


@pytest.mark.parametrize("units", fim.UNITS)
def test_texts(spark, messy, units):
    """Nulls, ties, repeated rows, clashing columns, odd and long texts, for each kind of unit; the text comes back."""
    odd = spark.createDataFrame([(i, t) for t in ODD for i in range(100, 112)], "doc_id bigint, text string")
    docs = messy.withColumn("form", F.lit(1)).unionByName(odd, allowMissingColumns=True)
    out = fim.fill_in_middle(docs, units).withColumn("again", fim.restored(F.col("text"), F.col("form")))
    assert set(out.columns) == {*docs.columns, *fim.RESULTS, "again"}
    got = sorted((str(r["doc_id"]), r["text"], r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["again"]) for r in out.collect())
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = [(d, *slow(d, t, units), t or "") for d, t in rows]
    assert got == sorted((str(d), x, n, f, str(p), str(m), t) for d, x, n, f, p, m, t in want)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30), st.integers(), st.sampled_from(fim.UNITS))
def test_any_text(text, doc_id, units):
    assert fim.rearranged(text, fim.draws(doc_id), units) == slow(doc_id, text, units)
    at = fim.boundaries(fim.code_points(text), units)
    assert np.all(np.diff(at) > 0) and at[0] == 0 and at[-1] == len(text)


def test_sql(spark, messy, tmp_path):
    docs = messy.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string"), allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = fim.op13_fill_in_middle(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(out.columns)} FROM ({fim.OP13_SQL})").fetchall()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_empty(no_docs):
    assert fim.fill_in_middle(no_docs).collect() == []


def test_units_are_named(no_docs):
    with pytest.raises(ValueError):
        fim.fill_in_middle(no_docs, "bytes")
