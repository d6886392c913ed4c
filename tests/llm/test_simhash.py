import re

import pytest
import xxhash
from pyspark.sql import functions as F

from vicinal.llm import simfinger, simhash
from vicinal.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """rows: (id, fingerprint); smallest id reachable over links of at most 4 bits."""
    out = []
    for i, (_, f) in enumerate(rows):
        seen, todo = {i}, [f]
        while todo:
            g = todo.pop()
            for j, (_, h) in enumerate(rows):
                if j not in seen and bin(g ^ h).count("1") <= 4:
                    seen.add(j)
                    todo.append(h)
        out.append(min((rows[j][0] for j in seen if rows[j][0] is not None), default=None))
    return out


def test_groups_equal_brute_force(messy, messy_rows):
    found = simhash.near_groups(messy.select("doc_id", "text", "row", F.col("fp").alias("component")))
    got = sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in found.collect())
    rows = [(r[0], slow_fingerprint(r[1])) for r in messy_rows]
    want = sorted((str(i), f, c) for (i, f), c in zip(rows, slow_components(rows)))
    assert got == want
    assert len({c for _, _, c in got}) < len(got) - 5  # near copies were found


@pytest.mark.parametrize("n", [60, 1 << 30])
def test_links_of_random_fingerprints(spark, n):
    """Of the plans of small and of large tables."""
    import random

    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:20]:  # chains at distances around the limit
        for bits in (2, 4, 5):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), bits)))
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, 1) for f in signed], "fp bigint, n bigint")
    roots = {r["node"]: r["root"] for r in components(simhash.links(df, segments=simhash.plan_segments(n))).collect()}
    got = [roots.get(f, f) for f in signed]
    want = slow_components(list(zip(signed, fps)))
    assert {frozenset(i for i, g in enumerate(got) if g == x) for x in got} == {frozenset(i for i, g in enumerate(want) if g == x) for x in want}


def test_near_dedup_keeps_one_of_each_group(messy, messy_rows, no_docs):
    kept = simhash.near_dedup(messy)
    assert kept.columns == messy.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    rows = [(r[0], slow_fingerprint(r[1])) for r in messy_rows if r[0] is not None]
    groups = {}
    for (i, _), c in zip(rows, slow_components(rows)):
        groups.setdefault(c, []).append(i)
    assert sorted(i for i, _ in got if i is not None) == sorted(min(g) for g in groups.values())
    assert sum(i is None for i, _ in got) == 1
    assert simhash.near_dedup(no_docs).collect() == []


def test_fingerprint_cases():
    for text in (None, "", "  \n", "A", "a b c", "a b c d e", "ÄB c\td", "x " * 1000):
        assert simfinger.fingerprint(text) == slow_fingerprint(text)


def test_components_of_chains_and_empty(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(300, 301), (301, 300), (5, 5)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(roots[i] == 0 for i in range(201)) and roots[301] == roots[300] == 300
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
