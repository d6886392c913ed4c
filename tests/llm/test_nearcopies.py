import random

import numpy as np
import pytest
from conftest import prose

import corpus_pipeline
from vicinal.llm import nearcopies, simfinger


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in (a, b)))
    return len(x & y) / len(x | y)


def planted(rng, n, words, least):
    """Texts and copies of a similarity just above ``least``."""
    for _ in range(n):
        text = prose(rng, words).split()
        copy = text[:]
        for _ in range(200):
            trial = copy[:]
            trial[rng.randrange(len(trial))] = prose(rng, 1)
            if jaccard(" ".join(text), " ".join(trial)) >= least:
                copy = trial
        yield " ".join(text), " ".join(copy)


@pytest.mark.parametrize("least", [0.8, 0.9, 0.95])
def test_planted_copies_go(spark, least):
    """Copies of changed words, of a similarity just above ``least``, are found by the pipeline's stage; dissimilar ones stay."""
    rng = random.Random(3)
    rows = []
    for i, (text, copy) in enumerate(planted(rng, 100, 200, least)):
        rows += [(2 * i, text), (2 * i + 1, copy)]
    rows += [(1000 + i, " ".join(prose(rng, 40).split() + rows[2 * i][1].split()[:120])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "unused").collect()}
    assert len([i for i in range(100) if 2 * i + 1 not in kept]) >= 96
    assert kept >= {2 * i for i in range(100)} | {1000 + i for i in range(20)}


@pytest.mark.parametrize("words, n", [(9, 2**18), (14, 2**18), (40, 2**18), (300, 2**18), (300, 2**27)])
def test_chance_to_meet(words, n):
    """The plans of large tables give pairs at the threshold the chance they promise, whatever the texts' length."""
    shape = nearcopies.plan(n)
    segments, width, unsure = shape
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        size = words - 4
        fresh = max(1, int(size / 9)) if size >= 9 else 0
        if size < 9:
            a = rng.integers(0, 1 << 63, size, np.uint64)
            b = a[:-1]
        else:
            a = rng.integers(0, 1 << 63, size, np.uint64)
            b = np.concatenate([a[fresh:], rng.integers(0, 1 << 63, fresh, np.uint64)])
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
        own, balls = [], []
        for x in (np.sort(a), np.sort(b)):
            margin = 2 * simfinger.bit_counts(simfinger.widened(x, -(-(128 + segments * width) // 64))) - len(x)
            part = margin[128 : 128 + segments * width].reshape(segments, width)
            own.append(part > 0)
            balls.append(np.argsort(np.argsort(np.abs(part), axis=1, kind="stable"), axis=1) < unsure)
        differ = own[0] != own[1]
        small = set(nearcopies._small_keys(np.sort(a))) & set(nearcopies._small_keys(np.sort(b)))
        met += bool(small) or any((~(differ & ~balls[i])).all(axis=1).any() for i in (0, 1))
    assert met / 300 >= 0.95


def test_groups_equal_brute_force(spark):
    rng = random.Random(6)
    base = prose(rng, 90).split()
    texts = [" ".join("other" if rng.random() < rng.choice([0.01, 0.03]) else w for w in base) for _ in range(40)]
    texts += ["one two three four five six seven", "ONE two three four five six seven", "one two three four five six", "a", "", None, "  "]
    root = list(range(len(texts)))
    for i, x in enumerate(texts):
        for j, y in enumerate(texts[:i]):
            if (x or "").split() == (y or "").split() == [] or (x or "").split() and (y or "").split() and jaccard(x, y) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert {r["doc_id"] for r in nearcopies.near_dedup(docs).collect()} == set(root)


def test_large_group_and_messy_rows(spark, messy, messy_rows, no_docs):
    rng = random.Random(8)
    base = prose(rng, 60).split()
    rows = [(i, " ".join([*base[:20], f"number{i}", *base[21:]])) for i in range(1500)] + [(5000 + i, prose(rng, 60)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r["doc_id"] for r in nearcopies.near_dedup(docs).collect()} == {0} | {5000 + i for i in range(30)}
    kept = nearcopies.near_dedup(messy)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == messy.columns and ids.count(None) == 1 and ids.count(8) == 2 and len(set(ids)) == len(ids) - 1
    assert {0, 3, 4, 8, 13} <= set(ids) and not {1, 2, 9, 10, 11, 12} & set(ids)
    assert nearcopies.near_dedup(no_docs).collect() == []


def brute_force(texts):
    """The least place of each group of texts of a similarity of 0.8 or more."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.lower().split() for t in texts)]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            common = len(x & y)
            if root[i] != root[j] and common >= 0.8 * (len(x) + len(y) - common):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return set(root)


def template(rng, n, base, changed):
    """Texts that share a template but for words of their own."""
    for i in range(n):
        text = base[:]
        for k, at in enumerate(rng.sample(range(len(base)), changed)):
            text[at] = f"own{i}x{k}"
        yield " ".join(text)


@pytest.mark.parametrize("n", [400, 1600])
def test_family_below_the_threshold(spark, n, monkeypatch):
    """A family of texts that are alike below the threshold is verified without listing its pairs: rows grow with the documents."""
    rng = random.Random(4)
    texts = list(template(rng, n, prose(rng, 200).split(), 4))
    pairs, listed = nearcopies.similar, []
    monkeypatch.setattr(nearcopies, "similar", lambda p, *more: listed.append(p.count()) or pairs(p, *more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    kept = {r["doc_id"] for r in nearcopies.near_dedup(docs).collect()}
    assert listed[0] <= 20 * n
    if n == 400:
        assert kept == brute_force(texts)
    assert len(kept) > 0.9 * n


@pytest.mark.parametrize("n", [400, 1600])
def test_family_half_alike(spark, n, monkeypatch):
    """In a family of texts that are about half alike, which few hubs hold, rows that meet grow with the documents, not with their pairs."""
    rng = random.Random(7)
    texts = list(template(rng, n, prose(rng, 150).split(), 6))
    texts += [text + " and more" for text in texts[::40]]
    assert 0.4 < np.median([jaccard(texts[0], t) for t in texts[1:100]]) < 0.6
    meet, pairs, listed = nearcopies.meet, nearcopies.similar, []
    monkeypatch.setattr(nearcopies, "meet", lambda *args: counted(meet(*args), listed))
    monkeypatch.setattr(nearcopies, "similar", lambda p, *more: pairs(counted(p, listed), *more))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    kept = {r["doc_id"] for r in nearcopies.near_dedup(docs).collect()}
    assert max(listed) <= 20 * n
    assert kept == set(range(n))


def counted(df, counts):
    counts.append(df.count())
    return df


def test_full_buckets(spark):
    """Buckets that meet whole, cut into cells or not, connect what their pairs connect; a spanning forest comes out."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, (6, 2), np.uint64)
    flips = lambda: np.bitwise_or.reduce([np.uint64(1) << np.uint64(x) for x in rng.integers(0, 64, 9)])
    rows = []
    for i in range(240):
        c1, c2 = (int(x ^ flips()) for x in base[i % 6])
        rows.append((i, i % 4, [7], [], *[nearcopies._signed(x) for x in (c1, c2)], [], 0 if i in (0, 6) else None))
    marked = spark.createDataFrame(rows, "cls bigint, x int, segs array<bigint>, unsure array<bigint>, c1 bigint, c2 bigint, small array<bigint>, root bigint").drop("x")
    hubs = spark.createDataFrame([(7, 240)], "key bigint, c bigint")
    bits = np.array([[r[4], r[5]] for r in rows]).view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2) <= nearcopies.CHECK_MOST

    def groups(pairs):
        root = list(range(240))
        for a, b in pairs:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
        return root

    for block in (nearcopies.BLOCK, 50 * nearcopies.CELL_ROWS):
        found = [(r["a"], r["b"]) for r in nearcopies._in_full_buckets(marked, hubs, block).collect()]
        assert groups([(0, 6), *found]) == groups([(0, 6), *np.argwhere(near).tolist()])
        assert block < nearcopies.BLOCK or len(found) < 2 * 240  # two cells


def test_families_of_many_cells(spark):
    """Families cut into many cells, with a group of copies that fills several, give the groups of brute force."""
    rng = random.Random(5)
    base = prose(rng, 120).split()
    texts = list(template(rng, 120, base, 1)) + list(template(rng, 60, prose(rng, 120).split(), 3)) + list(template(rng, 60, base, 3))
    texts += [t + " and then some more" for t in texts[120:240:7]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    for block in (20_000, 100_000):
        assert {r["doc_id"] for r in nearcopies.near_dedup(docs, block=block).collect()} == brute_force(texts)
