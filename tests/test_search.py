import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.functions.text import embed, embed_text, tokenize
from vicinal.operators import bm25, fusion, hnsw, ivf, knn, mmr, radius
from vicinal.schema import METRICS, HnswConfig, IvfConfig


def vectors(spark, n, dim, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=dim)], i % 3) for i in range(n)], "id bigint, vector array<double>, grp int").repartition(3).cache()


@pytest.mark.parametrize("metric", METRICS)
def test_join_equals_top_k(spark, metric):
    items = vectors(spark, 80, 6)
    asked = items.filter("id < 5").select(F.col("id").alias("query_id"), "vector")
    joined = knn.knn_join(asked, items, 4, metric).collect()
    for q in asked.collect():
        single = [(r["rank"], r["id"], round(r["distance"], 9)) for r in knn.top_k(items, q["vector"], 4, metric).collect()]
        assert sorted((r["rank"], r["id"], round(r["distance"], 9)) for r in joined if r["query_id"] == q["query_id"]) == single


def test_top_k_rules(spark):
    items = spark.createDataFrame([("e1", [1.0, 0.0, 0.0, 0.0], 1), ("e2", [0.0, 1.0, 0.0, 0.0], 2), ("d", [1.0, 1.0, 0.0, 0.0], 2)], "id string, vector array<double>, g int")
    got = knn.top_k(items, [1, 0, 0, 0], 2).collect()
    assert [(r["rank"], r["id"]) for r in got] == [(1, "e1"), (2, "d")] and got[0]["score"] == pytest.approx(1)
    assert knn.top_k(items, [1, 0, 0, 0], 0).collect() == []
    assert [r["id"] for r in knn.top_k(items, [1, 0, 0, 0], 5, where=F.col("g") == 2).collect()] == ["d", "e2"]
    assert "vector" in knn.top_k(items, [1, 0, 0, 0], 1, include_vector=True).columns
    with pytest.raises(ValueError):
        knn.check_dimension([1], 2)
    pairs = radius.radius_join(items, items, 1.0).collect()
    assert {(r["left_id"], r["right_id"]) for r in pairs} >= {("e1", "d"), ("d", "e2"), ("e1", "e1")} and ("e1", "e2") not in {(r["left_id"], r["right_id"]) for r in pairs}


def test_ivf(spark):
    items = vectors(spark, 60, 4, 1)
    centroids = ivf.train(items, "cosine", IvfConfig(nlist=4, max_iterations=5))
    indexed = ivf.layout(items, centroids, "cosine")
    assert len(centroids) == 4 and ivf.list_sizes(indexed).agg(F.sum("n")).first()[0] == 60
    q = items.filter("id = 7").first()["vector"]
    flat = knn.top_k(items, q, 5).collect()
    assert ivf.search(indexed, centroids, q, 5, nprobe=4).collect() == flat
    assert ivf.search(indexed, centroids, q, 5, nprobe=1).first()["id"] == 7
    few = ivf.search(indexed, centroids, q, 10, where=F.col("grp") == 1, nprobe=1)
    assert [r["id"] for r in few.collect()] == [r["id"] for r in knn.top_k(items, q, 10, where=F.col("grp") == 1).collect()]
    assert ivf.train(items, "cosine", IvfConfig(nlist=4, max_iterations=5)) == centroids


def test_hnsw(spark):
    items = vectors(spark, 150, 8, 2)
    config = HnswConfig(m=8, ef_construction=64, ef_search=64)
    graphs = hnsw.build(items, "euclidean", config, shards=2).cache()
    asked = items.filter("id < 12").orderBy("id").collect()
    truth = {r["id"]: [x["id"] for x in knn.top_k(items, r["vector"], 10, "euclidean").collect()] for r in asked}
    hits = sum(len(set(truth[r["id"]]) & {x["id"] for x in hnsw.search(graphs, items, r["vector"], 10, "euclidean", config=config).collect()}) for r in asked)
    assert hits >= 0.8 * 120
    got = hnsw.search(graphs, items, asked[0]["vector"], 60, "euclidean", F.col("grp") == 0, config=config).collect()
    assert len(got) == 50 and got[0]["id"] == 0  # fewer hits than asked for: the exact answer
    for r in hnsw.graph_stats(graphs).collect():
        assert r["avg_links"] <= config.m0 and (r["layer"] == 0 or r["avg_links"] <= config.m)
    whole = hnsw.Graph(np.array([r["vector"] for r in items.orderBy("id").collect()]), "euclidean", config, 1)
    assert [n for _, n in whole.search(np.array(asked[3]["vector"]), 10, 150)][:10] == truth[3]
    levels = [whole.level() for _ in range(3000)]
    assert max(levels) < config.max_layers and levels.count(0) > 2000


CORPUS = [("d1", "The quick brown fox"), ("d2", "the lazy brown dog; brown!"), ("d3", "sparse matrix product"), ("d4", ""), ("d5", None), ("d6", "!!!")]


def slow_bm25(text, k1=1.5, b=0.75):
    import re

    docs = {i: re.findall(r"\w+", t.lower()) for i, t in CORPUS if t}
    avg = sum(map(len, docs.values())) / len(docs)
    out = {}
    for term in re.findall(r"\w+", text.lower()):
        df = sum(term in d for d in docs.values())
        idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        for i, d in docs.items():
            if tf := d.count(term):
                out[i] = out.get(i, 0) + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / avg))
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("text", ["brown", "sparse matrix", "the the fox", "unknown", "", "BROWN dog"])
def test_bm25(spark, text):
    docs = spark.createDataFrame(CORPUS, "id string, document string")
    want = slow_bm25(text)
    got = [(r["id"], r["score"]) for r in bm25.search(docs, text, 10).collect()]
    stored = [(r["id"], r["score"]) for r in bm25.search_postings(bm25.postings(docs), bm25.doc_lengths(docs), text, 10).collect()]
    for found in (got, stored):
        assert [i for i, _ in found] == [i for i, _ in want] and [s for _, s in found] == pytest.approx([s for _, s in want])
    some = bm25.search(docs, text, 10, F.col("id") != "d2").collect()
    assert [(r["id"], pytest.approx(r["score"])) for r in some] == [(i, s) for i, s in want if i != "d2"]


def test_tokens(spark):
    row = spark.range(1).select(tokenize(F.lit("Über_x, naïve 12 — 漢字!")).alias("t"), tokenize(F.lit(None).cast("string")).alias("n")).first()
    assert row["t"] == ["über_x", "naïve", "12", "漢字"] and row["n"] == []


def ranking(spark, pairs):
    return spark.createDataFrame([(i, float(s), n + 1) for n, (i, s) in enumerate(pairs)], "id string, score double, rank bigint")


def test_fusion(spark):
    dense, sparse = ranking(spark, [("a", 0.9), ("b", 0.8), ("c", 0.7)]), ranking(spark, [("b", 5), ("d", 4), ("a", 3)])
    got = fusion.fuse_rrf(dense, sparse, 4).collect()
    assert [r["id"] for r in got] == ["b", "a", "d", "c"] and (got[0]["dense_rank"], got[0]["sparse_rank"]) == (2, 1) and got[2]["dense_rank"] == 4
    assert got[0]["combined_score"] == pytest.approx(1 / 62 + 1 / 61)
    d, s = ranking(spark, [("x", 1.0), ("m", 0.5), ("y", 0.0)]), ranking(spark, [("p", 10), ("m", 5), ("q", 0)])
    for alpha, first in ((1, "x"), (0, "p"), (7, "x")):
        assert fusion.fuse_linear(d, s, 1, alpha).first()["id"] == first
    assert {r["id"]: r["combined_score"] for r in fusion.fuse_linear(d, s, 9, 0.5).collect()}["m"] == pytest.approx(0.5)
    flat = fusion.fuse_linear(ranking(spark, [("a", 2.0), ("b", 2.0)]), s.limit(0), 5, 0.5).collect()
    assert [r["combined_score"] for r in flat] == [0.5, 0.5]
    with pytest.raises(ValueError):
        fusion.hybrid(d, [1.0], "x", 1, fusion="other")


def test_mmr(spark):
    items = spark.createDataFrame([("1", [1.0, 0.0, 0.0]), ("2", [0.99, 0.01, 0.0]), ("3", [0.7, 0.7, 0.0])], "id string, vector array<double>")
    assert [r["id"] for r in mmr.diverse_top_k(items, [1.0, 0, 0], 2, lam=1.0).collect()] == ["1", "2"]
    got = mmr.diverse_top_k(items, [1.0, 0, 0], 2, lam=0.3).collect()
    assert [r["id"] for r in got] == ["1", "3"] and got[0]["score"] == pytest.approx(1.0)
    assert mmr.diverse_top_k(items.limit(0), [1.0, 0, 0], 2).collect() == []


def test_embedder(spark):
    texts = ["Hello world hello", "", None, "a é漢 cat", "x" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r["id"]: r["vector"] for r in embed(df, "text", "id", 32).collect()}
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(embed_text(t or "", 32))
    assert len(embed_text("a", 0)) == 64 and sum(x * x for x in embed_text("hello")) == pytest.approx(1) and embed_text("") == [0.0] * 64


def test_recall(spark):
    truth = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7), (2, 2, 8)], "query_id int, rank int, id int")
    found = spark.createDataFrame([(1, 1, 6), (1, 2, 5), (2, 1, 9), (2, 2, 8)], "query_id int, rank int, id int")
    assert tuple(knn.recall_at_k(found, truth, 2).first()) == (2, 0.75)


def test_batch_searches(spark):
    """Joins over inverted files and graphs against the exact join; null vectors meet nothing."""
    import numpy as np

    from vicinal.operators import hnsw, ivf

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    items = spark.createDataFrame([*rows, (900, None), (901, [1.0, None] * 4)], "id bigint, vector array<double>")
    asked = spark.createDataFrame([*rows[:40], (950, None)], "query_id bigint, vector array<double>")
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    truth = knn.knn_join(asked, items, 5, same_table=True)
    assert len(key(truth)) == 200
    fine = items.filter("id < 900")
    centroids = [rows[i][1] for i in range(6)]
    indexed = ivf.layout(fine, centroids, "cosine")
    assert key(ivf.knn_join(indexed, centroids, asked, 5, nprobe=6, same_table=True)) == key(truth)
    some = ivf.knn_join(indexed, centroids, asked, 5, nprobe=3, same_table=True)
    assert knn.recall_at_k(some, truth, 5).first()["recall"] > 0.6
    graphs = hnsw.build(fine, "cosine", shards=2).persist()
    found = hnsw.knn_join(graphs, asked.filter("vector is not null"), 5, same_table=True)
    assert knn.recall_at_k(found, truth, 5).first()["recall"] >= 0.9
    graphs.unpersist()


def test_graphs_are_plain_arrays():
    import numpy as np

    from vicinal.operators.hnsw import Graph
    from vicinal.schema import HnswConfig

    x = np.random.default_rng(1).normal(size=(60, 4))
    graph = Graph(x, "euclidean", HnswConfig(), 3)
    again = Graph.load(graph.dump(), "euclidean", HnswConfig())
    assert again.layers == graph.layers and again.entry == graph.entry and again.search(x[5], 3, 10) == graph.search(x[5], 3, 10)
    empty = Graph.load(Graph(x[:0], "euclidean", HnswConfig(), 3).dump(), "euclidean", HnswConfig())
    assert empty.search(x[0], 3, 10) == []


def test_null_vectors_have_no_cluster(spark):
    from vicinal.operators.lloyd import assign

    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, None]), (4, [0.0, 2.0])], "id int, vector array<double>").coalesce(1)
    assert [(r["id"], r["cluster"]) for r in assign(df, [[1.0, 0.0], [0.0, 1.0]], "euclidean").orderBy("id").collect()] == [(1, 0), (2, None), (3, None), (4, 1)]


def test_stored_postings_give_the_same_ranking(spark, tmp_path):
    from vicinal.operators import bm25

    docs = spark.createDataFrame([(1, "the red fox"), (2, "the the dog"), (3, None), (4, ""), (5, "a fox, a dog and a fox")], "id bigint, document string")
    bm25.write_index(docs, str(tmp_path / "index"))
    for text in ("fox the", "dog", "none", ""):
        want = [(r["rank"], r["id"], round(r["score"], 9)) for r in bm25.search(docs, text, 3).filter("score > 0").orderBy("rank").collect()]
        got = [(r["rank"], r["id"], round(r["score"], 9)) for r in bm25.search_index(spark, str(tmp_path / "index"), text, 3).orderBy("rank").collect()]
        assert [(a, str(b), c) for a, b, c in got] == [(a, str(b), c) for a, b, c in want]


def _files(path):
    """Every data file below a folder, with when it was written and what it holds."""
    return {str(f.relative_to(path)): (f.stat().st_mtime_ns, f.read_bytes()) for f in path.rglob("*.parquet")}


def _points(n, seed=4, dimension=12):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(n, dimension)))]


def test_graph_upkeep(spark, tmp_path):
    """A fifth goes and a fifth comes: recall holds, nothing that is gone is found, and other shards' files stay as they were."""
    from vicinal.operators import hnsw, knn

    frame = spark.createDataFrame(_points(1200), "id bigint, vector array<double>").persist()
    path = tmp_path / "graphs"
    hnsw.write(hnsw.build(frame.filter("id % 5 <> 4"), "euclidean", shards=4), str(path))
    hnsw.upkeep(spark, str(path), frame.filter("id % 5 = 4"), frame.filter("id % 5 = 1").select("id"), "euclidean")
    now, asked = frame.filter("id % 5 <> 1"), frame.filter("id % 20 = 0").selectExpr("id AS query_id", "vector")
    found = hnsw.knn_join(hnsw.read(spark, str(path)), asked, 10, metric="euclidean", same_table=True).persist()
    truth = knn.knn_join(asked, now, 10, "euclidean", same_table=True)
    assert knn.recall_at_k(found, truth, 10).first()["recall"] >= 0.9
    assert found.filter("id % 5 = 1").count() == 0
    stored = hnsw.read(spark, str(path)).select(F.explode("ids").alias("id"))
    assert stored.exceptAll(now.select("id")).count() == 0 and now.select("id").exceptAll(stored).count() == 0
    # a moved vector and a deletion in one shard each
    before = _files(path)
    shard = {r["id"]: r["shard"] for r in hnsw.read(spark, str(path)).select("shard", F.explode("ids").alias("id")).collect()}
    gone, moved = [i for i in sorted(shard) if shard[i] == 0][:1], [i for i in sorted(shard) if shard[i] == 2][:1]
    hnsw.upkeep(spark, str(path), spark.createDataFrame([(moved[0], [50.0] * 12)], frame.schema), spark.createDataFrame([(i,) for i in gone + moved], "id bigint"), "euclidean")
    after = _files(path)
    same = {f for f in before if f in after and before[f] == after[f]}
    assert {f.split("/")[0] for f in before.keys() - same} == {"shard=0", "shard=2"} == {f.split("/")[0] for f in after.keys() - same}
    far = hnsw.knn_join(hnsw.read(spark, str(path)), spark.createDataFrame([(0, [49.0] * 12)], "query_id int, vector array<double>"), 1, metric="euclidean").first()
    assert far["id"] == moved[0]
    # all rows of all shards go, and some come back
    hnsw.upkeep(spark, str(path), frame.limit(0), frame.select("id"), "euclidean")
    assert hnsw.read(spark, str(path)).agg(F.sum("n")).first()[0] == 0
    assert hnsw.knn_join(hnsw.read(spark, str(path)), asked, 10, metric="euclidean").collect() == []
    hnsw.upkeep(spark, str(path), frame.filter("id < 50"), frame.limit(0).select("id"), "euclidean")
    back = hnsw.knn_join(hnsw.read(spark, str(path)), asked.filter("query_id < 50"), 1, metric="euclidean").collect()
    assert sorted(r["id"] for r in back) == [0, 20, 40]


@pytest.mark.parametrize("share", [0.2, 0.6, 0.95])
def test_graph_removal(share):
    """Whatever share goes, the graph stays in one piece from its entry, and its lists hold only rows that are left."""
    from vicinal.operators.hnsw import Graph
    from vicinal.schema import HnswConfig

    vectors = np.array([v for _, v in _points(300)])
    graph = Graph(vectors, "euclidean", HnswConfig(), 1)
    gone = set(np.random.default_rng(2).choice(300, int(300 * share), replace=False).tolist()) | {graph.entry}
    kept = [i for i in range(300) if i not in gone]
    graph.remove(gone)
    assert np.array_equal(graph.vectors, vectors[kept]) and 0 <= graph.entry < len(kept)
    for layer in graph.layers:
        assert all(0 <= x < len(kept) and x != n for n, own in layer.items() for x in own) and layer.keys() >= {x for own in layer.values() for x in own}
    assert set(graph.layers[0]) == set(range(len(kept)))
    hits = 0
    for q in range(0, len(kept), 5):
        near = set(np.argsort(((graph.vectors - graph.vectors[q]) ** 2).sum(axis=1), kind="stable")[:5].tolist())
        hits += len(near & {n for _, n in graph.search(graph.vectors[q], 5, 64)[:5]})
    assert hits >= 0.9 * min(5, len(kept)) * len(range(0, len(kept), 5))
    again = Graph.load(graph.dump(), "euclidean", HnswConfig())
    again.add(vectors[sorted(gone)])
    assert len(again.vectors) == 300 and again.search(vectors[min(gone)], 1, 32)[0][1] == len(kept)


def test_list_upkeep(spark, tmp_path):
    """Changes rewrite the folders of their lists only, and answers are those of lists laid out anew."""
    from vicinal.operators import ivf

    frame = spark.createDataFrame(_points(800), "id bigint, vector array<double>").persist()
    centroids = ivf.train(frame, "euclidean", IvfConfig(nlist=8, max_iterations=4))
    path = tmp_path / "lists"
    ivf.write(frame.filter("id < 700"), centroids, "euclidean", str(path))
    own = {r["id"]: r["centroid_id"] for r in ivf.layout(frame, centroids, "euclidean").collect()}
    out, come = [i for i in range(700) if own[i] == 2][:9], [i for i in range(700, 800) if own[i] in (2, 5)]
    before = _files(path)
    touched = ivf.upkeep(spark, str(path), centroids, frame.filter(F.col("id").isin(come)), spark.createDataFrame([(i,) for i in out], "id bigint"), "euclidean")
    after = _files(path)
    assert touched == sorted({own[i] for i in out + come})
    same = {f for f in before if f in after and before[f] == after[f]}
    assert {f.split("/")[0] for f in before.keys() - same} == {f"centroid_id={c}" for c in touched}
    now = frame.filter((F.col("id") < 700) & ~F.col("id").isin(out) | F.col("id").isin(come))
    fresh = ivf.layout(now, centroids, "euclidean")
    for q in (3, 77, come[0]):
        vector = frame.filter(F.col("id") == q).first()["vector"]
        for nprobe in (1, 3, 8):
            assert ivf.search(ivf.read(spark, str(path)), centroids, vector, 10, "euclidean", nprobe=nprobe).collect() == ivf.search(fresh, centroids, vector, 10, "euclidean", nprobe=nprobe).collect()
    # a list that loses all its rows loses its folder
    ivf.upkeep(spark, str(path), centroids, frame.limit(0), frame.filter(F.col("id").isin([i for i in own if own[i] == 5])).select("id"), "euclidean")
    assert not (path / "centroid_id=5").exists() and ivf.read(spark, str(path)).filter("centroid_id = 5").count() == 0
    assert ivf.upkeep(spark, str(path), centroids, frame.limit(0), frame.limit(0).select("id"), "euclidean") == []


def test_routed_graphs(spark, tmp_path):
    """Queries read a quarter of the shards at most - the others' files are spoilt - and still find 0.9; changes find their shards."""
    from vicinal.operators import hnsw, ivf, knn

    rng = np.random.default_rng(6)
    middles = rng.normal(scale=2.0, size=(40, 8))
    rows = [(i, [float(x) for x in middles[i % 40] + rng.normal(scale=0.6, size=8)]) for i in range(1600)]
    frame = spark.createDataFrame(rows, "id bigint, vector array<double>").persist()
    centroids = ivf.train(frame, "euclidean", IvfConfig(nlist=12, max_iterations=8))
    path = tmp_path / "graphs"
    hnsw.write(hnsw.build(frame.filter("id % 5 <> 4"), "euclidean", centroids=centroids), str(path))
    hnsw.upkeep(spark, str(path), frame.filter("id % 5 = 4"), frame.filter("id % 5 = 1").select("id"), "euclidean", centroids=centroids)
    stored = hnsw.read(spark, str(path)).select("shard", F.explode("ids").alias("id")).collect()
    assert {r["id"] for r in stored} == {i for i, _ in rows if i % 5 != 1} and 1280 < len(stored) < 2 * 1280
    now, asked = frame.filter("id % 5 <> 1"), frame.filter("id % 40 = 0").selectExpr("id AS query_id", "vector")
    truth = knn.knn_join(asked, now, 10, "euclidean", same_table=True)
    found = hnsw.knn_join(hnsw.read(spark, str(path)), asked, 10, metric="euclidean", same_table=True, centroids=centroids, nprobe=3)
    got = found.collect()
    assert len({(r["query_id"], r["id"]) for r in got}) == len(got)
    assert knn.recall_at_k(spark.createDataFrame(got, found.schema), truth, 10).first()["recall"] >= 0.9
    one = frame.filter("id = 0").first()["vector"]
    near = ivf.probes(one, centroids, 3, "euclidean")
    before = [r["id"] for r in hnsw.search(hnsw.read(spark, str(path)), now, one, 10, "euclidean", centroids=centroids, nprobe=3).collect()]
    table = hnsw.read(spark, str(path))
    for file in path.glob("shard=*/*.parquet"):
        if int(file.parent.name.split("=")[1]) not in near:
            file.write_bytes(b"spoilt")
    assert [r["id"] for r in hnsw.search(table, now, one, 10, "euclidean", centroids=centroids, nprobe=3).collect()] == before
    with pytest.raises(Exception):
        hnsw.search(table, now, one, 10, "euclidean").collect()


def test_stored_postings(spark, tmp_path):
    """Blocks that cannot hold one of the best are left out and the ranking stays that of a full search, filtered or not."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40), p=np.arange(40, 0, -1) / 820)) for _ in range(900)]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("none", None), ("empty", ""), ("marks", "!!")], "id string, document string").persist()
    path = str(tmp_path / "index")
    bm25.write_index(docs, path, block_docs=4)
    allowed = docs.filter("id LIKE '%7%'").select("id")
    for text, k in (("w39 w38", 3), ("w0 w1 W1", 10), ("w39 nowhere", 5), ("nowhere", 3), ("w20", 2000), ("", 4)):
        for only in (None, allowed):
            got = [(r["id"], round(r["score"], 9)) for r in bm25.search_index(spark, path, text, k, only).orderBy("rank").collect()]
            every = bm25.search(docs, text, None, F.col("id").like("%7%") if only is not None else None).select("id", "score").collect()
            assert got == sorted(((r["id"], round(r["score"], 9)) for r in every), key=lambda x: (-x[1], x[0]))[:k]
    seen = []
    real = bm25.search_postings
    bm25.search_postings = lambda post, *a, **b: seen.append(post) or real(post, *a, **b)
    try:
        bm25.search_index(spark, path, "w39 w2", 3).collect()
    finally:
        bm25.search_postings = real
    whole = docs.filter(F.col("document").rlike(r"\bw(39|2)\b")).count()
    assert seen[-1].select("id").distinct().count() < whole / 2


def test_beam_is_as_wide_as_the_graphs_ask_for(spark):
    """Vectors without near neighbours in many shards, each there three times: the default beam finds too few, the measured one 0.9."""
    from vicinal.operators import hnsw, knn
    from vicinal.schema import HnswConfig

    rng = np.random.default_rng(11)
    rows = [(i, [float(x) * (1 + i % 3) for x in v]) for i, v in enumerate(np.tile(rng.normal(size=(1500, 48)), (3, 1)))]
    frame = spark.createDataFrame(rows, "id bigint, vector array<double>").persist()
    asked, config = frame.filter("id % 25 = 0").selectExpr("id AS query_id", "vector"), HnswConfig(m=5, ef_construction=20, ef_search=11)
    graphs = hnsw.build(frame, "cosine", config, shards=3).persist()
    truth = knn.knn_join(asked, frame, 10, same_table=True).persist()
    share = lambda ef: knn.recall_at_k(hnsw.knn_join(graphs, asked, 10, ef, config=config, same_table=True), truth, 10).first()["recall"]
    ef = hnsw.beam_width(graphs, frame, asked, 10, config=config, same_table=True)
    assert share(None) < 0.9 <= share(ef) and ef < 1500


def test_copies_tie_by_id(spark):
    """Copies of a vector of other lengths are equally far, whatever the order of sums makes of them."""
    from vicinal.operators import knn

    rng = np.random.default_rng(12)
    rows = [(i, [float(x) * (1 + i % 7) / 3 for x in v]) for i, v in enumerate(np.tile(rng.normal(size=(20, 64)), (30, 1)))]
    frame = spark.createDataFrame(rows, "id bigint, vector array<double>")
    got = {}
    for r in knn.knn_join(frame.filter("id < 60").selectExpr("id AS query_id", "vector"), frame, 5, same_table=True).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {q: [i for i in range(q % 20, 600, 20) if i != q][:5] for q in range(60)}
