import io
import json
import threading
import urllib.error
import urllib.request
from pathlib import Path

import pytest

from vicinal.schema import CollectionConfig
from vicinal.service import cli, rest, rpc
from vicinal.service.api import Store, benchmark, quantize
from vicinal.sources import files, vdb
from vicinal.sources.collection import Collection
from vicinal.streaming import ingest


def rows(n=6):
    return [{"id": f"v{i}", "vector": [float(i == j) for j in range(3)] + [float(i)], "metadata": {"tag": f"g{i % 2}", "n": i}, "document": f"text number {i}"} for i in range(n)]


@pytest.fixture
def made(spark, tmp_path):
    c = Collection.create(spark, tmp_path, CollectionConfig("c", 4, "euclidean", "flat"))
    c.insert(c.from_rows(rows()))
    return c


def test_changes(made, spark):
    assert made.count() == 6 and made.get("v1")["document"] == "text number 1" and made.get("nope") is None
    with pytest.raises(ValueError):
        made.insert(made.from_rows(rows(1)))
    with pytest.raises(ValueError):
        made.insert(made.from_rows([{"id": "x", "vector": [0, 0, 0, 0]}] * 2))
    made.upsert(made.from_rows([{"id": "v0", "vector": [9, 9, 9, 9]}, {"id": "v0", "vector": [8, 8, 8, 8]}, {"id": "new", "vector": [1, 1, 1, 1]}]))
    assert made.count() == 7 and made.get("v0")["vector"] == [8] * 4
    assert [r["id"] for r in made.filter(None, 100).collect()][-2:] == ["v0", "new"]  # an updated row moves to the end
    assert made.delete(["v1", "nope"]) == 1 and made.delete(["v1"]) == 0 and made.count() == 6
    assert [(r["pos"], r["id"], r["document"]) for r in made.get_batch(["v2", "nope", "v3"]).collect()] == [(0, "v2", "text number 2"), (1, "nope", None), (2, "v3", "text number 3")]
    with pytest.raises(Exception, match="dimensions"):
        made.upsert(made.from_rows([{"id": "bad", "vector": [1]}]))
    assert made.count() == 6
    made.clear()
    assert made.count() == 0 and Collection.open(spark, made.path.parent, "c").config == made.config


@pytest.mark.parametrize("index", ["flat", "ivf", "hnsw"])
def test_queries(made, index):
    made.rebuild_index(index)
    top = made.query([0, 1, 0, 1], 2, include_vector=True).collect()
    assert (top[0]["id"], top[0]["distance"]) == ("v1", 0) and top[0]["vector"] == [0, 1, 0, 1] and len(top) == 2
    assert {r["id"] for r in made.query([0, 1, 0, 1], 9, {"tag": "g0"}).collect()} == {"v0", "v2", "v4"}
    with pytest.raises(ValueError):
        made.query([1.0])
    assert made.text_search("number 3").first()["id"] == "v3"
    assert made.hybrid([0, 0, 1, 2], "number 2", 1).first()["id"] == "v2"
    assert len(made.diverse_query([0, 0, 1, 2], 3).collect()) == 3
    assert made.filter({"n": {"$gte": 4}}).count() == 2 and made.filter({"tag": "g1"}, 2).count() == 2
    s = made.stats()
    assert (s["count"], s["dimension"], s["has_sparse_index"]) == (6, 4, True) and (index != "hnsw" or s["layers_count"] > 0)
    assert made.cluster(2).summary["k"] == 2


@pytest.mark.parametrize("kind", ["json", "vdb"])
def test_files(made, spark, tmp_path, kind):
    path = str(tmp_path / "out.bin")
    made.save(path, kind)
    assert files.detect_format(path) == kind
    again = Collection.load(spark, tmp_path / "other", path)
    key = lambda c: [(r["id"], r["vector"], json.loads(r["metadata"]), r["document"]) for r in c.items().orderBy("ord").collect()]
    assert key(again) == key(made) and again.config == made.config


def test_one_file_is_read_by_many_tasks(spark, tmp_path, monkeypatch):
    rows = [(f"i{i}", [float(i), 0.5], f'{{"n": {i}}}', "x" * (i % 50) if i % 3 else None, float(i)) for i in range(1000)]
    path = str(tmp_path / "one.vdb")
    assert vdb.write_file(path, {"dimension": 2}, iter(rows)) == 1000
    with open(path, "rb") as f:
        config, count, items = vdb.unpack(f)
        assert (config, count, [r[0] for r in items]) == ({"dimension": 2}, 1000, [r[0] for r in rows])
    runs = vdb.splits(path, 5000)
    assert len(runs) > 5 and sum(n for _, _, n in runs) == 1000 and vdb.splits(path, 1 << 30)[0][1:] == (0, 1000)
    monkeypatch.setattr(vdb, "SPLIT_BYTES", 5000)
    reader = vdb._Reader({"path": path})
    parts = reader.partitions()
    assert len(parts) == len(runs)
    assert [(*r[:4], r[5]) for p in parts for r in reader.read(p)] == [(i, v, m, d or None, n) for n, (i, v, m, d, _) in enumerate(rows)]
    vdb.write_file(path, {"dimension": 2}, iter([]))
    assert vdb.splits(path, 10) == [] and reader.partitions() == []
    vdb.register(spark)
    vdb.write_file(path, {"dimension": 2}, iter(rows))
    assert [r["id"] for r in spark.read.format("vdb").load(path).orderBy("ord").collect()] == [r[0] for r in rows]


def test_json_is_written_as_tasks_write_it(spark, tmp_path, monkeypatch):
    """Blocks of a few bytes give the same file; order is kept over many parts; nothing is left behind; no items give a file, too."""
    from vicinal.session import shared_folder
    from vicinal.sources import jsonl

    monkeypatch.setattr(jsonl, "_BLOCK", 7)
    items = spark.range(300).selectExpr("cast(id AS string) AS id", "array(1D, id) AS vector", "'{\"a\": 1}' AS metadata", "'é, \"x\"\n' AS document", "1D AS created_at", "300 - id AS ord").repartition(5)
    path = tmp_path / "all.json"
    before = set(Path(shared_folder(spark)).iterdir())
    jsonl.write_json(items, {"name": "c", "dimension": 2}, str(path))
    got = json.loads(path.read_text())
    assert [int(r["id"]) for r in got["items"]] == list(range(299, -1, -1)) and got["items"][0]["document"] == 'é, "x"\n' and got["config"]["name"] == "c"
    assert set(Path(shared_folder(spark)).iterdir()) == before and jsonl.read_json(spark, str(path))[1].count() == 300
    jsonl.write_json(items.limit(0), {"name": "c"}, str(path))
    assert json.loads(path.read_text())["items"] == []


def test_jsonl(made, spark, tmp_path):
    path = str(tmp_path / "lines")
    assert made.export_jsonl(path) == 6
    (tmp_path / "lines" / "more.txt").write_text('\n{"id": "t", "vector": [1,2,3,4], "text": "from text"}\n')
    other = Collection.create(spark, tmp_path / "b", CollectionConfig("b", 4))
    assert other.import_jsonl(path) == 7 and other.get("t")["document"] == "from text" and other.get("t")["created_at"] > 0
    assert json.loads(other.get("v1")["metadata"]) == {"tag": "g1", "n": 1}


def test_binary_format():
    raw = vdb.header({"dimension": 2}, 2) + vdb.pack_item("é", [0.1, 2], None, None, None) + vdb.pack_item("b", [3, 4], '{"a":1}', "d", 5.0)
    config, count, items = vdb.unpack(io.BytesIO(raw))
    got = list(items)
    assert raw[:4] == b"VDB\x01" and config == {"dimension": 2} and count == 2
    assert got[0][0] == "é" and got[0][3] is None and got[0][1] == pytest.approx([0.1, 2], abs=1e-7) and got[1] == ("b", [3, 4], '{"a":1}', "d", 5.0)
    with pytest.raises(ValueError):
        vdb.unpack(io.BytesIO(b"nope" * 9))
    with pytest.raises(ValueError):
        vdb.pack_item("x" * 70_000, [], None, None, None)


@pytest.mark.parametrize("bad", ["../x", "..", "/etc/passwd", "a/../../b"])
def test_paths(tmp_path, bad):
    with pytest.raises(ValueError):
        files.safe_path(tmp_path, bad)
    with pytest.raises(ValueError):
        files.safe_name(bad)


def test_file_helpers(tmp_path):
    assert files.safe_json_read(tmp_path / "no", 5) == 5
    files.atomic_write(tmp_path / "d" / "a.json", '{"x": 1}')
    assert files.safe_json_read(tmp_path / "d" / "a.json") == {"x": 1} and [p.name for p in (tmp_path / "d").iterdir()] == ["a.json"]
    assert files.safe_delete(tmp_path / "d") and not files.safe_delete(tmp_path / "d")


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, tmp_path / "store")
    s.create("docs", 4, "euclidean", "flat")
    s.put("docs", rows())
    return s


def test_cli(store, capsys):
    ask = lambda *a: cli.run(cli.parser().parse_args(list(a)), store)
    assert ask("create", "n", "-d", "3", "-m", "dot", "-i", "flat")["metric"] == "dot_product"
    assert ask("insert", "n", "--id", "a", "-v", "1,2,3", "--meta", "k=v", "--doc", "hello") == {"upserted": ["a"]}
    assert ask("query", "n", "-v", "[1,2,3]", "-k", "1", "-f", '{"k": "v"}')[0]["id"] == "a"
    assert ask("hybrid", "docs", "number 5", "-v", "0,0,0,5", "-k", "1")[0]["id"] == "v5"
    assert len(ask("embed", "hi", "-d", "8")["vector"]) == 8
    assert ask("stats", "n")["count"] == 1 and {c["name"] for c in ask("list")} == {"docs", "n"}
    assert ask("cluster", "docs", "-k", "2")["k"] == 2 and "spark" in ask("doctor") and all(ask("test").values())
    assert cli.parser().parse_args(["--json", "list"]).json and cli.parser().parse_args(["list", "--json"]).json
    assert "id" in cli.show([{"id": "a", "score": 0.5}])
    assert cli.main(["stats", "missing"]) == 1 and "error" in capsys.readouterr().err


def test_rpc(store):
    server = rpc.Server(store)

    def ask(method, **params):
        return server.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))

    def tool(tool_name, **a):
        return json.loads(ask("tools/call", name=tool_name, arguments=a)["result"]["content"][0]["text"])

    assert ask("initialize")["result"]["serverInfo"]["name"] == "vicinal" and len(ask("tools/list")["result"]["tools"]) == 10 and ask("ping")["result"] == {}
    assert tool("vector_query", collection="docs", vector=[0, 1, 0, 1], top_k=1)[0]["id"] == "v1"
    assert tool("vector_upsert", collection="docs", documents=[{"id": "t", "text": "some words"}])["ids"] == ["t"]
    assert tool("vector_hybrid_search", collection="docs", query_text="some words", top_k=1)[0]["id"] == "t"
    assert tool("vector_quantize", vector=[1, -1, 0.5], mode="binary")["code_hex"] == "a0" and tool("vector_collection_stats", collection="docs")["count"] == 7
    assert len(tool("vector_list_collections")["collections"]) == 1 and "spark" in tool("vector_diagnostics") and tool("vector_embed_text", text="x", dim=8)["dimension"] == 8
    assert tool("vector_create_collection", name="z", dimension=2)["dimension"] == 2 and len(tool("vector_cluster_analysis", collection="docs", k=2)["clusters"]) == 2
    assert json.loads(ask("resources/read", uri="vector://collections")["result"]["contents"][0]["text"]) and "red foxes" in ask("prompts/get", name="vector_rag_retrieval_prompt", arguments={"query": "red foxes"})["result"]["messages"][0]["content"]["text"]
    codes = [server.handle(x) for x in ("{", "[]", '{"id": 1, "method": "none"}', '{"method": "ping"}')]
    assert [c and c["error"]["code"] for c in codes] == [-32700, -32600, -32601, None]
    assert ask("tools/call", name="nope")["error"]["code"] == -32603
    out = io.StringIO()
    server.run(io.StringIO('{"id": 2, "method": "ping"}\n\n'), out)
    assert json.loads(out.getvalue()) == {"jsonrpc": "2.0", "id": 2, "result": {}}


def test_rest(store):
    server = rest.make_server(store, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}/api"

    def ask(method, path, body=None, **headers):
        request = urllib.request.Request(base + path, json.dumps(body).encode() if body is not None else None, headers, method=method)
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    assert ask("GET", "/health") == (200, {"status": "ok"}) and ask("GET", "/nothing")[0] == 404 and ask("GET", "/collections/none")[0] == 404
    assert ask("POST", "/collections", {"name": "r", "dimension": 2, "metric": "euclidean", "index_type": "hnsw"})[0] == 201
    assert ask("POST", "/collections/r/insert", {"documents": [{"id": "a", "vector": [1, 0]}, {"id": "b", "vector": [0, 1]}]})[1]["ids"] == ["a", "b"]
    assert ask("POST", "/collections/r/query", {"vector": [1, 0], "k": 1})[1]["results"][0]["id"] == "a"
    assert ask("POST", "/collections/docs/hybrid", {"query": "number 4", "vector": [0, 0, 0, 4], "k": 1})[1]["results"][0]["id"] == "v4"
    assert len(ask("GET", "/collections/r/items")[1]["items"]) == 2 and ask("GET", "/collections/docs/clusters?k=2")[1]["k"] == 2 and ask("GET", "/collections/r/stats")[1]["count"] == 2
    assert ask("POST", "/collections/r/insert", {"documents": [{"id": "x"}]})[0] == 400 and ask("POST", "/collections", {"name": "../x", "dimension": 2})[0] == 400
    assert ask("DELETE", "/collections/r", Origin="http://evil.example")[0] == 403 and ask("DELETE", "/collections/r", Origin="http://localhost:3000")[0] == 200
    assert ask("GET", "/collections/%2e%2e/stats")[0] == 400
    server.shutdown()
    server.server_close()


@pytest.mark.parametrize("origin,ok", [(None, True), ("http://127.0.0.1:8000", True), ("http://localhost", True), ("http://[::1]:1", True), ("https://localhost.evil.com", False), ("null", False)])
def test_origins(origin, ok):
    assert rest.local_origin(origin) is ok


def test_benchmark_and_quantize(spark):
    found = benchmark(spark, 100, 8, 10, 5)
    assert found["recall"] >= 0.5 and found["n"] == 100
    q = quantize([0.0, 0.5, 1.0])
    assert q["code_hex"] == "0080ff" and q["ratio"] == 4 and q["cosine_reconstruction"] > 0.99
    with pytest.raises(ValueError):
        quantize([1.0], "other")


def test_streams(made, spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"id": "v0", "vector": [7,7,7,7]}\n{"id": "s", "vector": [1,2,3,4], "metadata": {"k": 1}}\n')
    ingest.upsert_stream(made, str(folder), str(tmp_path / "cp")).awaitTermination()
    assert made.count() == 7 and made.get("v0")["vector"] == [7] * 4
    (folder / "b.jsonl").write_text('{"id": "s", "vector": [0,0,0,0]}\n')
    ingest.upsert_stream(made, str(folder), str(tmp_path / "cp")).awaitTermination()
    assert made.count() == 7 and made.get("s")["vector"] == [0] * 4
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = ingest.filtered(spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001", pathGlobFilter="events.parquet"), {"k": {"$gte": 50}}, "props")
    query = ingest.window_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == ingest.filtered(events, {"k": {"$gte": 50}}, "props").count()


@pytest.mark.parametrize("index", ["ivf", "hnsw"])
def test_indexes_follow_changes(spark, tmp_path, index):
    """Inserts, upserts and deletes are put into the index that is there: it is not built again, and answers as a flat collection does."""
    import random

    from vicinal.operators import hnsw, ivf
    from vicinal.schema import IvfConfig

    rng = random.Random(8)
    point = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    c = Collection.create(spark, tmp_path, CollectionConfig("c", 4, "euclidean", index, ivf=IvfConfig(nlist=5, nprobe=5)))
    flat = Collection.create(spark, tmp_path, CollectionConfig("flat", 4, "euclidean", "flat"))
    q = point()

    def same():
        key = lambda x: [(r["rank"], r["id"], round(r["distance"], 9)) for r in x.query(q, 12).orderBy("rank").collect()]
        assert key(c) == key(flat)

    rows = [{"id": f"i{n}", "vector": point(), "metadata": {"n": n}} for n in range(150)]
    for x in (c, flat):
        x.insert(x.from_rows(rows))
    same()
    kind = ivf if index == "ivf" else hnsw
    built = []
    real = kind.write
    kind.write = lambda *a, **b: built.append(1) or real(*a, **b)
    try:
        more = [{"id": f"j{n}", "vector": point()} for n in range(40)]
        moved = [{"id": f"i{n}", "vector": point()} for n in range(0, 60, 3)] + [{"id": "new", "vector": q}, {"id": "i3", "vector": q}]
        for x in (c, flat):
            x.insert(x.from_rows(more))
        same()
        for x in (c, flat):
            x.upsert(x.from_rows(moved))
        same()
        assert {r["id"] for r in c.query(q, 2).collect()} == {"new", "i3"}
        for x in (c, flat):
            assert x.delete(["new", *[f"i{n}" for n in range(30)], "nobody"]) == 31
        same()
        assert c.stats()["count"] == 160 and not built
        for x in (c, flat):
            x.clear()
            assert x.query(q, 3).collect() == []
            x.insert(x.from_rows(rows[:5]))
        same()
        assert built
        (tmp_path / "c" / "index" / f"{index}.version").unlink()  # an upkeep that broke off
        same()
    finally:
        kind.write = real


def test_command_options(monkeypatch):
    """Counts of vectors and of queries, long names and versions."""
    from vicinal.service import cli

    asked = []
    monkeypatch.setattr(cli, "benchmark", lambda spark, *a, **b: asked.append((a, b["config"])) or {})
    store = type("S", (), {"spark": None})()
    cli.run(cli.parser().parse_args(["benchmark", "--count", "300", "--queries", "7", "--dim", "8", "--top-k", "3", "--m", "6", "--ef-search", "40"]), store)
    (a, config), = asked
    assert a == (300, 8, 7, 3, "cosine") and (config.m, config.ef_search, config.ef_construction) == (6, 40, 64)
    args = cli.parser().parse_args(["--no-color", "query", "c", "--top-k", "9", "-v", "1,2"])
    assert args.k == 9 and args.vector == "1,2"
    assert cli.parser().parse_args(["insert", "c", "--embed", "-d", "text"]).doc == "text"
    assert cli.parser().parse_args(["serve", "--open-browser"]).open_browser
    with pytest.raises(SystemExit) as ended:
        cli.parser().parse_args(["--version"])
    assert ended.value.code == 0
