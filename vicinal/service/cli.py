"""Command line: ``python -m vicinal <command>``."""

from __future__ import annotations

import argparse
import json
import sys
from typing import Any

from vicinal.functions.filters import parse_metadata, parse_vector
from vicinal.functions.text import embed_text
from vicinal.service.api import HnswConfig, Store, benchmark, diagnostics

VERSION = "0.3.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vicinal", description="Similarity search and retrieval analytics on Spark")
    p.add_argument("--data-dir", default="./.vector_store")
    p.add_argument("--json", action="store_true", help="print JSON")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--no-color", action="store_true", help="output has no colours anyway")
    p.add_argument("-V", "--version", action="version", version=f"vicinal {VERSION}")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *aliases: str, collection: bool = True) -> argparse.ArgumentParser:
        c = sub.add_parser(name, aliases=aliases)
        c.add_argument("--json", action="store_true", default=argparse.SUPPRESS)
        if collection:
            c.add_argument("collection")
        return c

    c = command("create")
    c.add_argument("-d", "--dim", "--dimension", dest="dimension", type=int, default=64)
    c.add_argument("-m", "--metric", default="cosine")
    c.add_argument("-i", "--index", default="hnsw")
    for name, value in (("--m", 16), ("--ef-construction", 64), ("--ef-search", 32), ("--nlist", 16)):
        c.add_argument(name, type=int, default=value)
    c = command("insert")
    c.add_argument("--id")
    c.add_argument("-v", "--vector")
    c.add_argument("-d", "--doc", "--text", dest="doc")
    c.add_argument("--embed", action="store_true", help="embed the text where there is no vector, as is done anyway")
    c.add_argument("--meta", "--metadata", dest="meta")
    c.add_argument("-f", "--batch", help="a JSON file with a list of items")
    c = command("query")
    c.add_argument("-v", "--vector")
    c.add_argument("-t", "--text")
    c.add_argument("-k", "--top-k", dest="k", type=int, default=5)
    c.add_argument("-f", "--filter")
    c.add_argument("--include-vector", action="store_true")
    c.add_argument("--ef-search", type=int)
    c.add_argument("--lambda-mult", "--diversity", dest="diversity", type=float)
    c.add_argument("--fetch-k", type=int, default=50)
    c = command("hybrid")
    c.add_argument("text")
    c.add_argument("-v", "--vector")
    c.add_argument("-k", "--top-k", dest="k", type=int, default=5)
    c.add_argument("-a", "--alpha", type=float, default=0.5)
    c.add_argument("--fusion", default="rrf")
    c.add_argument("--rrf-k", type=int, default=60)
    c.add_argument("-f", "--filter")
    c = command("embed", collection=False)
    c.add_argument("text")
    c.add_argument("-d", "--dim", "--dimension", dest="dimension", type=int, default=64)
    c.add_argument("--no-normalize", action="store_true")
    c = command("benchmark", collection=False)
    c.add_argument("-d", "--dim", "--dimension", dest="dimension", type=int, default=64)
    c.add_argument("-n", "--count", "--num-vectors", "--num", dest="count", type=int, default=1000, help="vectors")
    c.add_argument("-c", "--queries", type=int, default=100)
    c.add_argument("-k", "--top-k", "--k", dest="k", type=int, default=10)
    c.add_argument("-m", "--metric", default="cosine")
    for name, value in (("--m", 16), ("--ef-construction", 64), ("--ef-search", 32)):
        c.add_argument(name, type=int, default=value)
    command("stats")
    c = command("list", collection=False)
    c.add_argument("--contains", default="")
    c = command("cluster")
    c.add_argument("-k", type=int, default=3)
    c.add_argument("--method", default="kmeans")
    c.add_argument("--filter")
    c.add_argument("--max-iter", type=int, default=50)
    c.add_argument("--seed", type=int, default=42)
    for name in ("export", "import"):
        c = command(name)
        c.add_argument("path")
    c = command("serve", collection=False)
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("-p", "--port", type=int, default=8000)
    c.add_argument("--open", "--open-browser", dest="open_browser", action="store_true")
    command("mcp", collection=False)
    command("diagnostics", "doctor", "platform", collection=False)
    command("test", collection=False)
    return p


def run(args: argparse.Namespace, store: Store) -> Any:
    """The answer to one command, as plain data."""
    where = parse_metadata(args.filter) if getattr(args, "filter", None) else None
    vector = parse_vector(args.vector) if getattr(args, "vector", None) else None
    match args.command:
        case "create":
            return store.create(args.collection, args.dimension, args.metric, args.index, {"m": args.m, "ef_construction": args.ef_construction, "ef_search": args.ef_search}, {"nlist": args.nlist})
        case "insert":
            if args.batch:
                with open(args.batch, encoding="utf-8") as f:
                    rows = json.load(f)
            else:
                rows = [{"id": args.id, "vector": vector, "document": args.doc, "metadata": parse_metadata(args.meta)}]
            return {"upserted": store.put(args.collection, rows)}
        case "query":
            return store.query(args.collection, vector, args.text, args.k, where, args.include_vector, args.ef_search, args.diversity, args.fetch_k)
        case "hybrid":
            return store.hybrid(args.collection, args.text, vector, args.k, where, args.fusion, args.alpha, args.rrf_k)
        case "embed":
            return {"vector": embed_text(args.text, args.dimension, not args.no_normalize)}
        case "benchmark":
            config = HnswConfig(m=args.m, ef_construction=args.ef_construction, ef_search=args.ef_search)
            return benchmark(store.spark, args.count, args.dimension, args.queries, args.k, args.metric, config=config)
        case "stats":
            return store.open(args.collection).stats()
        case "list":
            return store.list(args.contains)
        case "cluster":
            return store.cluster(args.collection, args.k, args.method, where, args.max_iter, args.seed)
        case "export":
            return {"exported": store.open(args.collection).export_jsonl(args.path)}
        case "import":
            return {"imported": store.open(args.collection).import_jsonl(args.path)}
        case "test":
            return self_test(store)
        case _:
            return diagnostics(store.spark)


def self_test(store: Store) -> dict[str, bool]:
    """A short check of an installation on a collection of its own."""
    name = "self-test"
    if any(c["name"] == name for c in store.list()):
        store.delete(name)
    store.create(name, 3, "cosine", "flat")
    store.put(name, [{"id": "a", "vector": [1, 0, 0], "document": "red fox"}, {"id": "b", "vector": [0, 1, 0], "document": "blue bird"}])
    found = {
        "query": store.query(name, [1, 0, 0], k=1)[0]["id"] == "a",
        "hybrid": store.hybrid(name, "bird", [0, 1, 0], k=1)[0]["id"] == "b",
        "delete": store.open(name).delete(["a"]) == 1,
        "count": store.open(name).count() == 1,
    }
    store.delete(name)
    return found


def show(answer: Any) -> str:
    """A table for rows, else JSON."""
    if not (isinstance(answer, list) and answer and isinstance(answer[0], dict)):
        return json.dumps(answer, indent=2, ensure_ascii=False, default=str)
    names = list(answer[0])
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)[:40]
    rows = [names, *[[cell(r.get(n)) for n in names] for r in answer]]
    widths = [max(len(r[i]) for r in rows) for i in range(len(names))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in rows)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        from vicinal.session import get_spark

        store = Store(get_spark(), args.data_dir)
        if args.command == "serve":
            from vicinal.service.rest import serve

            if args.open_browser:
                import threading
                import webbrowser

                threading.Timer(1.0, webbrowser.open, [f"http://{args.host}:{args.port}/"]).start()
            serve(store, args.host, args.port)
        elif args.command == "mcp":
            from vicinal.service.rpc import Server

            Server(store).run(sys.stdin, sys.stdout)
        else:
            answer = run(args, store)
            print(json.dumps(answer, ensure_ascii=False, default=str) if args.json else show(answer))
        return 0
    except Exception as e:  # noqa: BLE001  a command reports any failure in one line
        print(f"error: {e}", file=sys.stderr)
        return 1
