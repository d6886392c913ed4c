"""REST over the standard library's threading server; changes are taken from local origins only."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from vicinal.service.api import Store, benchmark, diagnostics, plain

LOCAL = ("localhost", "127.0.0.1", "::1")


def local_origin(origin: str | None) -> bool:
    """Whether a request's Origin header is missing or names this machine."""
    if not origin:
        return True
    try:
        found = urlsplit(origin)
        return found.scheme in ("http", "https") and found.hostname in LOCAL
    except ValueError:
        return False


class Api:
    """Routes without the transport: (method, path, query, body) -> (status, answer). Writes to one collection wait for one another."""

    def __init__(self, store: Store):
        self.store, self.lock = store, threading.Lock()

    def handle(self, method: str, target: str, body: dict | None = None, origin: str | None = None) -> tuple[int, Any]:
        if method in ("POST", "DELETE") and not local_origin(origin):
            return 403, {"error": "foreign origin"}
        url = urlsplit(target)
        parts = [unquote(p) for p in url.path.split("/") if p]
        if any(p in (".", "..") or "/" in p or "\\" in p or "\0" in p for p in parts):
            return 400, {"error": "bad path"}
        if parts[:1] != ["api"]:
            return 404, {"error": "not found"}
        ask = {k: v[-1] for k, v in parse_qs(url.query).items()}
        try:
            return self._route(method, parts[1:], ask, body or {})
        except KeyError as e:
            return 404, {"error": str(e.args[0])}
        except (ValueError, TypeError) as e:
            return 400, {"error": str(e)}

    def _route(self, method: str, parts: list[str], ask: dict, b: dict) -> tuple[int, Any]:
        s, k = self.store, int(b.get("k", b.get("top_k", 10)))
        match method, parts:
            case "GET", ["health"]:
                return 200, {"status": "ok"}
            case "GET", ["diagnostics"]:
                return 200, diagnostics(s.spark)
            case "GET", ["collections"]:
                return 200, {"collections": s.list()}
            case "POST", ["collections"]:
                with self.lock:
                    return 201, s.create(b["name"], int(b.get("dimension", 128)), b.get("metric", "cosine"), b.get("index_type", "hnsw"), b.get("hnsw_config"), b.get("ivf_config"))
            case "GET", ["collections", name]:
                return 200, s.open(name).config.to_dict()
            case "DELETE", ["collections", name]:
                with self.lock:
                    s.delete(name)
                return 200, {"deleted": name}
            case "GET", ["collections", name, "stats"]:
                return 200, s.open(name).stats()
            case "GET", ["collections", name, "items" | "export"]:
                return 200, {"items": plain(s.open(name).items().drop("ord").collect())}
            case "GET", ["collections", name, "clusters"]:
                return 200, s.cluster(name, int(ask.get("k", 3)), ask.get("method", "kmeans"))
            case "POST", ["collections", name, "clusters"]:
                return 200, s.cluster(name, int(b.get("k", 3)), b.get("method", "kmeans"), b.get("filter"), int(b.get("max_iter", 50)), int(b.get("seed", 42)))
            case "POST", ["collections", name, "insert" | "upsert"]:
                with self.lock:
                    return 201, {"ids": s.put(name, b.get("documents") or b.get("items") or [])}
            case "POST", ["collections", name, "query" | "search"]:
                return 200, {"results": s.query(name, b.get("vector"), b.get("query_text"), k, b.get("filter", b.get("filter_expr")), bool(b.get("include_vector")))}
            case "POST", ["collections", name, "hybrid"]:
                return 200, {"results": s.hybrid(name, b.get("query_text") or b["query"], b.get("query_vector", b.get("vector")), k, b.get("filter"), b.get("fusion_method", "rrf"), float(b.get("alpha", 0.5)))}
            case "POST", ["benchmark"]:
                return 200, benchmark(s.spark, int(b.get("num_vectors", 300)), int(b.get("dimension", 32)), int(b.get("queries_count", 30)), k, b.get("metric", "cosine"))
        return 404, {"error": "not found"}


def make_server(store: Store, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    api = Api(store)

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw) if raw else {}
                status, answer = api.handle(self.command, self.path, body, self.headers.get("Origin"))
            except ValueError:
                status, answer = 400, {"error": "body is not JSON"}
            except Exception as e:  # noqa: BLE001  a request must be answered
                status, answer = 500, {"error": str(e)}
            data = json.dumps(answer, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _answer

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def serve(store: Store, host: str, port: int) -> None:
    server = make_server(store, host, port)
    print(f"serving on http://{host}:{server.server_address[1]}/api")
    try:
        server.serve_forever()
    finally:
        server.server_close()
