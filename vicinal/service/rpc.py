"""JSON-RPC over lines of text, with tools, resources and prompts for agents."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any, TextIO

from vicinal.functions.text import embed_text
from vicinal.service.api import Store, benchmark, diagnostics, quantize

#: Protocol version and error codes of JSON-RPC, and the names by which agents call the tools.
PROTOCOL = "2024-11-05"
PARSE_ERROR, INVALID_REQUEST, UNKNOWN_METHOD, INTERNAL_ERROR = -32700, -32600, -32601, -32603

_STR, _INT, _NUM, _BOOL, _OBJ = ({"type": t} for t in ("string", "integer", "number", "boolean", "object"))
_VEC = {"type": "array", "items": _NUM}
#: name -> (description, required parameters, further parameters)
TOOLS: dict[str, tuple[str, dict, dict]] = {
    "vector_create_collection": ("Create a collection.", {"name": _STR, "dimension": _INT}, {"metric": _STR, "index_type": _STR, "m": _INT, "ef_construction": _INT, "ef_search": _INT, "nlist": _INT}),
    "vector_upsert": ("Put items into a collection.", {"collection": _STR}, {"id": _STR, "vector": _VEC, "document": _STR, "metadata": _OBJ, "items": {"type": "array"}, "documents": {"type": "array"}}),
    "vector_query": ("Nearest items to a vector or text.", {"collection": _STR}, {"vector": _VEC, "query_text": _STR, "text": _STR, "top_k": _INT, "k": _INT, "filter": _OBJ, "metadata_filter": _OBJ, "include_vector": _BOOL, "ef_search": _INT, "diversity_lambda": _NUM, "lambda_mult": _NUM, "fetch_k": _INT}),
    "vector_hybrid_search": ("Dense and text search, fused.", {"collection": _STR, "query_text": _STR}, {"vector": _VEC, "top_k": _INT, "k": _INT, "alpha": _NUM, "fusion": _STR, "filter": _OBJ, "rrf_k": _INT}),
    "vector_embed_text": ("Hashed embedding of a text.", {"text": _STR}, {"dimension": _INT, "dim": _INT, "normalize": _BOOL}),
    "vector_quantize": ("Compress a vector.", {"vector": _VEC}, {"mode": _STR, "num_bits": _INT}),
    "vector_collection_stats": ("Figures of a collection.", {"collection": _STR}, {}),
    "vector_list_collections": ("All collections.", {}, {"filter_name": _STR}),
    "vector_diagnostics": ("State of the engine.", {}, {"include_benchmarks": _BOOL}),
    "vector_cluster_analysis": ("Clusters of a collection.", {"collection": _STR}, {"k": _INT, "method": _STR, "filter": _OBJ, "max_iter": _INT, "seed": _INT}),
}
METRICS_GUIDE = "cosine: angle; euclidean: length of the difference; dot_product: inner product, larger is nearer; manhattan: sum of differences; hamming: share of differing places; jaccard: sum of minima over sum of maxima."
#: Names and arguments of the prompts are fixed values.
PROMPTS = {
    "vector_semantic_search_prompt": ("Plan a collection for search by meaning.", ("dataset_type", "domain"), "Plan a vector collection for this kind of data: {dataset_type} (field: {domain}). Say how to cut the texts, which metric and index to take, and create it with vector_create_collection."),
    "vector_rag_retrieval_prompt": ("Set up retrieval for answering questions.", ("query", "use_hybrid"), "Find passages that answer: {query}. Search by words as well as vectors: {use_hybrid}. Filter by metadata where it helps, fuse the rankings, and answer from the passages found."),
}


class Server:
    def __init__(self, store: Store):
        self.store = store
        self.methods: dict[str, Callable[[dict], Any]] = {
            "initialize": lambda p: {"protocolVersion": PROTOCOL, "serverInfo": {"name": "vicinal", "version": "0.1.0"}, "capabilities": {"tools": {}, "resources": {}, "prompts": {}, "logging": {}}},
            "ping": lambda p: {},
            "tools/list": lambda p: {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": need | more, "required": list(need)}} for n, (d, need, more) in TOOLS.items()]},
            "tools/call": self._call,
            "resources/list": lambda p: {"resources": [{"uri": "vector://collections", "name": "collections", "mimeType": "application/json"}, {"uri": "vector://metrics/guide", "name": "metrics", "mimeType": "text/plain"}]},
            "resources/read": self._read,
            "prompts/list": lambda p: {"prompts": [{"name": n, "description": d, "arguments": [{"name": a, "required": False} for a in args]} for n, (d, args, _) in PROMPTS.items()]},
            "prompts/get": self._prompt,
            "logging/setLevel": lambda p: {},
        }

    def tool(self, name: str, a: dict) -> Any:
        if name not in TOOLS:
            raise KeyError(f"unknown tool {name!r}")
        if missing := [k for k in TOOLS[name][1] if k not in a]:
            raise ValueError(f"missing: {', '.join(missing)}")
        k, where = a.get("top_k", a.get("k", 5)), a.get("filter", a.get("metadata_filter"))
        match name.removeprefix("vector_"):
            case "create_collection":
                return self.store.create(a["name"], a["dimension"], a.get("metric", "cosine"), a.get("index_type", "hnsw"), {x: a.get(x) for x in ("m", "ef_construction", "ef_search")}, {"nlist": a.get("nlist")})
            case "upsert":
                rows = a.get("items") or a.get("documents") or [{x: a.get(x) for x in ("id", "vector", "document", "metadata")}]
                ids = self.store.put(a["collection"], rows)
                return {"upserted": len(ids), "ids": ids[:50]}
            case "query":
                lam = a.get("diversity_lambda", a.get("lambda_mult"))
                return self.store.query(a["collection"], a.get("vector"), a.get("query_text", a.get("text")), k, where, a.get("include_vector", False), a.get("ef_search"), lam, a.get("fetch_k", max(3 * k, 20)))
            case "hybrid_search":
                return self.store.hybrid(a["collection"], a["query_text"], a.get("vector"), k, where, a.get("fusion", "rrf"), a.get("alpha", 0.5), a.get("rrf_k", 60))
            case "embed_text":
                v = embed_text(a["text"], a.get("dimension", a.get("dim", 64)), a.get("normalize", True))
                return {"dimension": len(v), "vector": v}
            case "quantize":
                return quantize(a["vector"], a.get("mode", "sq8"), a.get("num_bits", 8))
            case "collection_stats":
                return self.store.open(a["collection"]).stats()
            case "list_collections":
                return {"collections": self.store.list(a.get("filter_name", ""))}
            case "diagnostics":
                found = diagnostics(self.store.spark)
                return found | {"benchmarks": benchmark(self.store.spark)} if a.get("include_benchmarks") else found
            case _:
                return self.store.cluster(a["collection"], a.get("k", 3), a.get("method", "kmeans"), where, a.get("max_iter", 50), a.get("seed", 42))

    def _call(self, p: dict) -> dict:
        answer = self.tool(p.get("name", ""), p.get("arguments") or {})
        return {"content": [{"type": "text", "text": json.dumps(answer, ensure_ascii=False, default=str)}], "isError": False}

    def _read(self, p: dict) -> dict:
        match uri := p.get("uri"):
            case "vector://collections":
                text, kind = json.dumps(self.store.list()), "application/json"
            case "vector://metrics/guide":
                text, kind = METRICS_GUIDE, "text/plain"
            case _:
                raise KeyError(f"unknown resource {uri!r}")
        return {"contents": [{"uri": uri, "mimeType": kind, "text": text}]}

    def _prompt(self, p: dict) -> dict:
        if p.get("name") not in PROMPTS:
            raise KeyError(f"unknown prompt {p.get('name')!r}")
        description, args, text = PROMPTS[p["name"]]
        given = {a: (p.get("arguments") or {}).get(a, "") for a in args}
        return {"description": description, "messages": [{"role": "user", "content": {"type": "text", "text": text.format(**given)}}]}

    def handle(self, line: str) -> dict | None:
        """The reply to one request line; None for notifications."""
        try:
            request = json.loads(line)
        except ValueError:
            return _error(None, PARSE_ERROR, "parse error")
        if not isinstance(request, dict) or not isinstance(request.get("method"), str):
            return _error(request.get("id") if isinstance(request, dict) else None, INVALID_REQUEST, "invalid request")
        if "id" not in request:
            return None
        method = self.methods.get(request["method"])
        if method is None:
            return _error(request["id"], UNKNOWN_METHOD, f"unknown method {request['method']!r}")
        try:
            return {"jsonrpc": "2.0", "id": request["id"], "result": method(request.get("params") or {})}
        except Exception as e:  # noqa: BLE001  the protocol reports failures as replies
            return _error(request["id"], INTERNAL_ERROR, str(e))

    def run(self, source: TextIO, sink: TextIO) -> None:
        for line in source:
            if line.strip() and (reply := self.handle(line)) is not None:
                sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
                sink.flush()


def _error(id_: Any, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}
