"""A local HTTP service over one engine: status, search, graph, chunk, index, context."""

from __future__ import annotations

import json
import os
import threading
import webbrowser
from collections.abc import Iterable, Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .api import Engine, to_json
from .session import scratch


def _rows(df: DataFrame) -> list:
    return json.loads(to_json(df))


def _stream(df: DataFrame) -> Iterator[str]:
    """The rows as one JSON list, a row at a time, so that the driver never holds them all."""
    yield "["
    for i, r in enumerate(df.select(F.to_json(F.struct("*"))).toLocalIterator()):
        yield ("," if i else "") + r[0]
    yield "]"


PAGE = """<!doctype html><html lang="en"><meta charset="utf-8"><title>tessera</title>
<style>body{font:15px/1.5 sans-serif;max-width:60rem;margin:2rem auto;padding:0 1rem}input{width:70%;padding:.4rem}pre{background:#f4f4f4;padding:.6rem;overflow:auto}small{color:#666}</style>
<h1>tessera</h1><p id="state"></p><form><input name="q" placeholder="What to look for" autofocus> <button>Search</button></form><div id="hits"></div>
<script>
const put = (tag, text) => { const e = document.createElement(tag); e.textContent = text; return e };
fetch('/api/status').then(r => r.json()).then(s => { state.textContent = Object.entries(s).map(x => x[1] + ' ' + x[0]).join(', ') });
document.forms[0].onsubmit = async e => {
  e.preventDefault();
  const body = JSON.stringify({ query: document.forms[0].q.value, limit: 10, hops: 1 });
  const found = await (await fetch('/api/search', { method: 'POST', body })).json();
  hits.replaceChildren(...found.hits.flatMap(h => [
    put('h3', h.rank + '. ' + h.file_path + ':' + h.start_line + '-' + h.end_line),
    put('small', 'score ' + h.score.toFixed(3) + (h.related ? ', related: ' + h.related.join(', ') : '')), put('pre', h.content)]));
};
</script></html>
"""


def make_server(engine: Engine, port: int = 8080) -> ThreadingHTTPServer:
    """A server on 127.0.0.1; each request reads the version in force, an index request puts a new one in force."""
    writing = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: object) -> None:
            pass

        def reply(self, code: int, body: object) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            for k, v in (("Content-Type", "application/json"), ("Content-Length", str(len(data))), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Headers", "*")):
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def reply_parts(self, kind: str, parts: Iterable[str]) -> None:
            self.send_response(200)
            for k, v in (("Content-Type", kind), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Headers", "*")):
                self.send_header(k, v)
            self.end_headers()
            for x in parts:
                self.wfile.write(x.encode())

        def do_OPTIONS(self) -> None:
            self.reply(204, None)

        def do_GET(self) -> None:
            with scratch(engine.spark):
                self.get()

        def get(self) -> None:
            url = urlsplit(self.path)
            args = {k: v[0] for k, v in parse_qs(url.query).items()}
            if url.path == "/":
                self.reply_parts("text/html; charset=utf-8", [PAGE])
            elif url.path == "/api":
                self.reply(200, {"routes": ["/api/status", "/api/search", "/api/graph", "/api/chunk/{id}", "/api/index", "/api/llm-context"]})
            elif url.path == "/api/status":
                self.reply(200, engine.stats() | {t: engine.tables[t].count() for t in ("files", "features")})
            elif url.path == "/api/graph":
                nodes, edges = engine.tables["nodes"].orderBy("id"), engine.tables["edges"].orderBy("source", "target", "kind")
                self.reply_parts("application/json", chain(('{"nodes": ',), _stream(nodes), (', "edges": ',), _stream(edges), ("}",)))
            elif url.path.startswith("/api/chunk/"):
                found = _rows(engine.chunk(unquote(url.path[len("/api/chunk/") :])))
                self.reply(200, found[0]) if found else self.reply(404, {"error": "no such chunk"})
            elif url.path == "/api/llm-context":
                self.reply(200, {"context": engine.context(args.get("q", ""), int(args.get("limit", 5)))})
            else:
                self.reply(404, {"error": "no such route"})

        def do_POST(self) -> None:
            with scratch(engine.spark):
                self.post()

        def post(self) -> None:
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                self.reply(400, {"error": "the body is no JSON"})
                return
            if self.path == "/api/search":
                found = engine.search(body.get("query", ""), int(body.get("limit", 10)), int(body.get("hops", 1)))
                out = {"query": body.get("query", ""), "hits": _rows(found.hits)}
                if found.nodes is not None:
                    out["subgraph"] = {"nodes": _rows(found.nodes), "edges": _rows(found.edges)}
                self.reply(200, out)
            elif self.path == "/api/index":
                if not os.path.isdir(body.get("path", "")):
                    self.reply(400, {"error": "no such folder"})
                    return
                with writing:
                    self.reply(200, engine.index(body["path"]))
            else:
                self.reply(404, {"error": "no such route"})

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def serve(engine: Engine, port: int = 8080, show: bool = False) -> None:
    """Serve until interrupted; ``show`` opens the page in a browser."""
    server = make_server(engine, port)
    if show:
        webbrowser.open(f"http://127.0.0.1:{server.server_port}/")
    server.serve_forever()
