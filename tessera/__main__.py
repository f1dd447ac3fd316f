"""Command line: index, search, find, chunk, graph, impact, context, co-change, status, watch, evaluate, serve and benchmarks."""

from __future__ import annotations

import argparse

from .api import Engine, to_json
from .session import get_session


def main() -> None:
    p = argparse.ArgumentParser("tessera")
    p.add_argument("--db-dir", default=".tessera")
    sub = p.add_subparsers(dest="what", required=True)
    one = {
        "index": [("path", {"nargs": "?", "default": "."})],
        "search": [("query", {}), ("--limit", {"type": int, "default": 5}), ("--expand-graph", {"type": int, "default": 1}), ("--format", {"choices": ["text", "json", "llm"], "default": "text"})],
        "find": [("query", {})],
        "chunk": [("id", {})],
        "graph": [("id", {}), ("--hops", {"type": int, "default": 1})],
        "impact": [("symbol", {}), ("--depth", {"type": int, "default": 2})],
        "context": [("task", {})],
        "co-change": [("file", {}), ("--commits", {"type": int, "default": 200})],
        "status": [],
        "watch": [("path", {"nargs": "?", "default": "."}), ("--debounce", {"type": int, "default": 300})],
        "evaluate": [("fixture", {})],
        "serve": [("--port", {"type": int, "default": 8080}), ("--open", {"action": "store_true"})],
        "ann-benchmark": [("--vectors", {"type": int, "default": 1000}), ("--dimension", {"type": int, "default": 256}), ("--queries", {"type": int, "default": 100}), ("-k", {"type": int, "default": 10})],
        "cold-benchmark": [("--vectors", {"type": int, "default": 1000}), ("--iterations", {"type": int, "default": 5})],
    }
    for name, args in one.items():
        s = sub.add_parser(name)
        for flag, how in args:
            s.add_argument(flag, **how)
    a = p.parse_args()
    e = Engine(a.db_dir, get_session(master="local[*]"))
    if a.what == "index":
        print(e.index(a.path))
    elif a.what == "search":
        if a.format == "llm":
            print(e.context(a.query, a.limit))
            return
        h = e.search(a.query, a.limit, a.expand_graph).hits
        print(to_json(h) if a.format == "json" else "\n".join(f"{r.rank}. {r.file_path}:{r.start_line}-{r.end_line} ({r.score:.3f})" for r in h.collect()))
    elif a.what == "context":
        print(e.context(a.task))
    elif a.what == "status":
        print(e.stats())
    elif a.what == "watch":
        e.watch(a.path, a.debounce)
    elif a.what == "serve":
        from .server import serve

        serve(e, a.port, a.open)
    elif a.what == "ann-benchmark":
        from .benchmarks import ann

        print(ann(e.spark, a.vectors, a.dimension, a.queries, a.k))
    elif a.what == "cold-benchmark":
        from .benchmarks import cold

        print(cold(e.spark, a.vectors, a.iterations))
    elif a.what == "graph":
        for df in e.subgraph([a.id], a.hops):
            print(to_json(df))
    else:
        df = {"find": lambda: e.find(a.query), "chunk": lambda: e.chunk(a.id), "impact": lambda: e.impact(a.symbol, a.depth), "co-change": lambda: e.co_change(a.file, ".", a.commits), "evaluate": lambda: e.evaluate(a.fixture)}[a.what]()
        print("not found" if df is None else to_json(df))


if __name__ == "__main__":
    main()
