"""One object over stored tables: index, search, look up, traverse, watch."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .operators import bm25, cochange, evaluate, graph, passes, retrieval, updates
from .session import get_session, materialize, outside, scratch, ship
from .sources import files, parsers
from .streaming import watch

CHUNKS = "id string, file_path string, start_line int, end_line int, content string, node_id string, tokens_approx int, vector_id bigint"
NODES = "id string, label string, kind string, file_path string, start_line int, end_line int, signature string, docstring string, chunk_id string"
EDGES = "source string, target string, kind string, weight double, seq bigint"
FILES = "path string, mtime timestamp, length bigint"
POSTINGS = "term string, id string, tf bigint, doc_len bigint"
FEATURES = "vector_id bigint, id string, space string, vector array<float>"
LENGTHS = "n_docs bigint, avg_len double"
SCHEMAS = {"chunks": CHUNKS, "nodes": NODES, "edges": EDGES, "files": FILES, "postings": POSTINGS, "features": FEATURES, "lengths": LENGTHS}


@dataclass
class Hits:
    """Hits of one search, and the nodes and links around them if hops were asked for."""

    hits: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None


class Engine:
    """Tables of one folder of snapshots; an absent folder is an empty engine.

    A version holds postings in the order of their terms and the chunks' vectors,
    so a search reads what it needs and makes nothing anew. ``embedder`` may take
    the place of hashed vectors: a function from a text column to a column of
    ``array<float>``, for chunks and queries alike.
    """

    def __init__(self, db_dir: str = ".tessera", spark: SparkSession | None = None, embedder=None) -> None:
        self.spark = spark or get_session()
        ship(self.spark)
        self.db_dir, self.embedder = db_dir, embedder
        self.tables = files.load_snapshot(self.spark, db_dir)
        older = bool(self.tables) and "postings" not in self.tables
        for name, schema in SCHEMAS.items():
            self.tables.setdefault(name, self.spark.createDataFrame([], schema))
        if older:
            self.rebuild()
            self.purge_non_text()

    # -- writing

    def _read(self, root: str, only: DataFrame | None = None) -> dict[str, DataFrame]:
        scanned = files.scan(self.spark, root)
        if only is not None:
            scanned = scanned.join(only, "path", "left_semi")
        scanned = materialize(scanned, "scan")
        text = scanned.where("category = 'TextOrCode'").select("path", F.col("content").cast("string").alias("text"))
        u = materialize(parsers.units(text), "units")
        pdf = parsers.parse_pdfs(scanned.where("category = 'Pdf'"))
        chunks = parsers.chunks_of(u).unionByName(
            pdf.select(
                F.concat(F.lit("chunk:"), "file_path", F.lit(":sec"), "section").alias("id"), "file_path", F.col("section").alias("start_line"), F.col("section").alias("end_line"), "content", "node_id", T.token_count(F.col("content")).alias("tokens_approx")
            )
        )
        none = F.lit(None).cast("string")
        pdf_nodes = pdf.select("node_id", F.concat(F.lit("section "), "section").alias("label"), F.lit("DocSection").alias("kind"), "file_path", F.col("section").alias("start_line"), F.col("section").alias("end_line"), none.alias("signature"), none.alias("docstring"), F.concat(F.lit("chunk:"), "file_path", F.lit(":sec"), "section").alias("chunk_id")).withColumnRenamed("node_id", "id")
        pdf_docs = pdf.select("file_path").distinct().select(F.concat(F.lit("pdf:"), "file_path").alias("id"), T.file_stem(F.col("file_path")).alias("label"), F.lit("Document").alias("kind"), "file_path", F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), none.alias("signature"), none.alias("docstring"), none.alias("chunk_id"))
        nodes = parsers.nodes_of(u, text).unionByName(pdf_nodes).unionByName(pdf_docs)
        edges = parsers.edges_of(u).unionByName(pdf.select(F.concat(F.lit("pdf:"), "file_path").alias("source"), F.col("node_id").alias("target"), F.lit("Contains").alias("kind"), F.lit(1.0).alias("weight")))
        return {"chunks": chunks, "nodes": nodes, "edges": edges, "files": scanned.select("path", "mtime", "length")}

    def _derived(self, chunks: DataFrame, nodes: DataFrame, given: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Postings and features of chunks; ``given(id, vector)`` are vectors in place of made ones."""
        about = nodes.select(F.col("id").alias("node_id"), "label", "signature", "kind").dropDuplicates(["node_id"])
        c = chunks.join(about, "node_id", "left").withColumn("body", retrieval.body_of(["label"]))
        sized = F.when(F.size("vector") == retrieval.DIM, F.col("vector")).otherwise(F.raise_error(F.lit(f"a given vector has not {retrieval.DIM} numbers")).cast("array<double>"))
        over = (given if given is not None else self.spark.createDataFrame([], "id string, vector array<double>")).select("id", sized.alias("given")).dropDuplicates(["id"])
        c = c.join(over, "id", "left").withColumn("space", retrieval.feature_space(F.col("file_path"), F.coalesce("kind", F.lit("")), F.col("given").isNotNull()))
        cols = ("vector_id", "space", "given")
        if self.embedder is None:
            v = passes.vector_rows(c.select("id", "body", *cols), text_col="body", extra=cols)
        else:
            v = c.select("id", *cols, V.normalize(self.embedder(F.col("body"))).alias("vector"))
        v = v.where("space <> 'Metadata'").select("vector_id", "id", "space", F.coalesce("given", "vector").cast("array<float>").alias("vector"))
        return bm25.postings(chunks), v

    def _finish(self, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, stamps: DataFrame, root: str, kept: DataFrame | None = None, given: DataFrame | None = None) -> None:
        """Links across files over the whole corpus, valid links alone, numbered vectors, postings and features; then one new version.

        Postings and features of the chunks ``kept(id)`` are taken over, those of
        all others are made.
        """
        functions = nodes.where("kind in ('Function', 'Method')")
        calls = parsers.call_candidates(chunks.select("node_id", "content"), nodes.where("kind = 'Function'")).join(functions.select(F.col("id").alias("source")), "source", "left_semi")
        history = files.git_history(self.spark, root)
        both = cochange.pairs(history.select("hash", F.col("seq").cast("bigint").alias("seq"), "subject", "files"))
        path = lambda c: F.concat(F.lit("file:"), c)
        together = both.select(path("a").alias("source"), path("b").alias("target"), F.col("jaccard").alias("weight")).unionByName(both.select(path("b").alias("source"), path("a").alias("target"), F.col("jaccard").alias("weight")))
        extra = calls.select("source", "target", F.lit("CallsCandidate").alias("kind"), F.lit(0.5).alias("weight")).unionByName(together.select("source", "target", F.lit("CoChangedWith").alias("kind"), "weight"))
        base = edges.where("kind not in ('CallsCandidate', 'CoChangedWith')").select("source", "target", "kind", "weight")
        all_edges = base.unionByName(extra).withColumn("seq", F.xxhash64("source", "target", "kind"))
        chunks = materialize(chunks.drop("vector_id").dropDuplicates(["id"]).withColumn("vector_id", F.xxhash64("id")), "chunks")
        nodes, all_edges = parsers.normalize_chunk_edges(chunks, nodes, all_edges)
        chunks = chunks.withColumn("node_id", F.coalesce("node_id", "id"))
        nodes = materialize(nodes.dropDuplicates(["id"]), "nodes")
        pruned = graph.prune_dangling(all_edges, nodes)
        w = Window.partitionBy("source", "target", "kind").orderBy("seq", "weight")
        valid = pruned.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
        postings, features = self._derived(chunks if kept is None else chunks.join(kept, "id", "left_anti"), nodes, given)
        if kept is not None:
            postings = postings.unionByName(self.tables["postings"].join(kept, "id", "left_semi"))
            features = features.unionByName(self.tables["features"].join(kept, "id", "left_semi"))
        self._save({"chunks": chunks, "nodes": nodes, "edges": valid, "files": stamps, "postings": postings, "features": features})

    def _save(self, out: dict[str, DataFrame]) -> None:
        """A new version of all tables, postings in the order of terms and the statistics of their lengths besides."""
        out["postings"] = materialize(out["postings"], "postings")
        per = out["postings"].groupBy("id").agg(F.max("doc_len").alias("n"))
        out["lengths"] = per.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_len"))
        out["postings"] = bm25.clustered(out["postings"])
        out["features"] = out["features"].repartitionByRange("space", "vector_id").sortWithinPartitions("space", "vector_id")
        out = {k: v.selectExpr(*(f"cast({c} as {t}) as {c}" for c, t in (x.strip().split(" ") for x in SCHEMAS[k].split(",")))) for k, v in out.items()}
        files.save_snapshot(out, self.db_dir)
        self.tables = files.load_snapshot(self.spark, self.db_dir)

    def index(self, root: str = ".", given: DataFrame | None = None) -> dict[str, int]:
        """Read a folder anew; the new version takes the old one's place once it is whole.

        ``given(id, vector)`` are vectors of chunks, in place of made ones.
        """
        with scratch(self.spark):
            t = self._read(root)
            self._finish(t["chunks"], t["nodes"], t["edges"], t["files"], root, given=given)
        return self.stats()

    def rebuild(self) -> None:
        """Make postings and features of all chunks anew, as for versions that were stored without; given vectors stay."""
        given = self.tables["features"].where("space = 'BinaryFingerprint'").select("id", "vector")
        with scratch(self.spark):
            postings, features = self._derived(self.tables["chunks"], self.tables["nodes"], given)
            self._save({k: self.tables[k] for k in ("chunks", "nodes", "edges", "files")} | {"postings": postings, "features": features})

    def purge_non_text(self) -> list[str]:
        """Take out files that an older version holds though they are no text; returns their paths."""
        pdf = self.tables["nodes"].where("kind = 'Document'").select("file_path")
        odd = updates.non_text_paths(self.tables["chunks"], self.tables["nodes"], self.tables["features"], files.SKIP_EXTENSIONS).join(pdf, "file_path", "left_anti")
        # as many as there are files of a kind that is no longer indexed; a path at a time goes to the driver
        paths = [r[0] for r in odd.toLocalIterator()]
        if paths:
            self.remove_files(paths)
        return paths

    def remove_files(self, paths: list[str]) -> None:
        """Take files out of all tables."""
        gone = self.spark.createDataFrame([(p,) for p in sorted(set(paths))], "file_path string")
        nodes, edges = graph.remove_file(self.tables["nodes"], self.tables["edges"], gone)
        ids = self.tables["chunks"].join(gone, "file_path", "left_semi").select("id")
        keep = {"chunks": updates.remove_by(self.tables["chunks"], gone), "nodes": nodes, "edges": edges, "files": self.tables["files"].join(gone.toDF("path"), "path", "left_anti")}
        with scratch(self.spark):
            self._save(keep | {t: self.tables[t].join(ids, "id", "left_anti") for t in ("postings", "features")})

    def refresh(self, root: str = ".") -> DataFrame:
        """Read what changed since the last version; the result equals a full run. Returns the changes."""
        now = files.scan(self.spark, root).select("path", "mtime", "length")
        diff = materialize(updates.snapshot_diff(self.tables["files"], now), "changes")
        if diff.isEmpty():
            return diff
        with scratch(self.spark):
            fresh = self._read(root, diff.where("change <> 'delete'").select("path"))
            gone = diff.select(F.col("path").alias("file_path"))
            nodes, edges = graph.remove_file(self.tables["nodes"], self.tables["edges"], gone)
            old = updates.remove_by(self.tables["chunks"], gone)
            self._finish(
                old.drop("vector_id").unionByName(fresh["chunks"]), nodes.unionByName(fresh["nodes"]),
                edges.select("source", "target", "kind", "weight").unionByName(fresh["edges"]), materialize(now, "stamps"), root, kept=old.select("id"),
            )
        return diff

    def watch(self, root: str = ".", interval_ms: int = 300, rounds: int | None = None) -> None:
        """Refresh once for each burst of changes: the first change opens a batch that takes all within ``interval_ms``.

        ``rounds`` bounds the batches looked for; None goes on for ever.
        """
        for _ in watch.bursts(lambda: files.stamps(root), interval_ms, rounds):
            self.refresh(root)

    # -- reading

    def search(self, text: str, limit: int = 5, hops: int = 1, mode: str = "hybrid") -> Hits:
        """Hits of a text in fused order, with up to five related nodes each."""
        q = self.spark.createDataFrame([(1, text)], "query_id int, query string")
        c = self.tables["chunks"]
        with scratch(self.spark):
            words = bm25.search(self.tables["postings"], q, 2 * limit, stats=self.tables["lengths"]) if mode != "dense" else None
            dense = retrieval.stored_lists(self.tables["features"], q, 2 * limit, self.embedder) if mode != "bm25" else None
            h = retrieval.hybrid_search(c, q, limit, mode, words, dense).drop("query_id").join(c, "id")
            h = outside(h, "hits")
        if not hops:
            return Hits(h.orderBy("rank"))
        seeds = h.where("node_id is not null").select(F.col("node_id").alias("id"))
        e = self._edges()
        rel = graph.context_expand(e, seeds).groupBy(F.col("hit").alias("node_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "related"))).alias("r"))
        near, links = graph.k_hop(e, self.tables["nodes"], seeds, hops)
        full = h.join(rel, "node_id", "left").withColumn("related", F.transform("r", lambda x: x["related"])).drop("r").orderBy("rank")
        return Hits(full, self.tables["nodes"].join(near, "id").orderBy("id"), links.orderBy("source", "target", "kind"))

    def _edges(self) -> DataFrame:
        return self.tables["edges"].withColumn("kind", graph.kind_of())

    def find(self, text: str) -> DataFrame:
        return graph.find_symbols(self.tables["nodes"], text)

    def chunk(self, chunk_id: str) -> DataFrame:
        return self.tables["chunks"].where(F.col("id") == chunk_id)

    def subgraph(self, ids: list[str], hops: int = 1) -> tuple[DataFrame, DataFrame]:
        seeds = self.spark.createDataFrame([(i,) for i in ids], "id string")
        near, links = graph.k_hop(self._edges(), self.tables["nodes"], seeds, hops)
        return self.tables["nodes"].join(near, "id"), links

    def impact(self, symbol: str, depth: int = 2) -> DataFrame | None:
        """``(target, id, depth)`` for an id, else for the first symbol found; None where there is none."""
        n = self.tables["nodes"]
        target = n.where(F.col("id") == symbol).select("id").limit(1).collect() or self.find(symbol).select("id").limit(1).collect()
        if not target:
            return None
        return graph.impact(self._edges(), n, self.spark.createDataFrame([(target[0][0],)], "id string"), depth)

    def co_change(self, file: str, root: str = ".", commits: int = 200, top: int = 5) -> DataFrame:
        """Files that change together with one."""
        h = files.git_history(self.spark, root, commits)
        # of a log the latest commit comes first
        return cochange.candidates(h.withColumn("seq", -F.col("seq").cast("bigint")), file, top)

    def context(self, task: str, limit: int = 4) -> str:
        """Markdown of the best hits with their symbols, related nodes and, if several, the files a change affects."""
        found = self.search(task, limit, 1)
        n = self.tables["nodes"]
        about = n.select(F.col("id").alias("node_id"), "label", "kind", "signature")
        hits = found.hits.join(about, "node_id", "left").orderBy("rank").collect()
        if not hits:
            return f"# Context for: {task}\n\nNothing relevant was found."
        seeds = found.hits.where("node_id is not null").select(F.col("node_id").alias("id"))
        touched = {r["target"]: sorted(r["f"]) for r in graph.affected_files(graph.impact(self._edges(), n, seeds), n).groupBy("target").agg(F.collect_set("file_path").alias("f")).collect()}
        near = found.hits.select(F.explode("related").alias("id")).distinct().join(n.select("id", "label", "kind", "file_path"), "id").collect()
        named = {r["id"]: f"`{r['label']}` ({r['kind']}) in `{r['file_path']}`" for r in near}
        out = [f"# Context for: {task}"]
        for r in hits:
            ext = os.path.splitext(r["file_path"] or "")[1][1:]
            out += ["", f"## {r['rank']}. {r['file_path']}:{r['start_line']}-{r['end_line']} (score {r['score']:.3f})"]
            if r["label"]:
                out.append(f"Symbol: `{r['label']}` ({r['kind']})" + (f", `{r['signature']}`" if r["signature"] else ""))
            if r["related"]:
                out.append("Related: " + "; ".join(named.get(x, x) for x in r["related"]))
            if len(touched.get(r["node_id"], [])) > 1:
                out.append("Affects: " + ", ".join(touched[r["node_id"]]))
            out += [f"```{T.FENCE_TAGS.get(ext, '')}", r["content"] or "", "```"]
        return "\n".join(out)

    def stats(self) -> dict[str, int]:
        return {t: self.tables[t].count() for t in ("chunks", "nodes", "edges")}

    def evaluate(self, fixture: str) -> DataFrame:
        """Metrics by mode and kind over a labelled fixture of its own documents."""
        docs, qrels = files.fixture(self.spark, fixture)
        c = docs.select("id", F.col("path").alias("file_path"), "content", "fingerprint_byte")
        labels = qrels.select("query_id", "id", "grade")
        q = qrels.select("query_id", F.col("text").alias("query"), "kind").distinct()
        out = None
        asked = q.select("query_id", "query")
        # documents with a given vector are in a space of their own, which no text reaches
        own = c.where("fingerprint_byte is null")
        if self.embedder is None:
            dense = retrieval.dense_lists(own, asked, 20)
        else:
            made = own.select("id", retrieval.feature_space(F.col("file_path")).alias("space"), V.normalize(self.embedder(F.col("content"))).alias("vector"))
            dense = retrieval.stored_lists(made, asked, 20, self.embedder)
        for mode in ("bm25", "dense", "hybrid"):
            m = evaluate.by_kind(evaluate.metrics(retrieval.hybrid_search(c, asked, 10, mode, dense=dense), labels), q.select("query_id", "kind")).withColumn("mode", F.lit(mode))
            out = m if out is None else out.unionByName(m)
        return out.orderBy("kind", "mode")


def to_json(df: DataFrame) -> str:
    """Rows as one JSON list."""
    return json.dumps([json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"))).collect()], indent=2)
