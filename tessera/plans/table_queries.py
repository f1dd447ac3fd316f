"""Queries of vectors, lookups, joins, updates, evaluation, parsing and streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import evaluate, retrieval, updates
from ..session import shared_dir, table
from ..sources import files, parsers
from ..streaming import watch
from . import graph_queries as GQ
from .catalog import query
from .text_queries import CH, CODE, _chunks, _searches

PAIR = "pr AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings))"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("a"), F.pmod(F.col("vec_id") * 7 + 3, F.lit(e.count())).alias("b_id"))
    return a.join(e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("b")), "b_id")


def _pair_query(name: str, sql: str, column) -> None:
    @query(name, f"WITH {PAIR} SELECT a_id, b_id, round({sql}, 6) AS value FROM pr")
    def q(spark: SparkSession, d: str) -> DataFrame:
        return _pairs(spark, d).select("a_id", "b_id", F.round(column(F.col("a"), F.col("b")), 6).alias("value"))

    q.__doc__ = f"{name} of each vector with another."


_pair_query("vec_dot", "list_inner_product(a, b)", V.dot)
_pair_query("vec_l2", "list_distance(a, b) ** 2", V.l2_squared)
_pair_query("vec_norm", "sqrt(list_inner_product(a, a))", lambda a, b: V.norm(a))
_pair_query("vec_cosine_sim", "greatest(-1, least(1, list_cosine_similarity(a, b)))", V.cosine_similarity)
_pair_query("vec_cosine_dist", "1 - greatest(-1, least(1, list_cosine_similarity(a, b)))", V.cosine_distance)


@query("vec_metric_dispatch", f"WITH {PAIR} SELECT a_id, b_id, round(1 - list_cosine_similarity(a, b), 6) AS cosine, round(-list_inner_product(a, b), 6) AS dot, round(list_distance(a, b), 6) AS euclidean, round(1 / (1 + list_distance(a, b)), 6) AS score FROM pr")
def vec_metric_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Distances under each metric, and a score."""
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d).select("a_id", "b_id", *(F.round(V.distance(m, a, b), 6).alias(m) for m in V.METRICS), F.round(V.score("euclidean", V.distance("euclidean", a, b)), 6).alias("score"))


@query("vec_normalize", "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5)) AS unit FROM embeddings")
def vec_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of length 1."""
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.normalize(F.col("embedding")), lambda x: F.round(x, 5)).alias("unit"))


@query("vec_dim_check", "SELECT space, len(vector) AS dim, count(*) AS n FROM features WHERE vector IS NOT NULL GROUP BY ALL")
def vec_dim_check(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the vectors of each space."""
    return table(spark, d, "features").where("vector is not null").groupBy("space", F.size("vector").cast("bigint").alias("dim")).agg(F.count("*").alias("n"))


@query("feature_space_counts", "SELECT space, count(*) AS n FROM features GROUP BY space")
def feature_space_counts(spark: SparkSession, d: str) -> DataFrame:
    """Features of each space."""
    return table(spark, d, "features").groupBy("space").agg(F.count("*").alias("n"))


@query("override_vectors", f"WITH {CH}, g AS (SELECT vector_id, min(list_transform(vector::DOUBLE[], lambda x: round(x, 6) + 0.0)) AS given FROM features WHERE space = 'BinaryFingerprint' AND len(vector) = 256 GROUP BY vector_id) SELECT ch.id, CASE WHEN given IS NOT NULL THEN 'BinaryFingerprint' WHEN regexp_extract(file_path, '[^/.][^/]*\\.([^./]+)$', 1) IN {CODE} THEN 'Code' ELSE 'Text' END AS space, given FROM ch LEFT JOIN g USING (vector_id)")
def override_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Given vectors in place of hashed ones, for chunks that have them."""
    given = table(spark, d, "features").where("space = 'BinaryFingerprint' and size(vector) = 256").groupBy("vector_id").agg(F.min(F.transform("vector", lambda x: F.round(x.cast("double"), 6) + F.lit(0.0))).alias("given"))
    return _chunks(spark, d).select("id", "vector_id", "file_path").join(given, "vector_id", "left").select("id", retrieval.feature_space(F.col("file_path"), override=F.col("given").isNotNull()).alias("space"), "given")


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _ann_sql(distance: str) -> str:
    return f"""SELECT query_id, id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM
        (SELECT q.vec_id AS query_id, e.vec_id AS id, round({distance}, 6) AS distance FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)) WHERE rank <= 10"""


def _ann_query(metric: str, sql: str) -> None:
    @query(f"ann_exact_{metric}", _ann_sql(sql))
    def q(spark: SparkSession, d: str) -> DataFrame:
        e = _embeddings(spark, d)
        return retrieval.exact_knn(e.where("id % 50 = 0").withColumnRenamed("id", "query_id"), e, 10, metric if metric != "l2" else "euclidean").withColumn("rank", F.col("rank").cast("bigint"))

    q.__doc__ = f"The ten nearest of every fiftieth vector among all ({metric})."


A, B = "q.embedding::DOUBLE[]", "e.embedding::DOUBLE[]"
_ann_query("cosine", f"1 - greatest(-1, least(1, list_cosine_similarity({A}, {B})))")
_ann_query("dot", f"-list_inner_product({A}, {B})")
_ann_query("l2", f"list_distance({A}, {B})")


def _near_one(spark: SparkSession, d: str, metric: str, k: int) -> DataFrame:
    e = _embeddings(spark, d)
    return retrieval.exact_knn(e.where("id = 5").withColumnRenamed("id", "query_id"), e, k, metric)


@query("topk_ann", f"SELECT e.vec_id AS id, round(1 - list_cosine_similarity({A}, {B}), 6) AS distance FROM embeddings q, embeddings e WHERE q.vec_id = 5 ORDER BY distance, id LIMIT 10")
def topk_ann(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to one."""
    return _near_one(spark, d, "cosine", 10).select("id", "distance")


@query("join_cross_vectors", f"SELECT q.vec_id AS query_id, count(*) AS n, round(avg(list_inner_product({A}, {B})), 6) AS mean FROM embeddings q, embeddings e WHERE q.vec_id IN (1, 2, 3) GROUP BY ALL")
def join_cross_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Three given vectors against all, by blocks."""
    e = _embeddings(spark, d)
    x = retrieval.block_products(e.where("id in (1, 2, 3)").withColumnRenamed("id", "query_id"), e)
    return x.groupBy("query_id").agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean"))


@query("topk_per_query", "SELECT event_type, event_id, value, rank FROM (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5")
def topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    """The five largest events of each type."""
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 5").select("event_type", "event_id", "value", "rank")


_LSH = retrieval.LshConfig(bits=6, tables=12)


@query("ann_lsh")
def ann_lsh(spark: SparkSession, d: str) -> DataFrame:
    """Near vectors of every fiftieth one by random hyperplanes, ranked exactly."""
    e = _embeddings(spark, d)
    return retrieval.lsh_knn(e.where("id % 50 = 0").withColumnRenamed("id", "query_id"), e, 10, _LSH)


@query("ann_recall")
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the hyperplanes for every fiftieth vector."""
    e = _embeddings(spark, d)
    q = e.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    gold = retrieval.exact_knn(q, e, 10)
    found = retrieval.lsh_knn(q, e, 10, _LSH)
    return evaluate.recall(found.select("query_id", "id"), gold.select("query_id", "id"))


@query("ann_recall_ok", "SELECT count(*) AS queries, true AS recall_ok FROM embeddings WHERE vec_id % 50 = 0")
def ann_recall_ok(spark: SparkSession, d: str) -> DataFrame:
    """Whether the mean recall of the hyperplanes is at least 0.9."""
    return ann_recall(spark, d).agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("recall_ok"))


@query("set_intersect_topk", f"SELECT id FROM (SELECT e.vec_id AS id FROM embeddings q, embeddings e WHERE q.vec_id = 5 ORDER BY round(1 - list_cosine_similarity({A}, {B}), 6), e.vec_id LIMIT 40) INTERSECT SELECT id FROM (SELECT e.vec_id AS id FROM embeddings q, embeddings e WHERE q.vec_id = 5 ORDER BY round(-list_inner_product({A}, {B}), 6), e.vec_id LIMIT 40)")
def set_intersect_topk(spark: SparkSession, d: str) -> DataFrame:
    """Vectors near to one under two metrics."""
    top = lambda m: _near_one(spark, d, m, 40).select("id")
    return top("cosine").intersect(top("dot"))


@query("chunk_lookup", f"WITH {CH} SELECT id, file_path, start_line, end_line FROM ch WHERE file_path = 'mono/docs/operations.md'")
def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of one file."""
    return _chunks(spark, d).where("file_path = 'mono/docs/operations.md'").select("id", "file_path", "start_line", "end_line")


@query("chunk_by_vector", f"WITH {CH}, f AS (SELECT DISTINCT vector_id, space FROM features WHERE vector_id IS NOT NULL) SELECT ch.id, f.vector_id, f.space FROM ch JOIN f USING (vector_id)")
def chunk_by_vector(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by the ids of their vectors."""
    f = table(spark, d, "features").where("vector_id is not null").select("vector_id", "space").distinct()
    return _chunks(spark, d).join(f, "vector_id").select("id", "vector_id", "space")


@query("upsert_latest", f"WITH {CH} SELECT id, seq, indexed_at FROM ch")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of each chunk."""
    return _chunks(spark, d).select("id", "seq", "indexed_at")


@query("path_filter", f"WITH {CH}, p AS (SELECT DISTINCT file_path FROM ch WHERE file_path IS NOT NULL) SELECT file_path FROM p WHERE NOT regexp_matches(file_path, '(^|/)(\\.[^/]+|target|node_modules)(/|$)')")
def path_filter(spark: SparkSession, d: str) -> DataFrame:
    """Paths that a watcher looks at."""
    p = _chunks(spark, d).where("file_path is not null").select("file_path").distinct()
    return p.where(files.path_allowed(F.col("file_path"), ("target", "node_modules")))


@query("indexed_paths", "SELECT file_path FROM chunks WHERE file_path IS NOT NULL AND file_path <> '' UNION SELECT file_path FROM nodes WHERE file_path IS NOT NULL AND file_path <> ''")
def indexed_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of all chunks and nodes."""
    a, b = (table(spark, d, t).select("file_path") for t in ("chunks", "nodes"))
    return a.unionByName(b).where("file_path is not null and file_path <> ''").distinct()


@query("set_except_paths", "SELECT file_path FROM nodes WHERE file_path <> '' EXCEPT SELECT file_path FROM chunks")
def set_except_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of nodes that no chunk has."""
    return table(spark, d, "nodes").where("file_path <> ''").select("file_path").subtract(table(spark, d, "chunks").select("file_path"))


@query("dup_ids", "SELECT id, count(*) AS n FROM chunks WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
def dup_ids(spark: SparkSession, d: str) -> DataFrame:
    """Chunk ids that come more than once."""
    return table(spark, d, "chunks").where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


@query("join_left_node", f"WITH {CH}, {GQ.ND}, bc AS (SELECT chunk_id, max(id) AS node FROM nd WHERE chunk_id IS NOT NULL GROUP BY chunk_id) SELECT ch.id, bc.node FROM ch LEFT JOIN bc ON bc.chunk_id = ch.id")
def join_left_node(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk with its node, if any."""
    n = GQ.nodes(spark, d).where("chunk_id is not null").groupBy(F.col("chunk_id").alias("id")).agg(F.max("id").alias("node"))
    return _chunks(spark, d).select("id").join(n, "id", "left")


_GONE = "SELECT file_path FROM ch WHERE file_path LIKE '%.md'"


@query("join_anti_removed", f"WITH {CH} SELECT id, file_path FROM ch WHERE file_path IS NULL OR file_path NOT IN ({_GONE})")
def join_anti_removed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without those of Markdown files."""
    c = _chunks(spark, d)
    return updates.remove_by(c, c.where("file_path like '%.md'")).select("id", "file_path")


@query("remove_files", f"WITH {CH}, k AS (SELECT * FROM ch WHERE file_path IS NULL OR file_path NOT IN ({_GONE})) SELECT 'chunks' AS what, count(*) AS n FROM k UNION ALL SELECT 'features', count(*) FROM features WHERE vector_id NOT IN (SELECT vector_id FROM ch WHERE vector_id IS NOT NULL AND file_path LIKE '%.md') OR vector_id IS NULL")
def remove_files(spark: SparkSession, d: str) -> DataFrame:
    """What a removal of files leaves of chunks and features."""
    c = _chunks(spark, d)
    gone = c.where("file_path like '%.md'")
    kept = updates.remove_by(c, gone)
    f = table(spark, d, "features").join(gone.where("vector_id is not null").select("vector_id").distinct(), "vector_id", "left_anti")
    return kept.agg(F.count("*").alias("n")).select(F.lit("chunks").alias("what"), "n").unionByName(f.agg(F.count("*").alias("n")).select(F.lit("features").alias("what"), "n"))


_DIFF = """o AS (SELECT o_orderkey AS path, o_totalprice AS mtime, o_custkey AS length FROM orders WHERE o_orderkey % 10 <> 0),
    n AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS mtime, o_custkey AS length FROM orders WHERE o_orderkey % 11 <> 0)"""


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("mtime"), F.col("o_custkey").alias("length"))
    return o.where("path % 10 <> 0"), o.where("path % 11 <> 0").withColumn("mtime", F.when(F.col("path") % 7 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))


@query("snapshot_diff", f"WITH {_DIFF} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'insert' WHEN n.path IS NULL THEN 'delete' ELSE 'update' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR o.mtime <> n.mtime OR o.length <> n.length")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Changes between two states of a table."""
    return updates.snapshot_diff(*_states(spark, d))


@query("join_full_diff", f"WITH {_DIFF} SELECT CASE WHEN o.path IS NULL THEN 'insert' WHEN n.path IS NULL THEN 'delete' ELSE 'both' END AS side, count(*) AS n FROM o FULL JOIN n ON o.path = n.path GROUP BY ALL")
def join_full_diff(spark: SparkSession, d: str) -> DataFrame:
    """Rows of either state or both."""
    a, b = _states(spark, d)
    j = a.select("path", F.lit(1).alias("a")).join(b.select("path", F.lit(1).alias("b")), "path", "full_outer")
    return j.groupBy(F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").otherwise("both").alias("side")).agg(F.count("*").alias("n"))


@query("percentile_ceil", "SELECT event_type, list_sort(list(value))[CAST(ceil((count(*) - 1) * 0.95) AS BIGINT) + 1] AS value FROM events WHERE value IS NOT NULL GROUP BY event_type")
def percentile_ceil(spark: SparkSession, d: str) -> DataFrame:
    """The 95th percentile of each event type, as an item."""
    return evaluate.percentile_ceil(table(spark, d, "events"), "event_type", "value", 0.95)


@query("next_chunk_edges", f"WITH {CH} SELECT before AS source, id AS target FROM (SELECT id, lag(id) OVER (PARTITION BY file_path ORDER BY start_line NULLS FIRST, id) AS before FROM ch WHERE file_path IS NOT NULL) WHERE before IS NOT NULL")
def next_chunk_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk and the next of its file."""
    return parsers.next_links(_chunks(spark, d), "file_path", ["start_line"], "id")


_QREL = "rl AS (SELECT doc_id % 20 AS query_id, doc_id AS id, CAST(doc_id % 4 AS INT) AS grade, doc_kind AS kind FROM documents), rk AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY (id * 7919) % 1009, id) AS rank FROM rl)"
_EVAL = f"""{_QREL}, id AS (SELECT query_id, sum(CASE WHEN grade > 0 THEN 1 ELSE 0 END) AS relevant, sum(CASE WHEN r <= 10 THEN (2.0 ** least(grade, 20) - 1) / log2(r + 1) END) AS ideal
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS r FROM rl) GROUP BY query_id),
    gt AS (SELECT query_id, sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS b, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN (2.0 ** least(grade, 20) - 1) / log2(rank + 1) ELSE 0 END) AS dcg
        FROM rl JOIN rk USING (query_id, id) WHERE grade > 0 GROUP BY query_id),
    ev AS (SELECT query_id, coalesce(a, 0) / greatest(relevant, 1)::DOUBLE AS recall_at_5, coalesce(b, 0) / greatest(relevant, 1)::DOUBLE AS recall_at_10, coalesce(1.0::DOUBLE / first, 0) AS mrr,
        CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END AS ndcg_at_10, CASE WHEN first = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_at_1 FROM id LEFT JOIN gt USING (query_id))"""


def _eval(spark: SparkSession, d: str) -> DataFrame:
    rl = table(spark, d, "documents").select((F.col("doc_id") % 20).alias("query_id"), F.col("doc_id").alias("id"), (F.col("doc_id") % 4).cast("int").alias("grade"))
    w = Window.partitionBy("query_id").orderBy((F.col("id") * 7919) % 1009, "id")
    return evaluate.metrics(rl.select("query_id", "id", F.row_number().over(w).alias("rank")), rl)


def _eval_query(name: str, columns: tuple[str, ...]) -> None:
    @query(name, f"WITH {_EVAL} SELECT query_id, {', '.join(f'round({c}, 6) AS {c}' for c in columns)} FROM ev")
    def q(spark: SparkSession, d: str) -> DataFrame:
        return _eval(spark, d).select("query_id", *(F.round(c, 6).alias(c) for c in columns))

    q.__doc__ = f"{', '.join(columns)} of a ranking against graded labels."


_eval_query("eval_recall", ("recall_at_5", "recall_at_10"))
_eval_query("eval_mrr", ("mrr",))
_eval_query("eval_ndcg", ("ndcg_at_10",))
_eval_query("eval_hit1", ("hit_at_1",))


@query("eval_metrics", f"WITH {_EVAL} SELECT CASE WHEN query_id % 2 = 0 THEN 'exact' ELSE 'semantic' END AS kind, count(*) AS queries, round(avg(recall_at_5), 6) AS recall_at_5, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(mrr), 6) AS mrr, round(avg(ndcg_at_10), 6) AS ndcg_at_10, round(avg(hit_at_1), 6) AS hit_at_1 FROM ev GROUP BY ALL")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Means of the metrics by kind of query."""
    e = _eval(spark, d)
    kinds = e.select("query_id", F.when(F.col("query_id") % 2 == 0, "exact").otherwise("semantic").alias("kind"))
    m = evaluate.by_kind(e, kinds)
    return m.select("kind", "queries", *(F.round(c, 6).alias(c) for c in m.columns[2:]))


_WS = r"[\t-\r\x1c-\x1f\x{0085}\p{Z}]"
_MD = rf"""md AS (SELECT doc_id, l, line, regexp_extract(l, '^{_WS}*(```|~~~)', 1) AS mark FROM (SELECT doc_id, unnest(x) AS l, generate_subscripts(x, 1) AS line FROM
        (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '\n$', ''), chr(10)) AS x FROM documents WHERE text IS NOT NULL))),
    mk AS (SELECT doc_id, line, mark, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS k FROM md WHERE mark <> ''),
    fs AS (SELECT doc_id, k, line, mark AS fence FROM mk WHERE k = 1
        UNION ALL SELECT mk.doc_id, mk.k, mk.line, CASE WHEN fence = '' THEN mk.mark WHEN fence = mk.mark THEN '' ELSE fence END FROM fs JOIN mk ON mk.doc_id = fs.doc_id AND mk.k = fs.k + 1),
    hd AS (SELECT md.doc_id, l, md.line, CASE WHEN mark = '' AND coalesce(fence, '') = '' AND regexp_matches(l, '^#{{1,6}}{_WS}') THEN 1 ELSE 0 END AS h FROM md ASOF LEFT JOIN fs ON md.doc_id = fs.doc_id AND md.line >= fs.line)"""


def _md_lines(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, line, h, title)`` of all documents: lines in fences and lines that mark them are no headings."""
    t = table(spark, d, "documents").where("text is not null")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lines = b.column(1)[i].as_py()
                titles = parsers.headings(lines)[1]
                n = len(lines)
                at = [k in titles for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], n), pa.array(range(1, n + 1), pa.int64()), pa.array(at).cast(pa.int32()), pa.array([titles.get(k) for k in range(n)], pa.string())], ["doc_id", "line", "h", "title"])

    return t.select("doc_id", T.lines(F.col("text")).alias("l")).mapInArrow(f, f"doc_id {dict(t.dtypes)['doc_id']}, line bigint, h int, title string")


@query("md_sections", f"WITH RECURSIVE {_MD}, s AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY line) AS sec FROM hd) SELECT doc_id, CAST(sec AS BIGINT) AS section, CAST(min(line) AS BIGINT) AS start_line, CAST(max(line) AS BIGINT) AS end_line, count(*) AS lines FROM s GROUP BY ALL")
def md_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of all documents, by a running count of the headings outside of fences."""
    s = _md_lines(spark, d).withColumn("section", F.sum("h").over(Window.partitionBy("doc_id").orderBy("line")).cast("bigint"))
    return s.groupBy("doc_id", "section").agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.count("*").alias("lines"))


@query("anchor_ordinals", rf"""WITH RECURSIVE {_MD}, t AS (SELECT doc_id, line, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(l, '^#{{1,6}}{_WS}+', '')), '[^\p{{L}}\p{{N}}{T.OTHER_LETTERS}_\-\t-\r\x1c-\x1f\x{{0085}}\p{{Z}}]', '', 'g'), '-?{_WS}+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM hd WHERE h = 1)
    SELECT doc_id, line, slug, row_number() OVER (PARTITION BY doc_id, slug ORDER BY line) - 1 AS ordinal FROM t""")
def anchor_ordinals(spark: SparkSession, d: str) -> DataFrame:
    """Number of each heading outside of fences among those of equal anchor, in any script."""
    heads = _md_lines(spark, d).where("h = 1").select("doc_id", "line", T.slug(F.col("title"), runs=True).alias("slug"))
    return heads.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id", "slug").orderBy("line")).cast("bigint") - 1)


#: Earlier names.
md_sections_whole, anchor_ordinals_whole = md_sections, anchor_ordinals


@query("brace_blocks", rf"""WITH {CH}, x AS (SELECT id, string_split(regexp_replace(regexp_replace(content, '\r\n', chr(10), 'g'), '\n$', ''), chr(10)) AS x FROM ch WHERE content IS NOT NULL AND content <> ''),
    l AS (SELECT id, unnest(x) AS l, generate_subscripts(x, 1) AS line, len(x) AS n FROM x),
    c AS (SELECT id, line, n, length(l) - length(replace(l, '{{', '')) AS ups, length(l) - length(replace(l, '}}', '')) AS downs FROM l),
    s AS (SELECT id, line, n, ups, ups - downs AS move, sum(ups - downs) OVER (PARTITION BY id ORDER BY line) AS depth FROM c)
    SELECT a.id, CAST(a.line AS BIGINT) AS line, CAST(any_value(a.depth) AS BIGINT) AS depth, CASE WHEN any_value(a.ups) > 0 THEN CAST(coalesce(min(b.line), any_value(a.n)) AS BIGINT) END AS block_end
    FROM s a LEFT JOIN s b ON a.ups > 0 AND a.id = b.id AND b.line >= a.line AND b.depth <= a.depth - a.move GROUP BY a.id, a.line""")
def brace_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Depth of braces after each line of all chunks, and for lines that open one the line that closes it."""
    c = _chunks(spark, d).where("content is not null and content <> ''").select("id", T.lines(F.col("content")).alias("l"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                lines = b.column(1)[i].as_py()
                depth, rows = 0, []
                for k, x in enumerate(lines):
                    depth += x.count("{") - x.count("}")
                    rows.append((k + 1, depth, parsers.block_end(lines, k) if "{" in x else None))
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column(0)[i], len(lines)), *(pa.array(v, pa.int64()) for v in zip(*rows))], ["id", "line", "depth", "block_end"])

    return c.mapInArrow(f, "id string, line bigint, depth bigint, block_end bigint")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The texts of chunks as files of their own, under their ids."""
    c = _chunks(spark, d).where("content is not null")
    return c.select(F.concat_ws(".", F.regexp_replace("id", r"\.", "_"), F.coalesce(T.extension(F.col("file_path")), F.lit("txt"))).alias("path"), F.col("content").alias("text"))


@query("parse_chunks")
def parse_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Symbols, sections and windows of all chunks' texts."""
    return parsers.chunks_of(parsers.units(_files(spark, d)))


@query("parse_edges")
def parse_edges(spark: SparkSession, d: str) -> DataFrame:
    """Links between what was parsed."""
    return parsers.edges_of(parsers.units(_files(spark, d)))


#: Small files of every kind that is parsed; fixed texts.
SMALL_FILES = (
    ("a/lib.rs", "/// Adds.\npub fn add(x: u8) -> u8 {\n    x + 1\n}\n\nimpl Show for Point {\n    pub(crate) async fn show(&self) {\n        if true { add(1); }\n    }\n}\n\npub struct Point { x: u8 }\nenum Kind {\n    A,\n}\n"),
    ("a/mod.py", "class Store(Base, object):\n    def put(self, k):\n        return k\n\nasync def load(path):\n    return open(path)\n\nx = 1\n"),
    ("a/ui.ts", "export class View extends Base implements Shown, Sized {\n}\nexport const draw = async (v) => {\n  v.draw();\n}\ninterface Shown {\n}\nfunction main() {\n}\n"),
    ("doc/read.md", "before\n# First part\n[go](#second--part) ![no](#first-part)\n```\n# not one\n~~~\n[no](#first-part)\n```\n## Second - part\ntext\n# First part\nend\n"),
    ("doc/plain.txt", "".join(f"line {i}\n" for i in range(1, 61))),
    ("doc/empty.md", " \n"),
)
_SMALL_CHUNKS = """('a/lib.rs', 'symbol:a/lib.rs:add', 1, 4, 'Function', 'add', 'pub fn add(x: u8) -> u8'), ('a/lib.rs', 'symbol:a/lib.rs:Point::show', 7, 9, 'Method', 'Point::show', 'impl Show for Point -> fn show'),
    ('a/lib.rs', 'symbol:a/lib.rs:Point', 12, 12, 'Struct', 'Point', 'pub struct Point'), ('a/lib.rs', 'symbol:a/lib.rs:Kind', 13, 15, 'Class', 'Kind', 'enum Kind'),
    ('a/mod.py', 'symbol:a/mod.py:Store', 1, 4, 'Class', 'Store', 'class Store'), ('a/mod.py', 'symbol:a/mod.py:load', 5, 7, 'Function', 'load', 'def load(path)'),
    ('a/ui.ts', 'symbol:a/ui.ts:View', 1, 2, 'Class', 'View', 'class View'), ('a/ui.ts', 'symbol:a/ui.ts:draw', 3, 5, 'Function', 'draw', 'const draw = () =>'),
    ('a/ui.ts', 'symbol:a/ui.ts:Shown', 6, 7, 'Interface', 'Shown', 'interface Shown'), ('a/ui.ts', 'symbol:a/ui.ts:main', 8, 9, 'Function', 'main', 'function main'),
    ('doc/read.md', 'doc:doc/read.md:L1', 1, 1, 'DocSection', 'Introduction', NULL), ('doc/read.md', 'doc:doc/read.md:L2', 2, 8, 'DocSection', 'First part', NULL),
    ('doc/read.md', 'doc:doc/read.md:L9', 9, 10, 'DocSection', 'Second - part', NULL), ('doc/read.md', 'doc:doc/read.md:L11', 11, 12, 'DocSection', 'First part', NULL),
    ('doc/plain.txt', 'chunk:doc/plain.txt:1:50', 1, 50, 'Chunk', '', NULL), ('doc/plain.txt', 'chunk:doc/plain.txt:41:60', 41, 60, 'Chunk', '', NULL)"""


def _small(spark: SparkSession) -> DataFrame:
    return parsers.units(spark.createDataFrame(list(SMALL_FILES), "path string, text string"))


@query("parse_small", f"SELECT * FROM (VALUES {_SMALL_CHUNKS}) AS t(file_path, node_id, start_line, end_line, kind, name, signature)")
def parse_small(spark: SparkSession, d: str) -> DataFrame:
    """What small files of every kind are cut into, against rows written by hand."""
    return _small(spark).where("has_chunk").select("file_path", "node_id", "start_line", "end_line", "kind", "name", "signature")


@query(
    "parse_small_edges",
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line) AS r FROM (VALUES {_SMALL_CHUNKS}) AS t(file_path, node_id, start_line, end_line, kind, name, signature))
    SELECT 'file:' || file_path AS source, node_id AS target, 'Contains' AS kind FROM c UNION ALL SELECT a.node_id, b.node_id, 'NextChunk' FROM c a JOIN c b ON a.file_path = b.file_path AND b.r = a.r + 1
    UNION ALL SELECT * FROM (VALUES ('file:a/lib.rs', 'symbol:a/lib.rs:impl_Show_for_Point', 'Contains'), ('symbol:a/lib.rs:impl_Show_for_Point', 'symbol:a/lib.rs:Point::show', 'Defines'),
        ('symbol:a/lib.rs:Point', 'symbol:Show', 'Implements'), ('symbol:a/lib.rs:Point::show', 'symbol:Show::show', 'Implements'), ('symbol:a/mod.py:Store', 'symbol:Base', 'Implements'),
        ('symbol:a/ui.ts:View', 'symbol:Base', 'Implements'), ('symbol:a/ui.ts:View', 'symbol:Shown', 'Implements'), ('symbol:a/ui.ts:View', 'symbol:Sized', 'Implements'), ('doc:doc/read.md:L2', 'doc:doc/read.md:L9', 'LinksTo'))""",
)
def parse_small_edges(spark: SparkSession, d: str) -> DataFrame:
    """The links between them."""
    return parsers.edges_of(_small(spark)).select("source", "target", "kind")


@query("index_pipeline")
def index_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Files to chunks, nodes, links and terms: what one indexing run stores."""
    from ..operators import bm25, graph
    from ..session import materialize

    f = _files(spark, d)
    u = materialize(parsers.units(f), "units")
    c, n = parsers.chunks_of(u), parsers.nodes_of(u, f)
    e = parsers.edges_of(u).withColumn("seq", F.lit(0))
    valid = graph.insert_valid(e, n)
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(c, "chunks").unionByName(count(n, "nodes")).unionByName(count(valid, "edges")).unionByName(count(bm25.term_frequencies(c), "postings"))


@query("gitlog_sessionize", "WITH c AS (SELECT * FROM commits WHERE hash IS NOT NULL AND len(files) > 0), f AS (SELECT seq, hash, coalesce(subject, '') AS subject, list_filter(files, lambda x: x IS NOT NULL AND trim(x) <> '') AS files, row_number() OVER (ORDER BY seq) AS n FROM c) SELECT CAST(n AS BIGINT) AS seq, hash, subject, files FROM f WHERE len(files) > 0")
def gitlog_sessionize(spark: SparkSession, d: str) -> DataFrame:
    """Commits out of the lines of a log; each commit's lines are put out and read again."""
    c = table(spark, d, "commits").where("hash is not null and size(files) > 0")
    lines = c.select("seq", F.posexplode(F.concat(F.array(F.concat(F.lit("COMMIT:"), "hash", F.lit("|"), F.coalesce("subject", F.lit("")))), F.filter("files", lambda x: x.isNotNull()))).alias("k", "line"))
    return files.parse_git_log(lines.select((F.col("seq") * 100_000 + F.col("k")).alias("line_no"), "line"))


@query(
    "debounce_batches",
    """WITH RECURSIVE e AS (SELECT event_type, ts FROM events WHERE ts IS NOT NULL),
    b AS (SELECT event_type, min(ts) AS s FROM e GROUP BY ALL UNION ALL
        SELECT b.event_type, min(e.ts) FROM b JOIN e ON e.event_type = b.event_type AND e.ts > b.s + INTERVAL 300 SECOND GROUP BY b.event_type, b.s)
    SELECT b.event_type, b.s AS batch_start, count(*) AS n FROM b JOIN e ON e.event_type = b.event_type AND e.ts >= b.s AND e.ts <= b.s + INTERVAL 300 SECOND GROUP BY ALL""",
)
def debounce_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches of events within 5 minutes of their first."""
    e = watch.debounce(table(spark, d, "events"), "ts", "event_type", 300_000)
    return e.groupBy("event_type", F.col("batch_start").cast("timestamp_ntz").alias("batch_start")).agg(F.count("*").alias("n"))


@query("stream_events", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_events(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts, by a stream that runs over all files there are; each micro-batch puts out all windows as they stand."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    last: list[str] = []

    def put(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(path := f"{root}/v{n}")
        last[:] = [path]

    s = watch.windowed_counts(_stream_of(spark, d, "events"))
    s.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(last[0]) if last else watch.windowed_counts(table(spark, d, "events").limit(0))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def _stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", f"{name}.parquet").load(d)


@query("stream_upsert", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each user, kept by micro-batches."""
    root = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    cols = ("user_id", "event_id", "value")
    state = {"path": f"{root}/v0", "n": 0}
    spark.createDataFrame([], "user_id bigint, event_id bigint, value double").write.parquet(state["path"])

    def write(df: DataFrame) -> None:
        state["n"] += 1
        df.write.mode("overwrite").parquet(path := f"{root}/v{state['n']}")
        state["path"] = path

    q = watch.upsert_stream(_stream_of(spark, d, "events").select(*cols), lambda: spark.read.parquet(state["path"]), write, "user_id", "event_id", f"{root}/log")
    q.awaitTermination()
    return spark.read.parquet(state["path"])


@query("task_context")
def task_context(spark: SparkSession, d: str) -> DataFrame:
    """For each search the best chunks, with related nodes and the files a change of them affects."""
    from ..operators import graph

    hits = retrieval.hybrid_search(_chunks(spark, d).select("id", "file_path", "content"), _searches(spark), 4)
    n, e = GQ.nodes(spark, d), GQ.edges(spark, d)
    at = hits.join(n.where("chunk_id is not null").select(F.col("chunk_id").alias("id"), F.col("id").alias("node")), "id", "left")
    near = graph.context_expand(e, at.where("node is not null").select(F.col("node").alias("id"))).groupBy(F.col("hit").alias("node")).agg(F.sort_array(F.collect_list(F.struct("rank", "related"))).alias("related"))
    touched = graph.affected_files(graph.impact(e, n, at.where("node is not null").select(F.col("node").alias("id")), 2), n).groupBy(F.col("target").alias("node")).agg(F.sort_array(F.collect_set("file_path")).alias("files"))
    return at.join(near, "node", "left").join(touched, "node", "left").select("query_id", "rank", "id", "node", F.transform("related", lambda x: x["related"]).alias("related"), F.when(F.size("files") > 1, F.col("files")).alias("affected"))
