"""Hashed feature vectors, exact nearest neighbours, rank fusion and hybrid search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..session import materialize
from . import bm25, passes

DIM, RRF_K = 256, 60
#: Queries that one pass takes along as a matrix (8 MB); more are met in blocks.
MOST_QUERIES = 4096
#: Extensions of code; fixed values.
CODE_EXTENSIONS = ("rs", "py", "js", "ts", "jsx", "tsx", "go", "c", "cpp", "h", "hpp")


def feature_counts(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """``(id, feature, count)``: words 1, character trigrams 0.5, word pairs 1.5 each time they occur."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).repartition("id")
    t = src.select("id", T.embed_tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    some = lambda a, w: F.transform(a, lambda x: F.struct(x.alias("feature"), F.lit(w).alias("w")))
    grams = F.flatten(F.transform("t", lambda x: T.char_grams(x)))
    each = F.concat(some(F.col("t"), 1.0), some(grams, 0.5), some(T.bigrams(F.col("t")), 1.5))
    return t.select("id", F.explode(each).alias("f")).groupBy("id", F.col("f.feature").alias("feature")).agg(F.sum("f.w").alias("count"))


def hash_buckets(docs: DataFrame, id_col: str = "id", text_col: str = "content", dim: int = DIM) -> DataFrame:
    """``(id, bucket, value)``: the places of each text's vector of length 1 that a feature fell on; ids are unique."""
    v = passes.vector_rows(docs, id_col, text_col, dim).select("id", F.posexplode(F.arrays_zip("vector", "hit")).alias("bucket", "x"))
    return v.where("x.hit").select("id", F.col("bucket").cast("bigint").alias("bucket"), F.col("x.vector").alias("value"))


def hash_embed(docs: DataFrame, id_col: str = "id", text_col: str = "content", dim: int = DIM) -> DataFrame:
    """``(id, vector array<double>)`` of unique ids; texts without words have a zero vector, null texts too."""
    return passes.vector_rows(docs, id_col, text_col, dim).select("id", "vector")


def feature_space(path: Column, kind: Column | None = None, override: Column | None = None) -> Column:
    """Space of a chunk: given vectors are fingerprints, audio has only metadata, code goes by extension."""
    out = F.when(T.extension(path).isin(*CODE_EXTENSIONS), "Code").otherwise("Text")
    if kind is not None:
        out = F.when(kind == "AudioTrack", "Metadata").otherwise(out)
    if override is not None:
        out = F.when(override, "BinaryFingerprint").otherwise(out)
    return out


def _blocks(queries: DataFrame, corpus: DataFrame, block: int) -> DataFrame:
    """Rows of both sides under each pair of blocks ``(qb, cb)`` they belong to; each side is cut by hash."""
    q_blocks, c_blocks = (max(1, -(-d.count() // block)) for d in (queries, corpus))
    place = lambda col, n: F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col("query_id").alias("id"), "vector", place("query_id", q_blocks).alias("qb"), every(c_blocks).alias("cb"), F.lit(True).alias("is_query"))
    c = corpus.select("id", "vector", every(q_blocks).alias("qb"), place("id", c_blocks).alias("cb"), F.lit(False).alias("is_query"))
    return q.unionByName(c)


def block_products(queries: DataFrame, corpus: DataFrame, block: int = 4096) -> DataFrame:
    """``(query_id, n, total)``: number and sum of the inner products of each query with the vectors of one block."""
    typ = dict(queries.dtypes)["query_id"]

    def multiply(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        ask = t.column("is_query").to_numpy()
        if not ask.any() or ask.all():
            return
        a, b = t.take(pa.array(np.flatnonzero(ask))), t.take(pa.array(np.flatnonzero(~ask)))
        x = passes.matrix_of(a.column("vector")) @ passes.matrix_of(b.column("vector")).T
        yield pa.RecordBatch.from_arrays([a.column("id").combine_chunks(), pa.array(np.full(len(x), x.shape[1])), pa.array(x.sum(1))], ["query_id", "n", "total"])

    return _blocks(queries, corpus, block).groupBy("qb", "cb").applyInArrow(multiply, f"query_id {typ}, n bigint, total double")


def exact_knn(queries: DataFrame, corpus: DataFrame, k: int = 10, metric: str = "cosine", block: int = 4096) -> DataFrame:
    """``(query_id, id, distance, rank)`` of ``queries(query_id, vector)`` against all of ``corpus(id, vector)``.

    Both sides are cut into blocks by hash; each pair of blocks is one matrix
    product and keeps ``k`` a query, so the work is spread and nothing is
    broadcast. Distances are rounded to 6 places; ties go to the smaller id.
    """
    both = _blocks(queries, corpus, block)
    typ = dict(corpus.dtypes)["id"]

    def rank(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        ask = t.column("is_query").to_numpy()
        if not ask.any() or ask.all():
            return
        a, b = t.take(pa.array(np.flatnonzero(ask))), t.take(pa.array(np.flatnonzero(~ask))).sort_by("id")
        x, y = passes.matrix_of(a.column("vector")), passes.matrix_of(b.column("vector"))
        if metric == "cosine":
            nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
            scale = nx[:, None] * ny[None]
            d = 1 - np.where(scale < 1e-12, 0, np.clip((x @ y.T) / np.maximum(scale, 1e-300), -1, 1))
        elif metric == "dot":
            d = -(x @ y.T)
        else:
            d = np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))
        d = np.round(d, 6) + 0.0
        # rows stand in the order of ids; all that tie with the last of the k go on, the ranks below decide
        bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if d.shape[1] > k else d.max(axis=1, keepdims=True)
        r, top = np.nonzero(d <= bound)
        yield pa.RecordBatch.from_arrays([a.column("id").combine_chunks().take(pa.array(r)), b.column("id").combine_chunks().take(pa.array(top)), pa.array(d[r, top])], ["query_id", "id", "distance"])

    near = both.groupBy("qb", "cb").applyInArrow(rank, f"query_id {typ}, id {typ}, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class LshConfig:
    """Options of the hyperplane index: planes a table, tables, length of the vectors, seed, and vectors of a bucket's part.

    More tables find more; more planes examine less. Neighbouring buckets are
    always probed, so the recall wanted is a matter of these two.
    """

    bits: int = 12
    tables: int = 6
    dim: int = 64
    seed: int = 17
    most: int = 400


def lsh_candidates(queries: DataFrame, vectors: DataFrame, bits: int = 12, tables: int = 6, dim: int = 64, seed: int = 17, most: int = 400) -> DataFrame:
    """``(query_id, id)`` of ``queries(query_id, vector)`` and ``vectors(id, vector)`` whose buckets of random hyperplanes differ in one plane at most.

    Buckets of more than ``most`` vectors are dealt into parts, in proportion to
    their size, so a dense region is no hot key; a query goes to all parts.
    """
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dim))
    flips = np.concatenate(([0], 1 << np.arange(bits)))

    def sign(probes: np.ndarray):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.array(b.column(1).to_pylist(), dtype=np.float64)
                for t in range(tables):
                    own = (x @ planes[t].T > 0).astype(np.int64) @ (1 << np.arange(bits))
                    for p in probes:
                        yield pa.RecordBatch.from_arrays([b.column(0), pa.array((own ^ p) + (t << bits))], ["id", "bucket"])

        return f

    s = vectors.select("id", "vector").mapInArrow(sign(flips[:1]), f"id {dict(vectors.dtypes)['id']}, bucket bigint")
    q = queries.select("query_id", "vector").mapInArrow(sign(flips), f"id {dict(queries.dtypes)['query_id']}, bucket bigint").withColumnRenamed("id", "query_id")
    n = s.groupBy("bucket").agg(F.ceil(F.count("*") / most).alias("parts"))
    members = s.join(n, "bucket").select("bucket", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), "id")
    asks = q.join(n, "bucket").select("query_id", "bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    return asks.join(members, ["bucket", "part"]).select("query_id", "id").distinct()


def lsh_knn(queries: DataFrame, vectors: DataFrame, k: int = 10, config: LshConfig | None = None, **how) -> DataFrame:
    """``(query_id, id, cosine, rank)``: the ``k`` nearest among candidates of random hyperplanes, by exact cosine."""
    c = lsh_candidates(queries, vectors, **((asdict(config) if config else {}) | how))
    u = queries.select("query_id", V.normalize(F.col("vector")).alias("u"))
    v = vectors.select("id", V.normalize(F.col("vector")).alias("v"))
    scored = c.join(u, "query_id").join(v, "id").select("query_id", "id", F.round(V.dot(F.col("u"), F.col("v")), 6).alias("cosine"))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``(query_id, id, rank)`` lists: ``(query_id, id, rrf, best_list, rank)``.

    Order: larger sum, earlier list, smaller id.
    """
    all_of = reduce(DataFrame.unionByName, [x.select("query_id", "id", "rank", F.lit(i).alias("list_no")) for i, x in enumerate(lists)])
    f = all_of.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.min("list_no").alias("best_list"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "best_list", "id")
    return f.withColumn("rank", F.row_number().over(w))


def _query_matrix(queries: DataFrame) -> tuple[list, np.ndarray, np.ndarray] | None:
    """Ids, hashed vectors and places of a stated set of queries; None where there are more than MOST_QUERIES."""
    rows = queries.select("query_id", T.words(F.col("query")).alias("words")).limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        return None
    h = passes.Hasher(DIM)
    made = [h.vector(r["words"]) for r in rows]
    return [r["query_id"] for r in rows], np.array([v for v, _ in made]).reshape(-1, DIM), np.array([x for _, x in made], bool).reshape(-1, DIM)


def body_of(columns: list[str]) -> Column:
    """What a chunk's vector is made of: its symbol's label and signature, if known, and the content."""
    return F.concat_ws("\n", F.concat_ws(" ", "label", "signature"), "content") if "label" in columns else F.col("content")


def dense_lists(chunks: DataFrame, queries: DataFrame, limit: int) -> dict[str, DataFrame]:
    """Nearest chunks of each query in the Text and the Code space: ``(query_id, id, distance, rank)``.

    Vectors are made in one pass and meet all queries there; more than
    MOST_QUERIES queries meet them in blocks.
    """
    src = chunks.select("id", feature_space(F.col("file_path")).alias("space"), body_of(chunks.columns).alias("content"))
    return _lists(passes.vector_rows(src, extra=("space",)), queries, limit)


def stored_lists(features: DataFrame, queries: DataFrame, limit: int, embedder=None) -> dict[str, DataFrame]:
    """The same from stored ``features(id, space, vector)``; ``embedder`` is the function of a text column that made them, if not hashing."""
    usable = features.where(F.col("space").isin("Text", "Code") & F.col("vector").isNotNull() & (F.exists("vector", lambda x: x != 0)))
    if embedder is None:
        return _lists(usable, queries, limit)
    asked = queries.select("query_id", V.normalize(embedder(F.col("query"))).alias("vector"))
    rows = asked.where("vector is not null").limit(MOST_QUERIES + 1).collect()
    q = ([r["query_id"] for r in rows], np.array([r["vector"] for r in rows]), None) if 0 < len(rows) <= MOST_QUERIES else None
    return _lists(usable, queries, limit, q, asked)


def _lists(vectors: DataFrame, queries: DataFrame, limit: int, q=None, asked: DataFrame | None = None) -> dict[str, DataFrame]:
    q = q if q is not None or asked is not None else _query_matrix(queries)
    typ = dict(queries.dtypes)["query_id"]
    if q is not None and len(q[0]):
        near = passes.nearest_rows(vectors, q[0], q[1], q[2] if "hit" in vectors.columns else None, limit, typ)
    elif q is not None:
        near = queries.sparkSession.createDataFrame([], f"query_id {typ}, id {dict(vectors.dtypes)['id']}, space string, distance double")
    else:
        # many queries: blocks of queries against blocks of vectors, a space at a time
        vectors = materialize(vectors, "vectors")
        asked = materialize(asked if asked is not None else passes.vector_rows(queries, "query_id", "query").select(F.col("id").alias("query_id"), "vector"), "asked")
        near = reduce(DataFrame.unionByName, [exact_knn(asked, vectors.where(F.col("space") == s), limit).withColumn("space", F.lit(s)).drop("rank") for s in ("Text", "Code")])
    w = Window.partitionBy("query_id", "space").orderBy("distance", "id")
    # at most limit rows a query and space; written, as fusion and scoring both read them
    best = materialize(near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit), "dense")
    return {s: best.where(F.col("space") == s).select("query_id", "id", "distance", "rank") for s in ("Text", "Code")}


def hybrid_search(chunks: DataFrame, queries: DataFrame, limit: int = 5, mode: str = "hybrid", words: DataFrame | None = None, dense: dict[str, DataFrame] | None = None) -> DataFrame:
    """``(query_id, id, rank, rrf, score, distance)`` of ``chunks(id, file_path, content[, label, signature])``.

    Lists of twice ``limit`` are fused in the order keywords, text vectors, code
    vectors. Hits stay in that order; the score is the dense one if that is larger
    than 50 times the fused sum, so it need not fall along the ranks. ``words`` and
    ``dense`` are the lists of a stored index where there is one.
    """
    over = 2 * limit
    empty = chunks.sparkSession.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, id string, distance double, rank int")
    if mode == "dense":
        words = empty
    elif words is None:
        words = bm25.search_texts(chunks, queries, over)
    if mode == "bm25":
        dense = {"Text": empty, "Code": empty}
    elif dense is None:
        dense = dense_lists(chunks, queries, over)
    fused = rrf([words.select("query_id", "id", "rank"), dense["Text"], dense["Code"]]).where(F.col("rank") <= limit)
    near = dense["Text"].unionByName(dense["Code"]).select("query_id", "id", "distance")
    return hit_scores(fused.join(near, ["query_id", "id"], "left")).select("query_id", "id", "rank", "rrf", "score", "distance")


def hit_scores(fused: DataFrame) -> DataFrame:
    """Score and distance of fused hits ``(rrf, distance?)``; ``score_pct`` is held within 0 and 100."""
    boost = 50 * F.col("rrf")
    score = F.when(F.col("distance").isNull(), boost).otherwise(F.greatest(1 - F.col("distance"), boost))
    dist = F.coalesce(F.col("distance"), 1 - F.least(F.col("rrf"), F.lit(1.0)))
    return fused.withColumn("score", score).withColumn("distance", dist).withColumn("score_pct", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * F.col("score"))))
