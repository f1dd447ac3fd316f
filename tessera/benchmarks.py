"""Recall and timings of neighbour search, and of building, saving, loading and the first search."""

from __future__ import annotations

import math
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .operators import bm25, evaluate, retrieval
from .sources import files


def percentile(values: list[float], fraction: float) -> float:
    """The item at index ceil((n - 1) * fraction) of the sorted values."""
    return sorted(values)[math.ceil((len(values) - 1) * fraction)]


def noisy_queries(vectors: DataFrame, n: int, noise: float = 0.05, seed: int = 42) -> DataFrame:
    """``(query_id, vector)``: the first n vectors with seeded noise, scaled to length 1."""
    shake = F.transform("vector", lambda x, i: x + noise * (F.pmod(F.xxhash64("id", i, F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30) - 0.5))
    return vectors.where(F.col("id") < n).select(F.col("id").alias("query_id"), V.normalize(shake).alias("vector"))


def ann(spark: SparkSession, vectors: int = 1000, dim: int = 256, queries: int = 100, k: int = 10, seed: int = 42) -> dict:
    """Exact and hyperplane search over synthetic vectors: recall at k and seconds of each for the whole query set."""
    config = retrieval.LshConfig(bits=4, tables=16, dim=dim)
    v = files.synthetic_vectors(spark, vectors, dim, seed).cache()
    q = noisy_queries(v, queries, seed=seed).cache()
    v.count(), q.count()
    began = time.time()
    gold = retrieval.exact_knn(q, v, k).cache()
    gold.count()
    exact = time.time() - began
    began = time.time()
    near = retrieval.lsh_knn(q, v, k, config).select("query_id", "id").cache()
    near.count()
    approximate = time.time() - began
    # single queries one after another, for the spread of their times
    one = {"exact": [], "approximate": []}
    for i in range(min(5, queries)):
        single = q.where(F.col("query_id") == i)
        for name, f in (("exact", lambda: retrieval.exact_knn(single, v, k)), ("approximate", lambda: retrieval.lsh_knn(single, v, k, config))):  # noqa: B023
            began = time.time()
            f().collect()
            one[name].append(time.time() - began)
    spread = {f"{n}_p{int(100 * p)}_s": round(percentile(x, p), 3) for n, x in one.items() for p in (0.5, 0.95)}
    recall = evaluate.recall(near, gold).agg(F.avg("recall")).first()[0]
    return {"vectors": vectors, "dimension": dim, "queries": queries, "k": k, "seed": seed, "exact_s": round(exact, 3), "approximate_s": round(approximate, 3), "recall_at_k": recall} | spread


def cold(spark: SparkSession, vectors: int = 1000, iterations: int = 5) -> dict:
    """Seconds to build, save, load and search first, over synthetic chunks; p95 of few runs is their maximum."""
    chunks = files.synthetic_chunks(spark, vectors)
    ask = spark.createDataFrame([(1, f"marker{vectors // 2}")], "query_id int, query string")
    load, first = [], []
    with tempfile.TemporaryDirectory() as d:
        began = time.time()
        tf = bm25.postings(chunks).cache()
        lengths = tf.groupBy("id").agg(F.max("doc_len").alias("n")).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_len")).cache()
        lengths.count()
        build = time.time() - began
        began = time.time()
        files.save_snapshot({"chunks": chunks, "postings": bm25.clustered(tf), "lengths": lengths}, d)
        save = time.time() - began
        for _ in range(iterations):
            began = time.time()
            t = files.load_snapshot(spark, d)
            load.append(time.time() - began)
            assert bm25.search(t["postings"], ask, 1, stats=t["lengths"]).first()["id"] == f"chunk:{vectors // 2}"
            first.append(time.time() - began)
    return {"vectors": vectors, "build_s": build, "save_s": save} | {f"{n}_{p}": percentile(x, f) for n, x in (("load", load), ("first_search", first)) for p, f in (("p50", 0.5), ("p95", 0.95))}
