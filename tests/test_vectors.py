import numpy as np
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import evaluate, retrieval
from tessera.plans import table_queries

from .conftest import DATA


def test_functions_match_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal(131).tolist(), rng.standard_normal(131).tolist()
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    x, y = F.col("a"), F.col("b")
    got = df.select(V.dot(x, y), V.l2_squared(x, y), V.norm(x), V.cosine_similarity(x, y)).first()
    u, w = np.array(a), np.array(b)
    want = [u @ w, ((u - w) ** 2).sum(), np.sqrt(u @ u), u @ w / np.sqrt((u @ u) * (w @ w))]
    assert np.allclose(list(got), want)


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert tuple(df.select(V.cosine_similarity(F.col("a"), F.col("b")), V.cosine_distance(F.col("a"), F.col("b"))).first()) == (0.0, 1.0)


def test_exact_knn_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((60, 4)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")
    got = retrieval.exact_knn(df.where("id < 7").withColumnRenamed("id", "query_id"), df, 5, "euclidean", block=16)
    by = {}
    for r in got.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    for q in range(7):
        d = np.round(np.sqrt(((x - x[q]) ** 2).sum(1)), 6)
        assert [i for _, i in sorted(by[q])] == sorted(range(60), key=lambda i: (d[i], i))[:5]


def test_hyperplanes_find_nine_tenths(spark):
    assert table_queries.ann_recall(spark, DATA).agg(F.avg("recall")).first()[0] >= 0.9


def test_parts_of_large_buckets_are_all_probed(spark):
    x = np.random.default_rng(4).standard_normal((300, 8)) + 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")
    q = df.where("id < 20").withColumnRenamed("id", "query_id")
    whole, parts = ({tuple(r) for r in retrieval.lsh_candidates(q, df, bits=3, tables=2, dim=8, most=m).collect()} for m in (1000, 5))
    planes = np.random.default_rng(17).standard_normal((2, 3, 8))
    side = np.stack([x @ p.T > 0 for p in planes])
    want = {(i, j) for i in range(20) for j in range(300) if ((side[:, i] != side[:, j]).sum(1) <= 1).any()}
    assert whole == parts == want


def test_embedding_is_nearer_for_similar_texts(spark):
    t = [("a", "parse the query plan"), ("b", "parse a query plan"), ("c", "weather tomorrow sunny"), ("d", None), ("e", "")]
    v = {r["id"]: np.array(r["vector"]) for r in retrieval.hash_embed(spark.createDataFrame(t, "id string, content string")).collect()}
    assert v["a"] @ v["b"] > v["a"] @ v["c"] and not v["d"].any() and not v["e"].any() and abs(v["a"] @ v["a"] - 1) < 1e-9


def test_rrf_order(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, id string, rank int")
    assert [r["id"] for r in retrieval.rrf([a, b]).orderBy("rank").collect()] == ["y", "x", "z"]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "b", 1), (1, "a", 2)], "query_id int, id string, rank int")
    qrels = spark.createDataFrame([(1, "a", 3), (1, "c", 1), (2, "a", 1)], "query_id int, id string, grade int")
    m = {r["query_id"]: r for r in evaluate.metrics(ranked, qrels).collect()}
    assert m[1]["mrr"] == 0.5 and m[1]["recall_at_5"] == 0.5 and m[1]["hit_at_1"] == 0.0
    assert abs(m[1]["ndcg_at_10"] - (7 / np.log2(3)) / (7 + 1 / np.log2(3))) < 1e-9 and m[2]["mrr"] == 0.0


def test_percentile_is_an_item(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 3.0)], "g string, v double")
    assert {r[0]: r[1] for r in evaluate.percentile_ceil(df, "g", "v", 0.95).collect()} == {"a": 9.0, "b": 3.0}
