import random
import re

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import bm25


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_identifier_parts(spark):
    assert one(spark, "foo_BarBaz", T.identifier_parts) == ["foo", "barbaz", "bar", "baz"]
    assert one(spark, "HTTPServerX", T.identifier_parts) == ["http", "server", "x"]
    assert one(spark, "plain", T.identifier_parts) == ["plain"]


def naive_tokens(text):
    out = []
    for w in re.findall(r"\w+", text):
        out.append(w.lower())
        parts = []
        for p in [x for x in w.split("_") if x]:
            if "_" in w:
                parts.append(p)
        for p in [x for x in w.split("_") if x]:
            parts += [x for x in re.split(r"(?<=[a-z])(?=[A-Z])|(?<=[^_])(?=[A-Z][a-z])", p) if x]
        for p in parts:
            if p.lower() not in out:
                out.append(p.lower())
    return out


def test_term_frequencies_match_a_sequential_model(spark):
    rnd = random.Random(4)
    make = lambda: "".join(rnd.choice(["foo", "Bar", "HTTP", "x", "_", "Baz", "9"]) for _ in range(rnd.randint(1, 4)))
    docs = [(str(i), " ".join(make() for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    got = {}
    for r in bm25.term_frequencies(spark.createDataFrame(docs, "id string, content string")).collect():
        got.setdefault(r["id"], {})[r["term"]] = r["tf"]
    for i, t in docs:
        want = {}
        for x in naive_tokens(t):
            want[x] = want.get(x, 0) + 1
        assert got.get(i, {}) == want


def test_search_ranks_and_ties(spark):
    docs = spark.createDataFrame([("a", "error E0502 borrow"), ("b", "fn cosine_similarity()"), ("c", "struct"), ("d", None), ("e", "")], "id string, content string")
    tf = bm25.term_frequencies(docs)
    q = spark.createDataFrame([(1, "E0502"), (2, "cosine similarity"), (3, "nothing here")], "query_id int, query string")
    hits = {(r["query_id"], r["id"]): r["rank"] for r in bm25.search(tf, q).collect()}
    assert hits == {(1, "a"): 1, (2, "b"): 1}
    assert bm25.corpus_stats(tf).first()["n_docs"] == 3


def test_lines_slug_paths(spark):
    assert one(spark, "a\r\nb\n\n", T.lines) == ["a", "b", ""]
    assert one(spark, "A  b--C!", T.slug) == "a-b-c"
    assert one(spark, "x/y.tar.gz", T.extension) == "gz" and one(spark, ".hidden", T.extension) == ""
    assert one(spark, "ab", T.char_grams) == [] and one(spark, "abcd", T.char_grams) == ["c3_abc", "c3_bcd"]
