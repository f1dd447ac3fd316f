import json
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from tessera import benchmarks, hook
from tessera.api import Engine
from tessera.operators import updates
from tessera.server import make_server
from tessera.sources import files
from tessera.streaming import watch


def test_server_and_hook(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text("def load_table(x):\n    return x\n")
    e = Engine(str(root / ".tessera"), spark)
    s = make_server(e, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_port}"

    def ask(path, body=None):
        req = urllib.request.Request(url + path, json.dumps(body).encode() if body is not None else None)
        try:
            with urllib.request.urlopen(req) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as x:
            return x.code, json.load(x)

    assert ask("/api/index", {"path": str(tmp_path / "none")})[0] == 400
    assert ask("/api/index", {"path": str(root)})[1]["chunks"] == 1
    assert ask("/api/status")[1]["files"] == 1
    code, found = ask("/api/search", {"query": "load table"})
    assert code == 200 and found["hits"][0]["file_path"] == "a.py" and found["subgraph"]["nodes"]
    assert ask("/api/chunk/" + found["hits"][0]["id"].replace(":", "%3A"))[1]["content"].startswith("def load")
    assert ask("/api/chunk/x")[0] == 404 and len(ask("/api/graph")[1]["nodes"]) == 2
    assert "load_table" in ask("/api/llm-context?q=load%20table")[1]["context"]
    with urllib.request.urlopen(url + "/") as r:
        assert r.headers["Content-Type"].startswith("text/html") and b"/api/search" in r.read()
    s.shutdown()
    assert hook.leads({"cwd": str(root), "prompt": "where is load_table defined"}, e) == ["a.py:1"]
    assert hook.leads({"cwd": str(root), "prompt": "short"}, e) == []
    assert hook.nearest_db(str(root)) and hook.nearest_db(str(tmp_path)) is None


def test_fixture_is_checked(spark, tmp_path):
    good = {"documents": [{"id": "a", "path": "a.md", "content": "alpha beta"}, {"id": "b", "path": "b.md", "content": "gamma"}], "queries": [{"id": "q", "kind": "exact", "text": "gamma", "relevance": {"b": 3}}]}
    p = tmp_path / "f.json"
    p.write_text(json.dumps(good))
    table = Engine(str(tmp_path / "db"), spark).evaluate(str(p)).collect()
    assert {(r["mode"], r["hit_at_1"]) for r in table} == {("bm25", 1.0), ("dense", 1.0), ("hybrid", 1.0)}
    for bad in ({"documents": good["documents"] * 2}, {"queries": [dict(good["queries"][0], relevance={"zz": 1})]}, {"documents": []}):
        p.write_text(json.dumps(good | bad))
        with pytest.raises(ValueError):
            files.fixture(spark, str(p))


def test_snapshot_failure_keeps_the_old_version(spark, tmp_path):
    d = str(tmp_path / "db")
    files.save_snapshot({"t": spark.range(3).toDF("x")}, d)
    broken = spark.range(3).selectExpr("assert_true(id < 1) as x")
    with pytest.raises(Exception):
        files.save_snapshot({"t": broken}, d)
    assert files.load_snapshot(spark, d)["t"].count() == 3


def test_snapshot_through_hadoop(spark, tmp_path):
    d = f"file://{tmp_path}/hdb"
    assert files.load_snapshot(spark, d) == {}
    for n in (2, 5):
        files.save_snapshot({"t": spark.range(n).toDF("x")}, d)
        assert files.load_snapshot(spark, d)["t"].count() == n


def test_benchmarks(spark):
    out = benchmarks.ann(spark, 200, 16, 10, 5)
    assert out["recall_at_k"] > 0.9
    assert benchmarks.cold(spark, 50, 1)["first_search_p50"] > 0
    assert benchmarks.percentile([3, 1, 2], 0.5) == 2


def test_non_text_paths(spark):
    c = spark.createDataFrame([("a.png", "x", 1), ("b.md", "x", 2), ("c.md", "PDF Document: y", 3), ("d.md", "x", 4), ("e.md", "x", 5)], "file_path string, content string, vector_id bigint")
    n = spark.createDataFrame([("b.md", "Image"), ("e.md", "File")], "file_path string, kind string")
    f = spark.createDataFrame([(4, "BinaryFingerprint"), (5, "Text")], "vector_id bigint, space string")
    assert {r[0] for r in updates.non_text_paths(c, n, f, files.SKIP_EXTENSIONS).collect()} == {"a.png", "b.md", "c.md", "d.md"}


def test_stored_index(spark, tmp_path):
    """Vectors that are given, an embedder of one's own, versions without postings, and removal."""
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text("def load_table(x):\n    return x\n")
    (root / "b.md").write_text("# Reader\nthe snapshot reader\n")
    (root / "c.md").write_text("# Other\nplain words\n")
    e = Engine(str(tmp_path / "db"), spark)
    e.index(str(root))
    one = e.tables["chunks"].where("file_path = 'b.md'").first()["id"]
    hits = lambda x, mode="hybrid": [r["file_path"] for r in x.search("snapshot reader", 3, 0, mode).hits.collect()]
    assert hits(e)[0] == hits(e, "dense")[0] == "b.md" and hits(e, "bm25") == ["b.md"]
    assert {r["space"] for r in e.tables["features"].collect()} == {"Code", "Text"}
    plan = e.tables["postings"].where("term in ('reader')")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,reader)]" in plan
    e.index(str(root), spark.createDataFrame([(one, [1.0] + [0.0] * 255)], "id string, vector array<double>"))
    assert [r["id"] for r in e.tables["features"].where("space = 'BinaryFingerprint'").collect()] == [one]
    assert "b.md" not in hits(e, "dense") and hits(e, "bm25") == ["b.md"]
    with pytest.raises(Exception, match="a given vector"):
        e.index(str(root), spark.createDataFrame([(one, [1.0])], "id string, vector array<double>"))
    e.rebuild()
    assert [r["id"] for r in e.tables["features"].where("space = 'BinaryFingerprint'").collect()] == [one]
    e.remove_files(["b.md"])
    assert hits(e, "bm25") == [] and e.tables["features"].count() == e.tables["chunks"].count() == 2
    f = lambda t: F.array(F.contains(t, F.lit("words")).cast("double"), F.lit(0.1).cast("double"))
    own = Engine(str(tmp_path / "db2"), spark, embedder=f)
    own.index(str(root))
    assert [r["file_path"] for r in own.search("words", 1, 0, "dense").hits.collect()] == ["c.md"]
    older = {k: own.tables[k] for k in ("chunks", "nodes", "edges", "files")}
    files.save_snapshot(older, str(tmp_path / "db3"))
    again = Engine(str(tmp_path / "db3"), spark)
    assert hits(again)[0] == "b.md" and again.tables["postings"].count() == own.tables["postings"].count()


def test_non_text_goes_on_purge(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.md").write_text("# A\nx\n")
    (root / "b.md").write_text("# B\ny\n")
    e = Engine(str(tmp_path / "db"), spark)
    e.index(str(root))
    chunks = e.tables["chunks"].withColumn("content", F.when(F.col("file_path") == "b.md", "PDF Document: z").otherwise(F.col("content")))
    files.save_snapshot({k: e.tables[k] for k in ("nodes", "edges", "files")} | {"chunks": chunks}, str(tmp_path / "db2"))
    assert {r["file_path"] for r in Engine(str(tmp_path / "db2"), spark).tables["chunks"].collect()} == {"a.md"}


def test_bursts_and_limits(tmp_path):
    (tmp_path / "a.md").write_text("1")
    (tmp_path / "x.png").write_text("1")
    seen = []
    for i, state in enumerate(watch.bursts(lambda: files.stamps(str(tmp_path)), 40, 4, 5)):
        seen.append(sorted(state))
        if i == 0:
            (tmp_path / "b.md").write_text("2")
    assert seen == [["a.md"], ["a.md", "b.md"]]
    assert hook.within(5, lambda: ["a:1"]) == ["a:1"] and hook.within(0.05, lambda: time.sleep(1) or ["late"]) == [] and hook.within(1, lambda: 1 / 0) == []


def test_fingerprints_of_a_fixture(spark, tmp_path):
    x = {"documents": [{"id": "a", "path": "a.md", "content": "alpha beta", "fingerprint_byte": 7}, {"id": "b", "path": "b.md", "content": "gamma"}], "queries": [{"id": "q", "kind": "exact", "text": "alpha", "relevance": {"a": 3}}]}
    (tmp_path / "f.json").write_text(json.dumps(x))
    got = {r["mode"]: r["hit_at_1"] for r in Engine(str(tmp_path / "db"), spark).evaluate(str(tmp_path / "f.json")).collect()}
    assert got["bm25"] == 1.0 and got["dense"] == 0.0


def test_scratch_files_go(spark):
    from tessera import session

    def files_of(df):
        return df.inputFiles()

    with session.scratch(spark):
        a = session.materialize(spark.range(3), "inner")
        gone = files_of(a)
        with session.scratch(spark):
            b = session.outside(a.where("id > 0"), "outer")
        assert b.count() == 2
    import os

    assert gone and not any(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in gone)


def test_search_where_nothing_is_stored(spark, tmp_path):
    e = Engine(str(tmp_path / "none"), spark)
    assert [e.search("any words", 3, 1, m).hits.collect() for m in ("hybrid", "bm25", "dense")] == [[], [], []]
    assert "Nothing relevant" in e.context("any words")
