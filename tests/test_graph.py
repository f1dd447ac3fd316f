from tessera.operators import cochange, graph, updates


def frames(spark, edges):
    e = spark.createDataFrame([(s, t, k, 1.0, i) for i, (s, t, k) in enumerate(edges)], "source string, target string, kind string, weight double, seq bigint")
    n = spark.createDataFrame([(x, f"f{x}") for x in sorted({y for s, t, _ in edges for y in (s, t)})], "id string, file_path string")
    return e, n


def test_insert_drops_dangling_and_repeats(spark):
    e, n = frames(spark, [("a", "b", " Calls"), ("a", "b", "calls"), ("b", "c", "Contains")])
    got = graph.insert_valid(e, n.where("id <> 'c'")).collect()
    assert [(r["source"], r["target"], r["kind"], r["seq"]) for r in got] == [("a", "b", "calls", 0)]


def test_k_hop_leaves_out_the_rim(spark):
    e, n = frames(spark, [("s", "a", "calls"), ("a", "b", "calls"), ("s", "c", "calls"), ("a", "c", "calls"), ("b", "d", "calls")])
    seeds = spark.createDataFrame([("s",), ("unknown",)], "id string")
    near, links = graph.k_hop(e, n, seeds, 1)
    assert {(r["id"], r["hop"]) for r in near.collect()} == {("s", 0), ("a", 1), ("c", 1)}
    assert {(r["source"], r["target"]) for r in links.collect()} == {("s", "a"), ("s", "c")}
    near, links = graph.k_hop(e, n, seeds, 0)
    assert near.count() == 1 and links.count() == 0


def test_context_takes_five_outgoing_first(spark):
    e, n = frames(spark, [("p", "h", "contains")] + [("h", f"t{i}", "calls") for i in range(6)] + [("h", "h", "calls")])
    got = graph.context_expand(e, n.where("id = 'h'")).orderBy("rank").collect()
    assert [r["related"] for r in got] == [f"t{i}" for i in range(5)]


def test_impact_depth(spark):
    e, n = frames(spark, [("b", "a", "calls"), ("c", "b", "references"), ("d", "c", "calls"), ("x", "a", "contains")])
    t = n.where("id = 'a'")
    assert {(r["id"], r["depth"]) for r in graph.impact(e, n, t, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r["id"] for r in graph.impact(e, n, t, 0).collect()} == {"a", "b"}
    assert {r["file_path"] for r in graph.affected_files(graph.impact(e, n, t, 2), n).collect()} == {"fa", "fb", "fc"}


def test_cochange(spark):
    c = spark.createDataFrame([("h1", "one", ["a", "b", "a"], 1), ("h2", "two", ["a", "b", "c"], 2), ("h3", "three", ["c"], 3), ("h2", "two", ["a", "b", "c"], 4), ("h4", "x", None, 5)], "hash string, subject string, files array<string>, seq bigint")
    got = cochange.candidates(c, "a").collect()
    assert [(r["file"], r["together"], r["total"], r["confidence"]) for r in got] == [("b", 2, 2, 1.0), ("c", 1, 2, 0.5)]
    assert got[0]["recent"] == ["h2 two", "h1 one"]
    assert [(r["a"], r["b"], r["together"], r["jaccard"]) for r in cochange.pairs(c).collect()] == [("a", "b", 2, 1.0)]


def test_snapshot_diff_and_upsert(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, mtime int, length int")
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, mtime int, length int")
    assert {tuple(r) for r in updates.snapshot_diff(old, new).collect()} == {("b", "update"), ("c", "delete"), ("d", "insert")}
    assert {tuple(r) for r in updates.upsert(old, new, "path").collect()} == {("a", 1, 1), ("b", 2, 1), ("c", 1, 1), ("d", 1, 1)}


def test_pairs_of_large_commits(spark):
    import random
    from itertools import combinations

    rnd = random.Random(5)
    rows = [(i, f"h{i}", "s", sorted({f"f{rnd.randrange(14)}" for _ in range(rnd.choice([2, 3, 9, 12]))})) for i in range(25)]
    df = spark.createDataFrame(rows, "seq bigint, hash string, subject string, files array<string>")
    want = {}
    for _, _, _, fs in rows:
        for p in combinations(fs, 2):
            want[p] = want.get(p, 0) + 1
    for large in (0, 4, 8, 300):
        assert {(r["a"], r["b"]): r["together"] for r in cochange.pairs(df, 2, large).collect()} == {p: n for p, n in want.items() if n >= 2}
