import random

import pytest

from tessera.operators import hierarchy as H


def brute(parent):
    out = {}
    for v in set(parent) | set(parent.values()):
        seen, x = {}, v
        while x in parent and x not in seen:
            seen[x] = len(seen)
            x = parent[x]
        out[v] = (min(y for y, k in seen.items() if k >= seen[x]), -1) if x in seen else (x, len(seen))
    return out


def solve(spark, parent, block):
    df = spark.createDataFrame(list(parent.items()), "child string, parent string")
    return {r[0]: (r[1], r[2]) for r in H.resolve_roots(df, block).collect()}


@pytest.mark.parametrize("n,block", [(40, 200_000), (60, 17)])
def test_roots_and_loops_match_a_walk(spark, n, block):
    rnd = random.Random(n)
    names = [f"symbol:r{i % 3}/d/n{i}" for i in range(n)]
    parent = {x: rnd.choice(names[max(0, i - 3) : i + 2]) for i, x in enumerate(names) if rnd.random() < 0.9}
    parent |= {f"c{i}": f"c{i + 1}" for i in range(25)} | {f"l{i}": f"l{(i + 1) % 9}" for i in range(9)} | {"self": "self", "below": "self"}
    assert solve(spark, parent, block) == brute(parent)


def test_hot_parent_and_long_chain(spark):
    parent = {f"leaf{i}": "hub" for i in range(300)} | {"hub": "top"} | {f"k{i:03}": f"k{i + 1:03}" for i in range(120)}
    assert solve(spark, parent, 60) == brute(parent)


def test_no_links(spark):
    df = spark.createDataFrame([], "child string, parent string")
    assert H.resolve_roots(df).collect() == []


def test_links_from_edges(spark):
    rows = [("a", "b", " Contains "), ("b", "c", "contains"), ("d", "c", "x"), ("e", "a", "BELONGSTO"), ("a", None, "Contains"), ("a", "zz", "Contains"), ("a", "b", "Contains"), ("0", "b", "Contains")]
    e = spark.createDataFrame(rows, "source string, target string, kind string")
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("e",), ("0",)], "id string")
    assert {tuple(r) for r in H.parent_links(e, ids=ids).collect()} == {("b", "0"), ("c", "b"), ("e", "a")}


def test_paths_descendants(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("x", "y"), ("y", "x")], "child string, parent string")
    roots = H.resolve_roots(links)
    paths = {r["node_id"]: (r["path"], r["is_cyclic"]) for r in H.full_paths(links, roots).collect()}
    assert paths["c"] == ("a > b > c", False) and paths["a"] == ("a", False) and paths["x"] == ("x", True)
    assert {r["node_id"]: r["descendants"] for r in H.descendant_counts(links, roots).collect()}["a"] == 3


@pytest.mark.parametrize("block", [200_000, 23])
def test_paths_come_back_with_the_fragments(spark, block):
    rnd = random.Random(block)
    names = [f"symbol:r{i % 3}/d/n{i}" for i in range(80)]
    parent = {x: rnd.choice(names[max(0, i - 3) : i]) for i, x in enumerate(names) if i and rnd.random() < 0.95}
    parent |= {f"c{i:03}": f"c{i + 1:03}" for i in range(90)} | {f"l{i}": f"l{(i + 1) % 9}" for i in range(9)} | {"below": "l3", "lower": "below"}
    df = spark.createDataFrame(list(parent.items()), "child string, parent string")
    got = H.resolve_roots(df, block, paths=True)
    roots = brute(parent)

    def path(x):
        out = [x]
        while roots[x][1] >= 0 and out[-1] in parent:
            out.append(parent[out[-1]])
        return out[::-1]

    rows = got.collect()
    assert {r["node_id"]: r["path_ids"] for r in rows} == {x: path(x) for x in roots}
    assert {r["node_id"]: (r["root_id"], r["depth"]) for r in rows} == roots
    assert {tuple(r) for r in H.ancestor_pairs(df, got).collect()} == {(x, y, len(p) - 1 - k) for x in roots for p in [path(x)] for k, y in enumerate(p)}
