import random
import re

import numpy as np
import pytest

from tessera.llm import kernels as K
from tessera.llm import neardup as N

SCHEMA = "id string, content string, class_id int, key string, n string"


def shingles(t):
    w = [x.lower() for x in re.findall(r"[A-Za-z0-9_]+", t or "")]
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 30 else set()


def brute(rows, t=0.7):
    s = {(i, c): shingles(c) for i, c in rows if i is not None and c is not None}
    s = {k: v for k, v in s.items() if v}
    return {(a[0], b[0]) for a in s for b in s if a[0] < b[0] and len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-9}


def pairs(spark, rows, **how):
    df = spark.createDataFrame([(i, c, 7, "x", "y") for i, c in rows], SCHEMA)
    return {(r["id_a"], r["id_b"]) for r in N.near_duplicate_pairs(df, **how).collect()}


def texts(seed, n, vocabulary=400):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(30, 90))] for _ in range(n // 3)]
    out = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(9)}"
        out.append((f"d{i}", rnd.choice([" ", "\n", "--"]).join(w)))
    return out


def test_matches_brute_force(spark):
    rows = texts(1, 90)
    want = brute(rows)
    assert want and pairs(spark, rows) == want


def test_frequent_shingles_use_pairs_of_them(spark, monkeypatch):
    monkeypatch.setattr(N, "FREQUENT", 2)
    rows = texts(2, 90, vocabulary=12)
    want = brute(rows)
    assert want and pairs(spark, rows) == want


def test_small_sets_of_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(N, "FREQUENT", 1)
    rnd = random.Random(8)
    rows = []
    for i in range(80):
        unit = [f"u{rnd.randrange(3)}" for _ in range(rnd.randint(3, 7))]
        w = (unit * 40)[: rnd.randint(30, 36)]
        if rnd.random() < 0.5:
            w += [f"e{rnd.randrange(3)}"]
        rows.append((f"d{i:02}", " ".join(w)))
    assert pairs(spark, rows) == brute(rows)


def test_prefix_keys_meet_for_random_sets():
    rnd = np.random.default_rng(3)
    for trial in range(300):
        level = rnd.choice([0, 3, 8, 20], N.LEAST_CELLS).astype(np.uint8)
        n = int(rnd.integers(5, 80))
        pool = rnd.integers(0, 1 << 62, 2 * n).astype(np.uint64)
        a = pool[:n]
        keep = int(np.ceil(0.7 * n)) + int(rnd.integers(0, max(1, n // 4)))
        b = np.concatenate((rnd.permutation(a)[: min(keep, n)], pool[n : n + int(rnd.integers(0, max(1, n // 6)))]))
        common = len(np.intersect1d(a, b))
        if common < 0.7 * len(np.union1d(a, b)):
            continue
        s = np.concatenate((a, b))
        row = np.repeat([0, 1], [len(a), len(b)])
        key, r, _ = N.prefix_keys(s, row, 2, level, 0.7)
        assert np.intersect1d(key[r == 0], key[r == 1]).size, trial


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [("a", long), ("a", long), ("b", long.upper()), ("c", None), (None, long), ("e", ""), ("f", "too few words"), ("g", long + " K İ tail"), ("h", " ".join(["same"] * 50)), ("i", "same " * 31)]
    want = brute(rows)
    assert ("a", "b") in want and ("h", "i") in want
    assert pairs(spark, rows) == want


def test_hot_group_of_copies(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(f"c{i:02}", long) for i in range(30)] + texts(5, 30)
    assert pairs(spark, rows) == brute(rows)
    df = spark.createDataFrame([(i, c, 7, "x", "y") for i, c in rows], SCHEMA)
    got = {r["id"]: r for r in N.near_duplicate_summary(df).collect()}
    assert got["c00"]["copies"] == 30 and got["c00"]["class_id"] == got["c29"]["class_id"] and got["c00"]["links"] == 0


def test_empty_table_and_threshold(spark):
    assert pairs(spark, []) == set()
    with pytest.raises(ValueError):
        pairs(spark, [], threshold=0)


def test_words_keep_within_rows():
    data = "a_b C9é-x".encode()
    off = np.array([0, 3, len(data)])
    h, row = K.words(np.frombuffer(data, np.uint8), off)
    assert row.tolist() == [0, 1, 1]
    assert K.words(np.frombuffer(b"c9", np.uint8), np.array([0, 2]))[0][0] == h[1]


def test_levels_of_counts():
    for mean in (0.5, 3.7, 5000.0, 1e7):
        level = N.level_codes(mean)
        assert (np.diff(level.astype(int)) >= 0).all()
        count = np.array([0, 1, 2, 3, 6, 7, 100, 70_000, 5 * 10**9], np.int64)
        code = np.minimum(255, np.round(np.log2(1 + count) * N._CODES)).astype(int)
        hot = level[code] >= 8
        assert hot[-1] or mean > 1e9
        assert not hot[0] and (np.abs(np.log2((count[hot] + 1) / (N.FREQUENT + 2 * mean))) >= -0.2).all()
    assert [int(x) for x in N.level_codes(0.0)[np.round(np.log2(1 + np.array([0, 1, 2, 3, 4])) * N._CODES).astype(int)] >= 8] == [0, 0, 0, 1, 1]


def test_key_report(spark):
    rows = texts(2, 90, vocabulary=12)
    df = spark.createDataFrame([(i, c, 7, "x", "y") for i, c in rows], SCHEMA)
    got = N.key_report(df).first()
    assert 0 < got["combinations"] < got["keys"] and 0 < got["resting"] <= got["sets"] <= 4 * len(rows)
    assert N.key_report(df.limit(0)).first()["keys"] is None
