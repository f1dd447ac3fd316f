import random

import numpy as np

from tessera.llm import spans as S

SCHEMA = "doc_id bigint, text string, fp int, anchor string, shard int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)


def brute(rows, n=150):
    has = {i: {t[k : k + n] for k in range(len(t) - n + 1)} for i, t in rows if i is not None and t}
    return {(a, b) for a in has for b in has if a < b and has[a] & has[b]}


def docs(seed, n=40):
    rnd = random.Random(seed)
    make = lambda k: "".join(rnd.choice("abcdefgh \nß漢😀") for _ in range(k))
    shared = [make(rnd.randint(140, 400)) for _ in range(6)]
    out = []
    for i in range(n):
        t = make(rnd.randint(0, 300))
        for _ in range(rnd.randrange(3)):
            s = rnd.choice(shared)
            a = rnd.randrange(0, 60)
            t += s[a : a + rnd.randint(100, 400)] + make(rnd.randint(0, 50))
        out.append((i, t))
    return out


def test_pairs_match_brute_force(spark):
    rows = docs(1)
    want = brute(rows)
    got = {tuple(r) for r in S.shared_pairs(frame(spark, rows)).collect()}
    assert want and got == want


def test_small_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_CHARS", 500)
    monkeypatch.setattr(S, "MOST_SHARD_CHARS", 900)
    monkeypatch.setattr(S, "STREAM_CHARS", 700)
    rows = docs(2)
    assert {tuple(r) for r in S.shared_pairs(frame(spark, rows)).collect()} == brute(rows)


def test_odd_rows(spark):
    line = "-" * 400
    p = "".join(chr(97 + i * i % 23) for i in range(200))
    rows = [(1, line), (2, "x" + line), (3, None), (4, ""), (5, p + " " + p), (6, p[:149]), (7, "z" * 149), (8, p + " " + p), (None, p), (1, line), (9, p.upper())]
    got = {tuple(r) for r in S.shared_pairs(frame(spark, rows)).collect()}
    assert got == brute(rows) == {(1, 2), (5, 8)}
    assert S.shared_pairs(frame(spark, [])).collect() == [] and S.shared_share(frame(spark, [])).collect() == []


def test_a_passage_of_many_different_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_SHARD_CHARS", 5000)
    rnd = random.Random(9)
    p = "".join(rnd.choice("abcdef ") for _ in range(260))
    rows = [(i, "".join(rnd.choice("uvwxyz") for _ in range(90)) + p[: 200 + i] + "".join(rnd.choice("UVWXYZ") for _ in range(90))) for i in range(40)]
    assert {tuple(r) for r in S.shared_pairs(frame(spark, rows)).collect()} == brute(rows)


def test_exact_limit(spark):
    p = "".join(chr(97 + (i * 7 + i * i) % 26) for i in range(150))
    rows = [(1, "1" + p + "2"), (2, "3" + p + "4"), (3, p[:149] + "#")]
    assert {tuple(r) for r in S.shared_pairs(frame(spark, rows)).collect()} == {(1, 2)}
    spans = {(r["id"], r["start"], r["end"]) for r in S.shared_spans(frame(spark, rows)).collect()}
    assert spans == {(1, 1, 151), (2, 1, 151)}


def test_share_matches_brute_force(spark):
    rows = docs(3, 24)
    has = {}
    for i, t in rows:
        for k in range(len(t) - 149):
            has.setdefault(t[k : k + 150], set()).add(i)
    want = {}
    for i, t in rows:
        cover = np.zeros(len(t), bool)
        for k in range(len(t) - 149):
            if has[t[k : k + 150]] - {i}:
                cover[k : k + 150] = True
        want[i] = int(cover.sum())
    got = {r["id"]: r["shared_chars"] for r in S.shared_share(frame(spark, rows)).collect()}
    assert got == want


def test_anchors_of_long_texts_agree(monkeypatch):
    rnd = random.Random(4)
    p = "".join(rnd.choice("abc") for _ in range(300))
    from tessera.llm import kernels as K

    monkeypatch.setattr(S, "_SEGMENT", 256)
    a = S.anchors(K.code_points("".join(rnd.choice("xyz") for _ in range(700)) + p))[0]
    b = S.anchors(K.code_points(p + "q" * 500))[0]
    assert np.intersect1d(a, b).size


def test_crowded_anchors_give_the_same_spans(spark, monkeypatch):
    rows = docs(11, 60) + [(100, "".join(chr(97 + i % 3) for i in range(400))), (101, "ab" * 300), (102, "ab" * 200 + "x")]
    spans = lambda: {tuple(r) for r in S.shared_spans(frame(spark, rows)).collect()}
    want = spans()
    assert want
    for crowd in (1, 4):
        monkeypatch.setattr(S, "CROWD", crowd)
        assert spans() == want
