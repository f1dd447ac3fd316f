import numpy as np

from tessera.llm import imi

SCHEMA = "vector_id bigint, space string, vector array<float>, key string, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, s, v, "a", 1) for i, s, v in rows], SCHEMA)


def brute(rows, dims, k=10):
    by = {}
    for i, s, v in rows:
        if i is None or s not in dims or v is None or len(v) != dims[s]:
            continue
        x = np.array(v, np.float32).astype(float)
        if np.isnan(x).any() or not x.any():
            continue
        by.setdefault(s, {})[i] = x
    out = {}
    for s, m in by.items():
        ids = sorted(m)
        x = np.array([m[i] / np.sqrt(m[i] @ m[i]) for i in ids])
        c = np.round(x @ x.T, 6)
        for a, i in enumerate(ids):
            out[(s, i)] = sorted(((-c[a, b], j) for b, j in enumerate(ids) if j != i))[:k]
    return out


def test_small_collections_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "Text" if i % 3 else "Code", rng.standard_normal(64).round(2).tolist()) for i in range(150)]
    want = brute(rows, imi.DIMS)
    got = {}
    for r in imi.nearest(frame(spark, rows)).collect():
        got.setdefault((r["space"], r["id"]), []).append((r["rank"], r["neighbour"], r["cosine"]))
    assert {k: [j for _, j, _ in sorted(v)] for k, v in got.items()} == {k: [j for _, j in v] for k, v in want.items()}


def test_recall_beyond_the_reach(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 64))
    rows = [(i, "Text", (centres[i % 60] + 0.35 * rng.standard_normal(64)).tolist()) for i in range(3000)]
    want = brute(rows, imi.DIMS)
    near = imi.nearest(frame(spark, rows), reach=400)
    got = {}
    for r in near.collect():
        got.setdefault((r["space"], r["id"]), set()).add(r["neighbour"])
    recall = np.mean([len(got.get(k, set()) & {j for _, j in v}) / len(v) for k, v in want.items()])
    assert recall >= 0.9


def test_odd_rows_copies_and_ties(spark):
    e = np.eye(64)
    v = e[0].tolist()
    rows = [(i, "Text", v) for i in range(30)] + [(100, "Text", (2 * e[0]).tolist()), (101, "Text", (e[0] + e[1]).tolist())]
    rows += [(200, "Text", None), (201, None, v), (202, "Text", [0.0] * 64), (203, "Text", v[:63]), (204, "Text", [float("nan")] + v[1:]), (None, "Text", v), (0, "Text", v), (300, "Code", v), (205, "Other", v)]
    want = brute(rows, imi.DIMS)
    got = {}
    for r in imi.nearest(frame(spark, rows)).collect():
        got.setdefault((r["space"], r["id"]), []).append((-r["cosine"], r["neighbour"]))
    assert {k: sorted(x) for k, x in got.items()} == {k: x for k, x in want.items() if x}


def test_large_blocks_are_split(spark, monkeypatch):
    monkeypatch.setattr(imi, "PART_ROWS", 40)
    rng = np.random.default_rng(4)
    rows = [(i, "Text", (np.ones(64) + 0.5 * rng.standard_normal(64)).tolist()) for i in range(300)]
    want = brute(rows, imi.DIMS)
    got = {}
    for r in imi.nearest(frame(spark, rows), reach=1000).collect():
        got.setdefault((r["space"], r["id"]), set()).add(r["neighbour"])
    assert got == {k: {j for _, j in v} for k, v in want.items()}


def test_empty_table(spark):
    assert imi.similar_pairs(frame(spark, [])).collect() == []


def test_visit_goes_by_summed_distance():
    rng = np.random.default_rng(5)
    m = imi.MultiIndex(rng.standard_normal((500, 8)).astype(np.float32), 500, 5)
    m.counts = {c: 1 for c in range(len(m.c[0]) * m.k2)}
    order = m.visit(7, 10**9)
    i, j = divmod(7, m.k2)
    d = [((m.c[0][c // m.k2] - m.c[0][i]) ** 2).sum() + ((m.c[1][c % m.k2] - m.c[1][j]) ** 2).sum() for c in order]
    assert len(order) == len(m.counts) and np.all(np.diff(d) > -1e-4)


def test_pairs_far_from_their_centroids_are_found(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((5000, 64))
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(x)
    noise = rng.standard_normal((400, 64))
    noise = unit(noise - (noise * x[:400]).sum(1, keepdims=True) * x[:400])
    both = np.concatenate((x, 0.9 * x[:400] + np.sqrt(1 - 0.81) * noise))
    got = {(r["id_a"], r["id_b"]) for r in imi.similar_pairs(frame(spark, [(i, "Text", v.tolist()) for i, v in enumerate(both)]), reach=200).collect()}
    assert len(got & {(i, 5000 + i) for i in range(400)}) >= 392 and len(got) <= 400


def test_visits_in_step_end_where_the_heap_does(monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((900, 8)).astype(np.float32)
    m = imi.MultiIndex(x, 900, 3)
    cells, n = np.unique(m.cells(x), return_counts=True)
    m.counts = dict(zip(cells.tolist(), n.tolist()))
    for steps in (1024, 5):
        monkeypatch.setattr(imi, "STEPS", steps)
        end, to = m.visits(x[:40], 60)
        for i, (d1, d2) in enumerate(zip(*m.apart(x[:40]))):
            got = np.array(m.visit((d1, d2), 60))
            assert abs((d1[got // m.k2] + d2[got % m.k2]).max() - end[i]) < 1e-4
            assert set(m.block(got)) == set(np.flatnonzero(to[i]))
    end, to = m.visits(x[:2], 10**6)
    assert np.all(end == np.inf) and set(np.flatnonzero(to[0])) == set(m.block(cells))
