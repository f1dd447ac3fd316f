"""Most similar vectors for every vector, by an inverted multi-index.

Vectors of one space, scaled to length 1, are cut into two halves, each quantised
by its own k-means; a pair of centroids is a cell. For each vector cells are
visited by the sum of the distances of its own halves to the two centroids, the
least of the heads of sorted rows first, until enough vectors are in reach; all of
these are ranked by their exact cosine in double precision. Visits of a batch go
on in step; those that take long go on with a heap, one by one.

Cells lie in blocks (groups of near centroids of both halves). A vector goes to
the blocks its cells lie in, and not to single cells, so it moves few times; the
sum its visit ended at goes along, and tells which of a block's cells it reaches.
Blocks of many vectors are split on both sides. Equal vectors are one entry, with
their smallest ids; members get the entry's neighbours.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DIMS = {"Text": 64, "Code": 64, "BinaryFingerprint": 256}
K_NEIGHBOURS = 10
#: Vectors of a space that its centroids are fitted on at most (smallest hashes), most centroids of
#: a half, vectors of a cell on average, vectors that a visit has to reach, vectors of a block's part,
#: and vectors sent to it that one task compares.
SAMPLE, MOST_CENTROIDS, CELL_ROWS, REACH, PART_ROWS, SHARE_ROWS = 20_000, 1024, 16, 4000, 80_000, 100_000
#: Cells that visits of a batch take in step, visits of a batch, and what rounding may change of a sum.
STEPS, BATCH, SLACK = 1024, 2048, 1e-5


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids of the rows of ``x``; empty ones move to the rows farthest from theirs."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = (c * c).sum(1)[None] - 2 * x @ c.T
        own = d.argmin(1)
        n = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        sums = np.zeros_like(c)
        full = np.flatnonzero(n)
        sums[full] = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(n[full])[:-1])), axis=0)
        c[full] = sums[full] / n[full, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[np.argsort(-d[np.arange(len(x)), own])[: len(empty)]]
    return c


def _distances(c: np.ndarray) -> np.ndarray:
    s = (c * c).sum(1)
    return np.maximum(0, s[:, None] + s[None] - 2 * c @ c.T)


class MultiIndex:
    """The centroids of one space's halves, the vectors in each cell, and the blocks of cells."""

    def __init__(self, sample: np.ndarray, n: int, cell_rows: int = CELL_ROWS) -> None:
        half = sample.shape[1] // 2
        k = int(min(MOST_CENTROIDS, max(2, np.ceil(np.sqrt(max(n, 1) / cell_rows)))))
        self.half = half
        self.c = [kmeans(np.ascontiguousarray(p), k, seed=s) for s, p in enumerate((sample[:, :half], sample[:, half:]))]
        self.k2 = len(self.c[1])
        self.counts: dict[int, int] = {}
        parts = int(max(1, np.ceil(np.sqrt(n / PART_ROWS))))
        self.group = []
        for c in self.c:
            g = kmeans(c, parts, rounds=12)
            self.group.append(((g * g).sum(1)[None] - 2 * c @ g.T).argmin(1))
        self.groups2 = int(self.group[1].max()) + 1
        self.near = [np.argsort(_distances(c), axis=1, kind="stable") for c in self.c]
        self.dist = [np.take_along_axis(_distances(c), o, 1) for c, o in zip(self.c, self.near)]

    def apart(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of both halves of the rows to their centroids, less the squares of the halves themselves."""
        return [(c * c).sum(1)[None] - 2 * p @ c.T for c, p in zip(self.c, (x[:, : self.half], x[:, self.half :]))]

    def cells(self, x: np.ndarray) -> np.ndarray:
        own = [d.argmin(1) for d in self.apart(x)]
        return own[0].astype(np.int64) * self.k2 + own[1]

    def block(self, cell: np.ndarray) -> np.ndarray:
        return self.group[0][cell // self.k2].astype(np.int64) * self.groups2 + self.group[1][cell % self.k2]

    def visit(self, of: int | tuple[np.ndarray, np.ndarray], reach: int) -> list[int]:
        """Cells in order of summed distance from a cell's centroids, or by a vector's ``apart``, until they hold ``reach`` vectors."""
        if isinstance(of, tuple):
            n1, n2 = (np.argsort(d, kind="stable") for d in of)
            d1, d2 = of[0][n1], of[1][n2]
        else:
            i, j = divmod(of, self.k2)
            d1, d2, n1, n2 = self.dist[0][i], self.dist[1][j], self.near[0][i], self.near[1][j]
        heap, out, got = [(d1[0] + d2[0], 0, 0)], [], 0
        while heap and got < reach:
            _, a, b = heapq.heappop(heap)
            at = int(n1[a]) * self.k2 + int(n2[b])
            n = self.counts.get(at)
            if n:
                out.append(at)
                got += n
            if b + 1 < len(d2):
                heapq.heappush(heap, (d1[a] + d2[b + 1], a, b + 1))
            if b == 0 and a + 1 < len(d1):
                heapq.heappush(heap, (d1[a + 1] + d2[0], a + 1, 0))
        return out

    def visits(self, x: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row: the sum its visit ends at, and which blocks hold a vector of the cells up to it."""
        blocks = (int(self.group[0].max()) + 1) * self.groups2
        end, to = np.full(len(x), np.inf), np.zeros((len(x), blocks), bool)
        held = np.zeros(len(self.c[0]) * self.k2, np.int64)
        held[list(self.counts)] = list(self.counts.values())
        of_cell = self.block(np.arange(len(held)))
        if held.sum() <= reach:
            to[:, of_cell[held > 0]] = True
            return end, to
        for at in range(0, len(x), BATCH):
            d1, d2 = full = self.apart(x[at : at + BATCH])
            n1, n2 = np.argsort(d1, axis=1), np.argsort(d2, axis=1)
            # a column of no end at the right closes rows
            close = np.full((len(d1), 1), np.inf, d1.dtype)
            d1, d2 = np.hstack((np.take_along_axis(d1, n1, 1), close)), np.hstack((np.take_along_axis(d2, n2, 1), close))
            # each nearer centroid of the first half has a row of cells, of which its head is the next one
            head, nxt = np.full(d1.shape, np.inf, d1.dtype), np.zeros(d1.shape, np.int64)
            head[:, 0] = d1[:, 0] + d2[:, 0]
            f1, f2, m1, m2, heads, nexts = (z.ravel() for z in (d1, d2, n1, n2, head, nxt))
            k1, k2 = n1.shape[1], n2.shape[1]
            r, got, wide = np.arange(len(d1)), np.zeros(len(d1), np.int64), 1
            for _ in range(STEPS):
                a = (head[:, :wide] if len(r) == len(head) else head[r, :wide]).argmin(1)
                i = r * (k1 + 1) + a
                b = nexts.take(i)
                cell = m1.take(r * k1 + a) * k2 + m2.take(r * k2 + b)
                n = held.take(cell)
                total = got.take(r) + n
                got[r] = total
                end[at + r] = heads.take(i)
                some = n > 0
                to[at + r[some], of_cell.take(cell[some])] = True
                nexts[i] = b + 1
                heads[i] = f1.take(i) + f2.take(r * (k2 + 1) + b + 1)
                new = b == 0
                i = i[new] + 1
                heads[i] = f1.take(i) + f2.take(r[new] * (k2 + 1))
                wide = min(max(wide, int(a.max()) + 2), k1)
                go = total < reach
                if not go.all():
                    r = r[go]
                    if not len(r):
                        break
            for i in r:
                cells = np.array(self.visit((full[0][i], full[1][i]), reach), np.int64)
                end[at + i] = (full[0][i][cells // self.k2] + full[1][i][cells % self.k2]).max()
                to[at + i, of_cell[cells]] = True
        return end + SLACK, to


def usable(features: DataFrame, dims: dict[str, int], id_col: str, space_col: str, vector_col: str) -> DataFrame:
    """``(id, space, vector)``, once each id and space: vectors of their space's length, finite and not all zero."""
    size = F.create_map(*(F.lit(x) for kv in dims.items() for x in kv))
    v = F.col("vector")
    ok = (F.size(v) == size[F.col("space")]) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    src = features.select(F.col(id_col).alias("id"), F.col(space_col).alias("space"), F.col(vector_col).cast("array<float>").alias("vector"))
    return src.where(F.col("id").isNotNull() & F.col("space").isin(*dims) & v.isNotNull() & ok).groupBy("id", "space").agg(F.min("vector").alias("vector"))


def _matrix(arr: pa.Array) -> np.ndarray:
    """Rows of an array column of equal lengths, in double precision."""
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(arr), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, as squares of very large or small numbers leave the range
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest(
    features: DataFrame,
    id_col: str = "vector_id",
    space_col: str = "space",
    vector_col: str = "vector",
    k: int = K_NEIGHBOURS,
    dims: dict[str, int] | None = None,
    reach: int = REACH,
    cell_rows: int = CELL_ROWS,
    least: float = -1.0,
) -> DataFrame:
    """``(id, space, neighbour, cosine, rank)``: the ``k`` most similar other vectors of the same space.

    Cosines are rounded to 6 places; larger ones come first, then smaller ids;
    those below ``least`` drop out.
    Unusable rows (null, of the wrong length, all zero, not finite, of a null or
    unknown space) take no part; repeated ids count once. A space of one vector
    gives no rows.
    """
    dims = dims or DIMS
    spark = features.sparkSession
    rows = materialize(usable(features, dims, id_col, space_col, vector_col).withColumn("key", F.xxhash64("vector")), "vectors")
    # equal vectors are one entry with its k + 1 smallest ids; the rank is cut before the shuffle
    first = rows.select("space", "key", "id").withColumn("r", F.row_number().over(Window.partitionBy("space", "key").orderBy("id"))).where(F.col("r") <= k + 1)
    ids = first.groupBy("space", "key").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = rows.groupBy("space", "key").agg(F.min("vector").alias("vector")).join(ids, ["space", "key"])
    entries = materialize(entries, "entries")
    totals = {r["space"]: r["c"] for r in entries.groupBy("space").agg(F.count("*").alias("c")).collect()}
    # only about twice the sample of each space moves before its smallest hashes are ranked
    most = F.create_map(*(F.lit(x) for n, c in totals.items() for x in (n, min(1.0, (2 * SAMPLE + 1000) / c)))) if totals else F.create_map(F.lit(""), F.lit(1.0))
    drawn = entries.select("space", "key", "vector").where(F.xxhash64("key") / F.lit(float(1 << 63)) < 2 * most[F.col("space")] - 1)
    drawn = drawn.withColumn("r", F.row_number().over(Window.partitionBy("space").orderBy(F.xxhash64("key")))).where(F.col("r") <= SAMPLE)
    sample: dict[str, list] = defaultdict(list)
    for b in drawn.select("space", "vector").toArrow().to_batches():
        names = b.column(0).to_pylist()
        for s in set(names):
            pick = pa.array([i for i, x in enumerate(names) if x == s])
            sample[s].append(_unit(_matrix(b.column(1).take(pick))))
    index = {s: MultiIndex(np.concatenate(x).astype(np.float32), totals[s], cell_rows) for s, x in sample.items()}
    number = {s: i for i, s in enumerate(sorted(index))}
    fitted = spark.sparkContext.broadcast((index, number))

    def by_space(b: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch, np.ndarray]]:
        names = b.column(0).to_pylist()
        for s in sorted(set(names)):
            part = b.take(pa.array([i for i, x in enumerate(names) if x == s]))
            yield s, part, _unit(_matrix(part.column(1))).astype(np.float32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, num = fitted.value
        for b in batches:
            for s, _, x in by_space(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), num[s], np.int32)), pa.array(idx[s].cells(x))], ["s", "cell"])

    # at most MOST_CENTROIDS ** 2 cells a space
    for r in entries.select("space", "vector").mapInArrow(count, "s int, cell bigint").groupBy("s", "cell").agg(F.count("*").alias("c")).collect():
        index[sorted(index)[r["s"]]].counts[r["cell"]] = r["c"]
    counted = spark.sparkContext.broadcast((index, number))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, num = counted.value
        for b in batches:
            for s, part, x in by_space(b):
                cell = idx[s].cells(x)
                end, to = idx[s].visits(x, reach)
                at = np.concatenate(([0], np.cumsum(to.sum(1)))).astype(np.int32)
                blocks = pa.ListArray.from_arrays(pa.array(at), pa.array(np.nonzero(to)[1] * 64 + num[s]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), num[s], np.int32)), part.column(2), part.column(1), part.column(3), pa.array(cell), pa.array(idx[s].block(cell) * 64 + num[s]), pa.array(end), blocks],
                    ["s", "key", "vector", "low", "cell", "block", "end", "to"],
                )

    id_type = dict(rows.dtypes)["id"]
    placed = entries.select("space", "vector", "key", F.element_at("ids", 1).alias("low"))
    placed = materialize(placed.mapInArrow(route, f"s int, key bigint, vector array<float>, low {id_type}, cell bigint, block bigint, end double, to array<bigint>"), "placed")
    # parts of a block: a share of its entries, against a share of the vectors sent to it
    held = placed.groupBy("block").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    sent = placed.select(F.explode("to").alias("block")).groupBy("block").agg(F.ceil(F.count("*") / SHARE_ROWS).cast("int").alias("shares"))
    size = materialize(held.join(sent, "block"), "blocks")
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = placed.join(size, "block").select("block", part, all_of("shares").alias("share"), "cell", "key", "vector", "low", F.lit(None).cast("double").alias("end"))
    share = F.pmod(F.xxhash64("key", F.lit(3)), F.col("shares")).cast("int").alias("share")
    asked = placed.select(F.explode("to").alias("block"), "key", "vector", "end").join(size, "block")
    asked = asked.select("block", all_of("parts").alias("part"), share, F.lit(None).cast("bigint").alias("cell"), "key", "vector", F.lit(None).cast(id_type).alias("low"), "end")
    lowest = round(least * 1e6)

    def rank(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        mine = t.column("end").is_null().to_numpy()
        a, q = (t.take(pa.array(np.flatnonzero(x))) for x in (mine, ~mine))
        if not a.num_rows or not q.num_rows:
            return
        # larger cosine first, then the entry whose smallest id is smaller
        a = a.take(pa.compute.sort_indices(a.column("low")))
        n, cell = a.num_rows, a.column("cell").to_numpy()
        by = np.argsort(cell, kind="stable")
        base, keys = _unit(_matrix(a.column("vector").combine_chunks()))[by], a.column("key").to_numpy()
        s = key[0].as_py() % 64
        m = counted.value[0][names[s]]
        asks, q_keys, end = _unit(_matrix(q.column("vector").combine_chunks())), q.column("key").to_numpy(), q.column("end").to_numpy()
        d1, d2 = (np.ascontiguousarray(x.T) for x in m.apart(asks.astype(np.float32)))
        end = end.astype(np.float32)
        none = lowest * n - 1
        best = np.full((len(asks), k), none, np.int64)
        # single precision tells which rows may hold one that comes before the last of the best so far
        near_asks, near_base = asks.astype(np.float32), base.astype(np.float32)
        floor = np.full(len(asks), least - SLACK, np.float32)
        for c, b, e in zip(*_spans(cell[by])):
            hit = np.flatnonzero(d1[c // m.k2] + d2[c % m.k2] <= end)
            hit = hit[(near_asks[hit] @ near_base[b:e].T).max(1) >= floor[hit]]
            cos = np.rint(asks[hit] @ base[b:e].T * 1e6).astype(np.int64)
            total = cos * n + (n - 1 - by[b:e])
            total[q_keys[hit][:, None] == keys[by[b:e]]] = none
            best[hit] = got = np.partition(np.concatenate((best[hit], np.maximum(total, none)), axis=1), -k, axis=1)[:, -k:]
            floor[hit] = got[:, 0] // n / 1e6 - SLACK
        rr, kk = np.nonzero(best > none)
        value, at = np.divmod(best[rr, kk], n)
        at = n - 1 - at
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(rr), s, np.int32)), pa.array(q_keys[rr]), pa.array(keys[at]), a.column("low").combine_chunks().take(pa.array(at)), pa.array(value / 1e6)], ["s", "key", "other", "low", "cosine"]
        )

    names = sorted(index)
    near = own.unionByName(asked).groupBy("block", "part", "share").applyInArrow(rank, f"s int, key bigint, other bigint, low {id_type}, cosine double")
    # each entry has one id at least, so the best k ids are of the best k entries by their smallest ids
    w = Window.partitionBy("s", "key").orderBy(F.desc("cosine"), "low")
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    if number:
        spaces = F.create_map(*(F.lit(x) for n, i in number.items() for x in (i, n)))
        near = near.select(spaces[F.col("s")].alias("space"), "key", "other", "cosine")
    else:
        near = near.select(F.lit(None).cast("string").alias("space"), "key", "other", "cosine")
    return _expand(rows, entries, near, k, least)


def _spans(x: np.ndarray) -> tuple[list, list, list]:
    b = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    return x[b].tolist(), b.tolist(), np.append(b[1:], len(x)).tolist()


def _expand(rows: DataFrame, entries: DataFrame, near: DataFrame, k: int, least: float) -> DataFrame:
    """From neighbours of entries to neighbours of ids."""
    by_key = entries.select("space", "key", "ids")
    others = near.join(by_key.select(F.col("key").alias("other"), "ids", "space"), ["space", "other"]).select("space", "key", "cosine", F.explode("ids").alias("neighbour"))
    copies = by_key.where((F.size("ids") > 1) & F.lit(least <= 1)).select("space", "key", F.lit(1.0).alias("cosine"), F.explode("ids").alias("neighbour"))
    w = Window.partitionBy("space", "key").orderBy(F.desc("cosine"), "neighbour")
    best = others.unionByName(copies).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")
    every = rows.select("id", "space", "key").join(best, ["space", "key"]).where("id <> neighbour")
    order = Window.partitionBy("space", "id").orderBy(F.desc("cosine"), "neighbour")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "space", "neighbour", "cosine", "rank")


def similar_pairs(features: DataFrame, least: float = 0.85, **how) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: one is among the other's nearest, with a cosine of at least ``least``."""
    near = nearest(features, least=least, **how)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
