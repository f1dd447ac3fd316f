"""Filling containers of fixed capacity by a configuration linear program.

Items are known by their sizes alone. The program asks for the fewest containers,
as a weighting of configurations (multisets of sizes that fit one container),
such that each size is covered as often as it occurs. It is solved on the length
histogram, whose size is the capacity and not the number of items: prices of
sizes grow multiplicatively where coverage lags and fall where it leads, and a
knapsack by dynamic programming gives the configurations worth most at these
prices. No size is covered beyond its need, so the weights are a feasible
solution, and the prices bound the optimum from below. Weights are rounded to
whole containers, the program is solved again for what is left over, and the last
remainder is packed best-fit from the longest. The plan then goes back to
the items by their rank within their size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

CAPACITY = 2048
#: Rounds of multiplicative weights, and the share of a size's need that one round may cover.
ROUNDS, SHARE = 60, 0.3
#: Relative change of a price in a round: while prices are learnt, falling with the rounds; least, first and most while they are used.
LEARN, STEPS = 0.1, (5e-5, 2e-4, 0.05)
#: Spread of the draw among sizes of nearly equal worth, in units of room, and how many of them are kept for each room.
SPREAD, CHOICES = 0.4, 12
#: Containers of the program against those of best fit alone from which the latter is taken.
GUARD = 1.0005
#: Rows of one size that one task ranks.
RANK_ROWS = 200_000
_DONE = 1e-6


@dataclass
class Solution:
    """Weights of configurations that cover the histogram, their sum, what the weights alone gave of it, and a bound for any solution."""

    weights: list[tuple[dict[int, int], float]]
    objective: float
    by_weights: float
    bound: float


def knapsack(size: np.ndarray, price: np.ndarray, left: np.ndarray, capacity: int, rng: np.random.Generator, spread: float = SPREAD) -> tuple[np.ndarray, list[list[int]]]:
    """For each room up to ``capacity`` the worth of its best multiset of sizes, and sizes to take first.

    The sizes come in the order to try them: a draw in proportion to what is
    ``left`` of each among those that cost next to nothing against the best. None:
    leave one unit unused.
    """
    spread /= capacity
    best = np.zeros(capacity + 1)
    first: list[list[int]] = [[]] * (capacity + 1)
    upto = np.searchsorted(size, np.arange(capacity + 1), "right")
    much = left * size
    bias = spread * np.log(np.maximum(much / much.max(), 1e-12))
    noise = -np.log(-np.log(rng.random(4 * len(size) + 64))) * spread
    shift = rng.integers(0, 3 * len(size) + 64, capacity + 1)
    for c in range(1, capacity + 1):
        m = int(upto[c])
        best[c] = best[c - 1]
        if not m:
            continue
        gain = best[c - size[:m]] + price[:m]
        best[c] = max(best[c], gain.max())
        score = np.where(gain >= best[c] - 4 * spread, gain + bias[:m] + noise[shift[c] : shift[c] + m], -np.inf)
        top = np.argpartition(-score, CHOICES)[:CHOICES] if m > CHOICES else np.arange(m)
        top = top[np.argsort(-score[top], kind="stable")]
        first[c] = top[np.isfinite(score[top])].tolist()
    return best, first


def _configuration(first: list[list[int]], size: list[int], capacity: int, k: int, free: list[float]) -> dict[int, int] | None:
    """A configuration that holds size number ``k``; None where only sizes without free need would fit."""
    config, room = {k: 1}, capacity - size[k]
    while room > 0:
        for j in first[room]:
            if free[j] > 0:
                config[j] = config.get(j, 0) + 1
                room -= size[j]
                break
        else:
            if first[room]:
                return None
            room -= 1
    return config


def _cover(size: np.ndarray, need: np.ndarray, capacity: int, price: np.ndarray, rounds: int, total: dict | None) -> tuple[np.ndarray, float, np.ndarray]:
    """Rounds of multiplicative weights: what is left of the need, the best bound and the prices that gave it.

    A round prices once and takes, from the largest of the sizes that lag most, configurations
    worth nearly as much as the best, as far as free need goes. ``total`` gathers
    their weights; where it is None only prices are learnt, and each round begins
    with the whole need.
    """
    rng = np.random.default_rng(5)
    low, start, high = STEPS
    left, change, was = need.copy(), np.full(len(size), start), np.zeros(len(size))
    volume = float((need * size).sum())
    slack, bound, best_price = 0.01, 0.0, price
    for turn in range(rounds):
        live = np.flatnonzero(left > _DONE * need)
        at = size[live]
        best, first = knapsack(at, price[live], left[live], capacity, rng)
        if len(live) == len(size) and (price * need).sum() / best[capacity] > bound:
            bound, best_price = float((price * need).sum() / best[capacity]), price
        done = 1 - left[live] / need[live]
        worth = price[live] + best[capacity - at] >= (1 - slack) * best[capacity]
        order = np.lexsort((-at, np.floor(done / (SHARE / 4))))
        least = (_DONE * need[live]).tolist()
        free = (np.minimum(left, SHARE * need)[live] - least).tolist()
        rest, names, moved = left[live].tolist(), at.tolist(), 0.0
        for i in order[worth[order]].tolist():
            for _ in range(4):
                config = _configuration(first, names, capacity, i, free) if free[i] > least[i] else None
                if not config:
                    break
                w = min(free[j] / n for j, n in config.items())
                for j, n in config.items():
                    free[j] -= n * w
                    rest[j] -= n * w
                moved += w
                if total is not None:
                    key = tuple(sorted((names[j], n) for j, n in config.items()))
                    total[key] = total.get(key, 0.0) + w
        left[live] = rest
        open_ = float((left * size).sum())
        # what lags behind in coverage gets dearer, what leads cheaper; a change that keeps its sign grows
        lag = np.clip((left / need - open_ / volume) / SHARE, -1, 1)
        if total is None:
            price = price * np.exp(LEARN / np.sqrt(1 + turn / 10) * lag)
            left = need.copy()
            continue
        change = np.clip(np.where(lag * was > 0, change * 1.3, change * 0.6), low, high)
        price, was = price * np.exp(change * lag), lag
        if open_ <= 2e-3 * volume:
            break
        if moved < 0.01 * open_ / capacity:
            slack = min(0.5, slack * 1.3)
    return left, bound, best_price


def _solve(size: np.ndarray, need: np.ndarray, capacity: int, price: np.ndarray, rounds: int) -> Solution:
    total: dict[tuple, float] = {}
    left, bound, _ = _cover(size, need, capacity, price, rounds, total)
    by_weights = sum(total.values())
    rng = np.random.default_rng(6)
    # the last that the weights leave open: the knapsack's configurations from the largest size down
    while (left > 1e-9 * need).any():
        live = np.flatnonzero(left > 1e-9 * need)
        names, rest = size[live].tolist(), left[live].tolist()
        _, first = knapsack(size[live], price[live], left[live], capacity, rng, 1e-3)
        for i in range(len(live) - 1, -1, -1):
            config = _configuration(first, names, capacity, i, rest) if rest[i] > 1e-9 * need[live[i]] else None
            if config:
                w = min(rest[j] / n for j, n in config.items())
                for j, n in config.items():
                    rest[j] -= n * w
                key = tuple(sorted((names[j], n) for j, n in config.items()))
                total[key] = total.get(key, 0.0) + w
        left[live] = np.maximum(0, rest)
    return Solution([(dict(k), w) for k, w in total.items()], sum(total.values()), by_weights, bound)


def fractional(hist: dict[int, int], capacity: int, rounds: int = ROUNDS, learn: bool = True) -> Solution:
    """Configurations with weights that cover each size of ``hist`` exactly as often as it occurs, about fewest in sum.

    Prices in proportion to sizes are right where containers can be filled whole;
    where the solution stays away from its bound, prices are learnt by rounds of
    their own and the better of two solutions counts.
    """
    size = np.array(sorted(hist))
    need = np.array([hist[s] for s in size], float)
    plain = size / capacity
    got = _solve(size, need, capacity, plain, rounds)
    if learn and got.objective > 1.01 * got.bound:
        _, bound, learnt = _cover(size, need, capacity, plain, 3 * rounds, None)
        again = _solve(size, need, capacity, learnt, rounds)
        bound = max(bound, got.bound, again.bound)
        got = min(got, again, key=lambda x: x.objective)
        got.bound = bound
    return got


def plan(hist: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, most_solved: int = 4) -> list[tuple[dict[int, int], int]]:
    """``[(configuration, copies)]`` that packs exactly ``hist`` (sizes from 1 to ``capacity``).

    The program is solved, rounded, and solved again for what rounding leaves, up
    to ``most_solved`` times, until a twentieth is left; that is packed best-fit.
    Best fit of everything is a guard: it counts where it needs clearly (GUARD)
    fewer containers, as it may for few sizes of which most exceed half a container.
    """
    start = Counter({s: n for s, n in hist.items() if n > 0 and s > 0})
    if any(s > capacity for s in start):
        raise ValueError("sizes must not exceed the capacity")
    full = start.pop(capacity, 0)
    whole = [({capacity: 1}, full)] if full else []
    left, out = +start, []
    room = lambda sizes: sum(s * n for s, n in sizes.items()) / capacity
    waste = lambda config: capacity - sum(s * n for s, n in config.items())
    for turn in range(most_solved):
        left = +left
        if not left or room(left) <= 0.05 * room(start):
            break
        made = sorted(fractional(dict(left), capacity, rounds if turn == 0 else rounds // 2, learn=turn == 0).weights, key=lambda x: -x[1])
        placed = 0
        # whole copies first; then one more of each that wastes next to nothing, while its sizes last
        for down in (True, False):
            for config, w in made if down else sorted(made, key=lambda x: (waste(x[0]), int(x[1]) - x[1])):
                if not down and waste(config) * 100 > capacity:
                    break
                copies = min([int(w + 1e-6) if down else 1, *(left[s] // n for s, n in config.items())])
                if copies:
                    out.append((config, copies))
                    placed += copies
                    for s, n in config.items():
                        left[s] -= n * copies
        if placed < 0.1 * room(left):
            break
    out += _best_fit(+left, capacity)
    greedy = _best_fit(start, capacity)
    boxes = lambda p: sum(c for _, c in p)
    return whole + (greedy if boxes(out) > GUARD * boxes(greedy) else out)


def _best_fit(left: Counter, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Pack a histogram: fill each container from the longest size down, the longest that still fits first."""
    out: list[tuple[dict[int, int], int]] = []
    left = Counter({s: n for s, n in left.items() if n})
    while left:
        sizes = np.array(sorted(left))
        room, config = capacity, Counter()
        while True:
            k = int(np.searchsorted(sizes, room, "right")) - 1
            while k >= 0 and config[int(sizes[k])] >= left[int(sizes[k])]:
                k -= 1
            if k < 0:
                break
            s = int(sizes[k])
            n = min(room // s, left[s] - config[s])
            config[s] += n
            room -= n * s
        copies = min(left[s] // n for s, n in config.items())
        out.append((dict(config), copies))
        for s, n in config.items():
            left[s] -= n * copies
            if not left[s]:
                del left[s]
    return out


def pack(items: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """``(id_col, piece, start, size, container)``: where each piece of each item goes.

    An item within the capacity is one piece. A larger one is cut into pieces of
    exactly the capacity, each filling a container, and one rest. Items of null,
    zero or negative size need no room: they have piece 0 of size 0 in container
    0. Containers are numbered from 0 without gaps where any item has a size.
    Repeated rows of an id are items of their own. Null ids drop out.
    """
    spark = items.sparkSession
    typ = dict(items.dtypes)[id_col]
    size = F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0))
    src = materialize(items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), size.alias("n")), "sizes")
    pieces = src.select("id", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)))).alias("piece")).select(
        "id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("size")
    )
    hist = {r["size"]: r["c"] for r in pieces.where("size > 0").groupBy("size").agg(F.count("*").alias("c")).collect()}
    # the plan by size: the first rank of a run of copies, its first container, pieces of this size in each
    runs: list[tuple[int, int, int, int]] = []
    used: Counter = Counter()
    base = 0
    for config, copies in plan(hist, capacity, rounds):
        for s, n in config.items():
            runs.append((s, used[s], base, n))
            used[s] += n * copies
        base += copies
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast(table)
    most = max(hist.values(), default=0)
    salts = max(1, -(-most // RANK_ROWS))
    # rank within the size: counts of each salt first, so that a frequent size is ranked by many tasks
    salted = pieces.where("size > 0").withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    counts = {(r["size"], r["salt"]): r["c"] for r in salted.groupBy("size", "salt").agg(F.count("*").alias("c")).collect()} if salts > 1 else {}
    offset = np.zeros((capacity + 1, salts), np.int64)
    for (s, k), c in counts.items():
        offset[s, k] = c
    offset = np.cumsum(offset, axis=1) - offset
    shift = spark.sparkContext.broadcast(offset)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy("id", "piece")) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, by = shared.value, shift.value
        key = t[:, 0] << 40 | t[:, 1]
        for b in batches:
            n, salt, rank = (b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("size", "salt", "rank"))
            rank = rank + by[n, salt]
            at = np.searchsorted(key, n << 40 | rank, "right") - 1
            box = t[at, 2] + (rank - t[at, 1]) // t[at, 3]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("id", "piece", "start", "size")), pa.array(box)], ["id", "piece", "start", "size", "container"])

    schema = f"id {typ}, piece int, start bigint, size int, container bigint"
    placed = ranked.select("id", "piece", "start", "size", "salt", "rank").mapInArrow(place, schema)
    none = pieces.where("size <= 0").select("id", "piece", F.col("start").cast("bigint").alias("start"), F.lit(0).alias("size"), F.lit(0).cast("bigint").alias("container"))
    return placed.unionByName(none).toDF(id_col, "piece", "start", "size", "container")


def program_report(items: DataFrame, size_col: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """``(objective, bound, gap, by_weights, configurations)`` of the program over the sizes of ``items``, without full containers.

    ``bound`` holds for any solution, ``by_weights`` is the share of the objective
    that the weights gave before the last remainder. No sizes give one row of zeros.
    """
    n = F.coalesce(F.col(size_col).cast("bigint"), F.lit(0))
    rest = items.select((n % capacity).cast("int").alias("s")).where("s > 0").groupBy("s").agg(F.count("*").alias("c"))
    hist = {r["s"]: r["c"] for r in rest.collect()}
    x = fractional(hist, capacity) if hist else Solution([], 0.0, 0.0, 0.0)
    row = (x.objective, x.bound, x.objective / x.bound - 1 if x.bound else 0.0, x.by_weights / x.objective if x.objective else 0.0, len(x.weights))
    return items.sparkSession.createDataFrame([tuple(map(float, row[:4])) + (row[4],)], "objective double, bound double, gap double, by_weights double, configurations int")


def misfits(packed: DataFrame, items: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """One row of what must hold of a packing of items of unique ids: items placed, items with a size, and counts of what is wrong.

    ``overfull`` containers, ``cut`` items that fit one container, ``lost`` items
    whose pieces do not make up their size, ``gaps`` in the container numbers,
    ``filled``: the containers are at least 98 % full or at most one beyond the
    least number.
    """
    parts = packed.groupBy(id_col).agg(F.sum("size").alias("s"), F.count("*").alias("pieces"))
    both = items.select(id_col, F.greatest(F.coalesce(F.col(size_col).cast("bigint"), F.lit(0)), F.lit(0)).alias("n")).join(parts, id_col, "full")
    own = both.agg(
        F.lit(1).alias("k"),
        F.count("s").alias("items"),
        F.count_if(F.col("s") > 0).alias("sized"),
        F.count_if((F.col("n") <= capacity) & (F.col("pieces") > 1)).alias("cut"),
        F.count_if(~F.col("n").eqNullSafe(F.col("s"))).alias("lost"),
    )
    box = packed.where("size > 0").groupBy("container").agg(F.sum("size").alias("s"))
    full = box.agg(F.lit(1).alias("k"), F.count_if(F.col("s") > capacity).alias("overfull"), F.coalesce(F.max("container") + 1 - F.count("*"), F.lit(0)).alias("gaps"), F.count("*").alias("boxes"), F.coalesce(F.sum("s"), F.lit(0)).alias("tokens"))
    filled = (F.col("tokens") >= 0.98 * capacity * F.col("boxes")) | (F.col("boxes") <= F.ceil(F.col("tokens") / capacity) + 1)
    return own.join(full, "k").select("items", "sized", "overfull", "cut", "lost", "gaps", filled.alias("filled"))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(containers, pieces, tokens, least, fill)`` of a packing; ``least`` is the bound tokens / capacity."""
    box = packed.where("size > 0").groupBy("container").agg(F.sum("size").alias("s"), F.count("*").alias("c"))
    return box.agg(F.count("*").alias("containers"), F.sum("c").alias("pieces"), F.sum("s").alias("tokens"), F.max("s").alias("fullest")).select(
        "containers", "pieces", "tokens", F.ceil(F.col("tokens") / capacity).alias("least"), "fullest", F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("fill")
    )
