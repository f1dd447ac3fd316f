"""Parent-child links to full hierarchies, by contracting fragments.

Links are spread over partitions. Within one, every chain of parents is followed
to its exit: the first node whose own link lies elsewhere, a root, or a loop.
Only nodes that are the exit of some fragment stay for the next round, as one
shorter link each to their own exit (the quotient forest), which is solved by
the same step over fewer partitions until it fits one. Then results are carried
back, round by round: a node's root is its exit's root, its depth the sum. A loop
that no partition holds whole turns up whole in some quotient.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Links one task contracts at a time; also the size of quotient that one task solves.
BLOCK_LINKS = 200_000


def parent_links(edges: DataFrame, parent_kinds: tuple[str, ...] = ("contains",), child_kinds: tuple[str, ...] = ("belongsto",), ids: DataFrame | None = None) -> DataFrame:
    """``(child, parent)`` from typed edges; kinds compare trimmed and in lower case.

    Edges of ``parent_kinds`` go from parent to child, of ``child_kinds`` from
    child to parent. Null ends drop out, with ``ids`` also ends that it lacks.
    Repeated links count once. A child with several parents keeps the smallest.
    """
    kind = F.lower(F.trim(F.regexp_replace("kind", r"[\t\r\n]", " ")))
    down, up = kind.isin(*parent_kinds), kind.isin(*child_kinds)
    links = edges.where((down | up) & F.col("source").isNotNull() & F.col("target").isNotNull()).select(
        F.when(down, F.col("target")).otherwise(F.col("source")).alias("child"), F.when(down, F.col("source")).otherwise(F.col("target")).alias("parent")
    )
    # a pair of columns as the group key keeps repeated links from moving more than once
    links = links.groupBy("child", "parent").agg(F.lit(1).alias("one")).drop("one")
    if ids is not None:
        known = ids.select(ids.columns[0]).where(F.col(ids.columns[0]).isNotNull()).distinct()
        links = links.join(known.toDF("child"), "child", "left_semi").join(known.toDF("parent"), "parent", "left_semi")
    return links.groupBy("child").agg(F.min("parent").alias("parent"))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the parents of one partition's links.

    In: child, parent, steps, low (the smallest id on the way, child included),
    and the way if it is wanted: the ids from below the parent down to the child.
    Out: child, exit, steps, low, looped, and the way from the exit; for a looped
    row ``exit`` is the loop's smallest id, and so is ``low``, and its way is empty.
    """
    held_rows = [b for b in batches if b.num_rows]
    if not held_rows:
        return
    t = pa.Table.from_batches(held_rows)
    n = t.num_rows
    child = t.column("child").combine_chunks()
    names = pa.chunked_array([child, t.column("parent").combine_chunks(), t.column("low").combine_chunks()]).dictionary_encode().combine_chunks()
    codes = names.indices.to_numpy().astype(np.int64)
    words = names.dictionary
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words.cast(pa.binary())).to_numpy()] = np.arange(len(words))
    c, p, low = codes[:n], codes[n : 2 * n], rank[codes[2 * n :]]
    of_rank = np.argsort(rank)
    m = len(words)
    # over all names: where to, how far, the smallest rank on the way
    nxt, dist, least, hops = np.arange(m), np.zeros(m, np.int64), np.full(m, m, np.int64), np.zeros(m, np.int64)
    nxt[c], dist[c], least[c], hops[c] = p, t.column("steps").to_numpy(), low, 1
    held = np.zeros(m, bool)
    held[c] = True
    for _ in range(max(1, int(m).bit_length())):
        move = held & held[nxt]
        if not move.any():
            break
        new_dist, new_least, new_next = dist + np.where(move, dist[nxt], 0), np.where(move, np.minimum(least, least[nxt]), least), np.where(move, nxt[nxt], nxt)
        hops = hops + np.where(move, hops[nxt], 0)
        dist, least, nxt = new_dist, new_least, new_next
    # after 2**k steps whoever has not left never will; its way then holds the whole loop
    looped = held & held[nxt]
    if looped.any():
        # nxt of a looped row lies on its loop; the loop's smallest id is the least of that node's own way
        on = np.unique(nxt[looped])
        loop_low = np.full(m, m, np.int64)
        loop_low[on] = least[on]
        least = np.where(looped, loop_low[nxt], least)
        nxt = np.where(looped, of_rank[np.minimum(least, m - 1)], nxt)
    out = [child, words.take(pa.array(nxt[c])), pa.array(dist[c]), words.take(pa.array(of_rank[least[c]])), pa.array(looped[c])]
    names = ["child", "exit", "steps", "low", "looped"]
    if "way" not in t.column_names:
        yield pa.RecordBatch.from_arrays(out, names)
        return
    column = t.column("way").combine_chunks()
    start, flat = column.offsets.to_numpy(), column.values
    way: dict[int, np.ndarray] = {}
    order = np.argsort(hops[c], kind="stable")
    order = order[~looped[c][order]]
    for i in order.tolist():
        own = np.arange(start[i], start[i + 1])
        up = way.get(int(p[i]))
        way[int(c[i])] = own if up is None else np.concatenate((up, own))
    # rows go out in slices, as their ways may be long
    none = np.empty(0, np.int64)
    ways = [way.get(int(x), none) for x in c]
    at = 0
    while at < n:
        to, size = at, 0
        while to < n and (to == at or size + len(ways[to]) <= _WAY_IDS):
            size += len(ways[to])
            to += 1
        offsets = np.concatenate(([0], np.cumsum([len(w) for w in ways[at:to]]))).astype(np.int32)
        made = pa.ListArray.from_arrays(pa.array(offsets), flat.take(pa.array(np.concatenate(ways[at:to]))))
        yield pa.RecordBatch.from_arrays([*(x.slice(at, to - at) for x in out), made], [*names, "way"])
        at = to


_CONTRACTED = "child string, exit string, steps bigint, low string, looped boolean"
#: Ids of ways that leave a task at once.
_WAY_IDS = 500_000


def _step(links: DataFrame, parts: int, locality: bool, block_links: int) -> DataFrame:
    """One contraction over ``parts`` partitions.

    The first round places links by the folder in the id, so that files and their
    symbols meet; places of more than ``block_links`` links are split by a salt of
    the id, in proportion to their size. Later rounds place by id alone.
    """
    ways = ["way"] if "way" in links.columns else []
    src = links.select("child", "parent", "steps", "low", *ways)
    if parts == 1:
        placed = src.coalesce(1)
    elif locality:
        src = src.withColumn("place", F.xxhash64(F.regexp_replace("child", "^[A-Za-z_]+:|/[^/]*$", "")))
        large = src.groupBy("place").agg(F.count("*").alias("c")).where(F.col("c") > block_links)
        split = F.pmod(F.xxhash64("child"), F.ceil(F.coalesce("c", F.lit(1)) / F.lit(block_links)))
        placed = src.join(large, "place", "left").withColumn("salt", split).repartition(parts, "place", "salt").select("child", "parent", "steps", "low", *ways)
    else:
        placed = src.repartition(parts, "child")
    return placed.mapInArrow(_contract, _CONTRACTED + (", way array<string>" if ways else ""))


def resolve_roots(links: DataFrame, block_links: int = BLOCK_LINKS, paths: bool = False) -> DataFrame:
    """``(node_id, root_id, depth)`` for each node of ``links(child, parent)``, each child once.

    A root has itself and 0. A node on a loop or below one has the smallest id on
    the loop and -1. No links give no rows. ``paths`` adds ``path_ids``, the ids
    from the root down to the node; of a node on or below a loop its own alone.
    The ways within fragments are carried back along with roots and depths.
    """
    first = links.select("child", "parent", F.lit(1).cast("bigint").alias("steps"), F.col("child").alias("low"), *([F.array("child").alias("way")] if paths else []))
    first = materialize(first, "links")
    ways = ["way"] if paths else []
    left = total = first.count()
    rounds: list[DataFrame] = []
    cur, solved = first, None
    down = lambda top: [F.when(F.col("looped"), F.array("child")).otherwise(F.concat(top, "way")).alias("path_ids")] if paths else []
    while True:
        parts = -(-left // block_links)
        done = _step(cur, max(1, parts), not rounds, block_links)
        if parts <= 1:
            solved = done.select("child", F.col("exit").alias("root"), F.when(F.col("looped"), -1).otherwise(F.col("steps")).alias("depth"), *down(F.array("exit")))
            break
        done = materialize(done, f"round{len(rounds)}")
        rounds.append(done)
        # exits that have a link of their own make the quotient; one on a loop that is known goes on as a loop of one
        exits = done.where("not looped").select(F.col("exit").alias("child")).distinct()
        cur = materialize(
            done.join(exits, "child", "left_semi").select(
                "child", F.when(F.col("looped"), F.col("child")).otherwise(F.col("exit")).alias("parent"), F.when(F.col("looped"), 1).otherwise(F.col("steps")).alias("steps"), "low", *ways
            ),
            "quotient",
        )
        now = cur.count()
        if now > 0.8 * left:
            # hardly any chain lay within a partition
            cur = materialize(_jump(cur, len(rounds)), "jumped")
        left = now
        if left == 0:
            solved = done.sparkSession.createDataFrame([], "child string, root string, depth bigint" + (", path_ids array<string>" if paths else ""))
            break
    for done in reversed(rounds):
        known = solved.toDF("exit", "up_root", "up_depth", *(["up_path"] if paths else []))
        lost = F.col("looped") | F.coalesce(F.col("up_depth") < 0, F.lit(False))
        solved = (
            done.join(known, "exit", "left")
            .select(
                "child",
                F.when(F.col("looped"), F.col("exit")).otherwise(F.coalesce("up_root", "exit")).alias("root"),
                F.when(lost, F.lit(-1)).otherwise(F.col("steps") + F.coalesce("up_depth", F.lit(0))).cast("bigint").alias("depth"),
                *([F.when(lost, F.array("child")).otherwise(F.concat(F.coalesce("up_path", F.array("exit")), "way")).alias("path_ids")] if paths else []),
            )
        )
    solved = materialize(solved, "solved") if total else solved
    top = F.col("child")
    roots = links.select(F.col("parent").alias("child")).distinct().join(links.select("child"), "child", "left_anti").select(top, top.alias("root"), F.lit(0).cast("bigint").alias("depth"), *([F.array("child").alias("path_ids")] if paths else []))
    return solved.unionByName(roots).toDF("node_id", "root_id", "depth", *(["path_ids"] if paths else []))


def _jump(links: DataFrame, salt: int) -> DataFrame:
    """Heads jump over tails: a link of a heads child to a tails parent goes on over the parent's link.

    On a chain or a loop a quarter of the nodes so lose their only child, and drop
    out of the next quotient; a loop may shrink to a link of a node to itself.
    """
    ways = "way" in links.columns
    heads = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(salt)), F.lit(2)) == 1
    up = links.where("child <> parent").select(F.col("child").alias("parent"), F.col("parent").alias("over"), F.col("steps").alias("more"), F.col("low").alias("low2"), *([F.col("way").alias("way2")] if ways else []))
    j = links.join(up, "parent", "left")
    go = F.col("over").isNotNull() & heads("child") & ~heads("parent")
    return j.select(
        "child",
        F.when(go, F.col("over")).otherwise(F.col("parent")).alias("parent"),
        F.when(go, F.col("steps") + F.col("more")).otherwise(F.col("steps")).alias("steps"),
        F.when(go, F.least("low", "low2")).otherwise(F.col("low")).alias("low"),
        *([F.when(go, F.concat("way2", "way")).otherwise(F.col("way")).alias("way")] if ways else []),
    )


def ancestor_pairs(links: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """``(node_id, ancestor_id, distance)`` of every node of a tree, itself at 0; nodes on or below loops have only themselves.

    The result holds the sum of all depths, which is what all descendants of all
    nodes are; it comes from the paths, without a join by ancestor. ``resolved`` may
    hold the paths already.
    """
    p = resolved if resolved is not None and "path_ids" in resolved.columns else resolve_roots(links, paths=True)
    at = p.select("node_id", F.size("path_ids").alias("n"), F.posexplode("path_ids").alias("pos", "ancestor_id"))
    return at.select("node_id", "ancestor_id", (F.col("n") - 1 - F.col("pos")).cast("bigint").alias("distance"))


def full_paths(links: DataFrame, resolved: DataFrame | None = None, separator: str = " > ") -> DataFrame:
    """``(node_id, path, path_ids, depth, root_id, is_cyclic)``: the ids from the root down to the node."""
    p = resolved if resolved is not None and "path_ids" in resolved.columns else resolve_roots(links, paths=True)
    return p.select("node_id", F.concat_ws(separator, "path_ids").alias("path"), "path_ids", "depth", "root_id", (F.col("depth") < 0).alias("is_cyclic"))


def descendant_counts(links: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """``(node_id, descendants, height)`` of each node; leaves have 0."""
    return ancestor_pairs(links, resolved).groupBy(F.col("ancestor_id").alias("node_id")).agg((F.count("*") - 1).alias("descendants"), F.max("distance").alias("height"))
