"""Property graph: validation, traversal, expansion, impact, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

EXPAND, PARENT, IMPACT = ("calls", "references", "linksto", "defines"), ("contains",), ("calls", "references", "implements")


def kind_of(c: Column | str = "kind") -> Column:
    """A kind without blanks at its ends, in lower case."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def first_edges(edges: DataFrame) -> DataFrame:
    """``(source, target, kind, weight, seq)``: of equal links the first one by ``seq``."""
    e = edges.select("source", "target", kind_of().alias("kind"), "weight", "seq")
    w = Window.partitionBy("source", "target", "kind").orderBy("seq")
    return e.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def prune_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are ids of ``nodes``."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.toDF("source"), "source", "left_semi").join(ids.toDF("target"), "target", "left_semi").select(*edges.columns)


def insert_valid(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What inserting edges one by one leaves: known ends, first weight of equal links."""
    return first_edges(prune_dangling(edges, nodes))


def k_hop(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, hop)`` within ``hops`` undirected links of seeds, and the edges met on the way.

    An edge counts if an end was reached in fewer than ``hops`` links; links between
    two nodes at the very rim do not.
    """
    ids = nodes.select("id").distinct()
    seen = materialize(seeds.select("id").distinct().join(ids, "id", "left_semi").withColumn("hop", F.lit(0)), "hop")
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("to")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("to")))
    for h in range(1, hops + 1):
        new = both.join(seen.where(F.col("hop") == h - 1).select("id"), "id", "left_semi").select(F.col("to").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = materialize(seen.unionByName(new.withColumn("hop", F.lit(h))), "hop")
    inner = seen.where(F.col("hop") < hops).select("id")
    a = edges.join(inner.toDF("source"), "source", "left_semi").select(*edges.columns)
    b = edges.join(inner.toDF("target"), "target", "left_semi").join(inner.toDF("source"), "source", "left_anti").select(*edges.columns)
    return seen, a.unionByName(b)


def context_expand(edges: DataFrame, hits: DataFrame, most: int = 5) -> DataFrame:
    """``(hit, related, rank)``: outgoing context links in order of arrival, then parents; distinct, one hop."""
    out = edges.where(F.col("kind").isin(*EXPAND)).select(F.col("source").alias("hit"), F.col("target").alias("related"), F.lit(0).alias("prio"), "seq")
    up = edges.where(F.col("kind").isin(*PARENT)).select(F.col("target").alias("hit"), F.col("source").alias("related"), F.lit(1).alias("prio"), "seq")
    r = out.unionByName(up).join(hits.select(F.col("id").alias("hit")).distinct(), "hit", "left_semi").where("hit <> related")
    one = r.groupBy("hit", "related").agg(F.min(F.struct("prio", "seq")).alias("o"))
    w = Window.partitionBy("hit").orderBy("o", "related")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("hit", "related", "rank")


def impact(edges: DataFrame, nodes: DataFrame, targets: DataFrame, depth: int = 2) -> DataFrame:
    """``(target, id, depth)``: who reaches each target against calls, references and implementations.

    Depth 1 is always looked at; a target itself has depth 0. Unknown targets give
    no rows.
    """
    back = edges.where(F.col("kind").isin(*IMPACT)).select(F.col("target").alias("id"), F.col("source").alias("caller"))
    seen = materialize(targets.select(F.col("id").alias("target"), "id").distinct().join(nodes.select("id").distinct(), "id", "left_semi").select("target", "id", F.lit(0).alias("depth")), "impact")
    for d in range(1, max(1, depth) + 1):
        new = seen.where(F.col("depth") == d - 1).join(back, "id").select("target", F.col("caller").alias("id")).distinct().join(seen, ["target", "id"], "left_anti")
        seen = materialize(seen.unionByName(new.withColumn("depth", F.lit(d))), "impact")
    return seen


def affected_files(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(target, file_path)``: distinct files of impacted nodes, the target's own included."""
    return found.join(nodes.select("id", "file_path"), "id").where("file_path is not null and file_path <> ''").select("target", "file_path").distinct()


def remove_file(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of the files ``paths(file_path)``."""
    gone = nodes.join(paths, "file_path", "left_semi").select("id").distinct()
    kept = nodes.join(gone, "id", "left_anti").select(*nodes.columns)
    rest = edges.join(gone.toDF("source"), "source", "left_anti").join(gone.toDF("target"), "target", "left_anti").select(*edges.columns)
    return kept, rest


def find_symbols(nodes: DataFrame, text: str) -> DataFrame:
    """``(id, label, kind, file_path, exact)`` of nodes whose label holds the text in any case; equal labels first."""
    hit = nodes.where(F.contains(F.lower("label"), F.lower(F.lit(text))))
    same = F.lower("label") == F.lit(text.lower())
    return hit.select("id", "label", "kind", "file_path", same.alias("exact")).orderBy(F.desc("exact"), "label", "id")
