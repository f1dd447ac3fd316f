"""Ranking metrics over labelled queries, recall of approximate search, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_GRADE = 20


def gain(grade: Column) -> Column:
    """2 to the grade, less 1; grades above 20 count as 20."""
    return F.pow(F.lit(2.0), F.least(grade, F.lit(MOST_GRADE))) - 1


def metrics(ranked: DataFrame, qrels: DataFrame, ks: tuple[int, int] = (5, 10)) -> DataFrame:
    """``(query_id, recall_at_5, recall_at_10, mrr, ndcg_at_10, hit_at_1)`` for each labelled query.

    ``ranked(query_id, id, rank)``, ``qrels(query_id, id, grade)``; grades above 0
    are relevant. A query without results or relevant labels has zeros.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    ideal = (
        qrels.withColumn("r", F.row_number().over(w))
        .groupBy("query_id")
        .agg(F.sum(F.when(F.col("grade") > 0, 1).otherwise(0)).alias("relevant"), F.sum(F.when(F.col("r") <= 10, gain(F.col("grade")) / F.log2(F.col("r") + 1))).alias("ideal"))
    )
    j = qrels.where("grade > 0").join(ranked.select("query_id", "id", "rank"), ["query_id", "id"])
    got = j.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= ks[0], 1).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("rank") <= ks[1], 1).otherwise(0)).alias("b"),
        F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= 10, gain(F.col("grade")) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    share = lambda c: F.when(F.col("relevant") > 0, F.coalesce(F.col(c), F.lit(0)) / F.col("relevant")).otherwise(0.0)
    return ideal.join(got, "query_id", "left").select(
        "query_id",
        share("a").alias(f"recall_at_{ks[0]}"),
        share("b").alias(f"recall_at_{ks[1]}"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("ideal") > 0, F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg_at_10"),
        F.when(F.col("first") == 1, 1.0).otherwise(0.0).alias("hit_at_1"),
    )


def by_kind(per_query: DataFrame, kinds: DataFrame) -> DataFrame:
    """Means of the metrics by kind of query."""
    names = [c for c in per_query.columns if c != "query_id"]
    return per_query.join(kinds, "query_id").groupBy("kind").agg(F.count("*").alias("queries"), *(F.avg(c).alias(c) for c in names))


def validate_qrels(qrels: DataFrame, docs: DataFrame) -> DataFrame:
    """Problems of labels: ids that no document has, and queries that label nothing."""
    unknown = qrels.join(docs.select("id").distinct(), "id", "left_anti").select("query_id", F.lit("unknown id").alias("problem"), "id")
    empty = qrels.groupBy("query_id").agg(F.max("grade").alias("g")).where("g is null or g <= 0").select("query_id", F.lit("no relevant label").alias("problem"), F.lit(None).cast("string").alias("id"))
    return unknown.unionByName(empty)


def recall(found: DataFrame, gold: DataFrame) -> DataFrame:
    """``(query_id, gold, hits, recall)`` of ``(query_id, id)`` lists against exact ones."""
    f = found.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    g = gold.select("query_id", "id").distinct().join(f, ["query_id", "id"], "left")
    return g.groupBy("query_id").agg(F.count("*").alias("gold"), F.count("hit").alias("hits")).withColumn("recall", F.col("hits") / F.col("gold"))


def percentile_ceil(df: DataFrame, by: str, value: str, fraction: float) -> DataFrame:
    """``(by, value)``: the item at index ceil((n - 1) * fraction) of each group's sorted values.

    Distinct values are counted first, so that a large group of few values stays
    small; the rank is a running sum over them.
    """
    c = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    upto = c.withColumn("upto", F.sum("c").over(w.orderBy(value))).withColumn("n", F.sum("c").over(w))
    at = F.ceil((F.col("n") - 1) * fraction)
    return upto.where((F.col("upto") > at) & (F.col("upto") - F.col("c") <= at)).select(by, F.col(value).alias("value"))
