"""Files that change together, from commit history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Files of a commit from which it counts as large.
LARGE = 300


def commit_files(commits: DataFrame) -> DataFrame:
    """``(hash, seq, file)``: distinct files of each commit; repeated rows of a hash count once, at their first ``seq``."""
    f = commits.where("hash is not null").select("hash", "seq", F.explode("files").alias("file")).where("file is not null")
    return f.groupBy("hash", "file").agg(F.min("seq").alias("seq")).select("hash", "seq", "file")


def file_counts(commits: DataFrame) -> DataFrame:
    return commit_files(commits).groupBy("file").agg(F.count("*").alias("commits"))


def candidates(commits: DataFrame, target: str, top: int | None = None, subjects: int = 3) -> DataFrame:
    """``(file, together, total, confidence, recent)`` of files in commits of ``target``, by path or its end.

    ``recent`` holds labels of the latest such commits, latest first.
    """
    f = commit_files(commits)
    of = f.where((F.col("file") == target) | F.endswith(F.col("file"), F.lit("/" + target))).select("hash").distinct()
    label = commits.where("hash is not null").groupBy("hash").agg(F.max_by("subject", "seq").alias("subject"))
    both = f.join(of, "hash", "left_semi").where((F.col("file") != target) & ~F.endswith(F.col("file"), F.lit("/" + target)))
    total = F.lit(of.count())
    # the latest few of each file are ranked before they are gathered
    g = both.groupBy("file").agg(F.count("*").alias("together"))
    w = Window.partitionBy("file").orderBy(F.desc("seq"), "hash")
    last = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= subjects).join(label, "hash").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("r", F.concat_ws(" ", "hash", "subject").alias("l")))).alias("x"))
    out = g.join(last, "file").select("file", "together", total.alias("total"), (F.col("together") / total).alias("confidence"), F.transform("x", lambda x: x["l"]).alias("recent"))
    out = out.orderBy(F.desc("together"), F.desc("confidence"), "file")
    return out.limit(top) if top else out


def pairs(commits: DataFrame, least: int = 2, large: int = LARGE) -> DataFrame:
    """``(a, b, together, jaccard)``, ``a < b``: files that share at least ``least`` commits.

    A commit of more than ``large`` files gives no pairs of its own files where it
    is the only large one of both: a pair of a count of 2 then is in a small commit
    too, and is looked up in the large ones.
    """
    f = commit_files(commits).select("hash", "file")
    # a pair that must come twice has two files that each come twice
    often = f.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    f = f.join(often.select("file"), "file", "left_semi")
    wide = f.groupBy("hash").agg(F.count("*").alias("c")).where(F.col("c") > large).select("hash")
    if least < 2 or wide.isEmpty():
        both = _pairs_of(f)
    else:
        small = _pairs_of(f.join(wide, "hash", "left_anti"))
        big = f.join(wide, "hash", "left_semi")
        # pairs of small commits, counted in the large ones as well
        in_small = small.withColumnRenamed("together", "x")
        at = big.toDF("hash", "a")
        seen = in_small.select("a", "b").join(at, "a").join(big.toDF("hash", "b"), ["hash", "b"]).groupBy("a", "b").agg(F.count("*").alias("y"))
        low = in_small.join(seen, ["a", "b"], "left").select("a", "b", (F.col("x") + F.coalesce("y", F.lit(0))).alias("together"))
        # pairs of large commits alone: both files are in several of these
        again = big.groupBy("file").agg(F.count("*").alias("c")).where(F.col("c") >= least).select("file")
        high = _pairs_of(big.join(again, "file", "left_semi")).join(in_small.select("a", "b"), ["a", "b"], "left_anti")
        both = low.unionByName(high)
    both = both.where(F.col("together") >= least)
    j = both.join(often.toDF("a", "na"), "a").join(often.toDF("b", "nb"), "b")
    return j.select("a", "b", "together", (F.col("together") / (F.col("na") + F.col("nb") - F.col("together"))).alias("jaccard"))


def _pairs_of(f: DataFrame) -> DataFrame:
    a, b = f.alias("a"), f.alias("b")
    j = a.join(b, (F.col("a.hash") == F.col("b.hash")) & (F.col("a.file") < F.col("b.file")))
    return j.groupBy(F.col("a.file").alias("a"), F.col("b.file").alias("b")).agg(F.count("*").alias("together"))
