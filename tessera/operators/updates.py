"""Upserts, removals and change detection on tables with keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str | list[str], order: str = "seq") -> DataFrame:
    """The row of largest ``order`` of each key; null keys drop out."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    ok = df
    for k in keys:
        ok = ok.where(F.col(k).isNotNull())
    return ok.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal keys."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def remove_by(df: DataFrame, paths: DataFrame, column: str = "file_path") -> DataFrame:
    """Rows whose ``column`` is not among ``paths``; null stays."""
    return df.join(paths.select(column).distinct(), column, "left_anti").select(*df.columns)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "path", stamps: tuple[str, ...] = ("mtime", "length")) -> DataFrame:
    """``(key, change)`` between two states: ``insert``, ``update`` or ``delete``; equal stamps give no row."""
    a = old.select(key, F.struct(*stamps).alias("a"))
    b = new.select(key, F.struct(*stamps).alias("b"))
    j = a.join(b, key, "full_outer")
    change = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").when(~F.col("a").eqNullSafe(F.col("b")), "update")
    return j.select(key, change.alias("change")).where("change is not null")


#: Extensions, node kinds and spaces of things that are not text; fixed values.
NON_TEXT_KINDS, NON_TEXT_SPACES = ("AudioTrack", "Image", "Binary"), ("BinaryFingerprint", "Metadata")


def non_text_paths(chunks: DataFrame, nodes: DataFrame, features: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """``file_path`` of files that stored tables hold though they are no text: by extension, node kind, space of a vector, or content."""
    from ..functions import text as T

    by_ext = chunks.select("file_path").unionByName(nodes.select("file_path")).where(F.lower(T.extension(F.col("file_path"))).isin(*extensions))
    by_kind = nodes.where(F.col("kind").isin(*NON_TEXT_KINDS)).select("file_path")
    odd = features.where(F.col("space").isin(*NON_TEXT_SPACES)).select("vector_id").distinct()
    by_space = chunks.join(odd, "vector_id", "left_semi").select("file_path")
    by_text = chunks.where(F.startswith(F.col("content"), F.lit("PDF Document: "))).select("file_path")
    return by_ext.unionByName(by_kind).unionByName(by_space).unionByName(by_text).where("file_path is not null").distinct()
