"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; an error for different lengths."""
    safe = F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<double>"))
    return _fold(safe)


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalize(a: Column) -> Column:
    """A vector of length 1; as it is where its length is at most 1e-12."""
    n = norm(a)
    return F.when(n <= 1e-12, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine within [-1, 1]; 0 where a vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale < 1e-12, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / scale)))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


METRICS = {"cosine": cosine_distance, "dot": lambda a, b: -dot(a, b), "euclidean": lambda a, b: F.sqrt(l2_squared(a, b))}


def distance(metric: str, a: Column, b: Column) -> Column:
    """Distance under a metric: ``cosine``, ``dot`` or ``euclidean``."""
    return METRICS[metric](a, b)


def score(metric: str, d: Column) -> Column:
    """Score of a distance, larger for nearer."""
    return {"cosine": 1 - d, "dot": -d, "euclidean": 1 / (1 + d)}[metric]


def feature_bucket(feature: Column, dim: int) -> Column:
    """Bucket of a feature by 31 bits of its MD5 hash, which other engines can compute too."""
    return F.pmod(F.shiftright(feature_code(feature), 1), F.lit(dim))


def feature_sign(feature: Column) -> Column:
    """+1 or -1 by the lowest bit of the hash."""
    return F.when(F.pmod(feature_code(feature), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def feature_code(feature: Column) -> Column:
    return F.conv(F.substring(F.md5(feature.cast("binary")), 1, 8), 16, 10).cast("bigint")


def fast_feature_code(feature: Column) -> Column:
    """The same role by a faster hash, for use inside Spark alone."""
    return F.xxhash64(feature)
