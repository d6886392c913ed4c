"""Distances and similarities of array columns as Catalyst expressions (higher-order functions, no Python on executors)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.schema import METRICS, parse_metric

Vector = Column | Sequence[float]


def vec(v: Vector) -> Column:
    """A column of doubles: a literal for a Python sequence, else the column cast element by element."""
    if isinstance(v, Column):
        return v.cast("array<double>")
    return F.array(*[F.lit(float(x)) for x in v]) if len(v) else F.array().cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _pairs(a: Vector, b: Vector, f: Callable[[Column, Column], Column]) -> Column:
    """zip_with that raises where lengths differ."""
    a, b = vec(a), vec(b)
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f)).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("array<double>"))


def dot(a: Vector, b: Vector) -> Column:
    return _sum(_pairs(a, b, lambda x, y: x * y))


def norm(a: Vector) -> Column:
    return F.sqrt(_sum(F.transform(vec(a), lambda x: x * x)))


def cosine_similarity(a: Vector, b: Vector) -> Column:
    """0 where either vector is zero; never outside [-1, 1]."""
    na, nb = norm(a), norm(b)
    return F.when((na <= 0) | (nb <= 0), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb))))


def cosine_distance(a: Vector, b: Vector) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - cosine_similarity(a, b))


def squared_euclidean(a: Vector, b: Vector) -> Column:
    return _sum(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean_distance(a: Vector, b: Vector) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def dot_distance(a: Vector, b: Vector) -> Column:
    return -dot(a, b)


def manhattan_distance(a: Vector, b: Vector) -> Column:
    return _sum(_pairs(a, b, lambda x, y: F.abs(x - y)))


def hamming_distance(a: Vector, b: Vector) -> Column:
    """Share of places that differ; 0 for empty vectors."""
    differing = _sum(_pairs(a, b, lambda x, y: F.when(x != y, F.lit(1.0)).otherwise(F.lit(0.0))))
    return F.when(F.size(vec(a)) == 0, F.lit(0.0)).otherwise(differing / F.size(vec(a)))


def jaccard_similarity(a: Vector, b: Vector) -> Column:
    """Sum of minima over sum of maxima, within [0, 1]; two empty vectors 1; maxima below 0 give 0; maxima of 0 give 1 for equal vectors."""
    low = _sum(_pairs(a, b, lambda x, y: F.least(x, y)))
    high = _sum(_pairs(a, b, lambda x, y: F.greatest(x, y)))
    ratio = F.when(high > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), low / high))).when((high == 0) & (vec(a) == vec(b)), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.size(vec(a)) == 0, F.lit(1.0)).otherwise(ratio)


def jaccard_distance(a: Vector, b: Vector) -> Column:
    return 1.0 - jaccard_similarity(a, b)


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays read as sets; two empty sets 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def distance(metric: str, a: Vector, b: Vector) -> Column:
    by_name = dict(zip(METRICS, (cosine_distance, euclidean_distance, dot_distance, manhattan_distance, hamming_distance, jaccard_distance)))
    return by_name[parse_metric(metric)](a, b)


def similarity(metric: str, a: Vector, b: Vector) -> Column:
    """Higher is nearer: cosine, Jaccard and dot product as they are, 1 / (1 + d) for sums of differences, 1 - d for Hamming."""
    match parse_metric(metric):
        case "cosine":
            return cosine_similarity(a, b)
        case "dot_product":
            return dot(a, b)
        case "euclidean":
            return 1.0 / (1.0 + euclidean_distance(a, b))
        case "manhattan":
            return 1.0 / (1.0 + manhattan_distance(a, b))
        case "hamming":
            return 1.0 - hamming_distance(a, b)
        case _:
            return jaccard_similarity(a, b)


def score(metric: str, d: Column) -> Column:
    """Score of a distance, higher is better."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    match parse_metric(metric):
        case "cosine":
            return clamp(1.0 - d)
        case "euclidean" | "manhattan":
            return 1.0 / (1.0 + F.greatest(F.lit(0.0), d))
        case "dot_product":
            return -d
        case _:
            return 1.0 - clamp(d)


def normalize(a: Vector) -> Column:
    """Unit vector; a zero vector stays zero."""
    n = norm(a)
    return F.when(n > 0, F.transform(vec(a), lambda x: x / n)).otherwise(F.transform(vec(a), lambda x: F.lit(0.0)))


def centroid(df: DataFrame, vector: str, by: Sequence[str] = ()) -> DataFrame:
    """Element-wise mean of the vectors of each group, as ``by`` columns and ``centroid``. Vectors of differing lengths raise."""
    one = df.select(*by, F.posexplode(vec(F.col(vector))).alias("pos", "x"), F.size(vector).alias("d"))
    means = one.groupBy(*by, "pos").agg(F.avg("x").alias("m"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    checked = F.when(F.col("lo") == F.col("hi"), F.col("m")).otherwise(F.raise_error(F.lit("vectors differ in length")).cast("double"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", checked.alias("m"))))
    return means.groupBy(*by).agg(F.transform(ordered, lambda s: s["m"]).alias("centroid"))


def random_projection(vector: Vector, dimension: int, target: int, seed: int = 42) -> Column:
    """Gaussian projection to ``target`` numbers, scaled by 1 / sqrt(target); vectors not longer than that are padded with zeros.

    The matrix is drawn row by row on the driver and becomes part of the plan.
    """
    v = vec(vector)
    if dimension <= target:
        return F.concat(v, F.array_repeat(F.lit(0.0), target - dimension))
    return F.array(*[dot(v, row) for row in projection_matrix(dimension, target, seed)])


def projection_matrix(dimension: int, target: int, seed: int = 42) -> list[list[float]]:
    import random

    rng, scale = random.Random(seed), target**-0.5
    return [[rng.gauss(0.0, 1.0) * scale for _ in range(dimension)] for _ in range(target)]


#: SQL functions over array<double>, inlined by Catalyst.
SQL_FUNCTIONS = {
    "vs_dot": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "vs_norm": "sqrt(aggregate(a, 0D, (s, x) -> s + x * x))",
    "vs_euclidean": "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "vs_manhattan": "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)",
    "vs_cosine": "CASE WHEN aggregate(a, 0D, (s, x) -> s + x * x) <= 0 OR aggregate(b, 0D, (s, x) -> s + x * x) <= 0 THEN 0D ELSE greatest(-1D, least(1D, aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))))) END",
}


def register_functions(spark) -> None:
    """Make the SQL functions known to ``spark.sql``."""
    for name, body in SQL_FUNCTIONS.items():
        two = "b ARRAY<DOUBLE>" if name != "vs_norm" else ""
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>{', ' + two if two else ''}) RETURNS DOUBLE RETURN {body}")
