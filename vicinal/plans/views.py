"""Tables as the queries read them, and the SQL that reads them the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as items (id, vector, label). Vectors are scaled by 1 to 3, so that metrics differ in order."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 3)).alias("vector"), "label")


ITEMS = "items AS (SELECT vec_id AS id, [x::DOUBLE * (1 + vec_id % 3) for x in embedding] AS vector, label FROM embeddings)"


def first_vectors(spark: SparkSession, sf_dir: str, n: int) -> list[list[float]]:
    """The vectors of the first n ids: fixed starting points."""
    return [[float(x) for x in r[0]] for r in items(spark, sf_dir).orderBy("id").limit(n).select("vector").collect()]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels as JSON metadata; unlabelled ones lack the keys."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = d.join(labels, "doc_id", "left")
    meta = F.to_json(F.struct("lang", "source", "n_chars", "quality", "toxic", F.array("lang", "source").alias("tags"), (F.col("doc_id") + 2**53).alias("big")))
    return joined.select(F.col("doc_id").alias("id"), F.col("text").alias("document"), "lang", "source", "n_chars", F.parse_json(meta).alias("metadata"))


META = "docs AS (SELECT d.doc_id AS id, d.text AS document, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents paired with the vector of the same number, where there is one."""
    v = items(spark, sf_dir).select("id", "vector")
    return documents(spark, sf_dir).join(v, "id", "left")


PAIRED = "paired AS (SELECT docs.*, items.vector FROM docs LEFT JOIN items USING (id))"


def dot(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b})"


def fold(a: str, b: str, each: str) -> str:
    """Sum over positions i of an expression of x and y."""
    body = each.replace("x", f"{a}[i]").replace("y", f"{b}[i]")
    return f"coalesce(list_sum([{body} for i in range(1, len({a}) + 1)]), 0)::DOUBLE"


def distance(metric: str, a: str, b: str) -> str:
    """SQL of a distance between two DOUBLE lists."""
    match metric:
        case "cosine":
            norms = f"(sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
            return f"CASE WHEN {norms} <= 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {dot(a, b)} / {norms}))) END"
        case "euclidean":
            return f"list_distance({a}, {b})"
        case "dot_product":
            return f"(-{dot(a, b)})"
        case "manhattan":
            return fold(a, b, "abs(x - y)")
        case "hamming":
            return f"({fold(a, b, '(x <> y)::INT')} / len({a}))"
        case _:
            low, high = fold(a, b, "least(x, y)"), fold(a, b, "greatest(x, y)")
            return f"(1 - CASE WHEN {high} > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, {low} / {high})) WHEN {high} = 0 AND {a} = {b} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def score(metric: str, d: str) -> str:
    match metric:
        case "cosine":
            return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - {d}))"
        case "euclidean" | "manhattan":
            return f"(1 / (1 + greatest(0.0::DOUBLE, {d})))"
        case "dot_product":
            return f"(-{d})"
        case _:
            return f"(1 - greatest(0.0::DOUBLE, least(1.0::DOUBLE, {d})))"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def joined(array, digits: int = 6):
    """An array of numbers as a string of fixed decimals; adding 0 makes -0 a plain 0."""
    return F.array_join(F.transform(array, lambda x: F.format_string(f"%.{digits}f", F.round(x, digits) + 0.0)), ",")


def joined_sql(array: str, digits: int = 6) -> str:
    return f"array_to_string([printf('%.{digits}f', round(x, {digits}) + 0.0) for x in {array}], ',')"
