"""Quality classification with interpolated modified Kneser-Ney n-grams of trusted text.

The model (``bytelm``) learns from trusted documents - labelled of good quality and not toxic - but those of one fold in
``FOLDS``. A document is kept if its perplexity is at most its language's threshold: the ``QUANTILE`` of the perplexities of the
trusted documents that were held out. Languages with fewer than ``LEAST_HELD`` of these are judged by the quantile over all
languages.

Null or empty texts have no perplexity and are not kept; texts of any length are scored whole. A null language is judged by the
quantile over all; without held-out trusted documents everything that has text is kept. A perplexity of just the threshold is
kept. Null doc_ids are scored but not trusted. Contradicting labels of a document make it untrusted. Repeated rows are returned
as often as they come in (and learnt as often); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm import bytelm
from vicinal.llm.common import join_few, written

QUANTILE = 0.995
FOLDS = 5
LEAST_HELD = 30


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return good.filter("q >= 1 AND t = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), doc_id), F.lit(FOLDS)) == 0


def thresholds(scores: DataFrame, quantile: float, least_held: int) -> tuple[DataFrame, float | None]:
    """((lang, own) of languages with enough held-out ``scores`` (lang, perplexity), the quantile over all)."""
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    by_lang = scores.filter("lang IS NOT NULL").groupBy("lang").agg(at.alias("own"), F.count("*").alias("n"))
    return by_lang.filter(F.col("n") >= least_held).select("lang", "own"), scores.agg(at).first()[0]


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, least_held: int = LEAST_HELD, order: int = bytelm.ORDER) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) of every row of ``docs`` (doc_id, text, lang)."""
    trusted = trusted_ids(labels)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    found = bytelm.perplexities(rows, trusted.filter(~held_out(F.col("doc_id"))), order)
    empty = rows.filter("coalesce(text, '') = ''").select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"))
    scores = written(found.unionAll(empty))
    held = scores.filter("perplexity IS NOT NULL").filter(held_out(F.col("doc_id"))).join(trusted.hint("merge"), "doc_id", "left_semi")
    by_lang, overall = thresholds(held, quantile, least_held)
    threshold = F.coalesce("own", F.lit(overall).cast("double"), F.lit(float("inf")))
    joined = join_few(scores, by_lang, ["lang"], "left").withColumn("threshold", threshold)
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return joined.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "lang", "perplexity", "threshold", kept.alias("kept"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))
