"""Okapi BM25 over exploded postings."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.functions.text import TOKEN, tokenize
from vicinal.operators.knn import ranked

#: BM25's parameters.
K1, B = 1.5, 0.75
#: Folders of a stored index, texts of a block, about, and how much below the k-th score a block's bound may be.
TERM_BUCKETS, BLOCK_DOCS, SLACK = 64, 128, 1e-9


def query_terms(text: str) -> Counter:
    """Terms of a query and how often each occurs; every occurrence counts."""
    import regex

    return Counter(regex.findall(TOKEN, text.lower()))


def indexed(docs: DataFrame, id_col: str = "id", text_col: str = "document") -> DataFrame:
    """Rows that enter the index: those with a text."""
    return docs.filter(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).alias("id"), F.col(text_col).alias("document"))


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "document", tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """(term, id, tf)."""
    terms = indexed(docs, id_col, text_col).select("id", F.explode(tokenizer(F.col("document"))).alias("term"))
    return terms.groupBy("term", "id").agg(F.count("*").alias("tf"))


def doc_lengths(docs: DataFrame, id_col: str = "id", text_col: str = "document", tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """(id, dl); a text without words has length 0 and still counts as a document."""
    return indexed(docs, id_col, text_col).select("id", F.size(tokenizer(F.col("document"))).cast("bigint").alias("dl"))


def search(docs: DataFrame, text: str, k: int | None, where: Column | None = None, id_col: str = "id", text_col: str = "document", k1: float = K1, b: float = B, tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """rank, id, score, distance of the k best matching documents.

    Corpus figures (documents, mean length, document frequencies) are those of all rows; ``where`` only drops results. The query's
    terms are few, so they become part of the plan: postings are filtered to them before anything is grouped, and one pass gives
    each matching document a single row.
    """
    wanted = query_terms(text)
    named = docs.withColumn("__pass", F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
    base = named.filter(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).alias("id"), "__pass", tokenizer(F.col(text_col)).alias("words"))
    terms = sorted(wanted)
    base = base.select("id", "__pass", F.size("words").cast("bigint").alias("dl"), F.filter("words", lambda w: w.isin(terms)).alias("hits") if terms else F.array().cast("array<string>").alias("hits"))
    totals = base.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum(F.array_contains("hits", t).cast("bigint")).alias(f"df{i}") for i, t in enumerate(terms)])
    rows = base.filter(F.col("__pass") & (F.size("hits") > 0)).join(F.broadcast(totals))  # one row of totals
    total = F.lit(0.0)
    for i, term in enumerate(terms):
        tf = F.size(F.filter("hits", _equals(term)))
        df = F.coalesce(F.col(f"df{i}"), F.lit(0))
        raw = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
        below = F.greatest(tf + k1 * (1 - b + b * F.col("dl") / F.greatest("avgdl", F.lit(1e-6))), F.lit(1e-6))
        total = total + F.when(tf > 0, wanted[term] * (idf * (tf * (k1 + 1)) / below)).otherwise(0.0)
    scored = rows.select("id", total.alias("score"))
    if k is not None:
        scored = ranked(scored, k, by="score", ascending=False).select("rank", "id", "score")
    return scored.withColumn("distance", 1 / (1 + F.col("score")))


def _equals(term: str):
    return lambda w: w == F.lit(term)


def stored_postings(docs: DataFrame, id_col: str = "id", text_col: str = "document", tokenizer: Callable[[Column], Column] = tokenize) -> DataFrame:
    """(term, id, tf, dl, bucket): postings as they are stored, by ranges of a term's hash, each with its text's length."""
    rows = indexed(docs, id_col, text_col).select("id", tokenizer(F.col("document")).alias("words"))
    rows = rows.select("id", F.size("words").cast("bigint").alias("dl"), F.explode("words").alias("term"))
    return rows.groupBy("term", "id").agg(F.count("*").alias("tf"), F.any_value("dl").alias("dl")).withColumn("bucket", term_bucket(F.col("term")))


def term_bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(TERM_BUCKETS)).cast("int")


def write_index(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "document", tokenizer: Callable[[Column], Column] = tokenize, block_docs: int = BLOCK_DOCS) -> None:
    """A stored index: postings, their blocks, and one row of totals.

    Postings lie in one folder a bucket, sorted by term, so that a query's terms prune folders and row groups. Texts are dealt to
    blocks of about ``block_docs``; a term's block has how many of its texts hold the term and its peak: the most that the term adds
    to any of their scores, but for the weight that it has for all texts alike.
    """
    spark = docs.sparkSession
    lengths = doc_lengths(docs, id_col, text_col, tokenizer)
    lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    totals = spark.read.parquet(f"{path}/totals").first()
    post = stored_postings(docs, id_col, text_col, tokenizer).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, totals["n"] // block_docs))).cast("int"))
    post.repartitionByRange("bucket", "term", "block", "id").sortWithinPartitions("bucket", "term", "block", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    part = _saturated(F.col("tf"), F.col("dl"), F.lit(totals["avgdl"]), K1, B)
    blocks = spark.read.parquet(f"{path}/postings").groupBy("bucket", "term", "block").agg(F.count("*").alias("n"), F.max(part).alias("peak"))
    blocks.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")


def search_index(spark: SparkSession, path: str, text: str, k: int | None, allowed: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """``search`` over a stored index: only the query's terms are read, and only blocks that can hold one of the k best are scored.

    The sum of its terms' peaks bounds what a text of a block can score. The k blocks of the highest bounds are scored first; a
    block whose bound is below the k-th score found there is left out. Scores are ranked by their first nine digits behind the
    point, as sums of other orders differ beyond. Other parameters than the peaks' own score all blocks. ``allowed`` (id) are the
    rows that pass a filter.
    """
    wanted = query_terms(text)
    buckets = sorted({zlib.crc32(t.encode()) % TERM_BUCKETS for t in wanted})
    of_terms = lambda what: spark.read.parquet(f"{path}/{what}").filter(F.col("bucket").isin(buckets) & F.col("term").isin(list(wanted)))
    totals = spark.read.parquet(f"{path}/totals")
    if not wanted or not totals.first()["n"]:
        return spark.createDataFrame([], "rank bigint, id string, score double, distance double")
    post, blocks = of_terms("postings"), of_terms("blocks")
    dfs = blocks.groupBy("term").agg(F.sum("n").alias("df"))

    def scored(some: DataFrame) -> DataFrame:
        return search_postings(some, None, text, None, allowed, k1, b, totals, dfs)

    if k is not None and (k1, b) == (K1, B):
        n = totals.first()["n"]
        weights = {r["term"]: wanted[r["term"]] * max(math.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5)), 1e-6) for r in dfs.collect()}  # a row a term
        weight = F.element_at(F.create_map(*[x for t, w in weights.items() for x in (F.lit(t), F.lit(w))]), F.col("term")) if weights else F.lit(0.0)
        bounds = blocks.groupBy("block").agg(F.sum(weight * F.col("peak")).alias("bound"))
        first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(k).collect()]
        found = ranked(scored(post.filter(F.col("block").isin(first))), k, by="score", ascending=False).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        if found["n"] == k:
            post = post.join(bounds.filter(F.col("bound") >= found["least"] - SLACK).select("block"), "block", "left_semi")
    out = scored(post)
    if k is None:
        return out
    return ranked(out.withColumn("r", F.round("score", 9)), k, by="r", ascending=False).select("rank", "id", "score", "distance")


def _saturated(tf: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    """What occurrences add, before the term's weight."""
    return tf * (k1 + 1) / F.greatest(tf + k1 * (1 - b + b * dl / F.greatest(avgdl, F.lit(1e-6))), F.lit(1e-6))


def search_postings(post: DataFrame, lengths: DataFrame | None, text: str, k: int | None, allowed: DataFrame | None = None, k1: float = K1, b: float = B, totals: DataFrame | None = None, dfs: DataFrame | None = None) -> DataFrame:
    """The same ranking from postings and lengths (id, dl), or from postings that hold their dl and one row of totals (n, avgdl); ``allowed`` (id) are the rows that pass a filter. k None: all, without ranks. ``dfs`` (term, df) are document frequencies where ``post`` lacks some postings."""
    spark = post.sparkSession
    wanted = query_terms(text)
    if not wanted:
        return spark.createDataFrame([], "rank bigint, id string, score double, distance double")
    hits = post.filter(F.col("term").isin(list(wanted)))
    totals = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")) if totals is None else totals
    dfs = hits.groupBy("term").agg(F.count("*").alias("df")) if dfs is None else dfs
    qtf = F.element_at(F.create_map(*[x for t, c in wanted.items() for x in (F.lit(t), F.lit(c))]), F.col("term"))
    joined = hits.join(F.broadcast(dfs), "term")  # at most one row for each term of the query
    if allowed is not None:
        joined = joined.join(allowed.select("id"), "id", "left_semi")
    joined = (joined if lengths is None else joined.join(lengths, "id")).join(F.broadcast(totals))  # one row
    raw = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)
    below = F.greatest(F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest("avgdl", F.lit(1e-6))), F.lit(1e-6))
    scored = joined.groupBy("id").agg(F.sum(qtf * (idf * (F.col("tf") * (k1 + 1)) / below)).alias("score"))
    scored = scored.withColumn("distance", 1 / (1 + F.col("score")))
    return scored if k is None else ranked(scored, k, by="score", ascending=False).select("rank", "id", "score", "distance")
