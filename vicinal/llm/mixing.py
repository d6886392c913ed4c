"""Mixing sources to target weights.

Every document gets a hash-random key (md5 of its doc_id). Within each source the keys are range-sorted: a leading run of key
digits names a range bucket, bucket totals give each bucket's offset, and a running sum inside a bucket completes the prefix sum,
so a source that holds a third of all rows is spread over its buckets. The prefix sum is cut at the source's exact budget:
whole epochs first, then documents in key order until the rest is used up; the document at the cut gives the words that remain.

Targets share 100 % of all words by weight, stop at ``max_epochs`` times their source's words, and the excess is shared again by
weight until none is above.

Rows of one doc_id and text are counted before they are sorted, so repeated rows cost one row however many they are.

Nulls: a null text has size 0; a null source is a source of its own, last in order; a null doc_id is keyed by its text. Rows that
repeat each count. Equal keys are ordered by doc_id, size and a hash of the text; rows equal in these are told apart by their
other columns where a budget ends among them. Texts of any length are counted whole. An empty table gives no rows; extra columns
are ignored by the query and kept by ``mixed_documents``. Sources without words have target 0. Reruns agree, whatever the
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.common import durable, join_few

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Rows of one source that one range bucket holds on average, at most.
BUCKET_ROWS = 4096
#: Rows of one doc_id and text that one task gives back in a row, at most.
COPY_ROWS = 4096
#: What rows are sorted by within a source.
_TUPLE = ("key", "doc_id", "size", "th")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _random_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``totals`` (one row per source: skey, source_size) plus target. Sources are ordered by skey, the null one last."""
    every = Window.partitionBy(F.lit(1))
    order = every.orderBy(F.col("skey") == "", "skey")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("bigint")
    t = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    t = t.withColumn("full", F.col("cap").cast("double") / F.col("weight"))
    before = every.orderBy("full", "skey").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("capped", F.col("cap") * open_weight <= left * F.col("weight"))
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    shared = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    share = (rest * F.col("weight")).cast("double") / shared
    return t.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share)).select("skey", "source_size", "target")


def counted(sized: DataFrame) -> DataFrame:
    """One row for each doc_id and text of a source of ``sized`` (see ``sizes``), and how many rows they are (copies)."""
    rows = sized.groupBy("source", *_TUPLE).agg(F.count("*").alias("copies"))
    return durable(rows.withColumns({"skey": _source_key(F.col("source")), "words": F.col("size") * F.col("copies")}))


def placed(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` (see ``counted``) plus source_size, target, epochs, rest and start.

    ``epochs`` is how often the whole source is taken, ``rest`` the words of the last, partial epoch, ``start`` the place of the
    first of the copies in the source's prefix sum.
    """
    totals = rows.groupBy("skey").agg(F.sum("words").alias("source_size"), F.count("*").alias("n"))
    largest = totals.agg(F.max("n")).first()[0] or 0
    digits = 0
    while digits < 8 and largest > bucket_rows * 16**digits:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    buckets = rows.groupBy("skey", "bucket").agg(F.sum("words").alias("bucket_size"))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("skey", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("offset"))
    plan = targets(totals.select("skey", "source_size"), weights, max_epochs)
    budget = F.round("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    inside = Window.partitionBy("skey", "bucket").orderBy(*_TUPLE).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("upto", F.sum("words").over(inside)).join(offsets.join(plan, "skey"), ["skey", "bucket"])
    return found.withColumn("start", F.col("offset") + F.col("upto") - F.col("words"))


def mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``sized`` plus source_size, target, epochs, rest, start (the row's own place) and taken."""
    rows = counted(sized)
    found = placed(rows, weights, max_epochs, bucket_rows)
    found = found.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPY_ROWS).cast("bigint"))))
    if not rows.filter(F.col("copies") > COPY_ROWS).isEmpty():
        found = found.repartition("skey", "key", "block")
    last = F.least(F.col("block") + COPY_ROWS, F.col("copies")) - 1
    found = found.withColumn("copy", F.explode(F.sequence("block", last))).withColumn("start", F.col("start") + F.col("size") * F.col("copy"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return found.withColumn("taken", F.col("epochs") * F.col("size") + part)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, size, th), written once: texts are read a single time."""
    text = F.col("text")
    return durable(docs.select("doc_id", "source", _random_key(F.col("doc_id"), text).alias("key"), n_words(text).alias("size"), F.xxhash64(text).alias("th")))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns; the one at a cut with its first words only.

    Which documents are in is told by one row per source (its epochs, where it is cut and the words left there), so texts are not
    moved unless that table is too large to send. Where a cut falls among rows of one doc_id and text, these are counted off.
    """
    own = F.struct(*_TUPLE)
    last = F.max(F.when(F.col("start") < F.col("rest"), F.struct(own.alias("at"), (F.col("rest") - F.col("start")).alias("left"), "copies")))
    cuts = durable(placed(counted(sizes(docs)), weights, max_epochs).filter("size > 0").groupBy("skey").agg(F.any_value("epochs").alias("epochs"), last.alias("cut")))
    names, text = docs.columns, F.col("row.text")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    shown = {"skey": _source_key(F.col("row.source")), "doc_id": F.col("row.doc_id"), "key": _random_key(F.col("row.doc_id"), text), "size": n_words(text), "th": F.xxhash64(text)}
    row = join_few(row.withColumns(shown).filter("size > 0"), cuts, ["skey"])
    part = F.when(own < F.col("cut.at"), F.col("size")).when(own == F.col("cut.at"), F.least("size", "cut.left"))
    row = row.withColumn("part", F.coalesce(part, F.lit(0)))
    among = F.coalesce((own == F.col("cut.at")) & (F.col("cut.copies") > 1) & (F.col("cut.left") < F.col("size") * F.col("cut.copies")), F.lit(False))
    copies = F.col("epochs") + (F.col("part") > 0).cast("bigint")
    taken = row.filter(~among & (copies > 0)).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("bigint"), copies)))
    taken = taken.select("row", F.when((F.col("epoch") <= F.col("epochs")) | (F.col("part") == F.col("size")), F.lit(None)).otherwise(F.col("part")).alias("part"))
    if not cuts.filter("cut.copies > 1 AND cut.left < cut.at.size * cut.copies").isEmpty():
        taken = taken.unionByName(_counted_off(row.filter(among)))
    words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    cut_here = F.col("part").isNotNull()
    out = {"text": F.when(cut_here, words).otherwise(text)}
    if "n_chars" in names:
        out["n_chars"] = F.when(cut_here, F.length(words).cast("bigint")).otherwise(F.col("row.n_chars"))
    return taken.select(*[out[c].cast(docs.schema[c].dataType).alias(c) if c in out else F.col(f"row.`{c}`").alias(c) for c in names])


def _counted_off(rows: DataFrame) -> DataFrame:
    """(row, part) of the rows of one doc_id and text at each source's cut: equal ones are counted, then taken in order of a hash until the words are used up."""
    alike = rows.groupBy("skey", F.xxhash64("row").alias("h")).agg(F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in ("row", "size", "epochs", "cut")])
    before = Window.partitionBy("skey").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("cut.left") - F.coalesce(F.sum("n").over(before), F.lit(0)) * F.col("size")
    alike = alike.withColumn("left", F.least(F.greatest(left, F.lit(0)), F.col("n") * F.col("size")))
    whole = F.col("n") * F.col("epochs") + F.floor(F.col("left") / F.col("size"))
    kinds = F.array(F.struct(whole.alias("times"), F.lit(None).cast("bigint").alias("part")), F.struct((F.col("left") % F.col("size") > 0).cast("bigint").alias("times"), (F.col("left") % F.col("size")).alias("part")))
    found = alike.select("row", F.explode(kinds).alias("kind")).filter("kind.times > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("kind.times"))))
    return found.select("row", F.col("kind.part").alias("part"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(sizes(docs)).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, text, '')) AS key
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM totals
), filled AS (
  SELECT *, cap * (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))
            <= (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) * weight AS capped
  FROM weighted
  WINDOW w AS (ORDER BY cap::DOUBLE / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aimed AS (
  SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
    ((sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) * weight)::DOUBLE
    / (sum(CASE WHEN NOT capped THEN weight END) OVER ()) END AS target
  FROM filled
), planned AS (
  SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM aimed
), placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.epochs, p.budget - p.epochs * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM placed
"""
