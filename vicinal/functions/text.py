"""Tokens and the hashed text embedder, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters, numbers and underscores of any script.
TOKEN = r"[\p{L}\p{N}_]+"
#: Fixed values of the embedder: weight of a word, of a 3-gram; salts of the three hashes and their weights.
WORD_WEIGHT, GRAM_WEIGHT = 1.0, 0.4
SALTS = (("", 1.2), ("_salt1", 0.8), ("_salt2", 0.5))


def tokenize(text: Column) -> Column:
    """Lower-cased words, in order; null and empty texts give an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def features(words: Column) -> Column:
    """Structs (t, w) of an array of words: each word, and each 3-gram of words of three characters or more."""
    grams = F.flatten(F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))
    tag = lambda a, weight: F.transform(a, lambda t: F.struct(t.alias("t"), F.lit(weight).alias("w")))
    return F.concat(tag(words, WORD_WEIGHT), tag(grams, GRAM_WEIGHT))


def hash32(token: Column) -> Column:
    """The first 32 bits of md5: the same in every process."""
    return F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint")


def embed(df: DataFrame, text: str, key: str, dimension: int = 64, normalized: bool = True) -> DataFrame:
    """(key, vector): each feature adds its weight, signed by bit 31, at hash modulo ``dimension`` for three salted hashes."""
    dimension = dimension if dimension > 0 else 64
    words = df.select(F.col(key).alias("key"), F.explode(tokenize(F.trim(F.col(text)))).alias("t"))
    words = words.groupBy("key", "t").agg(F.count("*").cast("double").alias("n"))  # a word is hashed once a text
    rows = words.select("key", "n", F.explode(features(F.array("t"))).alias("f"))
    salted = F.array(*[F.struct(hash32(F.concat(F.col("f.t"), F.lit(s))).alias("h"), F.lit(w).alias("m")) for s, w in SALTS])
    rows = rows.select("key", (F.col("n") * F.col("f.w")).alias("w"), F.explode(salted).alias("s"))
    sign = F.when(F.shiftright(F.col("s.h"), 31) % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    sums = rows.groupBy("key", (F.col("s.h") % dimension).cast("int").alias("i")).agg(F.sum(sign * F.col("w") * F.col("s.m")).alias("x"))
    sparse = sums.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    out = df.select(F.col(key).alias("key")).join(sparse, "key", "left").select(F.col("key").alias(key), dense.alias("vector"))
    if normalized:
        from vicinal.functions.distance import normalize

        out = out.withColumn("vector", normalize(F.col("vector")))
    return out


def embed_text(text: str, dimension: int = 64, normalized: bool = True) -> list[float]:
    """The same embedding of one text, on the driver."""
    import hashlib
    import math
    import re

    dimension = dimension if dimension > 0 else 64
    words = re.findall(r"\w+", text.lower().strip())
    weighted = [(w, WORD_WEIGHT) for w in words] + [(w[i : i + 3], GRAM_WEIGHT) for w in words if len(w) >= 3 for i in range(len(w) - 2)]
    out = [0.0] * dimension
    for token, weight in weighted:
        for salt, scale in SALTS:
            h = int(hashlib.md5((token + salt).encode()).hexdigest()[:8], 16)
            out[h % dimension] += (-1.0 if h >> 31 & 1 else 1.0) * weight * scale
    n = math.sqrt(sum(x * x for x in out))
    return [x / n for x in out] if normalized and n > 0 else out
