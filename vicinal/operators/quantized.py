"""Product quantisation, and searches over quantised vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.functions.distance import cosine_similarity, squared_euclidean, vec
from vicinal.functions.quantize import binary_dequantize, binary_quantize, hamming_bytes, hex_code, scalar_dequantize, scalar_quantize
from vicinal.operators.knn import ranked


class ProductQuantizer:
    """``subspaces`` codebooks of up to ``centroids`` rows each.

    The codebook (at most subspaces x 256 short vectors, whatever the data) lives on the driver and becomes part of the plans.
    """

    def __init__(self, dimension: int, subspaces: int = 8, centroids: int = 256):
        if subspaces <= 0 or dimension % subspaces:
            raise ValueError("the dimension must be a multiple of subspaces")
        if not 1 <= centroids <= 256:
            raise ValueError("centroids must be from 1 to 256")
        self.dimension, self.subspaces, self.centroids = dimension, subspaces, centroids
        self.width = dimension // subspaces
        self.codebook: list[list[list[float]]] = []

    def parts(self, v: Column) -> Column:
        """The vector's slices, one per subspace."""
        return F.array(*[F.slice(vec(v), m * self.width + 1, self.width) for m in range(self.subspaces)])

    def _books(self) -> Column:
        if not self.codebook:
            raise ValueError("the quantizer is not trained")
        return F.array(*[F.array(*[vec(c) for c in book]) for book in self.codebook])

    def start(self, vectors: DataFrame, vector: str = "vector", order: str = "id") -> ProductQuantizer:
        """Codebook from the first rows by ``order``; the last is repeated where there are too few."""
        rows = [r[0] for r in vectors.orderBy(order).limit(self.centroids).select(vec(F.col(vector))).collect()]
        if not rows:
            raise ValueError("nothing to train on")
        rows += [rows[-1]] * (self.centroids - len(rows))
        cut = lambda row, m: [float(x) for x in row[m * self.width : (m + 1) * self.width]]
        self.codebook = [[cut(row, m) for row in rows] for m in range(self.subspaces)]
        return self

    def step(self, vectors: DataFrame, vector: str = "vector") -> DataFrame:
        """One round of assignment and mean over all rows: (m, c, n, centroid) of the cells that got rows."""
        coded = vectors.select(self.parts(F.col(vector)).alias("parts"), self.encode(F.col(vector)).alias("code"))
        one = coded.select(F.posexplode(F.arrays_zip("parts", "code")).alias("m", "z")).select("m", F.col("z.code").alias("c"), F.posexplode("z.parts").alias("pos", "x"))
        means = one.groupBy("m", "c", "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
        return means.groupBy("m", "c").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))

    def train(self, vectors: DataFrame, vector: str = "vector", order: str = "id", max_iters: int = 15) -> ProductQuantizer:
        """Lloyd rounds under squared Euclidean distance until nothing moves; an empty cell keeps its centroid."""
        if not self.codebook:
            self.start(vectors, vector, order)
        for _ in range(max_iters):
            moved = False
            for r in self.step(vectors, vector).collect():  # subspaces x centroids rows at most
                new = [float(x) for x in r["centroid"]]
                moved |= new != self.codebook[r["m"]][r["c"]]
                self.codebook[r["m"]][r["c"]] = new
            if not moved:
                break
        return self

    def encode(self, v: Column) -> Column:
        """Nearest centroid of each slice, the first among equals."""

        def nearest(part: Column, book: Column) -> Column:
            d = F.transform(book, lambda c: squared_euclidean(part, c))
            return F.array_position(d, F.array_min(d)).cast("int") - 1

        return F.zip_with(self.parts(v), self._books(), nearest)

    def decode(self, code: Column) -> Column:
        return F.flatten(F.zip_with(code, self._books(), lambda c, book: F.get(book, c)))

    def distance_table(self, query: Sequence[float], metric: str = "euclidean") -> list[list[float]]:
        """Distance of each centroid to the query's slice: dot product negated, sums of differences, else squared Euclidean."""
        out = []
        for m, book in enumerate(self.codebook):
            q = query[m * self.width : (m + 1) * self.width]
            match metric:
                case "dot_product":
                    out.append([-sum(a * b for a, b in zip(q, c)) for c in book])
                case "manhattan":
                    out.append([sum(abs(a - b) for a, b in zip(q, c)) for c in book])
                case _:
                    out.append([sum((a - b) ** 2 for a, b in zip(q, c)) for c in book])
        return out

    def adc(self, code: Column, query: Sequence[float], metric: str = "euclidean") -> Column:
        """Asymmetric distance: the sum of table entries (not a root of it)."""
        table = F.array(*[vec(row) for row in self.distance_table(query, metric)])
        return F.aggregate(F.zip_with(code, table, lambda c, row: F.get(row, c)), F.lit(0.0), lambda s, x: s + x)

    def to_dict(self) -> dict:
        return {"dimension": self.dimension, "num_subspaces": self.subspaces, "num_centroids": self.centroids, "codebooks": self.codebook}

    @classmethod
    def from_dict(cls, d: dict) -> ProductQuantizer:
        pq = cls(d["dimension"], d["num_subspaces"], d["num_centroids"])
        pq.codebook = [[[float(x) for x in c] for c in book] for book in d["codebooks"]]
        return pq


def adc_top_k(items: DataFrame, pq: ProductQuantizer, query: Sequence[float], k: int, id_col: str = "id", vector_col: str = "vector", metric: str = "euclidean") -> DataFrame:
    rows = items.select(F.col(id_col).alias("id"), pq.adc(pq.encode(F.col(vector_col)), query, metric).alias("distance"))
    return ranked(rows, k).select("rank", "id", "distance")


def binary_top_k(items: DataFrame, query: Sequence[float], k: int, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Nearest by differing sign bits."""
    d = hamming_bytes(binary_quantize(F.col(vector_col)), binary_quantize(query)).cast("bigint")
    return ranked(items.select(F.col(id_col).alias("id"), d.alias("distance")), k).select("rank", "id", "distance")


def report(items: DataFrame, mode: str = "sq8", bits: int = 8, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """id, code_hex, n_bytes, ratio, min_value, max_value, mse, cosine_reconstruction of each vector (mode sq8 or binary)."""
    v = vec(F.col(vector_col))
    rows = items.select(F.col(id_col).alias("id"), v.alias("v"))
    if mode in ("sq8", "scalar8", "scalar"):
        rows = rows.withColumn("q", scalar_quantize(F.col("v"), bits)).withColumn("back", scalar_dequantize(F.col("q"), bits))
        code, lo, hi = F.col("q.codes"), F.col("q.lo"), F.col("q.hi")
        mse = F.round(F.aggregate(F.zip_with("v", "back", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size("v"), 8)
    elif mode == "binary":
        rows = rows.withColumn("q", binary_quantize(F.col("v")))
        rows = rows.withColumn("back", F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda i: F.when(F.get("v", i) > 0, 1.0).otherwise(-1.0)))
        code, lo, hi, mse = F.col("q"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double")
    else:
        raise ValueError(f"unknown mode {mode!r}")
    n = F.size(code).cast("bigint")
    return rows.select("id", hex_code(code).alias("code_hex"), n.alias("n_bytes"), (F.size("v") * 4.0 / n).alias("ratio"), lo.alias("min_value"), hi.alias("max_value"), mse.alias("mse"), F.round(cosine_similarity(F.col("v"), F.col("back")), 6).alias("cosine_reconstruction"))


__all__ = ["ProductQuantizer", "adc_top_k", "binary_dequantize", "binary_top_k", "report"]
