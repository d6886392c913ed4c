"""Names, configurations and row types of the engine."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import types as T

METRICS = ("cosine", "euclidean", "dot_product", "manhattan", "hamming", "jaccard")
INDEXES = ("flat", "hnsw", "ivf")

#: Items as stored. ``ord`` is the insertion order; metadata is schemaless JSON kept as VARIANT while queried.
ITEM = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.DoubleType()), False),
    T.StructField("metadata", T.StringType()),
    T.StructField("document", T.StringType()),
    T.StructField("created_at", T.DoubleType()),
    T.StructField("ord", T.LongType()),
])


def parse_metric(name: str) -> str:
    """Canonical metric name; case, blanks, ``-`` and inner spaces don't matter; ``dot`` is short for ``dot_product``."""
    key = name.strip().lower().replace("-", "_").replace(" ", "_")
    key = "dot_product" if key == "dot" else key
    if key not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return key


def parse_index(name: str) -> str:
    key = name.strip().lower()
    if key not in INDEXES:
        raise ValueError(f"unknown index type {name!r}; known: {', '.join(INDEXES)}")
    return key


# The defaults of the graph and of inverted files.


@dataclass(frozen=True)
class HnswConfig:
    m: int = 16
    ef_construction: int = 64
    ef_search: int = 32
    max_layers: int = 6
    heuristic_pruning: bool = True
    seed: int = 42

    @property
    def m0(self) -> int:
        return 2 * self.m

    @property
    def level_mult(self) -> float:
        return 1 / math.log(max(self.m, 2))


@dataclass(frozen=True)
class IvfConfig:
    nlist: int = 16
    nprobe: int = 4
    max_iterations: int = 20
    seed: int = 42


@dataclass(frozen=True)
class CollectionConfig:
    name: str
    dimension: int
    metric: str = "cosine"
    index_type: str = "hnsw"
    hnsw: HnswConfig = field(default_factory=HnswConfig)
    ivf: IvfConfig = field(default_factory=IvfConfig)

    def __post_init__(self) -> None:
        if self.dimension <= 0:
            raise ValueError("dimension must be positive")
        object.__setattr__(self, "metric", parse_metric(self.metric))
        object.__setattr__(self, "index_type", parse_index(self.index_type))

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict[str, Any]) -> CollectionConfig:
        known = lambda kind, x: kind(**{k: v for k, v in (x or {}).items() if k in kind.__dataclass_fields__ and v is not None})
        hnsw, ivf = d.get("hnsw") or d.get("hnsw_config"), d.get("ivf") or d.get("ivf_config")
        return cls(d["name"], int(d["dimension"]), d.get("metric", "cosine"), d.get("index_type", "hnsw"), known(HnswConfig, hnsw), known(IvfConfig, ivf))
