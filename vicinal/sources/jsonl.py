"""JSON and JSON Lines sources and sinks of items."""

from __future__ import annotations

import itertools
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = "id string, vector array<double>, document string, text string, metadata string, created_at double"
#: Bytes that the driver holds of a part while it copies it.
_BLOCK = 1 << 20


def to_lines(items: DataFrame) -> DataFrame:
    """One JSON object per item in a column ``value``: id, vector, document, metadata, created_at."""
    meta = F.expr("try_parse_json(coalesce(metadata, '{}'))")
    row = F.struct(F.col("id").cast("string").alias("id"), "vector", "document", meta.alias("metadata"), "created_at")
    return items.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(items: DataFrame, path: str) -> None:
    to_lines(items).write.mode("overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Items from JSON lines; blank lines are skipped, ``text`` stands in for ``document``, a missing created_at is now."""
    return from_lines(spark.read.text(path))


def from_lines(lines: DataFrame) -> DataFrame:
    rows = lines.filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("ord"), F.from_json("value", _LINE).alias("r"))
    return rows.select("r.id", "r.vector", F.coalesce("r.metadata", F.lit("{}")).alias("metadata"), F.coalesce("r.document", "r.text").alias("document"), F.coalesce("r.created_at", F.lit(time.time())).alias("created_at"), "ord")


def write_json(items: DataFrame, config: dict, path: str) -> None:
    """``{config, saved_at, items}`` in one file, written atomically, an item a line in order of ``ord``.

    Tasks write the items' lines as parts in the shared folder; the driver copies the parts' bytes one after the other into the
    file, so that its memory does not grow with the items. One file is the format; large collections are kept as Parquet.
    """
    import json

    from vicinal.sources.files import atomic_write
    from vicinal.session import shared_folder

    spark = items.sparkSession
    lines = to_lines(items.orderBy("ord") if "ord" in items.columns else items)
    parts = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    head = json.dumps({"config": config, "saved_at": time.time()}, ensure_ascii=False, default=str)
    try:
        lines.select(F.concat(F.lit(","), "value").alias("value")).write.text(parts)
        atomic_write(path, itertools.chain([f'{head[:-1]}, "items": [\n'.encode()], _skip(_parts(spark, parts), 1), [b"]}\n"]))
    finally:
        _remove(spark, parts)


def _file_system(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _parts(spark: SparkSession, folder: str) -> Iterator[bytes]:
    """The bytes of a folder's part files by name, in blocks."""
    fs, place = _file_system(spark, folder)
    found = sorted((s.getPath().toString(), s.getPath()) for s in fs.listStatus(place) if s.getPath().getName().startswith("part-"))
    for _, part in found:
        stream = fs.open(part)
        try:
            while block := bytes(stream.readNBytes(_BLOCK)):
                yield block
        finally:
            stream.close()


def _skip(blocks: Iterator[bytes], n: int) -> Iterator[bytes]:
    """All but the first ``n`` bytes of the first block, if there is one."""
    for block in blocks:
        yield block[n:]
        n = 0


def _remove(spark: SparkSession, folder: str) -> None:
    fs, place = _file_system(spark, folder)
    fs.delete(place, True)


def read_json(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """(config, items) of such a file; the items are parsed by Spark."""
    import json

    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    config = json.loads(whole.select(F.to_json(F.variant_get("v", "$.config", "variant"))).first()[0] or "{}")
    each = F.posexplode(F.variant_get("v", "$.items", "array<variant>")).alias("ord", "i")
    rows = whole.select(each).select(F.col("ord").cast("bigint").alias("ord"), F.to_json("i").alias("value"))
    parsed = rows.select("ord", F.from_json("value", _LINE).alias("r"))
    items = parsed.select("r.id", "r.vector", F.coalesce("r.metadata", F.lit("{}")).alias("metadata"), F.coalesce("r.document", "r.text").alias("document"), F.coalesce("r.created_at", F.lit(time.time())).alias("created_at"), "ord")
    return config, items
