"""Similarity search, retrieval analytics and corpus preparation on Spark."""

from __future__ import annotations

from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from pyspark.sql import SparkSession

    from vicinal.sources.collection import Collection


def export_collection(collection: Collection, path: str, format: str = "json") -> str:
    """A collection as one file: ``json``, or any other name for the binary format."""
    collection.save(path, "json" if format == "json" else "vdb")
    return path


def load_collection(spark: SparkSession, path: str, root: str | None = None) -> Collection:
    """The collection of such a file, kept below ``root`` (by default the session's shared folder)."""
    from vicinal.session import shared_folder
    from vicinal.sources.collection import Collection

    return Collection.load(spark, root or shared_folder(spark).removeprefix("file://").removeprefix("file:"), path)
