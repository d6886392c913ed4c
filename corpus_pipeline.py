"""From raw documents to token ids: language identification, near-dedup, substring dedup, mixing, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vicinal.llm import bpe, common, langid, mixing, nearcopies, substring

#: Encoding, and the learnt network before it, cannot be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go, those of a null text or one without letters among them. Repeated rows fare alike; a table without labels keeps none."""
    return langid.accepted(docs, langid.fit(docs.select("doc_id", "text", "lang")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 and more) stays: that of the smallest doc_id, then text hash.

    Null texts and texts without words are one group; rows without a doc_id stay.
    """
    return nearcopies.near_dedup(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that a smaller doc_id has as well are cut. Null texts and texts of fewer words stay as they are, as do first occurrences."""
    return substring.dedup_substrings(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is taken up to its target, documents as often as their source's epochs need. A null source is one of its own; texts without words are taken by none."""
    return mixing.mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text they decode to. A null text is empty; rows that repeat are encoded each."""
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next stage, after which it is removed.

    Columns named as a stage's own are kept as they come; texts of any length pass whole; an empty table gives no rows.
    """
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
        if before is not None:
            common.discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
