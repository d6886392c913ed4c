"""Alignment of two tokenizers' tokens over the same bytes.

A text with a space before it is encoded by a byte-level BPE (A), the text alone by a piece BPE with byte fallback (B), which adds
that space itself. Both token sequences spell the same bytes; two pointers merge the cumulative ends of their tokens, and where
both end, a group ends and the two tokens that end there are linked. ``align`` emits groups and links in ``mapInPandas``; Spark
counts each pair of ids over the corpus, takes each side's largest counts, and joins both back to the documents. Links are
counted by document before they become rows.

Texts that are null, empty, or not spelt by their tokens (B turns U+2581 into a space) have no tokens: zeros and empty groups.
Texts of any length are read whole. Rows of one doc_id, and repeated rows, are aligned each on its own and count each. Ties: every
link whose count equals its side's maximum is a best one. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.bpe import PATTERN, byte_alphabet, default_vocabulary
from vicinal.llm.common import bound_batches, durable, join_hot, written

#: Rows of the table of pairs that are sent to all tasks, at most: some 50 MB. A larger one is joined by shuffle.
SENT_PAIRS = 1 << 19
_NONE = np.empty(0, np.int64)


def piece_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def merged(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """The indexes at which two rising sequences have a value in common, by two pointers. Their last values are equal."""
    at_a, at_b, j = [], [], 0
    for i, end in enumerate(ends_a):
        while ends_b[j] < end:
            j += 1
        if ends_b[j] == end:
            at_a.append(i)
            at_b.append(j)
    return at_a, at_b


class Aligner:
    """Both tokenizers, for one worker."""

    def __init__(self, definition: str, model: bytes):
        import sentencepiece
        import tiktoken

        spec, alphabet = json.loads(definition)["model"], byte_alphabet()
        pieces = {i: bytes(alphabet[c] for c in p) for p, i in spec["vocab"].items() if all(c in alphabet for c in p)}
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in spec["merges"]]
        if [spec["vocab"][p] for p in made] != sorted(spec["vocab"][p] for p in made):
            raise ValueError("ids must rise in the order of the merges")  # as ranks, then, they tell which merge comes first
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={p: i for i, p in pieces.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(names)]
        self.lengths_a, self.lengths_b = (np.array([len(p) for p in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        # each id as text, once as one of several and once as its group's last
        self.shown_a = np.array([f"{i}{mark}" for i in range(len(self.bytes_a)) for mark in ",|"], object)
        self.shown_b = np.array([f"{i}{mark}" for i in range(len(self.bytes_b)) for mark in ",;"], object)

    def align(self, text: str | None) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """Tokens of A and of B, links, groups as text, distinct links as pairs and how often each occurs."""
        if not text:
            return 0, 0, 0, "", _NONE, _NONE
        ids_a, ids_b = self.a.encode_ordinary(f" {text}"), self.b.encode(text, num_threads=1)
        spelt = f" {text}".encode("utf-8", "surrogatepass")
        if b"".join([self.bytes_a[i] for i in ids_a]) != spelt or b"".join([self.bytes_b[i] for i in ids_b]) != spelt:
            return 0, 0, 0, "", _NONE, _NONE
        a, b = np.array(ids_a), np.array(ids_b)
        at_a, at_b = map(np.array, merged(np.cumsum(self.lengths_a[a]).tolist(), np.cumsum(self.lengths_b[b]).tolist()))
        pairs, times = np.unique(a[at_a] << 32 | b[at_b], return_counts=True)
        return len(a), len(b), len(at_a), self.shown(a, b, at_a, at_b), pairs, times

    def shown(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: a group's ids of A follow those of B of the groups before it, and its ids of B follow its own of A."""
        out = np.empty(len(a) + len(b), object)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a] = last_b[at_b] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        out[np.arange(len(a)) + np.concatenate(([0], at_b + 1))[group_a]] = self.shown_a[2 * a + last_a]
        out[np.arange(len(b)) + (at_a + 1)[group_b]] = self.shown_b[2 * b + last_b]
        return "".join(out.tolist())[:-1]


_HELD: dict[int, Aligner] = {}


def align(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times) of each row of ``docs``.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``; ``pairs`` are the distinct links, A's id in the upper 32 bits and B's in the lower, and
    ``times`` how often each occurs.
    """
    spark = docs.sparkSession
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f, open(pieces or piece_vocabulary(), "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))  # of the vocabularies' size, not the data's
    bound_batches(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = None
        for frame in frames:
            if aligner is None:
                key = hash(files.value)
                if key not in _HELD:
                    _HELD.clear()
                    _HELD[key] = Aligner(*files.value)
                aligner = _HELD[key]
            rows = [aligner.align(t) for t in frame["text"]]
            n_a, n_b, n_links, groups, pairs, times = zip(*rows) if rows else [[]] * 6
            yield pd.DataFrame({"id": frame["id"], "n_a": n_a, "n_b": n_b, "n_groups": n_links, "n_links": n_links, "groups": groups, "pairs": pairs, "times": times})

    schema = "id string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>"
    found = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(run, schema)
    return found.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), *found.columns[1:])


def links(aligned: DataFrame) -> DataFrame:
    """(row, pair, times), a row for each document and distinct link of ``aligned``, which has ``row``."""
    return aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), "link.times")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, count, rows, best_a, best_b) of ``links``: how many links hold the pair, in how many rows, and the largest count of each side's id."""
    counts = durable(found.groupBy("pair").agg(F.sum("times").alias("count"), F.count("*").alias("rows")))
    counts = counts.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))})
    for side in ("a", "b"):
        counts = counts.join(counts.groupBy(side).agg(F.max("count").alias(f"best_{side}")), side)
    return durable(counts.select("pair", "count", "rows", "best_a", "best_b"))


def scored(aligned: DataFrame, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """``aligned`` (a table with ``row``, unique) plus n_best_a, n_best (links whose count is their A or B id's highest) and count_sum.

    Up to ``sent_pairs`` distinct pairs are sent to all tasks, so that links stay where they are; more are joined by shuffle, with
    pairs that many rows have dealt over several tasks.
    """
    found = links(aligned)
    counts = pair_counts(found)
    if counts.count() <= sent_pairs:
        both = found.join(F.broadcast(counts.drop("rows")), "pair")
    else:
        both = join_hot(found, counts, "pair", "rows")
    best = lambda side: F.sum(F.when(F.col("count") == F.col(f"best_{side}"), F.col("times")).otherwise(0))
    sums = both.groupBy("row").agg(best("a").alias("n_best_a"), best("b").alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    added = ("n_best_a", "n_best", "count_sum")
    joined = aligned.join(sums, "row", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in added})


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    rows = align(docs).withColumn("row", F.monotonically_increasing_id())
    aligned = written(rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"))
    return scored(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_best_a")
