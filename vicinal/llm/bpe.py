"""BPE encoding and decoding through distinct-word tables.

Texts are split into words by the tokenizer's own pattern. Each worker keeps a table of the distinct words it has met and their
ids; a word is encoded when the table meets it first, and the ids are joined back by position. Decoding joins ids with the
id-to-piece table (fixed size: one row per vocabulary entry). A table holds ``MAX_WORDS`` words at most, those not met for long
give way, and no text or word leaves its partition.

Null texts are empty: no ids, the digest of no bytes. Repeated rows are returned as often as they come in; an empty table gives
no rows; extra columns are ignored by the query and kept by ``encode``, which replaces those named as its results.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import map_slices

#: Distinct words held by one worker at most.
MAX_WORDS = 1 << 18
#: Words encoded as one running text.
RUN_WORDS = 8192
#: Words longer than this many characters are encoded but not held.
LONG_WORD = 64
#: Fixed values of the byte-level pre-tokenizer: its split pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


_TABLES: dict[str, WordTable] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of each byte: itself where printable in Latin-1, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordTable:
    """Distinct words and their ids, for one worker, in two generations of at most half of ``MAX_WORDS`` words (and a group's)."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(definition)
        self.model.no_truncation()
        self.model.no_padding()
        spec = json.loads(definition)
        alphabet = byte_alphabet()
        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for piece, i in vocabulary.items():
            self.pieces[i] = bytes(alphabet[c] for c in piece)
        for content, i in self.special.items():
            self.pieces[i] = content.encode()
        self.split = regex.compile(PATTERN).findall
        names = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(names) + ")").split if names else None
        # code points that newer Unicode tables class otherwise than the library's: its own splitter decides there
        self.beyond = regex.compile("[\u0558-\U0010ffff]").search
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _split(self, text: str) -> list[str]:
        if self.beyond(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return [text[i:j] for _, (i, j) in self.model.pre_tokenizer.pre_tokenize_str(text)]
        return self.split(text)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words. Words of a space and letters are encoded as running text, which splits into just them."""
        plain = [w for w in words if w[0] == " " and w[1:].isalpha()]
        known: dict[str, bytes] = {}
        for at in range(0, len(plain), RUN_WORDS):
            known |= self._learn_run(plain[at : at + RUN_WORDS])
        rest = [w for w in words if w not in known]
        found = self.model.encode_batch(rest, add_special_tokens=False) if rest else []
        return known | {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(rest, found)}

    def _learn_run(self, words: list[str]) -> dict[str, bytes]:
        found = self.model.encode("".join(words), add_special_tokens=False)
        owner = np.array(found.word_ids)
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        if len(starts) != len(words):  # split otherwise: one by one, then
            return {}
        raw, cuts = np.array(found.ids, "<u4").tobytes(), [*(starts * 4).tolist(), len(owner) * 4]
        return {w: raw[i:j] for w, i, j in zip(words, cuts, cuts[1:])}

    def _words(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self._split(text)
        out: list[str] = []
        for part in self.cut(text):
            out += [part] if part in self.special else self._split(part)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        group: list[list[str]] = []
        held = 0
        for text in texts:
            group.append(self._words(text or ""))
            held += len(text or "")
            if held > 1 << 20:
                out += self._encode(group)
                group, held = [], 0
        return out + self._encode(group)

    def _encode(self, group: list[list[str]]) -> list[bytes]:
        """Ids of texts given as words: look up, learn what is missing at once, fill it in by position."""
        look = self.table.get
        found = [list(map(look, words)) for words in group]
        gaps = [(words, ids, [i for i, x in enumerate(ids) if x is None]) for words, ids in zip(group, found) if None in ids]
        missing = {words[i] for words, _, at in gaps for i in at}
        known = {w: ids for w in missing if (ids := self.older.get(w)) is not None}
        known |= self._learn([w for w in missing if w not in known])
        for words, ids, at in gaps:
            for i in at:
                ids[i] = known[words[i]]
        self.table.update((w, ids) for w, ids in known.items() if len(w) <= LONG_WORD)
        if len(self.table) > MAX_WORDS // 2:  # words of the last generation come back when they are met again
            self.table, self.older = {}, self.table
        return [b"".join(ids) for ids in found]

    def decode(self, ids: bytes) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _tables(spark, path: str | None) -> Callable[[], WordTable]:
    """The vocabulary file is read on the driver and sent to the workers (its size is fixed, not that of the data)."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    return lambda: _held(definition.value)


def _held(definition: str) -> WordTable:
    """The worker's table for a vocabulary: tasks that run one after another in a worker share it."""
    if definition not in _TABLES:
        _TABLES.clear()
        _TABLES[definition] = WordTable(definition)
    return _TABLES[definition]


def _mapped(docs: DataFrame, make: Callable[[], WordTable], add: list[tuple[str, str, pa.DataType]], work: Callable[[WordTable, list], list[list]]) -> DataFrame:
    names = [name for name, _, _ in add]
    keep = [c for c in docs.columns if c not in ("text", *names)]
    schema = docs.select(*[F.col(f"`{c}`") for c in keep])
    for name, kind, _ in add:
        schema = schema.withColumn(name, F.lit(None).cast(kind))
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    types = [t for _, _, t in add]
    names = [*keep, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = words or make()
            columns = work(words, batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, columns, types)], names=names)

    return map_slices(frame, run, schema.schema)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with its text replaced by ids (array of int) and n_tokens."""

    def work(words: WordTable, texts: list) -> list[list]:
        ids = words.encode(texts)
        return [[np.frombuffer(x, "<i4") for x in ids], [len(x) // 4 for x in ids]]

    return _mapped(docs, _tables(docs.sparkSession, vocabulary), [("ids", "array<int>", pa.list_(pa.int32())), ("n_tokens", "bigint", pa.int64())], work)


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """As ``encode``, plus decoded_sha256: the digest of the text that the ids decode to."""

    def work(words: WordTable, texts: list) -> list[list]:
        ids = words.encode(texts)
        return [[np.frombuffer(x, "<i4") for x in ids], [len(x) // 4 for x in ids], [hashlib.sha256(words.decode(x).encode()).hexdigest() for x in ids]]

    return _mapped(docs, _tables(docs.sparkSession, vocabulary), [("ids", "array<int>", pa.list_(pa.int32())), ("n_tokens", "bigint", pa.int64()), ("decoded_sha256", "string", pa.string())], work)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with its text replaced by n_tokens, ids_sha256 and decoded_sha256 of a whole round trip."""

    def work(words: WordTable, texts: list) -> list[list]:
        ids = words.encode(texts)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return [[len(x) // 4 for x in ids], [sha(x) for x in ids], [sha(words.decode(x).encode()) for x in ids]]

    return _mapped(docs, _tables(docs.sparkSession, vocabulary), [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())], work)


def encode_joined(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, n_tokens) with one table of distinct words for the whole input, by shuffles.

    Every word of every text becomes a row, each distinct word of the input is encoded once, and the ids are joined back by
    position. It gives what ``encode`` gives and moves each word twice, which is many times the size of the texts; ``encode``
    keeps a table for each task instead.
    """
    from vicinal.llm.common import written

    make = _tables(docs.sparkSession, vocabulary)
    rows = written(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = table or make()
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = table._words(text)
                yield pa.RecordBatch.from_arrays([pa.array([rid] * len(words), pa.int64()), pa.array(range(len(words)), pa.int64()), pa.array(words, pa.string())], names=["rid", "pos", "word"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = table or make()
            words = batch.column(0).to_pylist()
            learnt = table._learn(words) if words else {}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(learnt[w], "<i4") for w in words], pa.list_(pa.int32()))], names=["word", "ids"])

    words = map_slices(rows.select("rid", "text"), split, "rid bigint, pos bigint, word string")
    distinct = words.select("word").distinct().mapInArrow(look_up, "word string, ids array<int>")
    placed = words.join(distinct, "word").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda x: x["ids"]))
    out = rows.select("rid", "doc_id").join(placed.select("rid", ids.alias("ids")), "rid", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return out.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"))


def decode_joined(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): ids joined with the id-to-piece table, whose rows are those of the vocabulary."""
    spark = encoded.sparkSession
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        pieces = WordTable(f.read()).pieces
    table = F.broadcast(spark.createDataFrame(list(enumerate(map(bytearray, pieces))), "id int, piece binary"))
    keyed = encoded.select("doc_id", F.xxhash64("ids").alias("h"), "ids").distinct()
    rows = keyed.select("doc_id", "h", F.posexplode("ids").alias("pos", "id")).join(table, "id")
    text = F.decode(F.aggregate(F.transform(F.sort_array(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x)), "UTF-8")
    found = rows.groupBy("doc_id", "h").agg(text.alias("text"))
    return encoded.select("doc_id", F.xxhash64("ids").alias("h")).join(found, ["doc_id", "h"], "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def op5_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs)
