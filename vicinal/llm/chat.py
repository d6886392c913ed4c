"""Chat formatting of reply trees.

Messages hang under their parents. Iterative self-joins with doubling pointers enumerate every root-to-leaf path (a path of n
messages takes log2 n rounds), branches are ranked by the sum of their messages' scores, and each chosen path is written as one
conversation. A turn is written ``[INST]role[/INST]text</s>``; control strings inside roles and texts are escaped by a backslash
after their first character (one more where backslashes already stand there), which the reader takes away again.

The formatted conversation is kept as one piece per turn, in order, so that a conversation of any length is written, read back
and digested as a stream; ``assemble`` joins the pieces of conversations that are known to fit a row.

Nulls: a null text or role is empty; a null conversation id is a conversation of its own; messages whose parent is missing start
a tree; a null score counts 0. Equal branch scores are ordered by leaf. Repeated rows of a table of turns are turns of their own,
ordered by turn, role and text; repeated message ids raise an error, as does a reply cycle. Empty tables give no rows; very long
texts are turns of one piece. Further columns of a table of turns, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.common import durable

#: The strings that the template or its relatives give a meaning: <s> </s> [INST] [/INST] <<SYS>> <</SYS>>
_CONTROL = r"/?s>|/?INST\]|</?SYS>>"
ESCAPE = rf"([<\[])(\\*)({_CONTROL})"
UNESCAPE = rf"([<\[])\\(\\*)({_CONTROL})"
_UNESCAPE = re.compile(UNESCAPE)
_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _key(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def chains(turns: DataFrame) -> DataFrame:
    """Reply trees of a table of turns (conv_id, turn, role, text): every row answers the one before."""
    rows = turns.select("conv_id", _key(F.col("conv_id")).alias("ck"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(Window.partitionBy("ck").orderBy("turn", "role", "text")).cast("bigint"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("conv_id", "ck", "node", parent.alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def paths(nodes: DataFrame) -> DataFrame:
    """(ck, leaf, node, above): every message of every root-to-leaf path, ``above`` messages below it on the path.

    ``nodes`` has ck, node, parent. Round i joins the paths found so far with the pointers that lead 2**i messages up.
    """
    known = nodes.select("ck", F.col("node").alias("parent"))
    up = nodes.filter("parent is not null").select("ck", "node", "parent").join(known, ["ck", "parent"], "left_semi").select("ck", "node", F.col("parent").alias("up"))
    up = durable(up)
    leaves = nodes.select("ck", "node").join(up.select("ck", F.col("up").alias("node")).distinct(), ["ck", "node"], "left_anti")
    found = durable(leaves.select("ck", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("below")))
    largest = nodes.groupBy("ck").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while not up.isEmpty():
        if step > largest:
            raise ValueError("a reply cycle: some messages have no root")
        more = found.join(up, ["ck", "node"]).select("ck", "leaf", F.col("up").alias("node"), (F.col("below") + step).alias("below"))
        found = durable(found.unionAll(more))
        further = up.select("ck", F.col("node").alias("up"), F.col("up").alias("top"))
        up = durable(up.join(further, ["ck", "up"]).select("ck", "node", F.col("top").alias("up")))
        step *= 2
    return found


def choose(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """Messages of the ``branches`` best paths of each conversation (None: all): nodes' columns, branch (1 is best), depth (0 is the root)."""
    if nodes.groupBy("ck", "node").count().filter("count > 1").limit(1).count():
        raise ValueError("message ids repeat within a conversation")
    scored = paths(nodes.select("ck", "node", "parent")).join(nodes.select("ck", "node", F.coalesce("score", F.lit(0.0)).alias("score")), ["ck", "node"])
    ranked = scored.groupBy("ck", "leaf").agg(F.sum("score").alias("branch_score"), F.max("below").alias("length"))
    ranked = ranked.withColumn("branch", F.row_number().over(Window.partitionBy("ck").orderBy(F.desc("branch_score"), "leaf")).cast("bigint"))
    if branches is not None:
        ranked = ranked.filter(F.col("branch") <= branches)
    on_path = scored.select("ck", "leaf", "node", "below").join(ranked, ["ck", "leaf"])
    return nodes.join(on_path.select("ck", "node", "branch", "branch_score", (F.col("length") - F.col("below")).alias("depth")), ["ck", "node"])


def formatted(chosen: DataFrame) -> DataFrame:
    """One formatted piece per turn: conv_id, ck, branch, depth, piece, and the loss mask's span inside the piece (code points)."""
    head = F.concat(F.lit("[INST]"), escape("role"), F.lit("[/INST]"))
    piece = F.concat(head, escape("text"), F.lit("</s>"))
    trained = F.col("role") == TRAINED_ROLE
    start = F.when(trained, F.length(head))
    return chosen.select("conv_id", "ck", "branch", "depth", piece.alias("piece"), start.alias("loss_start"), F.when(trained, F.length(head) + F.length(escape("text"))).alias("loss_end"))


def assemble(pieces: DataFrame) -> DataFrame:
    """(conv_id, branch, conversation): whole conversations as strings; for conversations that fit a row."""
    ordered = F.sort_array(F.collect_list(F.struct("depth", "piece")))
    return pieces.groupBy("ck", "branch").agg(F.first("conv_id").alias("conv_id"), F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("conversation")).drop("ck")


class _Reader:
    """Reads one conversation's pieces back, as they come."""

    def __init__(self) -> None:
        self.rest, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, start: int | None, end: int | None) -> None:
        """``start`` and ``end`` bound what the loss mask covers in the piece; null covers nothing."""
        self.chars += len(piece)
        if start is not None:
            text = unescape(piece[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.rest += piece
        at = 0
        for turn in iter(lambda: _TURN.match(self.rest, at), None):
            at = turn.end()
            role, text = unescape(turn[1]), unescape(turn[2])
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        self.rest = self.rest[at:]

    def row(self) -> tuple:
        if self.rest:
            raise ValueError("a formatted conversation ends within a turn")
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, branch, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each formatted conversation.

    Turns are parsed from the text; the loss figures come from what the mask's spans cut out of it. A digest needs its
    conversation in order, so a conversation is streamed through one task, holding one turn at a time.
    """
    flow = pieces.select("ck", "branch", "depth", "conv_id", "piece", "loss_start", "loss_end").repartition("ck", "branch").sortWithinPartitions("ck", "branch", "depth")
    schema = flow.select("conv_id", "branch").withColumns({"n_turns": F.lit(0).cast("bigint"), "turns_sha256": F.lit(""), "loss_chars": F.lit(0).cast("bigint"), "loss_sha256": F.lit(""), "formatted_chars": F.lit(0).cast("bigint")}).schema
    kind = flow.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.name for f in schema])

        now, conv, reader, done = None, None, _Reader(), []
        for batch in batches:
            for ck, branch, c, piece, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6))):
                if (ck, branch) != now:
                    if now is not None:
                        done.append((conv, now[1], *reader.row()))
                    now, conv, reader = (ck, branch), c, _Reader()
                reader.feed(piece, start, end)
            if len(done) > 1000:
                yield out(done)
                done = []
        if now is not None:
            done.append((conv, now[1], *reader.row()))
        if done:
            yield out(done)

    return flow.mapInArrow(run, schema)


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return read_back(formatted(choose(durable(chains(turns.unionByName(own)))))).drop("branch")


OP3_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS r,
         regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') AS t
  FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(length('[INST]' || r || '[/INST]' || t || '</s>'))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
