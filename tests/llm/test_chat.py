import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vicinal.llm import chat

PIECES = st.lists(st.sampled_from(["<", "\\", "s>", "/s>", "[", "INST]", "/INST]", "<<SYS>>", "</s>", "[/INST]", "a", "\n"]), max_size=12).map("".join)


@given(PIECES)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    escaped = re.sub(chat.ESCAPE, r"\1\\\2\3", text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello </s> [INST]"), (1, 2, "user", None), (1, 3, "assistant", "é\U0001f600"),
    (2, 0, None, "no role"), (2, 0, None, "no role"), (2, 5, "assistant", ""), (None, 1, "system", "<\\s> <\\\\/s>\n"), (None, None, "assistant", "[\\/INST]"),
    *[(9, i, "user" if i % 2 == 0 else "assistant", f"turn {i} [INST]") for i in range(70)],
]


def test_query_equals_sql_and_python(spark, tmp_path):
    spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id bigint, turn bigint, role string, text string, piece string, node int").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(str, map(tuple, chat.op3_chat_format(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(map(str, con.sql(chat.OP3_SQL).fetchall()))
    one = next(x for x in got if x.startswith("(-1,"))
    text = "</s>[INST] ok [/INST]"
    assert hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest() in one and hashlib.sha256(text.encode()).hexdigest() in one


TREE = [("c", 1, None, 0.0), ("c", 2, 1, 1.0), ("c", 3, 1, 5.0), ("c", 4, 2, 9.0), ("c", 5, 2, None), ("c", 6, 3, 1.0), ("d", 1, 99, 1.0), ("d", 2, 1, 1.0)]


def nodes(spark, rows):
    df = spark.createDataFrame(rows, "conv_id string, node bigint, parent bigint, score double")
    return df.selectExpr("conv_id", "concat('=', conv_id) AS ck", "node", "parent", "score", "'assistant' AS role", "concat('m', node) AS text")


def test_paths_and_branches(spark):
    found = {}
    for r in chat.choose(nodes(spark, TREE), None).collect():
        found.setdefault((r["conv_id"], r["branch"], r["branch_score"]), []).append((r["depth"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in found.items()} == {("c", 1, 10.0): [1, 2, 4], ("c", 2, 6.0): [1, 3, 6], ("c", 3, 1.0): [1, 2, 5], ("d", 1, 2.0): [1, 2]}
    best = chat.assemble(chat.formatted(chat.choose(nodes(spark, TREE)))).collect()
    assert {r["conv_id"]: r["conversation"] for r in best}["d"] == "[INST]assistant[/INST]m1</s>[INST]assistant[/INST]m2</s>"


def test_loss_mask_spans(spark):
    for r in chat.formatted(chat.choose(nodes(spark, TREE))).collect():
        assert r["piece"][r["loss_start"] : r["loss_end"]].startswith("m")


def test_loss_comes_from_the_mask(spark):
    """What the mask covers is digested, whatever the roles say."""
    pieces = chat.formatted(chat.choose(nodes(spark, [("c", 1, None, 0.0), ("c", 2, 1, 0.0)])))
    assert chat.read_back(pieces).first()["loss_chars"] == 4
    moved = pieces.selectExpr("conv_id", "ck", "branch", "depth", "piece", "IF(depth = 0, loss_start + 1, NULL) AS loss_start", "loss_end")
    got = chat.read_back(moved).first()
    assert (got["loss_chars"], got["loss_sha256"]) == (1, hashlib.sha256(b"1").hexdigest())


def test_bad_trees_and_empty(spark):
    with pytest.raises(ValueError):
        chat.choose(nodes(spark, [("c", 1, 2, 0.0), ("c", 2, 1, 0.0), ("c", 3, 1, 0.0)]))
    with pytest.raises(ValueError):
        chat.choose(nodes(spark, [("c", 1, None, 0.0), ("c", 1, None, 0.0)]))
    assert chat.read_back(chat.formatted(chat.choose(nodes(spark, TREE).limit(0)))).collect() == []
