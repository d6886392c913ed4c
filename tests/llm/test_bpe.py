import hashlib

import numpy as np
import pytest

from vicinal.llm import bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_query_equals_the_library(messy, messy_rows, library):
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(messy.select("doc_id", "text")).collect())
    want = []
    for r in messy_rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((str(r[0]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)


def test_columns_and_empty_tables(messy, no_docs, library):
    out = bpe.encode(messy)
    assert out.columns == [c for c in messy.columns if c not in ("text", "ids")] + ["ids", "n_tokens"]
    row = out.filter("doc_id = 4").first()
    assert row["ids"] == library.encode("two words", add_special_tokens=False).ids
    assert bpe.encode(no_docs).collect() == []


def test_word_table_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe, "MAX_WORDS", 10)
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        words = bpe.WordTable(f.read())
    texts = [f"word{i} and ñandú{i} {'z' * 100}" for i in range(50)] * 3
    for text in texts:
        assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(words.table) <= 10 and len(words.older) <= 20


def test_code_points_of_newer_unicode(library):
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        words = bpe.WordTable(f.read())
    texts = ["a՘b1", "x\U00010940y 2", "a࢏b", "漢字 かな　x", "é नमस्ते"]
    for text in texts:
        assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_joined_form_equals_the_tables(spark, messy, messy_rows, no_docs):
    docs = messy.filter("doc_id is not null")
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in df.collect())
    joined = bpe.encode_joined(docs)
    assert key(joined) == key(bpe.encode(docs))
    back = sorted((r["doc_id"], r["text"]) for r in bpe.decode_joined(joined).collect())
    assert back == sorted((r[0], r[1] or "") for r in messy_rows if r[0] is not None)
    assert bpe.encode_joined(no_docs).collect() == []
