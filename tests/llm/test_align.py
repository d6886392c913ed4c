import hashlib
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vicinal.llm import align
from vicinal.llm.bpe import byte_alphabet, default_vocabulary

ODD = ["<|endoftext|> <s> </s> <unk> <0x41>", "  two  spaces \n\n and\tmore ", "a▁b", "naïve é é 漢字漢字 \U0001f600‍\U0001f469", " ", "\n", "\x00\x1c", "it's 12345.678!!!", "x" * 5000, "﻿᠎  y", "퟿ \U0010ffff", "ﬁ ①"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(default_vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.piece_vocabulary())


@pytest.fixture(scope="module")
def aligner():
    with open(default_vocabulary(), encoding="utf-8") as f, open(align.piece_vocabulary(), "rb") as g:
        return align.Aligner(f.read(), g.read())


def slow(libraries, text):
    """(n_a, n_b, groups as lists, links) with both libraries and sets of ends."""
    if not text:
        return 0, 0, [], []
    a, b = libraries
    alphabet = byte_alphabet()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    names = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, names)]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return 0, 0, [], []
    end_a, end_b = ({e: i for i, e in enumerate(accumulate(map(len, pieces)))} for pieces in (bytes_a, bytes_b))
    both = sorted(end_a.keys() & end_b.keys())
    groups, i, j = [], 0, 0
    for e in both:
        groups.append((ids_a[i : end_a[e] + 1], ids_b[j : end_b[e] + 1]))
        i, j = end_a[e] + 1, end_b[e] + 1
    return len(ids_a), len(ids_b), groups, [(ids_a[end_a[e]], ids_b[end_b[e]]) for e in both]


def shown(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def same(aligner, libraries, text):
    n_a, n_b, n, groups, pairs, times = aligner.align(text)
    want_a, want_b, want, links = slow(libraries, text)
    assert (n_a, n_b, n, groups) == (want_a, want_b, len(want), shown(want))
    assert {(p >> 32, p & 0xFFFFFFFF): t for p, t in zip(pairs.tolist(), times.tolist())} == Counter(links)


@pytest.mark.parametrize("text", [None, "", *ODD])
def test_odd_texts(aligner, libraries, text):
    same(aligner, libraries, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'0a▁é漢<>|"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(aligner, libraries, text):
    same(aligner, libraries, text)


def test_first_encoder_is_the_librarys(aligner, libraries):
    """Every code point between letters, digits, marks and spaces."""
    texts = [f"a{chr(c)}b1{chr(c)} {chr(c)}!{chr(c)}  x" for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        assert [e.ids for e in libraries[0].encode_batch(part, add_special_tokens=False)] == [aligner.a.encode_ordinary(t) for t in part]


def wanted(libraries, rows):
    """Sorted results of (doc_id, text) rows by brute force."""
    found = [(d, *slow(libraries, t)) for d, t in rows]
    count = Counter(link for *_, links in found for link in links)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    digest = lambda g: hashlib.sha256(shown(g).encode()).hexdigest() if g else ""
    return sorted((str(d), n_a, n_b, len(g), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest(g)) for d, n_a, n_b, g, links in found)


COLUMNS = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"


def shown_rows(df):
    return sorted((str(r["doc_id"]), *[r[c] for c in COLUMNS[1:]]) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("sent_pairs", [align.SENT_PAIRS, 0])
def test_counts(spark, messy, libraries, sent_pairs):
    """Nulls, repeated rows and ids, odd and long texts; the table of pairs sent and joined by shuffle."""
    odd = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)] + [(2**60 + 1, "one id beyond a double")], "doc_id bigint, text string")
    docs = messy.select("doc_id", "text").unionByName(odd)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = align.written(align.align(docs).withColumn("row", F.monotonically_increasing_id()).withColumn("groups_sha256", digest))
    out = align.scored(aligned, sent_pairs)
    assert shown_rows(out) == wanted(libraries, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_query(spark, libraries):
    sf = "/root/testdata/sf0.001"
    out = align.op11_token_alignment(spark, sf)
    assert dict(out.dtypes)["n_best"] == "bigint" and tuple(out.columns[: len(COLUMNS)]) == COLUMNS
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows.sort()
    assert shown_rows(out) == wanted(libraries, rows)


def test_empty(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert align.op11_token_alignment(spark, str(tmp_path)).collect() == []
