import hashlib
import random

import pytest

from vicinal.llm import substring
from vicinal.llm.tokenruns import fragments, word_hashes


def prose(rng, n, letters):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def brute(rows, window):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((str(d), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def shown(rows):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in rows)


def test_messy_documents(messy, messy_rows):
    got = shown(substring._cut_texts(messy.select("doc_id", "text"), 50, 16, digest=True).collect())
    want = sorted((d, n, g, hashlib.sha256(k).hexdigest()) for d, n, g, k in brute([(r[0], r[1]) for r in messy_rows], 50))
    assert got == want
    assert sum(g for _, _, g, _ in got) > 100


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh"])
def test_branching_and_periodic_texts(spark, letters):
    rng = random.Random(len(letters))
    rows = []
    for _ in range(60):
        words = []
        while len(words) < rng.choice([0, 3, 10, 40, 80]):
            if rows and rng.random() < 0.5:
                src = rng.choice(rows)[1].split()
                at = rng.randint(0, max(0, len(src) - 1))
                words += src[at : at + rng.randint(1, 30)]
            else:
                words += [rng.choice(letters) for _ in range(5)]
        rows.append((rng.randint(0, 40), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = shown(substring._cut_texts(df, 6, 3, digest=True).collect())
    assert got == sorted((d, n, g, hashlib.sha256(k).hexdigest()) for d, n, g, k in brute(rows, 6))


def test_texts_and_columns_are_kept(messy, messy_rows, no_docs):
    out = substring.dedup_substrings(messy)
    assert out.columns == messy.columns
    got = out.collect()
    assert len(got) == len(messy_rows)
    cut = [r for r in got if r["doc_id"] == 6]
    assert all(len(r["text"].split()) == 50 and r["n_chars"] == len(r["text"]) for r in cut)
    assert [r["text"] for r in got if r["doc_id"] == 0] == [None]
    assert substring.dedup_substrings(no_docs).collect() == []


def test_every_edge_lies_in_one_fragment():
    rng = random.Random(2)
    import numpy as np

    words = word_hashes(np.frombuffer(prose(rng, 3000, "ab").encode(), np.uint8))
    f = fragments(words, 50, 16)
    covered = np.concatenate([np.arange(s, s + n) for s, n in zip(f.start, f.windows)])
    assert covered.tolist() == list(range(len(words) - 49))


def test_long_words_and_chunks(monkeypatch):
    import numpy as np

    from vicinal.llm import tokenruns

    raw = np.frombuffer(("x" * 500 + " " + "yy zz " * 300).encode(), np.uint8)
    whole = word_hashes(raw)
    monkeypatch.setattr(tokenruns, "CHUNK_BYTES", 64)
    assert (word_hashes(raw) == whole).all()
    f = fragments(whole, 20, 5)
    monkeypatch.setattr(tokenruns, "CHUNK_WORDS", 100)
    g = fragments(whole, 20, 5)
    assert int(f.windows.sum()) == int(g.windows.sum()) == len(whole) - 19


def test_recurring_phrases(spark):
    """Phrases repeated over and over, in texts that share parts of such stretches."""
    rng = random.Random(8)
    rows = []
    for d in range(40):
        words = [rng.choice("uvwxyz") for _ in range(rng.randint(0, 8))]
        for _ in range(rng.randint(1, 3)):
            words += rng.choice(["a b", "a b c", "p q r s t k l m n o", "a"]).split() * rng.randint(1, 12) + [rng.choice("uvwxyz") for _ in range(rng.randint(0, 4))]
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = shown(substring._cut_texts(df, 6, 3, digest=True).collect())
    assert got == sorted((d, n, g, hashlib.sha256(k).hexdigest()) for d, n, g, k in brute(rows, 6))


def thue_morse(n):
    bits = [0]
    while len(bits) < n:
        bits += [1 - b for b in bits]
    return bits[:n]


def test_words_that_polynomial_hashes_confuse(spark):
    """Words of Thue-Morse bytes and their opposites collide under any polynomial modulo 2**64; so do sequences of two words."""
    word = lambda bits, x, y: "".join(y if b else x for b in bits)
    odd = [word(thue_morse(n), x, y) for n in (1024, 2048) for x, y in (("a", "b"), ("b", "a"))]
    rng = random.Random(4)
    plain = prose(rng, 60, "cdefg").split()
    rows = [(i, " ".join([*plain[:30], odd[i % 4], *plain[30:]])) for i in range(8)]
    rows += [(20 + i, " ".join("uv"[b ^ i % 2] for b in thue_morse(1200))) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = shown(substring._cut_texts(df, 50, 16, digest=True).collect())
    assert got == sorted((d, n, g, hashlib.sha256(k).hexdigest()) for d, n, g, k in brute(rows, 50))


def test_many_repeated_rows_and_long_copies(spark):
    rng = random.Random(5)
    long, passage = prose(rng, 4000, "abcdefgh"), prose(rng, 120, "abcdefgh")
    rows = [(5, f"{prose(rng, 60, 'abcd')} {passage}")] * 1000 + [(1, passage), (9, long), (7, long), (8, f"{long} x"), (10, f"y {' '.join(long.split()[1000:3000])}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = substring.repeated_spans(substring._keyed(df), substring._keyed(df), 50, 16).collect()
    spans = {r["doc_id"]: r["spans"] for r in found}
    assert sum(s["n"] for s in spans[9]) == 3951 and len(spans[9]) < 20  # compacted paths, not single fragments
    assert len(spans[5]) < 80  # however often the row repeats
    got = shown(substring._cut_texts(df, 50, 16, digest=True).collect())
    assert got == sorted((d, n, g, hashlib.sha256(k).hexdigest()) for d, n, g, k in brute(rows, 50))


def test_source_digests_guard_the_cut():
    words = substring.words_of(b"a b c d e f")
    span = {"s": 1, "n": 2, "step": 1, "digest": substring._digest(words, 1, 2, 3)}
    assert substring._covered(words, [span], 3).tolist() == [False, True, True, True, True, False]
    assert not substring._covered(words, [span | {"digest": b"other"}], 3).any()
