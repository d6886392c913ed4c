import math
import random
from collections import Counter

import numpy as np
import pytest

from vicinal.llm import bytelm, quality


def discounts(counts):
    n = [sum(1 for c in counts if c == i) for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    d = [i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else i * 0.5 for i in (1, 2, 3)]
    return [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]


def slow_model(texts, order):
    """Interpolated modified Kneser-Ney by its definition, over tuples of bytes."""
    cut = lambda t: [0] * (order - 1) + list(t.encode())
    counts = {order: Counter(tuple(s[i : i + order]) for s in map(cut, texts) for i in range(len(s) - order + 1))}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    off = {n: discounts(c.values()) for n, c in counts.items()}

    def p(gram):
        n = len(gram)
        if n == 0:
            return 1 / 256
        own = {g: v for g, v in counts[n].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total = sum(own.values())
        less = lambda v: off[n][min(v, 3) - 1]
        return ((own[gram] - less(own[gram])) if gram in own else 0) / total + sum(map(less, own.values())) / total * p(gram[1:])

    def perplexity(t):
        s = cut(t)
        bits = [math.log2(p(tuple(s[i : i + order]))) for i in range(len(s) - order + 1)]
        return 2 ** (-sum(bits) / len(bits))

    return perplexity


@pytest.mark.parametrize("order", [1, 3, 5])
def test_perplexities_equal_the_definition(spark, order, monkeypatch):
    monkeypatch.setattr(bytelm, "BUCKET_BYTES", 40)
    monkeypatch.setattr(bytelm, "PIECE_BYTES", 13)
    texts = ["the cat sat", "the hat, the bat. THE END!", "a cat and a hat 123", "Ünïcödé\0 的", "the cat sat"]
    docs = [(i, "en", t) for i, t in enumerate(texts)] + [(i, "fr", t) for i, t in enumerate(["a bat sat", "zzz", "", None, "the end " * 50], 10)]
    df = spark.createDataFrame([*docs, docs[1], (None, "en", "cat")], "doc_id bigint, lang string, text string").repartition(2)
    trusted = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 99)], "doc_id bigint")
    got = sorted(((str(r["doc_id"]), r["lang"], r["perplexity"]) for r in bytelm.perplexities(df, trusted, order).collect()), key=str)
    slow = slow_model([*texts[:4], texts[1]], order)
    want = sorted(((str(d), lang, slow(t)) for d, lang, t in [*docs, docs[1], (None, "en", "cat")] if t), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], rel=1e-9)


def test_gram_codes_and_blocks(monkeypatch):
    import zlib

    code, owner = bytelm.gram_codes([b"\0abc", b"\0", b"\0d"], 2)
    assert code.tolist() == [97, 97 << 8 | 98, 98 << 8 | 99, 100] and owner.tolist() == [0, 0, 0, 2]
    monkeypatch.setattr(bytelm, "_BLOCK", 4)
    assert list(bytelm._blocks([zlib.compress(x) for x in (b"abc", b"de", b"f")])) == [(0, [b"abc", b"de"]), (2, [b"f"])]


def test_pieces_have_the_grams_of_the_text(monkeypatch):
    text = bytes(range(1, 200)) * 3
    whole = bytelm.gram_codes(bytelm.cut(text))[0]
    monkeypatch.setattr(bytelm, "PIECE_BYTES", 50)
    pieces = bytelm.cut(text)
    assert len(pieces) == 12 and bytelm.gram_codes(pieces)[0].tolist() == whole.tolist() and bytelm.cut(b"") == []


def test_long_and_often_repeated_ids_are_trusted_in_all_places(spark, monkeypatch):
    monkeypatch.setattr(bytelm, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(bytelm, "PIECE_BYTES", 500)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs = [(1, "en", " ".join(word() for _ in range(4000))), *[(2, "en", " ".join(word() for _ in range(60))) for _ in range(300)], (3, "en", word())]
    df = spark.createDataFrame(docs, "doc_id bigint, lang string, text string")
    texts, labels = bytelm.bucketed(df, spark.createDataFrame([(1,), (2,)], "doc_id bigint"))
    got = {r["g"]: r["c"] for r in bytelm.count_grams(texts, labels).groupBy("g").agg({"c": "sum"}).toDF("g", "c").filter("c > 0").collect()}
    assert got == Counter(bytelm.gram_codes([x for d, _, t in docs if d < 3 for x in bytelm.cut(t.encode())])[0].tolist())
    sizes = [r["b"] for r in texts.groupBy("p").agg({"z": "count"}).toDF("p", "b").collect()]
    assert len(sizes) > 30 and max(sizes) < 30  # pieces of 500 bytes; 4 a bucket on average


def test_memory_of_a_bucket_does_not_follow_the_length_of_texts(monkeypatch):
    """A bucket holds the same bytes whatever its texts, and distinct grams are merged as they come."""
    import tracemalloc
    import zlib

    import pyarrow as pa

    monkeypatch.setattr(bytelm, "PIECE_BYTES", 1 << 17)
    rng, peaks = np.random.default_rng(0), []
    for words in (200, 2_000, 20_000):
        packed, held = [], 0
        while held < 4 << 20:
            text = rng.integers(97, 123, words * 7, np.uint8).tobytes()
            packed += [zlib.compress(x, 1) for x in bytelm.cut(text)]
            held += len(text)
        texts = pa.table({"p": pa.array([0] * len(packed), pa.int32()), "doc_id": pa.array(range(len(packed)), pa.int64()), "z": pa.array(packed, pa.binary())})
        tracemalloc.start()
        out = bytelm.bucket_grams(texts, pa.table({"doc_id": pa.array([], pa.int64())}))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert out.num_rows > 3 << 20
    assert max(peaks) < 1.2 * min(peaks) and max(peaks) < 80 * (4 << 20), peaks


def test_shuffled_words_score_worse(spark):
    """Five bytes see the end of one word and the start of the next: the order of words counts, if less than the words."""
    rng = random.Random(6)
    follows = {w: rng.sample(range(60), 3) for w in range(60)}
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6))) for _ in range(60)]

    def clean():
        at, out = rng.randrange(60), []
        for _ in range(80):
            out.append(words[at])
            at = rng.choice(follows[at])
        return out

    texts = [clean() for _ in range(400)]
    rows = [(i, "en", " ".join(t)) for i, t in enumerate(texts)] + [(1000 + i, "en", " ".join(rng.sample(t, len(t)))) for i, t in enumerate(texts) if i >= 300]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    got = {r["doc_id"]: r["perplexity"] for r in bytelm.perplexities(df, df.filter("doc_id < 300").select("doc_id")).collect()}
    worse = np.mean([got[1000 + i] > got[i] for i in range(300, 400)])
    assert worse > 0.95


def test_tables_grow_with_the_text(spark):
    docs = spark.createDataFrame([(i, "en", " ".join(f"{random.Random(i).getrandbits(60):x}" for _ in range(1)) * 3) for i in range(300)], "doc_id bigint, lang string, text string")
    small, all_ = (bytelm.count_grams(*bytelm.bucketed(d, d.select("doc_id"))).filter("c > 0").select("g").distinct().count() for d in (docs.filter("doc_id < 30"), docs))
    assert all_ > 8 * small


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(4)
    clean = lambda: " ".join(rng.choice("the of and there water people little house small words".split()) for _ in range(60)).capitalize() + "."
    junk = lambda: "".join(rng.choice("#$%&*!|ABCXYZ 09") for _ in range(200))
    rows = [(i, clean() if i % 4 else junk(), "en" if i % 3 else None) for i in range(1000)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(500)]
    out = quality.classify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert len(out) == 1000
    assert not any(r["kept"] for r in out if r["doc_id"] % 4 == 0)
    assert np.mean([r["kept"] for r in out if r["doc_id"] % 4]) > 0.95


def test_thresholds_equal_brute_force(spark):
    """Thresholds are quantiles of held-out trusted documents, by language where there are enough; kept follows from them."""
    rng = random.Random(9)
    words = {"en": "the of and with there", "fr": "le la être avec été", "xx": "qq zz"}
    langs = ["en"] * 250 + ["fr"] * 250 + ["xx"] * 8
    rows = [(i, " ".join(rng.choice(words[lang].split() + [str(rng.random())]) for _ in range(rng.randint(3, 30))), lang) for i, lang in enumerate(langs)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, len(rows), 2)]
    out = quality.classify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), 0.9, 15, 3).collect()
    ids = spark.createDataFrame([(i,) for i in range(len(rows))], "doc_id bigint").select("doc_id", quality.held_out(quality.F.col("doc_id")).alias("held"))
    held = {r["doc_id"] for r in ids.filter("held").collect()}
    trusted = {i for i, q, _ in labels if q}
    slow = slow_model([t for i, t, _ in rows if i in trusted - held], 3)
    score = {i: slow(t) for i, t, _ in rows}
    quantile = lambda v: sorted(v)[max(0, math.ceil(0.9 * len(v)) - 1)]
    of = {lang: [score[i] for i, _, x in rows if x == lang and i in trusted & held] for lang in words}
    overall = quantile([v for x in of.values() for v in x])
    assert len(of["en"]) >= 15 and len(of["fr"]) >= 15
    for r in out:
        want = quantile(of[r["lang"]]) if len(of[r["lang"]]) >= 15 else overall
        assert r["perplexity"] == pytest.approx(score[r["doc_id"]], rel=1e-9) and r["threshold"] == pytest.approx(want, rel=1e-9)
        assert r["kept"] == (r["perplexity"] <= r["threshold"])


def test_messy_documents(spark, messy, messy_rows, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (8, 1, None), (8, 1, 0), (9, 1, 0), (9, 0, 0), (None, 1, 0), (10, None, None)], "doc_id bigint, quality int, toxic int")
    assert sorted(r["doc_id"] for r in quality.trusted_ids(labels).collect()) == [5, 8]
    out = quality.classify(messy.select("doc_id", "text", "lang"), labels).collect()
    assert len(out) == len(messy_rows)
    assert all((r["perplexity"] is None) == (r["doc_id"] in (0, 1)) for r in out)
    assert all(not r["kept"] for r in out if r["doc_id"] in (0, 1))
    unlabelled = quality.classify(messy.select("doc_id", "text", "lang"), labels.limit(0)).collect()
    assert all(r["kept"] == (r["doc_id"] not in (0, 1)) for r in unlabelled) and all(math.isinf(r["threshold"]) for r in unlabelled)
    assert all(r["perplexity"] is None or r["perplexity"] == pytest.approx(256) for r in unlabelled)
    assert quality.classify(no_docs.select("doc_id", "text", "lang"), labels).collect() == []


def test_unlabelled_clean_texts_are_judged_as_trusted_ones(spark):
    """A model that judged by the texts it has read would reject clean texts it has not read."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en") for i in range(600)]
    labels = [(i, 1, 0) for i in range(400)]
    out = quality.classify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert np.mean([r["kept"] for r in out if r["doc_id"] >= 400]) > 0.9
