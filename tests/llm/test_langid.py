import zlib
from collections import Counter

import numpy as np
import pytest

from vicinal.llm import bytegru, langid

WORDS = {"en": "the of and thing with there house", "fr": "le élan où être château garçon être", "de": "der über straße schön mädchen größe"}


def corpus(spark, n=150):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(5, 60))), lang, "s", "x"))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score string")


def test_held_out_accuracy_and_no_leaks(spark):
    docs = corpus(spark)
    net = langid.fit(docs, steps=80)
    assert net.labels == ["de", "en", "fr"]
    out = langid.predict(docs.select("doc_id", "lang", langid.held_out(docs["doc_id"]).alias("held_out"), "text"), net).collect()
    held = [r for r in out if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(150) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out)
    assert not {r["doc_id"] for r in held} & {int(i) for i in _learnt(docs)}


def _learnt(docs):
    from pyspark.sql import functions as F

    rows = docs.filter(~langid.held_out(F.col("doc_id")))
    crops = {c.decode() for _, c in langid.training_crops(docs)}
    assert crops
    return [r["doc_id"] for r in rows.collect()]


def test_messy_documents(spark, messy, messy_rows, no_docs):
    net = langid.fit(corpus(spark), steps=5)
    out = {str(r["doc_id"]): r for r in langid.predict(messy.select("doc_id", "text", "lang"), net).collect()}
    for i in (0, 1, 2, 16):
        assert (out[str(i)]["lang_pred"], out[str(i)]["score"]) == ("und", 0.0)
    assert out["13"]["lang_pred"] in net.labels
    kept = langid.accepted(messy, net, 0.0)
    assert kept.columns == messy.columns and kept.count() == sum(any(c.isalpha() for c in r[1] or "") for r in messy_rows)
    assert langid.fit(no_docs) is None
    assert {r["lang_pred"] for r in langid.predict(messy.select("doc_id", "text"), None).collect()} == {"und"}
    assert langid.predict(no_docs.select("doc_id", "text"), net).collect() == []


def test_gradients():
    """Backpropagation against differences."""
    rng = np.random.default_rng(0)
    net = bytegru.new_net(["a", "b"], 3, 1)
    for name in ("table", "recur", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x, y = rng.integers(0, 256, (5, 4)).astype(np.uint8), np.array([0, 1, 1, 0])
    _, grads = bytegru._gradients(net, x, y)
    for p, g in zip(net.params(), grads):
        flat = p.reshape(-1)
        for at in np.unique(np.concatenate([np.flatnonzero(np.abs(g.reshape(-1)) > 1e-4)[:5], [0]])):
            old = flat[at]
            flat[at] = old + 1e-3
            up, _ = bytegru._gradients(net, x, y)
            flat[at] = old - 1e-3
            down, _ = bytegru._gradients(net, x, y)
            flat[at] = old
            assert g.reshape(-1)[at] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_pooling_covers_every_position():
    net = bytegru.new_net(["a", "b"], 4, 1)
    texts = [b"", b"x", b"hello world" * 40, b"y" * bytegru.SEGMENT]
    off = np.cumsum([0, *map(len, texts)])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    p = bytegru.pool(net, raw, off, batch=3)
    assert p[0].sum() == 0 and np.allclose(p[1:].sum(axis=1), 1, atol=1e-5)
    alone = bytegru.pool(net, np.frombuffer(texts[2], np.uint8), np.array([0, len(texts[2])]))
    assert np.allclose(alone[0], p[2], atol=1e-5)


def test_every_label_is_learnt(spark):
    rows = [(10 * i + j, f"text {i} in words {j}", f"l{i:03}") for i in range(100) for j in range(10)]
    crops = langid.training_crops(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 5)
    assert len({lang for lang, _ in crops}) == 100
    assert max(sum(1 for lang, _ in crops if lang == f"l{i:03}") for i in range(100)) <= 10 * langid.CROPS


def test_the_sample_is_bounded(spark):
    """Neither one document repeated over and over nor many languages draw more than the bounds."""
    rows = [(1, "ever the same text", "en")] * 5000 + [(100 + i, f"text {i}", "en") for i in range(3000)] + [(9000 + i, f"texte {i}", "fr") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    drawn = Counter(lang for lang, _ in langid.training_crops(docs, 40))
    assert drawn["en"] <= 40 * langid.CROPS and drawn["fr"] >= 30 * langid.CROPS
    assert sum(Counter(lang for lang, _ in langid.training_crops(docs, 40, most=20)).values()) <= 20 * langid.CROPS


def test_forward_pass_is_the_recurrence():
    """Pooled probabilities against a plain loop over bytes."""
    net = bytegru.new_net(["a", "b", "c"], 4, 2)
    text = b"some bytes \xc3\xa9 and more" * 7
    n, sigmoid = 4, lambda x: 1 / (1 + np.exp(-x))
    total = np.zeros(3)
    for at in range(0, len(text), bytegru.SEGMENT):
        part, states = text[at : at + bytegru.SEGMENT], []
        for way in (0, 1):
            h, mine = np.zeros(n), {}
            for t in range(len(part)) if way == 0 else range(len(part) - 1, -1, -1):
                a, u = net.table[way][:, part[t]], net.recur[way] @ h
                r, z = sigmoid(a[:n] + u[:n]), sigmoid(a[n : 2 * n] + u[n : 2 * n])
                c = np.tanh(a[2 * n :] + r * (u[2 * n :] + net.bias[way]))
                h = mine[t] = z * h + (1 - z) * c
            states.append(mine)
        for t in range(len(part)):
            logits = net.out[0] @ states[0][t] + net.out[1] @ states[1][t] + net.out_bias
            total += np.exp(logits) / np.exp(logits).sum()
    got = bytegru.pool(net, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert np.allclose(got[0], total / len(text), atol=1e-4)
