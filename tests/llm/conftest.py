import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, `ids` int, `row` string, `key` int, `fp` int, `media` string"


def prose(rng: random.Random, n: int, letters: str = "abcdefghijklmnop") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls everywhere, empty and long texts, repeated rows, shared passages, near copies, odd characters."""
    rng = random.Random(5)
    passage, base = prose(rng, 70), prose(rng, 300)
    words = base.split()
    near = [" ".join(words[:i] + ["changed"] + words[i + 1 :]) for i in (3, 100, 250)]
    texts = [None, "", " \n\t", "one", "two words", passage, f"{prose(rng, 30)} {passage} {prose(rng, 20)}", f"{passage}\n{prose(rng, 9)}", base, *near, base, prose(rng, 30_000), "Ünïcödé – text 漢字 \U0001f600\x1c  it's <|endoftext|> x  \n\n y", "In " * 400, "12345 !!! ???", "</s>[INST] x", *[prose(rng, 60) for _ in range(20)]]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", None]), None if t is None else len(t), 7, "r", 1, 2, "m") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[6], (None, passage, None, None, None, None, None, None, None, None), (8, "another text of one id", "en", "a", 3, 7, "r", 1, 2, "m")]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
