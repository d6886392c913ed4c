import pytest

import corpus_pipeline
from vicinal.llm import registry

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """The stages as a runner applies them: each result written and read again."""
    sf_dir = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), [("start", spark.read.parquet(f"{sf_dir}/documents.parquet"))]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def test_stages_keep_the_columns_of_documents(written):
    for name, df in written[:-1]:
        assert df.columns == written[0][1].columns and df.dtypes == written[0][1].dtypes, name


def least_of_groups(rows):
    """Smallest doc_id of each group of texts that five-word shingles link at a similarity of 0.8, pair by pair."""
    sets = {}
    for r in rows:
        w = (r["text"] or "").translate(LOWER).encode().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and (len(x & y) >= 0.8 * len(x | y)):
                one, two = root[a], root[b]
                root = {d: min(one, two) if r in (one, two) else r for d, r in root.items()}
    return set(root.values())


def test_each_stage_does_its_work(spark, written):
    start, lang, near, cut, mixed, encoded = [df for _, df in written]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(near) < ids(start) and ids(lang) <= ids(start) and ids(cut) == ids(near)
    from vicinal.llm import mixing, substring

    assert ids(near) == least_of_groups(lang.select("doc_id", "text").collect())
    plan = {r["doc_id"]: r["n_removed"] for r in substring._cut_texts(near.select("doc_id", "text"), 50, 16, digest=True).collect()}
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in (near, cut))
    assert all((before[d] == after[d]) == (n == 0) for d, n in plan.items())
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(mixing.sizes(cut)).collect() if r["taken"]}
    got = {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert got == taken
    assert encoded.count() == mixed.count() and encoded.filter("n_tokens <> size(ids)").count() == 0
    from pyspark.sql import functions as F

    assert encoded.select("doc_id", "decoded_sha256").exceptAll(mixed.select("doc_id", F.sha2("text", 256).alias("decoded_sha256"))).count() == 0


def test_run_and_registry(spark, written):
    run = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in df.collect())
    assert key(run) == key(written[-1][1])
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("which", ["messy", "no_docs"])
def test_stages_on_odd_tables(spark, request, tmp_path, which):
    """Nulls, repeated rows, clashing columns and empty tables pass through every stage."""
    docs = request.getfixturevalue(which)
    columns = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "unused")
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert (docs.count() == 0) == (which == "no_docs")
