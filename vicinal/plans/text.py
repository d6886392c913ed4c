"""Registered queries over documents: filters, tokens, BM25, fusion, the text embedder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vicinal.functions.distance import set_jaccard
from vicinal.functions.filters import column_resolver, compile_filter
from vicinal.functions.text import embed, tokenize
from vicinal.operators import bm25, fusion
from vicinal.operators.blocks import grid
from vicinal.plans.registry import query
from vicinal.plans.views import ITEMS, META, PAIRED, distance, documents, joined, joined_sql, rounded, score, table, text_items
from vicinal.session import shared_folder

K = 10
#: name -> (filter, SQL predicate over documents with their labels; ``tags`` are lang and source)
FILTERS = {
    "filter_eq": ({"lang": "fr"}, "lang = 'fr'"),
    "filter_ne_missing": ({"quality": {"$ne": 0}}, "quality IS DISTINCT FROM 0"),
    "filter_range": ({"n_chars": {"$gte": 500, "$lt": 2000}}, "n_chars >= 500 AND n_chars < 2000"),
    "filter_in": ({"source": {"$in": ["src1", "src2"]}}, "source IN ('src1', 'src2')"),
    "filter_nin": ({"quality": {"$nin": [0]}}, "quality IS DISTINCT FROM 0"),
    "filter_exists": ({"toxic": {"$exists": True}}, "toxic IS NOT NULL"),
    "filter_contains_substr": ({"source": {"$contains": "rc1"}}, "contains(source, 'rc1')"),
    "filter_contains_array": ({"tags": {"$contains": "src3"}}, "'src3' IN (lang, source)"),
    "filter_all": ({"tags": {"$all": ["fr", "src3"]}}, "lang = 'fr' AND source = 'src3'"),
    "filter_regex": ({"source": {"$regex": "^src1[0-9]$"}}, "regexp_matches(source, '^src1[0-9]$')"),
    "filter_regex_classes": ({"source": {"$regex": r"^(?P<a_word>[[s]rc)(?:[0-4]|9)\Z"}}, "regexp_matches(source, '^src([0-4]|9)$')"),
    "filter_whole_numbers": ({"$and": [{"big": {"$gt": 2**53 + 101}}, {"big": {"$ne": 2**53 + 103}}, {"big": {"$nin": [2**53 + 105, float(2**53)]}}, {"big": {"$lte": 2**53 + 301}}]}, "id > 101 AND id NOT IN (103, 105) AND id <= 301"),
    "filter_and_or": ({"$and": [{"lang": "en"}, {"$or": [{"quality": 1}, {"n_chars": {"$gt": 5000}}]}]}, "lang = 'en' AND (coalesce(quality = 1, false) OR n_chars > 5000)"),
    "filter_not_nor": ({"$not": {"lang": "en"}, "$nor": [{"quality": 0}, {"toxic": 1}]}, "lang <> 'en' AND NOT (coalesce(quality = 0, false) OR coalesce(toxic = 1, false))"),
}


def _make(name, expr, where):
    @query(name, f"WITH {META} SELECT id, lang, source, n_chars FROM docs WHERE {where}")
    def run(spark, sf_dir):
        rows = documents(spark, sf_dir)
        return rows.filter(compile_filter(expr, F.col("metadata"))).select("id", "lang", "source", "n_chars")


for _name, (_expr, _where) in FILTERS.items():
    _make(_name, _expr, _where)


@query("filter_typed_pushdown", "SELECT doc_id AS id, n_chars FROM documents WHERE lang IN ('fr', 'es') AND n_chars >= 1000")
def filter_typed_pushdown(spark, sf_dir):
    """The same language over real columns: the predicate reaches the scan."""
    rows = table(spark, sf_dir, "documents")
    return rows.filter(compile_filter({"lang": {"$in": ["fr", "es"]}, "n_chars": {"$gte": 1000}}, column_resolver(rows))).select(F.col("doc_id").alias("id"), "n_chars")


@query("filter_json_events", "SELECT event_type, count(*)::BIGINT AS n FROM events WHERE json_extract(props, '$.k')::BIGINT >= 50 AND event_type <> 'click' GROUP BY event_type")
def filter_json_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    where = compile_filter({"k": {"$gte": 50}}, F.expr("try_parse_json(props)")) & compile_filter({"event_type": {"$ne": "click"}}, column_resolver(rows))
    return rows.filter(where).groupBy("event_type").agg(F.count("*").alias("n"))


_TOKENS = "tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM documents WHERE text IS NOT NULL AND text <> '')"
_POST = "post AS (SELECT term, id, count(*)::BIGINT AS tf FROM tok GROUP BY term, id)"
_LEN = "lens AS (SELECT doc_id AS id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))::BIGINT AS dl FROM documents WHERE text IS NOT NULL AND text <> '')"


@query("tokenize_counts", f"WITH {_LEN} SELECT * FROM lens")
def tokenize_counts(spark, sf_dir):
    return bm25.doc_lengths(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("bm25_postings", f"WITH {_TOKENS}, {_POST} SELECT * FROM post")
def bm25_postings(spark, sf_dir):
    return bm25.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


def _bm25_sql(terms: dict[str, int], k: int, where: str = "true", name: str = "sparse") -> str:
    values = ", ".join(f"('{t}', {n})" for t, n in terms.items())
    return f"""{_TOKENS}, {_POST}, {_LEN}, {META}, qt(term, qtf) AS (VALUES {values}),
    tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    sc AS (SELECT id, sum(qtf * greatest(CASE WHEN ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END, 0)
      * tf * 2.5::DOUBLE / greatest(tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(avgdl, 1e-6)), 1e-6)) AS s
      FROM qt JOIN post USING (term) JOIN df USING (term) JOIN lens USING (id), tot WHERE id IN (SELECT id FROM docs WHERE {where}) GROUP BY id),
    {name} AS (SELECT row_number() OVER (ORDER BY round(s, 9) DESC, id)::BIGINT AS rank, id, s AS score FROM sc ORDER BY round(s, 9) DESC, id LIMIT {k})"""


TEXT = "the rights reserved"
_WORDS = {"the": 1, "rights": 1, "reserved": 1}


def _search(rows, text, k, where=None):
    """BM25 with scores rounded before ranking, so that both engines break ties alike."""
    from vicinal.operators.knn import ranked

    found = bm25.search(rows, text, None, where, "id", "document").select("id", "score")
    top = ranked(found.withColumn("r", F.round("score", 9)), k, by="r", ascending=False)
    return top.select("rank", "id", "score", (1 / (1 + F.col("score"))).alias("distance"))


@query("bm25_topk", f"WITH {_bm25_sql(_WORDS, K)} SELECT rank, id, round(score, 6) AS score, round(1 / (1 + score), 6) AS distance FROM sparse")
def bm25_topk(spark, sf_dir):
    return rounded(_search(documents(spark, sf_dir), TEXT, K), "score", "distance")


@query("bm25_topk_filtered", f"WITH {_bm25_sql(_WORDS, K, chr(34) + 'lang' + chr(34) + ' = ' + chr(39) + 'fr' + chr(39))} SELECT rank, id, round(score, 6) AS score, round(1 / (1 + score), 6) AS distance FROM sparse")
def bm25_topk_filtered(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return rounded(_search(rows, TEXT, K, compile_filter({"lang": "fr"}, F.col("metadata"))), "score", "distance")


@query("bm25_dup_terms", f"WITH {_bm25_sql({'the': 1, 'rights': 3}, K)} SELECT rank, id, round(score, 6) AS score, round(1 / (1 + score), 6) AS distance FROM sparse")
def bm25_dup_terms(spark, sf_dir):
    return rounded(_search(documents(spark, sf_dir), "rights the Rights RIGHTS", K), "score", "distance")


@query("bm25_from_postings", f"WITH {_bm25_sql(_WORDS, K)} SELECT rank, id, round(score, 6) AS score FROM sparse")
def bm25_from_postings(spark, sf_dir):
    """The same ranking from stored postings; ties are told apart by rounding."""
    docs = table(spark, sf_dir, "documents")
    post, lengths = bm25.postings(docs, "doc_id", "text"), bm25.doc_lengths(docs, "doc_id", "text")
    from vicinal.operators.knn import ranked

    every = bm25.search_postings(post, lengths, TEXT, None).withColumn("r", F.round("score", 9))
    return rounded(ranked(every, K, by="r", ascending=False).select("rank", "id", "score"), "score")


def _hybrid_sql(k: int, combined: str, where: str = "true") -> str:
    pool = max(3 * k, 20)
    return f"""WITH {ITEMS}, {_bm25_sql(_WORDS, pool, where, 'sparse')}, {PAIRED}, q AS (SELECT vector AS qv FROM items WHERE id = 0),
    near AS (SELECT id, {distance('cosine', 'vector', 'qv')} AS d FROM paired, q WHERE vector IS NOT NULL AND {where}),
    dense AS (SELECT row_number() OVER (ORDER BY d, id)::BIGINT AS rank, id, {score('cosine', 'd')} AS score FROM near ORDER BY d, id LIMIT {pool}),
    both_sides AS (SELECT coalesce(d.id, s.id) AS id, d.score AS ds, s.score AS ss, d.rank AS dr, s.rank AS sr FROM dense d FULL JOIN sparse s ON d.id = s.id),
    m AS (SELECT greatest((SELECT count(*) FROM dense), (SELECT count(*) FROM sparse)) + 1 AS miss),
    bounds AS (SELECT min(ds) AS dlo, max(ds) AS dhi, min(ss) AS slo, max(ss) AS shi FROM both_sides),
    fused AS (SELECT id, {combined} AS c, coalesce(ds, 0) AS ds, coalesce(ss, 0) AS ss, coalesce(dr, miss)::BIGINT AS dr, coalesce(sr, miss)::BIGINT AS sr FROM both_sides, m, bounds)
    SELECT row_number() OVER (ORDER BY round(c, 9) DESC, id)::BIGINT AS rank, id, round(c, 6) AS combined_score, round(ds, 6) AS dense_score, round(ss, 6) AS sparse_score, dr AS dense_rank, sr AS sparse_rank
    FROM fused ORDER BY round(c, 9) DESC, id LIMIT {k}"""


_RRF = "coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + sr), 0)"
_LINEAR = "0.5::DOUBLE * CASE WHEN ds IS NULL THEN 0 WHEN dhi - dlo <= 1e-12 THEN 1 ELSE (ds - dlo) / (dhi - dlo) END + 0.5::DOUBLE * CASE WHEN ss IS NULL THEN 0 WHEN shi - slo <= 1e-12 THEN 1 ELSE (ss - slo) / (shi - slo) END"


def _hybrid(spark, sf_dir, kind, where=None):
    from vicinal.operators.knn import top_k

    rows = text_items(spark, sf_dir)
    q = [float(x) for x in rows.filter("id = 0").select("vector").first()[0]]
    pred = compile_filter(where, F.col("metadata")) if where else None
    pool = max(3 * K, 20)
    dense = top_k(rows.filter("vector IS NOT NULL"), q, pool, "cosine", pred)
    sparse = _search(rows, TEXT, pool, pred)
    fused = fusion.fuse_rrf(dense, sparse, K) if kind == "rrf" else fusion.fuse_linear(dense, sparse, K)
    return rounded(fused, "combined_score", "dense_score", "sparse_score")


def _stored(spark, rows):
    path = f"{shared_folder(spark)}/bm25-{uuid.uuid4().hex}"
    bm25.write_index(rows, path)
    return path


@query("text_search_stored", f"WITH {_bm25_sql(_WORDS, K)} SELECT rank, id, round(score, 6) AS score, round(1 / (1 + score), 6) AS distance FROM sparse")
def text_search_stored(spark, sf_dir):
    """The best matches by a stored index: of the query's terms, and of blocks that can hold one of them."""
    return rounded(bm25.search_index(spark, _stored(spark, documents(spark, sf_dir)), TEXT, K), "score", "distance")


@query("hybrid_stored", _hybrid_sql(K, _RRF))
def hybrid_stored(spark, sf_dir):
    """Vectors and stored postings fused."""
    from vicinal.operators.knn import top_k

    rows = text_items(spark, sf_dir)
    q = [float(x) for x in rows.filter("id = 0").select("vector").first()[0]]
    pool = fusion.pool_rows(K)
    sparse = bm25.search_index(spark, _stored(spark, documents(spark, sf_dir)), TEXT, pool)
    fused = fusion.fuse(top_k(rows.filter("vector IS NOT NULL"), q, pool, "cosine"), sparse, K)
    return rounded(fused, "combined_score", "dense_score", "sparse_score")


@query("hybrid_rrf", _hybrid_sql(K, _RRF))
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir, "rrf")


@query("hybrid_linear", _hybrid_sql(K, _LINEAR))
def hybrid_linear(spark, sf_dir):
    return _hybrid(spark, sf_dir, "linear")


@query("hybrid_rrf_filtered", _hybrid_sql(K, _RRF, "lang = 'en'"))
def hybrid_rrf_filtered(spark, sf_dir):
    return _hybrid(spark, sf_dir, "rrf", {"lang": "en"})


_WORD_SETS = "w AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS words FROM documents)"


@query("set_jaccard", f"""WITH {_WORD_SETS}, p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.words, b.words)) AS common, len(a.words) + len(b.words) AS sizes FROM w a JOIN w b ON a.id % 50 = 0 AND a.id <> b.id)
SELECT a, b, round(CASE WHEN sizes = 0 THEN 1 ELSE common::DOUBLE / (sizes - common) END, 6) AS jaccard FROM p""")
def set_jaccard_query(spark, sf_dir):
    """Word sets of every document whose id is a multiple of 50 against those of all documents, blocks meeting blocks."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("b"), F.array_distinct(tokenize(F.col("text"))).alias("wb"))
    asked, known = grid(words.filter("b % 50 = 0").select(F.col("b").alias("a"), F.col("wb").alias("wa")), words, "a", "b")
    pairs = asked.join(known, ["qb", "ib"]).filter("a <> b")
    return rounded(pairs.select("a", "b", set_jaccard(F.col("wa"), F.col("wb")).alias("jaccard")), "jaccard")


_EMBED = f"""WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(trim(text)), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM documents),
c AS (SELECT id, t, count(*)::DOUBLE AS n FROM w GROUP BY id, t),
f AS (SELECT id, t, n AS w FROM c UNION ALL SELECT id, substr(t, i::INT, 3), n * 0.4::DOUBLE FROM (SELECT id, t, n, unnest(range(1, length(t) - 1)) AS i FROM c WHERE length(t) >= 3)),
s(salt, m) AS (VALUES ('', 1.2::DOUBLE), ('_salt1', 0.8::DOUBLE), ('_salt2', 0.5::DOUBLE)),
h AS (SELECT id, w * m AS w, ('0x' || substr(md5(t || salt), 1, 8))::UBIGINT AS h FROM f, s),
g AS (SELECT id, (h % 64)::INT AS i, sum(CASE WHEN h >= 2147483648 THEN -w ELSE w END) AS x FROM h GROUP BY ALL),
d AS (SELECT b.doc_id AS id, list(coalesce(g.x, 0) ORDER BY r.i) AS v FROM documents b CROSS JOIN range(0, 64) r(i) LEFT JOIN g ON g.id = b.doc_id AND g.i = r.i GROUP BY b.doc_id)
SELECT id, {joined_sql('CASE WHEN ' + 'list_inner_product(v, v)' + ' > 0 THEN [x / sqrt(list_inner_product(v, v)) for x in v] ELSE v END')} AS vector FROM d"""


@query("embed_text", _EMBED)
def embed_text(spark, sf_dir):
    """Every document's whole text."""
    return embed(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "text", "id").select("id", joined(F.col("vector")).alias("vector"))
