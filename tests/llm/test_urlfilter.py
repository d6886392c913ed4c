import duckdb
import numpy as np

from vicinal.llm import urlfilter

URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org", "http://example.org/", "https://sub.Example.ORG/es/x?y", "http://example.org/es", "http://example.org/en/12#a", "http://notexample.org/en/1",
    "http://a.com/fr/", "http://a.com/de/z", "ftp://com/de/", "http://com.evil/de/", "http://x.org?://y.com/de/", "a://b://c.org/", "http://user@a.org:80/", "http://É.org/ñ?", "http://a.org./", "http://.org/",
]


def slow(url, rules=urlfilter.RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])
        rest = rest[:cut]
        host, slash, path = rest.partition("/")
        path = slash + path
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if path.startswith(p) and (host == h or host.endswith("." + h))]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def pages(spark):
    return spark.createDataFrame([(i, u, "theirs", 3) for i, u in enumerate(URLS + URLS[5:7])], "page_id bigint, url string, rule string, extra int")


def test_rules(spark):
    out = urlfilter.filter_urls(pages(spark))
    assert out.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict"]
    for r in out.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == slow(r["url"]), r


def test_sql(spark, tmp_path):
    pages(spark).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(str, map(tuple, urlfilter.op4_url_filter(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(map(str, con.sql(urlfilter.OP4_SQL).fetchall()))


def test_collisions_are_told_apart(tmp_path):
    """All keys have one digest; the stored strings decide."""
    same = lambda keys: np.zeros(len(list(keys)), np.uint64)
    path = tmp_path / "index.bin"
    path.write_bytes(urlfilter.index_bytes(urlfilter.RULES, same))
    index = urlfilter.DigestIndex(str(path), same)
    host, _, rule, verdict = index.judge(URLS, "allow")
    assert [(h, r, v) for h, r, v in zip(host, rule, verdict)] == [(slow(u)[0], *slow(u)[2:]) for u in URLS]


def test_no_rules_and_no_pages(spark):
    assert {(r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages(spark), (), "block").collect()} == {(None, "block")}
    assert urlfilter.filter_urls(pages(spark).limit(0)).collect() == []


def test_many_rules(tmp_path):
    rules = [(f"host{i}.net", f"/{'p' * (i % 7)}", urlfilter.VERDICTS[i % 2]) for i in range(500)]
    path = tmp_path / "index.bin"
    path.write_bytes(urlfilter.index_bytes(rules))
    index = urlfilter.DigestIndex(str(path))
    urls = [f"http://a.host{i}.net/{'p' * (i % 9)}/x" for i in range(600)]
    assert list(zip(*index.judge(urls, "allow"))) == [slow(u, rules) for u in urls]


def test_very_long_urls(tmp_path):
    """Hosts and paths of 100 KB and many labels take memory in proportion."""
    import tracemalloc

    (tmp_path / "rules").write_bytes(urlfilter.index_bytes(urlfilter.RULES))
    index = urlfilter.DigestIndex(str(tmp_path / "rules"))
    urls = [f"http://{'a.' * 50_000}{end}" for end in ("example.org/es/" + "b/" * 50_000, "xexample.org/es/", "com/de/" + "c" * 100_000, "com.evil/de/")] + [f"http://{'a' * 100_000}.com/fr/", "http://" + "." * 100_000]
    tracemalloc.start()
    found = list(zip(*index.judge(urls, "allow")))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [slow(u) for u in urls]
    assert peak < 30 * sum(map(len, urls))
