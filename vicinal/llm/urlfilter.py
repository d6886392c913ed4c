"""URL filters through a sorted digest array.

Rules (host, path, verdict) are stored in one file: sorted 64-bit xxhash keys of host + path, then the full strings and verdicts
in the same order. The file goes to every executor once (``SparkContext.addFile``), where each worker memory-maps it. A batch's
candidate strings - every domain above a host that is no longer than the longest rule's, with every stored path length - are probed together by vectorised binary search,
and a hit counts only if the stored string is equal, so colliding digests do no harm.

A rule fits its host and all subdomains if the url's path starts with the rule's; the longest rule wins (host and path together,
then the longer host). Urls that no rule fits get ``default``. Null urls and urls without ``://`` have an empty host and path.
Repeated rows are returned as often as they come in; an empty table gives no rows; no rules fit nothing. Very long urls are judged
whole, in time and memory that grow with their length; columns named as results are replaced. No row is moved.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.llm.common import map_slices

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
VERDICTS = ("allow", "block")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` up to / ? # or the end, A-Z lower-cased; path from there up to ? or #."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        cut = rest.find(mark)
        if cut >= 0:
            rest = rest[:cut]
    slash = rest.find("/")
    return (rest.translate(_LOWER), "") if slash < 0 else (rest[:slash].translate(_LOWER), rest[slash:])


def _digest(keys: Iterable[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)


def index_bytes(rules: Iterable[tuple[str, str, str]], digest=_digest) -> bytes:
    """The stored form: counts, keys, string ends, host lengths, verdicts, path lengths in use, strings. A later rule with the same host and path replaces an earlier one."""
    by_key = {(h.translate(_LOWER), p): v for h, p, v in rules}
    items = sorted(by_key.items())
    strings = [(h + p).encode() for (h, p), _ in items]
    keys = digest(strings) if items else np.empty(0, np.uint64)
    order = np.argsort(keys, kind="stable")
    ends = np.cumsum([0, *[len(strings[i]) for i in order]])
    lengths = sorted({len(p) for (_, p), _ in items})
    hosts = [len(items[i][0][0]) for i in order]
    verdicts = [VERDICTS.index(items[i][1]) for i in order]
    head = np.array([len(items), len(lengths)], "<i8")
    parts = [head, keys[order].astype("<u8"), ends.astype("<i8"), np.array(hosts, "<i8"), np.array(verdicts, "<i8"), np.array(lengths, "<i8")]
    return b"".join(p.tobytes() for p in parts) + b"".join(strings[i] for i in order)


class DigestIndex:
    """A memory-mapped rule file."""

    def __init__(self, path: str, digest=_digest):
        n, m = np.fromfile(path, "<i8", 2)
        words = np.memmap(path, "<u8", "r", offset=16, shape=(int(4 * n + 1 + m),))
        self.keys, signed = words[:n], words.view("<i8")
        self.ends, self.hosts = signed[n : 2 * n + 1], signed[2 * n + 1 : 3 * n + 1]
        self.verdicts, self.lengths = signed[3 * n + 1 : 4 * n + 1], [int(x) for x in signed[4 * n + 1 :]]
        size = os.path.getsize(path) - 16 - words.nbytes
        self.blob = np.memmap(path, np.uint8, "r", offset=16 + words.nbytes, shape=(size,)) if size else np.empty(0, np.uint8)
        self.digest = digest
        self.longest = int(self.hosts.max()) if n else 0

    def text(self, i: int) -> bytes:
        return self.blob[self.ends[i] : self.ends[i + 1]].tobytes()

    def find(self, strings: list[bytes]) -> list[int]:
        """Place of each string in the file, -1 if it isn't there."""
        if not len(self.keys) or not strings:
            return [-1] * len(strings)
        digests = self.digest(strings)
        at = np.searchsorted(self.keys, digests)
        hit = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests)
        out = np.full(len(strings), -1)
        for j in np.flatnonzero(hit).tolist():
            i = int(at[j])
            while i < len(self.keys) and self.keys[i] == digests[j]:  # a collision's run
                if self.text(i) == strings[j]:
                    out[j] = i
                    break
                i += 1
        return out.tolist()

    def judge(self, urls: list[str | None], default: str) -> tuple[list, list, list, list]:
        """host, path, rule and verdict of each url."""
        split = [split_url(u) for u in urls]
        strings: dict[bytes, int] = {}
        wanted: list[list[int]] = []
        for host, path in split:
            own = []
            paths = [path[:n] for n in self.lengths if n <= len(path)]
            if len(host) > self.longest:  # no rule has a longer one
                dot = host.find(".", len(host) - self.longest - 1)
                host = host[dot + 1 :] if dot >= 0 else ""
            while host and paths:
                own += [strings.setdefault((host + p).encode("utf-8", "surrogatepass"), len(strings)) for p in paths]
                dot = host.find(".")
                host = host[dot + 1 :] if dot >= 0 else ""
            wanted.append(own)
        place = self.find(list(strings))
        rules, verdicts = [], []
        for own in wanted:
            fits = [place[i] for i in own if place[i] >= 0]
            best = max(fits, key=lambda i: (len(self.text(i).decode()), int(self.hosts[i])), default=-1)
            rules.append(self.text(best).decode() if best >= 0 else None)
            verdicts.append(VERDICTS[int(self.verdicts[best])] if best >= 0 else default)
        return [h for h, _ in split], [p for _, p in split], rules, verdicts


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` plus host, path, rule and verdict (replacing columns of these names)."""
    spark = pages.sparkSession
    stored = index_bytes(rules)
    name = f"vicinal-rules-{hashlib.sha256(stored).hexdigest()[:24]}.bin"
    local = os.path.join(tempfile.gettempdir(), name)  # the driver's copy, from which Spark serves every executor
    if not os.path.exists(local):
        with open(f"{local}.{os.getpid()}", "wb") as f:
            f.write(stored)
        os.replace(f"{local}.{os.getpid()}", local)
    spark.sparkContext.addFile(local)
    added = ("host", "path", "rule", "verdict")
    keep = [c for c in pages.columns if c not in added]
    at = keep.index(url)
    frame = pages.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*frame.schema.fields, *[T.StructField(c, T.StringType()) for c in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or DigestIndex(SparkFiles.get(name))
            found = index.judge(batch.column(at).to_pylist(), default)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.string()) for c in found]], names=[*keep, *added])

    return map_slices(frame, run, schema)


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
