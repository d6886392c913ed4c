"""Fill-in-middle transformation: a text is cut in two places and its middle moves to the end.

A text is decoded to an array of its code points. Each point has a class, neighbouring classes are compared, and where they
differ a unit ends; two of these boundaries, chosen by the digest of the doc_id, cut the text into prefix, middle and suffix.
``units`` says what a unit is: ``chars`` (every code point), ``words`` (runs of space, of word characters, of anything else) or
``lines`` (a line and its line feed). Forms: ``psm`` is prefix, suffix, middle, each behind its own mark, ``spm`` is suffix,
prefix, middle, and ``plain`` is the text as it was. Texts that are empty or contain a mark stay plain, so that every output
tells its text: ``restored`` rebuilds it from output and form alone.

Nulls: a null text is empty; a null doc_id counts as the word ``null``. Texts of any length are cut whole. The same doc_id and
text give the same output wherever and however often they occur, so ties and repeated rows are alike and each is returned. An
empty table gives no rows. Extra columns are kept, except those named as a result, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import map_slices

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many stay plain; of a hundred others so many put the suffix first.
PLAIN, SPM = 10, 20
SEED = 1
UNITS = ("chars", "words", "lines")
#: Result columns beside the text.
RESULTS = {"n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint"}


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def as_text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def classes(points: np.ndarray, units: str) -> np.ndarray:
    """A class for each code point; a unit ends where the next one's differs."""
    if units == "chars":
        return np.arange(len(points), dtype=np.uint32) & 1
    if units == "lines":
        ends = (points == 10).astype(np.int64)
        return np.cumsum(ends) - ends
    space = (points == 32) | ((points >= 9) & (points <= 13))
    low = points | 32
    word = ((low >= 97) & (low <= 122)) | ((points >= 48) & (points <= 57)) | (points >= 128) | (points == 95)
    return np.where(space, 0, np.where(word, 1, 2))


def boundaries(points: np.ndarray, units: str = "chars") -> np.ndarray:
    """Where units begin and end: 0, each place between two units, and the end; n + 1 places for n units."""
    if not len(points):
        return np.zeros(1, np.int64)
    kind = classes(points, units)
    return np.concatenate(([0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(points)]))


def draws(doc_id: object, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits that follow from the doc_id."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode("utf-8", "surrogatepass")).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def rearranged(text: str, drawn: list[int], units: str = "chars", plain: int = PLAIN, spm: int = SPM) -> tuple[str, int, str, int | None, int | None]:
    """(output, n units, form, code points of the prefix, of the middle) of one text."""
    points = code_points(text)
    at = boundaries(points, units)
    n = len(at) - 1
    if not text or any(m in text for m in MARKS) or drawn[2] % 100 >= 100 - plain:
        return text, n, "plain", None, None
    first, last = sorted(int(at[h % (n + 1)]) for h in drawn[:2])
    prefix, middle, suffix = as_text(points[:first]), as_text(points[first:last]), as_text(points[last:])
    p, s, m = MARKS
    if drawn[3] % 100 < spm:
        return f"{s}{suffix}{p}{prefix}{m}{middle}", n, "spm", first, last - first
    return f"{p}{prefix}{s}{suffix}{m}{middle}", n, "psm", first, last - first


def fill_in_middle(docs: DataFrame, units: str = "chars", seed: int = SEED, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """``docs`` with each text replaced by its output, plus n, form, prefix_chars and middle_chars (null where plain)."""
    if units not in UNITS:
        raise ValueError(f"units must be one of {UNITS}")
    keep = [c for c in docs.columns if c not in ("text", *RESULTS)]
    own = [F.col(f"`{c}`") for c in keep]
    schema = docs.select(*own, "text", *[F.lit(None).cast(t).alias(c) for c, t in RESULTS.items()]).schema
    frame = docs.select(*own, F.col("doc_id").cast("string").alias("__id"), F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()
            made = [rearranged(t or "", draws(i, seed), units, plain, spm) for i, t in zip(ids, texts)]
            columns = [pa.array([x[k] for x in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=schema.names)

    return map_slices(frame, run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``form`` was made of."""
    p, s, m = MARKS

    def cut(body: Column, mark: str) -> tuple[Column, Column]:
        at = F.instr(body, mark)
        return F.substring(body, F.lit(1), at - 1), F.substring(body, at + len(mark), F.length(body))

    prefix, rest = cut(F.substring(output, F.lit(1 + len(p)), F.length(output)), s)
    suffix, middle = cut(rest, m)
    psm = F.concat(prefix, middle, suffix)
    suffix, rest = cut(F.substring(output, F.lit(1 + len(s)), F.length(output)), p)
    prefix, middle = cut(rest, m)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    digest = F.sha2("text", 256).alias("output_sha256"), F.sha2(restored(F.col("text"), F.col("form")), 256).alias("restored_sha256")
    return fill_in_middle(docs).select("doc_id", *RESULTS, *digest)


OP13_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS d
  FROM documents
), numbers AS (
  SELECT *, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4
  FROM drawn
), cuts AS (
  SELECT doc_id, x, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
), made AS (
  SELECT *, substring(x, 1, a) AS p, substring(x, a + 1, b - a) AS m, substring(x, b + 1, n - b) AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM made
"""
