"""Media columns: texts stored as AVI motion-JPEG, read back through the file's index, and cut into timed clips.

``store`` writes each text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of 576, as the samples of 24 x 24
lossless intra frames. ``inspect`` parses the stored bytes, decodes every frame and detects shots by adaptive histogram
differences; ``clips`` gives one timed row per shot. Both read other motion-JPEG files as well: baseline or lossless frames of any
one size (``jpeg``). Nothing is shuffled; a long text is coded in blocks of its own.

A null text is empty (one frame of padding). A null media value gives null results in ``inspect`` and no clips. Repeated rows
are returned as often as they come in; an empty table gives no rows; extra columns are kept, and columns named as results are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vicinal.llm.avi import FPS, FRAME, decode_frames, encode_frames, read_avi, shot_starts, write_avi
from vicinal.llm.common import map_slices

#: Frames coded by one array operation.
BLOCK_FRAMES = 2048


def to_media(payload: bytes) -> bytes:
    """The AVI file of one byte string."""
    padded = payload + b"\xff" * (-len(payload) % FRAME if payload else FRAME)
    samples = np.frombuffer(padded, np.uint8).reshape(-1, FRAME)
    frames: list[bytes] = []
    for at in range(0, len(samples), BLOCK_FRAMES):
        frames += encode_frames(samples[at : at + BLOCK_FRAMES])
    return write_avi(frames, len(payload))


def from_media(media: bytes) -> tuple[np.ndarray, int, float]:
    """(samples of all frames, unpadded length, frames a second)."""
    frames, length, fps = read_avi(media)
    parts = [decode_frames(frames[at : at + BLOCK_FRAMES]) for at in range(0, len(frames), BLOCK_FRAMES)]
    if len({p.shape[1] for p in parts}) > 1:
        raise ValueError("frames of different sizes")
    return (np.concatenate(parts) if parts else np.empty((0, FRAME), np.uint8)), length, fps


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by a binary column ``media``."""
    keep = [c for c in docs.columns if c not in (text, "media")]
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias("media"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                media = [to_media(v or b"") for v in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(media, pa.binary())], names=[*keep, "media"])

    return map_slices(frame, run, frame.schema)


_RESULTS = (
    ("n_bytes", T.LongType(), pa.int64()), ("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()),
    ("tail_crc32", T.LongType(), pa.int64()), ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()),
    ("feature", T.StringType(), pa.string()),
)


def _inspected(media: bytes | None) -> tuple:
    if media is None:
        return (None,) * len(_RESULTS)
    samples, length, _fps = from_media(media)
    payload = samples.tobytes()
    starts = shot_starts(samples)
    feature = f"{len(samples)} frames, {len(starts)} shots at {' '.join(map(str, starts))}"
    return (length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)


def inspect(stored: DataFrame) -> DataFrame:
    """``stored`` with ``media`` replaced by lengths, digests and the shot feature, all read back from the stored bytes."""
    names = [n for n, _, _ in _RESULTS]
    keep = [c for c in stored.columns if c not in ("media", *names)]
    frame = stored.select(*[F.col(f"`{c}`") for c in keep], "media")
    schema = T.StructType([*frame.drop("media").schema.fields, *[T.StructField(n, t) for n, t, _ in _RESULTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_inspected(m) for m in batch.column(len(keep)).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(_RESULTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, t) for c, (_, _, t) in zip(columns, _RESULTS)]], names=[*keep, *names])

    return map_slices(frame, run, schema)


def clips(stored: DataFrame) -> DataFrame:
    """One row per shot of each media value: columns kept, then clip, first_frame, n_frames, start_s, end_s."""
    added = [("clip", T.LongType(), pa.int64()), ("first_frame", T.LongType(), pa.int64()), ("n_frames", T.LongType(), pa.int64()), ("start_s", T.DoubleType(), pa.float64()), ("end_s", T.DoubleType(), pa.float64())]
    names = [n for n, _, _ in added]
    keep = [c for c in stored.columns if c not in ("media", *names)]
    frame = stored.select(*[F.col(f"`{c}`") for c in keep], "media")
    schema = T.StructType([*frame.drop("media").schema.fields, *[T.StructField(n, t) for n, t, _ in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, media in enumerate(batch.column(len(keep)).to_pylist()):
                if media is None:
                    continue
                samples, _, fps = from_media(media)
                starts = shot_starts(samples)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(samples)])):
                    at.append(i)
                    rows.append((k, a, b - a, a / fps, b / fps))
            taken = [c.take(pa.array(at, pa.int64())) for c in batch.columns[: len(keep)]]
            columns = list(zip(*rows)) if rows else [()] * len(added)
            yield pa.RecordBatch.from_arrays([*taken, *[pa.array(c, t) for c, (_, _, t) in zip(columns, added)]], names=[*keep, *names])

    return map_slices(frame, run, schema)


def op10_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return inspect(store(docs))


__all__ = ["FPS", "clips", "from_media", "inspect", "op10_media", "store", "to_media"]
