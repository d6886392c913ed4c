import hashlib
import os
import zlib

import numpy as np
import pytest

from vicinal.llm import avi, media


@pytest.mark.parametrize("payload", [b"", b"a", b"\xff" * 576, b"\xff\x00" * 900, os.urandom(575), os.urandom(577), bytes(range(256)) * 9])
def test_round_trip(payload):
    stored = media.to_media(payload)
    samples, length, fps = media.from_media(stored)
    back = samples.tobytes()
    assert length == len(payload) and back[:length] == payload and set(back[length:]) <= {255} and len(back) % 576 == 0 and len(back) > 0
    assert fps == avi.FPS and stored == media.to_media(payload)


def slow_decode(frame):
    """One frame, bit by bit, as the format defines it."""
    head = avi.parse_jpeg(frame)
    data = frame[head.scan_at : frame.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
    bits = "".join(f"{b:08b}" for b in data)
    at, x = 0, np.zeros((24, 24), int)
    for i in range(24):
        for j in range(24):
            size = 8
            while bits[at] == "1" and size > 0:
                at, size = at + 1, size - 1
            at += 1
            value = int(bits[at : at + size] or "0", 2)
            at += size
            if size and value < 1 << (size - 1):
                value -= (1 << size) - 1
            left = 128 if i == j == 0 else x[i, j - 1] if j else x[i - 1, j]
            x[i, j] = (left + value) % 256
    return x.astype(np.uint8).reshape(-1)


def test_frames_are_lossless_jpegs():
    x = np.frombuffer(os.urandom(576 * 3), np.uint8).reshape(3, 576)
    frames = avi.encode_frames(x)
    assert all((slow_decode(f) == row).all() for f, row in zip(frames, x))
    assert (avi.decode_frames(frames) == x).all()


def test_broken_files():
    for bad in (b"", b"RIFF1234WAVE", media.to_media(b"x").replace(b"idx1", b"junk").replace(b"movi", b"xxxx")):
        with pytest.raises(ValueError):
            media.from_media(bad)
    with pytest.raises(ValueError):
        avi.decode_frames([b"\xff\xd8\xff\xd9"])


def test_shots():
    dark, light = np.full((10, 576), 10, np.uint8), np.full((10, 576), 200, np.uint8)
    assert avi.shot_starts(np.concatenate([dark, light, dark])) == [0, 10, 20]
    assert avi.shot_starts(np.concatenate([dark[:1], light])) == [0, 1]  # at the first difference
    assert avi.shot_starts(dark) == [0] and avi.shot_starts(dark[:0]) == []


def slow_shots(samples):
    """The rule, difference by difference."""
    hists = [[sum(1 for v in frame if v // 16 == b) for b in range(16)] for frame in samples.tolist()]
    diffs = [sum(abs(x - y) for x, y in zip(a, b)) / (2 * samples.shape[1]) for a, b in zip(hists, hists[1:])]
    starts = [0] if len(samples) else []
    for i, d in enumerate(diffs):
        last = diffs[max(0, i - 8) : i]
        mean = sum(last) / len(last) if last else 0.0
        spread = (sum((x - mean) ** 2 for x in last) / len(last)) ** 0.5 if last else 0.0
        if d > 0.1 and d > mean + 2 * spread + 1e-12:
            starts.append(i + 1)
    return starts


def test_shots_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(20):
        parts = [np.clip(rng.normal(rng.integers(0, 256), rng.integers(1, 40), (rng.integers(1, 12), 300)), 0, 255) for _ in range(6)]
        samples = np.concatenate(parts).astype(np.uint8)
        assert avi.shot_starts(samples) == slow_shots(samples)


def test_query(messy, messy_rows, no_docs):
    out = media.inspect(media.store(messy)).collect()
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in out)
    want = []
    for r in messy_rows:
        raw = (r[1] or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((str(r[0]), len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert got == sorted(want)
    assert len({(r["media_sha256"], r["feature"]) for r in out if r["doc_id"] in (0, 1)}) == 1
    assert media.inspect(media.store(no_docs)).collect() == []
    clips = media.clips(media.store(messy)).filter("doc_id = 13").orderBy("clip").collect()
    assert clips[0]["first_frame"] == 0 and sum(c["n_frames"] for c in clips) == -(-len(messy_rows[13][1].encode()) // 576)
    assert all(c["end_s"] == pytest.approx((c["first_frame"] + c["n_frames"]) / 25) for c in clips)


def test_null_media(spark):
    df = spark.createDataFrame([(1, None)], "doc_id bigint, media binary")
    assert media.inspect(df).first()["n_bytes"] is None and media.clips(df).collect() == []
