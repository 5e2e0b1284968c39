from __future__ import annotations

import hashlib
import io
import math
import wave
import zlib
from itertools import pairwise

import pytest

from wayfare.llm import media
from wayfare.llm.common import new_path, table
from wayfare.llm.queries import op6_media

ROWS = [(1, "hello é", "k"), (1, "hello é", "k"), (2, None, "k"), (3, "", "k"), (None, "a" * 192, "k"), (5, "b" * 193, "k"), (6, "long " * 20000, "k")]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, media string").repartition(3)
    path = new_path(spark, "media")
    media.write(df, path)
    for size in (16 << 20, 100):
        got = media.read(spark, path, size).collect()
        assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(i), len((t or "").encode())) for i, t, _ in ROWS)
        for r in got:
            payload, raw = bytes(r.payload), bytes(r.media)
            assert len(payload) % 192 == 0 and payload and set(payload[r.n_bytes :]) <= {32}
            with wave.open(io.BytesIO(raw)) as w:
                assert (w.getnchannels(), w.getsampwidth()) == (1, 1) and w.readframes(w.getnframes()) == payload
            assert r.feature.startswith(f"n={len(payload)};")
        assert {bytes(r.payload)[: r.n_bytes].decode() for r in got} == {t or "" for _, t, _ in ROWS}


def test_empty(spark):
    path = new_path(spark, "media")
    media.write(spark.createDataFrame([], "doc_id long, text string"), path)
    assert media.read(spark, path).count() == 0


def test_members_are_retried_alone(tmp_path, spark):
    path = new_path(spark, "media")
    media.write(spark.createDataFrame(ROWS, "doc_id long, text string, media string").coalesce(1), path)
    reader = media.Reader(path, 1 << 20)
    part = reader.partitions()[0]
    whole, failed, asked = reader.member, [], []

    def once(f, at):
        asked.append(at)
        if len(asked) % 2 and at not in failed:
            failed.append(at)
            raise OSError("lost")
        return whole(f, at)

    reader.member = once
    assert sum(b.num_rows for b in reader.read(part)) == len(ROWS) and failed
    reader.member = lambda f, at: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError, match="gone"):
        list(reader.read(part))


def test_query_columns(spark):
    """All columns of the query, computed anew from the documents."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    got = op6_media(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        made = io.BytesIO()
        with wave.open(made, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(media.RATE)
            w.writeframes(payload)
        form = made.getvalue()
        x = [b - 128 for b in payload]
        mean, rms = sum(x) / len(x), math.sqrt(sum(v * v for v in x) / len(x))
        flips = sum((a < 0) != (b < 0) for a, b in pairwise(x)) / (len(x) - 1)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
        assert r.feature == f"n={len(x)};s={len(x) / media.RATE:.4f};mean={mean:.4f};rms={rms:.4f};peak={max(map(abs, x))};flips={flips:.6f}"
