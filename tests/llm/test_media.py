"""ISO containers: round trips, foreign layouts, broken input."""

import hashlib
import struct
import zlib

from fitloom.llm import media


def test_round_trip_and_digests(spark):
    texts = [None, "", "a", "é" * 288, "x" * 577, "long " * 40_000, "a"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in media.digests(media.stored(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576) if raw else b"\xff" * 576
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-32:])
        data = media.store(want)
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert rows[2].feature == rows[6].feature and rows[2].feature.startswith("raw;0.04s;1;")
    assert media.stored(docs.limit(0)).count() == 0


def test_keyframe_ranges_point_at_frames():
    payload = bytes(i % 251 for i in range(576 * 40))
    data = media.store(payload)
    (t,) = media.tracks(data)
    assert [data[a:b] for a, b in t.key_ranges()] == [payload[576 * k : 576 * (k + 1)] for k in range(0, 40, 12)]
    assert t.seconds() == 40 / 25 and t.handler == "vide"


def test_other_layouts():
    body = struct.pack(">II", 0, 3) + struct.pack(">III", 3, 5, 2)
    stbl = media.box(
        b"stbl",
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(70))),
        media.full(b"stts", struct.pack(">III", 1, 3, 10)),
        media.full(b"stsc", struct.pack(">I", 2), struct.pack(">IIIIII", 1, 2, 1, 2, 1, 1)),
        media.full(b"stsz", body),
        media.full(b"co64", struct.pack(">IQQ", 2, 1000, 5_000_000_000)),
    )
    mdhd = media.box(b"mdhd", struct.pack(">IQQIQ", 1 << 24, 0, 0, 100, 30))
    moov = media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, media.box(b"minf", stbl))))
    data = moov + struct.pack(">I4s", 0, b"mdat") + b"rest"
    (t,) = media.tracks(data)
    assert (t.codec, t.seconds()) == ("avc1", 0.3)
    assert t.key_ranges() == [(1000, 1003), (1003, 1008), (5_000_000_000, 5_000_000_002)]


def test_bad_containers_give_an_error(spark):
    good = media.store(b"\xff" * 576)
    df = spark.createDataFrame([(1, good), (2, None), (3, b"nonsense" * 9), (4, good[:-600])], "doc_id long, media binary")
    rows = {r.doc_id: r for r in media.inspect(df).collect()}
    assert rows[1].error is None and rows[1].tracks[0].codec == "raw" and rows[1].tracks[0].key_ranges[0].last == len(good)
    assert all(rows[i].error and rows[i].tracks == [] for i in (2, 3, 4))
