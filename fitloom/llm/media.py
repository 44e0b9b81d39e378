"""Media columns in ISO base media containers (ISO/IEC 14496-12).

``store`` puts each text's UTF-8 bytes, padded to whole frames, into a container with one
track of raw 24 x 24 8-bit grey frames (576 bytes each).  ``inspect`` walks the nested
boxes of any container column, decodes its sample tables and returns per track the codec,
the duration and the byte ranges of the keyframes; it never decodes or even touches the
payload.  ``read_payload`` follows the same tables to give a track's stored bytes back.

Defined cases: a null or empty text is one frame of padding; unpaired surrogates become
"?"; equal texts give equal containers (no clock, no ids inside); repeated rows come back
repeatedly; a column value that is null or no valid container gives no tracks and an
``error`` text, never a failed task; offsets above 4 GiB use 64-bit tables.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

SIDE = 24
FRAME = SIDE * SIDE
TIMESCALE = 25
#: Frames per chunk, and from one frame marked as a random access point to the next.
PER_CHUNK, KEY_EVERY = 16, 12
#: Boxes that hold boxes only.
NESTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"}
UNITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(text: str | None) -> tuple[int, bytes]:
    """The text's byte count, and its bytes filled up with 255 to a positive multiple of a frame."""
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME))


def store(payload: bytes) -> bytes:
    """A container whose only track holds ``payload`` frame by frame."""
    n = len(payload) // FRAME
    chunks = -(-n // PER_CHUNK)
    runs = [(1, PER_CHUNK)] if n >= PER_CHUNK else []
    if n % PER_CHUNK:
        runs.append((chunks, n % PER_CHUNK))
    keys = range(1, n + 1, KEY_EVERY)
    entry = box(
        b"raw ",
        struct.pack(">6xH16xHHIIIH32sHh", 1, SIDE, SIDE, 0x480000, 0x480000, 0, 1, b"", 8, -1),
    )

    def moov(base: int) -> bytes:
        offsets = [base + i * PER_CHUNK * FRAME for i in range(chunks)]
        wide = offsets[-1] >= 1 << 32
        table = full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, per, 1) for first, per in runs)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            table,
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0))
        hdlr = full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0")
        tkhd = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0), UNITY, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, n, 0x10000, 0x100), UNITY, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    data = box(b"mdat", payload)
    base = len(head) + len(moov(0)) + len(data) - len(payload)
    return head + moov(base) + data


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    runs: list[tuple[int, int]] = field(default_factory=list)  # stts: samples, ticks
    keys: list[int] | None = None  # stss; None: all samples
    chunk_runs: list[tuple[int, int]] = field(default_factory=list)  # stsc: first chunk, samples per chunk
    fixed: int = 0
    count: int = 0
    sizes: tuple[int, ...] = ()
    offsets: tuple[int, ...] = ()

    def samples(self) -> list[tuple[int, int]]:
        """(offset, size) of each sample, from the chunk and size tables."""
        out: list[tuple[int, int]] = []
        bounds = [first for first, _ in self.chunk_runs[1:]] + [len(self.offsets) + 1]
        for (first, per), last in zip(self.chunk_runs, bounds, strict=True):
            for chunk in range(first, last):
                at = self.offsets[chunk - 1]
                for _ in range(min(per, self.count - len(out))):
                    size = self.fixed or self.sizes[len(out)]
                    out.append((at, size))
                    at += size
        if len(out) != self.count:
            raise ValueError(f"tables place {len(out)} of {self.count} samples")
        return out

    def seconds(self) -> float:
        ticks = self.duration or sum(n * d for n, d in self.runs)
        return ticks / self.timescale if self.timescale else 0.0

    def key_ranges(self) -> list[tuple[int, int]]:
        """Byte ranges (start, end exclusive) of the sync samples."""
        at = self.samples()
        return [(at[i - 1][0], sum(at[i - 1])) for i in (self.keys if self.keys is not None else range(1, self.count + 1))]


def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of the boxes in a range, 64-bit and to-the-end sizes included."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} at {start} has a bad size {size}")
        yield kind, body, start + size
        start += size


def tracks(data: bytes) -> list[Track]:
    """The tracks of a container, from its sample tables alone."""
    view, found = memoryview(data), []

    def table(at: int, end: int, form: str, head: int = 4) -> list[tuple]:
        (n,) = struct.unpack_from(">I", view, at + head)
        step = struct.calcsize(">" + form)
        if at + head + 4 + n * step > end:
            raise ValueError("a table is longer than its box")
        return list(struct.iter_unpack(">" + form, view[at + head + 4 : at + head + 4 + n * step]))

    def visit(start: int, end: int, track: Track | None) -> None:
        for kind, at, to in walk(view, start, end):
            inner = track
            if kind == b"trak":
                found.append(inner := Track())
            if kind in NESTS:
                visit(at, to, inner)
            elif inner is None:
                continue
            elif kind == b"mdhd":
                inner.timescale, inner.duration = struct.unpack_from(">IQ" if view[at] else ">II", view, at + (20 if view[at] else 12))
            elif kind == b"hdlr":
                inner.handler = bytes(view[at + 8 : at + 12]).decode("latin-1")
            elif kind == b"stsd":
                inner.codec = bytes(view[at + 12 : at + 16]).decode("latin-1").strip()
            elif kind == b"stts":
                inner.runs = table(at, to, "II")
            elif kind == b"stss":
                inner.keys = [k for (k,) in table(at, to, "I")]
            elif kind == b"stsc":
                inner.chunk_runs = [(a, b) for a, b, _ in table(at, to, "III")]
            elif kind == b"stsz":
                inner.fixed, inner.count = struct.unpack_from(">II", view, at + 4)
                if not inner.fixed:
                    inner.sizes = tuple(k for (k,) in table(at, to, "I", 8))
            elif kind in (b"stco", b"co64"):
                inner.offsets = tuple(k for (k,) in table(at, to, "Q" if kind == b"co64" else "I"))

    visit(0, len(data), None)
    return found


def read_payload(data: bytes, track: int = 0) -> bytes:
    """A track's stored bytes, put together from its sample tables."""
    return b"".join(data[a : a + n] for a, n in tracks(data)[track].samples())


TRACKS = "array<struct<codec:string,handler:string,seconds:double,samples:long,key_ranges:array<struct<first:long,last:long>>>>"


def inspect(df: DataFrame, column: str = "media") -> DataFrame:
    """``df`` with ``tracks`` (see the module's text) and ``error``, without the payload's decoding."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in ("tracks", "error"))

    def run(batches):
        for pdf in batches:
            out, errors = [], []
            for data in pdf[column]:
                try:
                    if data is None:
                        raise ValueError("null")
                    out.append([{"codec": t.codec, "handler": t.handler, "seconds": t.seconds(), "samples": t.count, "key_ranges": [{"first": a, "last": b} for a, b in t.key_ranges()]} for t in tracks(bytes(data))])
                    errors.append(None)
                except (ValueError, IndexError, struct.error) as e:
                    out.append([])
                    errors.append(str(e))
            yield pdf.assign(tracks=out, error=errors)

    return df.drop("tracks", "error").mapInPandas(run, f"{schema}, tracks {TRACKS}, error string")


def stored(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text as a container."""

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, 500):
                rows = [padded(t) for t in b.column(1)[k : k + 500].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[k : k + 500], pa.array([n for n, _ in rows], pa.int64()), pa.array([store(p) for _, p in rows], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def digests(media: DataFrame) -> DataFrame:
    """Digest columns of ``(doc_id, n_bytes, media)``, from the containers as they are stored.

    ``feature`` reads codec;seconds;samples;keyframe ranges (first-last, end exclusive, comma-joined).
    """

    def row(n: int, data: bytes) -> tuple:
        (track,) = tracks(data)
        payload = b"".join(data[a : a + k] for a, k in track.samples())
        ranges = ",".join(f"{a}-{b}" for a, b in track.key_ranges())
        return (
            n,
            len(payload),
            hashlib.sha256(payload).hexdigest(),
            zlib.crc32(payload[-32:]),
            len(data),
            hashlib.sha256(data).hexdigest(),
            f"{track.codec};{track.seconds():.2f}s;{track.count};{ranges}",
        )

    names = "n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()

    def run(batches):
        for b in batches:
            rows = [row(n, d) for n, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows, strict=True))], names=["doc_id", *names])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, schema)
