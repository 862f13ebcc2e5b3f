"""Media columns in ISO base media containers.

``write_container`` stores a payload as raw 8-bit frames: a file type box, a movie box with one video track whose
sample tables give durations, sizes, chunks and key frames, and a media data box. ``scan_container`` walks the
nested boxes of any such file and decodes its sample tables: codec, time scale, duration, and the byte range of
every key frame; payload bytes are located, never decoded.

Defined results: a null text is an empty payload, stored as one frame of zeros; equal texts give equal values;
nothing else of a row is read, so extra columns, ties and repeated rows do not matter; an empty table gives an
empty table. A truncated or foreign file gives a scan with ``codec`` null and no ranges.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, mapped, whole_text

FRAME = 64
FRAMES_A_GROUP = 16
TIMESCALE = 600
TICKS = 20
CODEC = b"raw "
#: Boxes that hold boxes; names fixed by the ISO base media format.
NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl")


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes, unit: int = FRAME) -> bytes:
    return data + bytes(-len(data) % unit if data else unit)


def write_container(payload: bytes) -> bytes:
    """A container whose frames are the payload's 64-byte pieces; each sixteenth frame is a key frame and starts a chunk."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"a payload is a positive multiple of {FRAME} bytes")
    frames = len(payload) // FRAME
    chunks = -(-frames // FRAMES_A_GROUP)
    duration = frames * TICKS
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    last = frames - (chunks - 1) * FRAMES_A_GROUP
    runs = [(1, FRAMES_A_GROUP)] * (chunks > 1 or last == FRAMES_A_GROUP) + [(chunks, last)] * (last != FRAMES_A_GROUP)
    entry = box(CODEC, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIII H", 8, 8, 72 << 16, 72 << 16, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))

    def movie(at: int) -> bytes:
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, TICKS)),
            full(b"stss", struct.pack(">I", chunks), (np.arange(chunks, dtype=">u4") * FRAMES_A_GROUP + 1).astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, n, 1) for first, n in runs)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            full(b"co64", struct.pack(">I", chunks), (np.arange(chunks, dtype=np.int64) * (FRAME * FRAMES_A_GROUP) + at).astype(">u8").tobytes()),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, duration, 0x55C4, 0)),
            full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"),
            box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
        )
        track = box(b"trak", full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, duration, 0, 0, 0, 0), matrix, struct.pack(">II", 8 << 16, 8 << 16), flags=7), media)
        return box(b"moov", full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, duration, 1 << 16, 1 << 8), matrix, bytes(24), struct.pack(">I", 2)), track)

    wide = len(payload) + 8 >= 1 << 32
    opening = 16 if wide else 8
    at = len(head) + len(movie(0)) + opening
    return b"".join((head, movie(at), struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat"), payload))


@dataclass
class Scan:
    """What a container tells about its first track with samples."""

    codec: str | None = None
    handler: str | None = None
    timescale: int = 0
    duration: int = 0
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def key_ranges(self) -> np.ndarray:
        """Start and end byte of each key frame."""
        return np.stack((self.starts[self.keys], self.starts[self.keys] + self.sizes[self.keys]), 1)

    def samples(self, data: bytes) -> bytes:
        """The stored bytes of all samples in order; runs of neighbours are copied at once."""
        if not len(self.starts):
            return b""
        cut = np.flatnonzero(self.starts[1:] != self.starts[:-1] + self.sizes[:-1]) + 1
        first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(self.starts)])) - 1
        return b"".join(data[a:b] for a, b in zip(self.starts[first].tolist(), (self.starts[last] + self.sizes[last]).tolist(), strict=True))


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Path, body start and body end of each box, depth first; stops at a box that does not fit."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                return
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield (*path, kind), body, start + size
        if kind in NESTED:
            yield from walk(data, body, start + size, (*path, kind))
        start += size


def _table(data: bytes, at: int, end: int, kind: str, width: int = 1) -> np.ndarray:
    """A counted table after a full box's version and flags."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    if at + 8 + n * width * np.dtype(kind).itemsize > end:
        raise ValueError("a table passes the end of its box")
    return np.frombuffer(data, kind, n * width, at + 8).astype(np.int64).reshape(-1, width)


def _scan_track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> Scan:
    at, _ = boxes[b"mdhd"]
    wide = data[at] == 1
    timescale, duration = struct.unpack_from(">IQ", data, at + 20) if wide else struct.unpack_from(">II", data, at + 12)
    codec = data[boxes[b"stsd"][0] + 12 :][:4].decode("latin-1")
    at, end = boxes[b"stsz"]
    each, n = struct.unpack_from(">II", data, at + 4)
    if not each and at + 12 + 4 * n > end:
        raise ValueError("a table passes the end of its box")
    sizes = np.full(n, each, np.int64) if each else np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
    chunks = (_table(data, *boxes[b"co64"], ">u8") if b"co64" in boxes else _table(data, *boxes[b"stco"], ">u4"))[:, 0]
    runs = _table(data, *boxes[b"stsc"], ">u4", 3)
    spans = np.diff(np.append(runs[:, 0], len(chunks) + 1))
    a_chunk = np.repeat(runs[:, 1], spans)
    of = np.repeat(np.arange(len(chunks)), a_chunk)
    if len(of) != n:
        raise ValueError("chunks and sizes disagree")
    before = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    first = np.concatenate(([0], np.cumsum(a_chunk)))[:-1]
    starts = chunks[of] + before - before[np.minimum(first[of], max(n - 1, 0))] if n else before
    if n and (starts + sizes).max() > len(data):
        raise ValueError("a sample passes the end of the file")
    keys = _table(data, *boxes[b"stss"], ">u4")[:, 0] - 1 if b"stss" in boxes else np.arange(n)
    if b"stts" in boxes and not duration:
        times = _table(data, *boxes[b"stts"], ">u4", 2)
        duration = int((times[:, 0] * times[:, 1]).sum())
    handler = data[boxes[b"hdlr"][0] + 8 :][:4].decode("latin-1") if b"hdlr" in boxes else None
    return Scan(codec, handler, timescale, duration, starts, sizes, keys)


def scan_container(data: bytes) -> Scan:
    """Codec, duration and key frame ranges of a container's first complete track."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, start, end in walk(data):
        if path[-1] == b"trak":
            tracks.append({})
        elif tracks and b"trak" in path:
            tracks[-1].setdefault(path[-1], (start, end))
    for boxes in tracks:
        try:
            return _scan_track(data, boxes)
        except (KeyError, ValueError, struct.error, IndexError):
            continue
    return Scan()


SCAN_SCHEMA = "codec string, handler string, timescale long, duration long, n_samples long, key_starts array<long>, key_ends array<long>"


def scan_media(df: DataFrame, media: str) -> DataFrame:
    """Adds the columns of ``SCAN_SCHEMA`` to rows with a binary column of containers (null: a scan without codec)."""

    def run(batches):
        for batch in batches:
            found = [scan_container(x.as_py() or b"") for x in batch.column(media)]
            own = [pa.array([s.codec for s in found], pa.string()), pa.array([s.handler for s in found], pa.string()), pa.array([s.timescale for s in found], pa.int64()), pa.array([s.duration for s in found], pa.int64()), pa.array([len(s.starts) for s in found], pa.int64()), pa.array([s.key_ranges()[:, 0] for s in found], pa.list_(pa.int64())), pa.array([s.key_ranges()[:, 1] for s in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, *(x.split()[0] for x in SCAN_SCHEMA.split(", "))])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return mapped(df, run, f"{kept}, {SCAN_SCHEMA}")


def feature(scan: Scan) -> str:
    ranges = scan.key_ranges()
    return f"{scan.codec}|{scan.handler}|{scan.timescale}|{scan.duration}|{len(scan.starts)}|{len(ranges)}|{zlib.crc32(ranges.astype('<i8').tobytes()):08x}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration long, timescale long, n_samples long, key_starts array<long>, key_ends array<long>"


def store_texts(docs: DataFrame) -> DataFrame:
    """Stores every text in a container, scans the stored bytes and returns their digests."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column("data"):
                data = text.as_py()
                media = write_container(padded(data))
                scan = scan_container(media)
                back = scan.samples(media)
                out.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(scan), scan.codec, scan.duration, scan.timescale, len(scan.starts), *scan.key_ranges().T.tolist()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *(pa.int64(),) * 3, *(pa.list_(pa.int64()),) * 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds))], [x.split()[0] for x in DIGEST.split(", ")])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("data")), run, DIGEST)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(documents(spark, sf_dir))


QUERIES = {"op6_media_columns": op6_media_columns}
ORACLE_SQL: dict[str, str] = {}
