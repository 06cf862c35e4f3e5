"""Matroska media columns: write a payload as laced audio blocks, and read any file into a packet table.

The reader walks EBML elements (variable-length ids and sizes, unknown sizes included), tracks, clusters, simple blocks and block
groups with each lacing (none, Xiph, fixed, EBML), and cues. Its packet table has track, timestamp, byte range, key-frame flag and
cluster of each frame. Frames of one lace follow each other by the track's default duration, or by their samples where the codec is PCM. Of a track with
header stripping, the bytes to put before each packet are given. Cues lead to the cluster from which a time is read (``since``). The writer stores bytes losslessly as 8-bit PCM at ``RATE`` samples a second: frames of ``FRAME`` bytes, up
to ``LACED`` frames a block, a cluster per ``PER_CLUSTER`` blocks, and a cue per cluster.

Defined results: a null or empty text becomes 64 zero bytes; very long texts are split into clusters; repeated rows have equal
values; an empty table gives an empty result; extra columns are ignored; read() of a broken file, or of one whose packets are compressed or encrypted, raises
ValueError, and packet_table() has one row with the error for it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the Matroska specification.
EBML, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION, ENCODINGS, ENCODING, COMPRESSION, COMPRESSION_ALGO, COMPRESSION_SETTINGS, ENCRYPTION = 0x23E383, 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255, 0x5035
HEADER_STRIPPING = 3
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS, EBML}
TOP = {CLUSTER, CUES, INFO, TRACKS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

RATE, FRAME, LACED, PER_CLUSTER = 8000, 1024, 8, 16
PAD = 64


# ---- writing ----


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length number."""
    width = width or next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], how: int) -> bytes:
    """Body of a block from its flags' lacing on, without the frame count for no lacing."""
    sizes = [len(f) for f in frames]
    head = b"" if how == NO_LACING else bytes([len(frames) - 1])
    if how == XIPH:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif how == EBML_LACING:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << (7 * w - 1)) - 1)
            head += vint(b - a + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(frames)


def block(track: int, at: int, frames: list[bytes]) -> bytes:
    if len(frames) == 1:
        how = NO_LACING
    elif len(set(map(len, frames))) == 1:
        how = FIXED
    else:
        how = EBML_LACING
    return element(SIMPLE_BLOCK, vint(track) + struct.pack(">hB", at, 0x80 | how << 1) + lace(frames, how))


def write(payload: bytes) -> bytes:
    """A Matroska file with one audio track whose samples are the payload's bytes."""
    header = element(EBML, element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues, step = [info, tracks], [], FRAME * LACED
    at = len(info) + len(tracks)
    for c in range(0, len(payload), step * PER_CLUSTER):
        began = c * 1000 // RATE
        inner = [uint(TIMESTAMP, began)]
        for b in range(c, min(len(payload), c + step * PER_CLUSTER), step):
            part = payload[b : b + step]
            inner.append(block(1, b * 1000 // RATE - began, [part[i : i + FRAME] for i in range(0, len(part), FRAME)]))
        cues.append(element(CUE_POINT, uint(CUE_TIME, began) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        body.append(element(CLUSTER, b"".join(inner)))
        at += len(body[-1])
    return header + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


# ---- reading ----


def read_vint(buf: bytes, at: int, keep_marker: bool) -> tuple[int, int, int]:
    """Value, place after it and width. With keep_marker the value is an id."""
    if at >= len(buf) or not buf[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - buf[at].bit_length()
    if at + width > len(buf):
        raise ValueError(f"cut off at byte {at}")
    n = int.from_bytes(buf[at : at + width], "big")
    return (n if keep_marker else n & ((1 << 7 * width) - 1)), at + width, width


def elements(buf: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int]]:
    """Id, start and end of the body of each element from at to end. One of unknown size goes to the next element that can't be in it."""
    while at < end:
        ident, at, _ = read_vint(buf, at, True)
        size, at, width = read_vint(buf, at, False)
        if size == (1 << 7 * width) - 1:
            stop = end if ident != CLUSTER else next((a for i, a in heads(buf, at, end) if i in TOP), end)
        else:
            stop = at + size
        if stop > end:
            raise ValueError(f"element {ident:#x} ends at byte {stop}, its parent at {end}")
        yield ident, at, stop
        at = stop


def heads(buf: bytes, at: int, end: int) -> Iterator[tuple[int, int]]:
    """Id and place of the elements that follow one another, as long as their sizes are known."""
    while at < end:
        ident, after, _ = read_vint(buf, at, True)
        yield ident, at
        size, after, _ = read_vint(buf, after, False)
        at = after + size


def number(buf: bytes, a: int, b: int) -> int:
    return int.from_bytes(buf[a:b], "big")


def floating(buf: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise ValueError(f"a float of {b - a} bytes at byte {a}")
    return struct.unpack(">f" if b - a == 4 else ">d", buf[a:b])[0] if b > a else 0.0


def lace_sizes(buf: bytes, at: int, end: int, how: int) -> tuple[list[int], int]:
    """Sizes of a block's frames, and where the first begins."""
    if how == NO_LACING:
        return [end - at], at
    if at >= end:
        raise ValueError("a lace without its number of frames")
    n, at = buf[at] + 1, at + 1
    if how == FIXED:
        if (end - at) % n:
            raise ValueError("a fixed lace doesn't divide its block")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    while len(sizes) < n - 1:
        if how == XIPH:
            stop = next((i for i in range(at, end) if buf[i] != 255), end)
            if stop == end:
                raise ValueError("a lace is longer than its block")
            size, at = 255 * (stop - at) + buf[stop], stop + 1
        else:
            size, at, width = read_vint(buf, at, False)
            if sizes:
                size = sizes[-1] + size - ((1 << (7 * width - 1)) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if at > end or min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    return sizes, at


@dataclass
class Media:
    """Packets: (track, timestamp, start, length, key frame, cluster, laced); times in ticks of scale nanoseconds. Clusters: where each begins in the segment, as cues name them."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def read(buf: bytes) -> Media:
    out = Media()
    parts = list(elements(buf, 0, len(buf)))
    if not parts or parts[0][0] != EBML:
        raise ValueError("no EBML header")
    for ident, a, b in parts:
        if ident == SEGMENT:
            read_segment(buf, a, b, out)
    return out


def read_segment(buf: bytes, begin: int, end: int, out: Media) -> None:
    head = begin
    for ident, a, b in elements(buf, begin, end):
        at, head = head - begin, b
        if ident == INFO:
            for i, x, y in elements(buf, a, b):
                if i == TIMESTAMP_SCALE:
                    out.scale = number(buf, x, y)
                elif i == DURATION:
                    out.duration = floating(buf, x, y)
        elif ident == TRACKS:
            out.tracks += [read_track(buf, x, y) for i, x, y in elements(buf, a, b) if i == TRACK_ENTRY]
        elif ident == CLUSTER:
            out.clusters.append(at)
            read_cluster(buf, a, b, out)
        elif ident == CUES:
            for i, x, y in elements(buf, a, b):
                if i == CUE_POINT:
                    read_cue(buf, x, y, out)


def read_track(buf: bytes, a: int, b: int) -> dict:
    track: dict = {"number": 0, "type": 0, "codec": "", "rate": 8000.0, "channels": 1, "bits": 0, "frame_ns": 0, "stripped": b""}
    for i, x, y in elements(buf, a, b):
        if i == TRACK_NUMBER:
            track["number"] = number(buf, x, y)
        elif i == TRACK_TYPE:
            track["type"] = number(buf, x, y)
        elif i == CODEC_ID:
            track["codec"] = buf[x:y].decode("ascii", "replace")
        elif i == DEFAULT_DURATION:
            track["frame_ns"] = number(buf, x, y)
        elif i == ENCODINGS:
            for j, u, v in elements(buf, x, y):
                if j == ENCODING:
                    track["stripped"] = stripped_header(buf, u, v) + track["stripped"]
        elif i == AUDIO:
            for j, u, v in elements(buf, x, y):
                if j == SAMPLING_FREQUENCY:
                    track["rate"] = floating(buf, u, v)
                elif j == CHANNELS:
                    track["channels"] = number(buf, u, v)
                elif j == BIT_DEPTH:
                    track["bits"] = number(buf, u, v)
    return track


def stripped_header(buf: bytes, a: int, b: int) -> bytes:
    out = b""
    for i, x, y in elements(buf, a, b):
        if i == ENCRYPTION:
            raise ValueError("encrypted packets")
        if i == COMPRESSION:
            inner = {j: (u, v) for j, u, v in elements(buf, x, y)}
            if COMPRESSION_ALGO not in inner or number(buf, *inner[COMPRESSION_ALGO]) != HEADER_STRIPPING:
                raise ValueError("packets are compressed otherwise than by header stripping")
            if COMPRESSION_SETTINGS in inner:
                out = buf[slice(*inner[COMPRESSION_SETTINGS])]
    return out


def lasts(track: dict | None, n: int) -> float:
    """Nanoseconds of a frame of n bytes; 0 if the track doesn't say."""
    if track and track["frame_ns"]:
        return track["frame_ns"]
    if track and track["codec"].startswith("A_PCM") and track["bits"] >= 8 and track["rate"] > 0 and track["channels"]:
        return n // (track["bits"] // 8 * track["channels"]) / track["rate"] * 1e9
    return 0


def read_cluster(buf: bytes, a: int, b: int, out: Media) -> None:
    began = 0
    for i, x, y in elements(buf, a, b):
        if i == TIMESTAMP:
            began = number(buf, x, y)
        elif i == SIMPLE_BLOCK:
            read_block(buf, x, y, began, None, out)
        elif i == BLOCK_GROUP:
            inner = list(elements(buf, x, y))
            key = all(j != REFERENCE_BLOCK for j, _, _ in inner)
            for j, u, v in inner:
                if j == BLOCK:
                    read_block(buf, u, v, began, key, out)


def read_block(buf: bytes, a: int, b: int, began: int, key: bool | None, out: Media) -> None:
    track, a, _ = read_vint(buf, a, False)
    if a + 3 > b:
        raise ValueError("a block without its head")
    at, flags = struct.unpack_from(">hB", buf, a)
    sizes, a = lace_sizes(buf, a + 3, b, flags >> 1 & 3)
    of, later = next((t for t in out.tracks if t["number"] == track), None), 0.0
    for n in sizes:
        out.packets.append((track, began + at + round(later / out.scale), a, n, bool(flags & 0x80) if key is None else key, len(out.clusters) - 1, len(sizes)))
        a, later = a + n, later + lasts(of, n + len(of["stripped"]) if of else n)


def read_cue(buf: bytes, a: int, b: int, out: Media) -> None:
    time, places = 0, []
    for i, x, y in elements(buf, a, b):
        if i == CUE_TIME:
            time = number(buf, x, y)
        elif i == CUE_TRACK_POSITIONS:
            inner = {j: number(buf, u, v) for j, u, v in elements(buf, x, y)}
            places.append((inner.get(CUE_TRACK, 0), inner.get(CUE_CLUSTER_POSITION, 0)))
    out.cues += [(time, t, p) for t, p in places]


def since(media: Media, time: int, track: int) -> list[tuple[int, int, int, int, bool, int, int]]:
    """The track's packets from the cluster on that the last cue at or before the time leads to; all of them without such a cue."""
    places = [p for t, of, p in sorted(media.cues) if of == track and t <= time and p in media.clusters]
    first = media.clusters.index(places[-1]) if places else 0
    return [p for p in media.packets if p[0] == track and p[5] >= first]


# ---- tables ----


def payload_of(text: bytes) -> bytes:
    """The bytes and zeros up to a positive multiple of PAD."""
    return text + bytes(max(PAD, -(-len(text) // PAD) * PAD) - len(text))


def features(media: Media, payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8)
    t = media.tracks[0]
    return f"{t['codec']} {t['rate']:.0f}Hz {t['channels']}ch {t['bits']}bit; {len(media.packets)} packets, {len(media.clusters)} clusters, {len(media.cues)} cues, {media.duration:.3f} ms; sum {int(x.sum(dtype=np.int64))}, min {x.min()}, max {x.max()}, crossings {int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))}"


def digest_row(text: bytes) -> tuple:
    stored = write(payload_of(text))
    media = read(stored)
    back = b"".join([stored[s : s + n] for _, _, s, n, *_ in media.packets])
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(stored), hashlib.sha256(stored).hexdigest(), features(media, back)


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [pa.array(c) for c in zip(*(digest_row(t.as_buffer().to_pybytes()) for t in b.column("text")))] if b.num_rows else []
            if columns:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id and media: the file that stores each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([write(payload_of(t.as_buffer().to_pybytes())) for t in b.column("text")], pa.binary())], names=["doc_id", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """A row per packet of the files in (doc_id, media): packet, track, timestamp, start, length, key_frame, cluster, stripped (bytes that belong before
    those in the file) and a null error; one with an error and nothing else for a file that can't be read. A null file has none."""
    names = ["packet", "track", "timestamp", "start", "length", "key_frame", "cluster", "stripped", "error"]

    def rows(file: bytes) -> list[tuple]:
        try:
            m = read(file)
        except ValueError as e:
            return [(None,) * 8 + (str(e),)]
        headers = {t["number"]: t["stripped"] for t in m.tracks}
        return [(i, *p[:6], headers.get(p[0], b""), None) for i, p in enumerate(m.packets)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.binary(), pa.string()]
        for b in batches:
            for i, m in enumerate(b.column("media")):
                found = rows(m.as_py())
                if found:
                    ids = pa.concat_arrays([b.column("doc_id").slice(i, 1)] * len(found))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*found), kinds))], names=["doc_id", *names])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.where("media is not null").select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, packet bigint, track bigint, timestamp bigint, start bigint, length bigint, key_frame boolean, cluster bigint, stripped binary, error string")
