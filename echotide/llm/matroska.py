"""Media columns in Matroska: write payloads as 8-bit PCM audio, parse files into packet tables.

The parser walks variable-length EBML elements: header, segment (of known or unknown
size), info, tracks, clusters with simple blocks and block groups, all four kinds of
lacing, and cues. It yields one row per frame with its timestamp, track and byte range.

Cases: null counts as empty, and an empty text is stored as one frame of padding;
payloads of any length become as many clusters as they need; equal texts give equal
bytes; rows with null or repeated doc_id are kept; an empty table gives an empty
result; other columns are ignored. Broken files raise ValueError in `parse`; the packet
table has one row without a frame and with the error for them.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_map, batch, materialize, table, text_of

#: Element ids of the format.
EBML, DOCTYPE, SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
EBML_VERSION, EBML_READ_VERSION, MAX_ID, MAX_SIZE, DOCTYPE_VERSION, DOCTYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4287, 0x4285
#: Samples of a frame, frames of a laced block, blocks of a cluster, samples a second.
FRAME, LACED, BLOCKS, SAMPLE_RATE = 576, 8, 32, 8000


def vint(n: int, size: int | None = None) -> bytes:
    """A data size, in the fewest bytes unless told."""
    size = size or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * size).to_bytes(size, "big")


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def _uint(name: int, n: int) -> bytes:
    return element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _millis(frame: int) -> int:
    return frame * FRAME * 1000 // SAMPLE_RATE


def mux(payload: bytes) -> bytes:
    """A file with one 8-bit PCM track whose frames are the payload, which is whole frames."""
    frames = len(payload) // FRAME
    head = element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(MAX_ID, 4) + _uint(MAX_SIZE, 8) + element(DOCTYPE, b"matroska") + _uint(DOCTYPE_VERSION, 4) + _uint(DOCTYPE_READ_VERSION, 2))
    info = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", _millis(frames))))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    out, cues, at = [info, tracks], [], len(info) + len(tracks)
    for first in range(0, frames, BLOCKS * LACED):
        base = _millis(first)
        parts = [_uint(CLUSTER_TIME, base)]
        for f in range(first, min(first + BLOCKS * LACED, frames), LACED):
            n = min(LACED, frames - f)
            head_of = b"\x81" + struct.pack(">h", _millis(f) - base) + (bytes([0x80 | 0x04, n - 1]) if n > 1 else b"\x80")  # fixed-size lacing
            parts.append(element(SIMPLE_BLOCK, head_of + payload[f * FRAME : (f + n) * FRAME]))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, base) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        out.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(out) + element(CUES, b"".join(cues)))


def _number(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """A variable-length number at a place: value, place after it, and whether it says unknown."""
    if at >= len(data) or not data[at]:
        raise ValueError("no variable-length number")
    size = 9 - data[at].bit_length()
    if at + size > len(data):
        raise ValueError("number is cut off")
    whole = int.from_bytes(data[at : at + size], "big")
    value = whole & ((1 << 7 * size) - 1)
    return (whole if keep_marker else value), at + size, value == (1 << 7 * size) - 1


def _children(data: bytes, at: int, end: int, stop: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, place, body start, body end) of the elements in a range; of an unknown size it reaches to an id in stop or the end."""
    while at < end:
        name, body, _ = _number(data, at, True)
        size, body, unknown = _number(data, body, False)
        if unknown:
            to = spot = body
            while spot < end:
                child, inner, _ = _number(data, spot, True)
                if child in stop:
                    break
                length, inner, open_ = _number(data, inner, False)
                to = spot = inner if open_ else inner + length  # what is in one of unknown size follows it
        else:
            to = body + size
        if to > end:
            raise ValueError(f"element {name:x} is longer than what holds it")
        yield name, at, body, to
        at = to


@dataclass
class Media:
    """What a file holds."""

    doctype: str = ""
    scale: int = 1_000_000
    duration: float | None = None
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple] = field(default_factory=list)  # cluster, timestamp in ticks, track, start, length, keyframe, lacing
    clusters: list[int] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, cluster's place in the segment


def _laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block's body."""
    if not lacing:
        return [(at, end - at)]
    if at >= end:
        raise ValueError("lacing without a count")
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 1:  # Xiph: bytes of 255 and a last one, summed
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise ValueError("lacing is cut off")
                size, byte, at = size + data[at], data[at], at + 1
                if byte < 255:
                    break
            sizes.append(size)
    elif lacing == 3:  # EBML: the first size, then differences
        for k in range(n - 1):
            before = at
            value, at, _ = _number(data, at, False)
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1))
    else:
        if (end - at) % n:
            raise ValueError("frames of fixed lacing differ in size")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Media:
    """What a file holds; ValueError where it is broken."""
    m, seen = Media(), False

    def uint(a: int, z: int) -> int:
        value = int.from_bytes(data[a:z], "big")
        if value >> 63:
            raise ValueError("number of more than 63 bits")
        return value

    def real(a: int, z: int) -> float:
        if z - a not in (0, 4, 8):
            raise ValueError(f"real number of {z - a} bytes")
        return struct.unpack(">d" if z - a == 8 else ">f", data[a:z])[0] if z > a else 0.0

    def block(a: int, z: int, base: int, cluster: int, key: bool | None) -> None:
        track, at, _ = _number(data, a, False)
        if at + 3 > z:
            raise ValueError("block is cut off")
        time, flags = struct.unpack_from(">hB", data, at)
        if base + time >> 63 not in (0, -1):
            raise ValueError("timestamp of more than 63 bits")
        for start, n in _laced(data, at + 3, z, flags >> 1 & 3):
            m.packets.append((cluster, base + time, track, start, n, bool(flags & 0x80) if key is None else key, flags >> 1 & 3))

    for name, _, a, z in _children(data, 0, len(data)):
        if name == EBML:
            seen = True
            for n, _, b, y in _children(data, a, z):
                if n == DOCTYPE:
                    m.doctype = data[b:y].rstrip(b"\0").decode("ascii", "replace")
        elif name == SEGMENT:
            for n, place, b, y in _children(data, a, z, frozenset([CLUSTER, CUES, INFO, TRACKS])):
                if n == INFO:
                    for k, _, c, x in _children(data, b, y):
                        if k == TIMESTAMP_SCALE:
                            m.scale = uint(c, x)
                        elif k == DURATION:
                            m.duration = real(c, x)
                elif n == TRACKS:
                    for k, _, c, x in _children(data, b, y):
                        if k == TRACK:
                            found: dict = {"number": 0, "type": 0, "codec": "", "rate": 8000.0, "channels": 1, "bits": 0}
                            for k2, _, d, w in _children(data, c, x):
                                if k2 == TRACK_NUMBER:
                                    found["number"] = uint(d, w)
                                elif k2 == TRACK_TYPE:
                                    found["type"] = uint(d, w)
                                elif k2 == CODEC:
                                    found["codec"] = data[d:w].decode("ascii", "replace")
                                elif k2 == AUDIO:
                                    for k3, _, e, v in _children(data, d, w):
                                        if k3 == RATE:
                                            found["rate"] = real(e, v)
                                        elif k3 in (CHANNELS, BIT_DEPTH):
                                            found["channels" if k3 == CHANNELS else "bits"] = uint(e, v)
                            m.tracks.append(found)
                elif n == CLUSTER:
                    base = 0
                    m.clusters.append(place - a)
                    for k, _, c, x in _children(data, b, y):
                        if k == CLUSTER_TIME:
                            base = uint(c, x)
                        elif k == SIMPLE_BLOCK:
                            block(c, x, base, len(m.clusters) - 1, None)
                        elif k == BLOCK_GROUP:
                            inner = list(_children(data, c, x))
                            for k2, _, d, w in inner:
                                if k2 == BLOCK:
                                    block(d, w, base, len(m.clusters) - 1, all(i[0] != 0xFB for i in inner))  # no reference block
                elif n == CUES:
                    for k, _, c, x in _children(data, b, y):
                        time, spots = 0, []
                        for k2, _, d, w in _children(data, c, x):
                            if k2 == CUE_TIME:
                                time = uint(d, w)
                            elif k2 == CUE_POSITIONS:
                                spot = {k3: uint(e, v) for k3, _, e, v in _children(data, d, w)}
                                spots.append((spot.get(CUE_TRACK, 0), spot.get(CUE_CLUSTER, 0)))
                        m.cues += [(time, t, p) for t, p in spots]
    if not seen:
        raise ValueError("no EBML header")
    return m


_MEDIA_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of (doc_id, n_bytes, media): each text as UTF-8, padded by bytes 255 to whole frames."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches):
            texts = b.column("text").cast(pa.binary()).to_pylist()
            yield batch(_MEDIA_ARROW, b.column("doc_id"), list(map(len, texts)), [mux(t + b"\xff" * (FRAME - len(t) if not t else -len(t) % FRAME)) for t in texts])

    return materialize(arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), rows, "doc_id long, n_bytes long, media binary"), "media")


_PACKETS = "doc_id long, packet long, cluster long, track long, time_ns long, start long, length long, keyframe boolean, lacing int, cued boolean, error string"
_PACKETS_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("packet", "cluster", "track", "time_ns", "start", "length")), ("keyframe", pa.bool_()), ("lacing", pa.int32()), ("cued", pa.bool_()), ("error", pa.string())])


def packets(media: DataFrame) -> DataFrame:
    """The packet table: one row per frame of each file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in tokens.slices(iter([whole]), "media"):
                out = []
                for doc, data in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()):
                    try:
                        m = parse(data or b"")
                    except ValueError as e:
                        out.append((doc, *[None] * 9, str(e)))
                        continue
                    cued = {p for _, _, p in m.cues}
                    out += [(doc, k, c, track, time * m.scale, start, n, key, lacing, m.clusters[c] in cued, None) for k, (c, time, track, start, n, key, lacing) in enumerate(m.packets)]
                if out:
                    yield batch(_PACKETS_ARROW, *zip(*out))

    return arrow_map(media.select("doc_id", "media"), rows, _PACKETS)


def read_back(media: DataFrame) -> DataFrame:
    """Per file: the payload that its packets' byte ranges hold, by digests, and features of the container."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.slices(batches, "media"):
            out = []
            for doc, n, data in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                m = parse(data)
                payload = b"".join(data[start : start + size] for _, _, _, start, size, _, _ in m.packets)
                ok = sum(p in set(m.clusters) for _, _, p in m.cues)
                mean = sum(payload) / len(payload)
                feature = f"codec={m.tracks[0]['codec']};bits={m.tracks[0]['bits']};packets={len(m.packets)};clusters={len(m.clusters)};cues={ok};last_ms={m.packets[-1][1] * m.scale // 1_000_000};mean={mean:.6f}"
                out.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield batch(schema, *zip(*out))

    return arrow_map(media, rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9(spark, sf_dir: str) -> DataFrame:
    return read_back(store(table(spark, sf_dir, "documents")))
