"""Matroska media columns: EBML elements, clusters, lacing and cues to packet tables.

``write`` stores bytes as 8-bit samples of one audio track; ``parse`` reads any
Matroska file of known or unknown element sizes into its packets, with track,
timestamp and byte range, whatever lacing its blocks use.

Defined results: a null text is an empty one; the payload of an empty text is 64
bytes of 0; a very long text is one file, held whole by its task; null keys and repeated rows are kept; an empty table gives an empty
result; other columns are not read.  A file that breaks off ends its packet
table at the last whole packet.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quire.llm import tokens

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements whose content is elements.
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS}
#: Elements that end a cluster or segment of unknown size.
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

RATE = 8000
FRAME = 400  # samples of a frame: 50 ms
FRAMES = 8  # of a block
BLOCKS = 20  # of a cluster: 8 s, so that block times fit 16 bits


def size_bytes(n: int, width: int = 0) -> bytes:
    """A data size as a variable-length integer; all ones mean unknown and are not used."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(number: int, body: bytes) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def uint(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _block(track: int, at: int, frames: list[bytes], lacing: int) -> bytes:
    head = size_bytes(track) + struct.pack(">hB", at, 0x80 | lacing << 1)
    if lacing == NO_LACING:
        return element(SIMPLE_BLOCK, head + frames[0])
    sizes = [len(f) for f in frames]
    head += bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING and len(sizes) > 1:
        head += size_bytes(sizes[0])
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(n - before) < (1 << 7 * w - 1))
            head += size_bytes(n - before + (1 << 7 * width - 1) - 1, width)
    return element(SIMPLE_BLOCK, head + b"".join(frames))


_HEAD = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(MAX_ID_LENGTH, 4) + uint(MAX_SIZE_LENGTH, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)),
    ),
)


def write(payload: bytes) -> bytes:
    """A Matroska file with the payload as unsigned 8-bit samples at 8 kHz.

    Blocks of equal frames have fixed-size lacing, the last one EBML lacing where
    its frames differ; every cluster has a cue.
    """
    info = element(INFO, uint(TIMESTAMP_SCALE, 10**6) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"quire") + element(WRITING_APP, b"quire"))
    body, cues = [info, _TRACKS], []
    at = len(info) + len(_TRACKS)
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    for c in range(0, len(frames), FRAMES * BLOCKS):
        base = c * FRAME * 1000 // RATE
        parts = [uint(CLUSTER_TIMESTAMP, base)]
        for b in range(c, min(c + FRAMES * BLOCKS, len(frames)), FRAMES):
            own = frames[b : b + FRAMES]
            lacing = NO_LACING if len(own) == 1 else FIXED if len(own[-1]) == FRAME else EBML_LACING
            parts.append(_block(1, b * FRAME * 1000 // RATE - base, own, lacing))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, uint(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


@dataclass(slots=True)
class Packet:
    track: int
    timestamp: int  # ns
    offset: int
    size: int
    keyframe: bool
    cluster: int  # offset of its cluster


@dataclass
class Media:
    packets: list[Packet] = field(default_factory=list)
    #: Track number: codec, type, default duration in ns.
    tracks: dict[int, tuple[str, int, int]] = field(default_factory=dict)
    #: (track, timestamp in ns, offset of the cluster).
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0
    duration: float = 0.0  # in ns
    whole: bool = True


def _vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, int]:
    """(value, width, place after it) of a variable-length integer; value -1 if its bits are all ones."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("broken integer")
    value = int.from_bytes(data[at : at + width], "big")
    if not keep_marker:
        value -= 1 << 7 * width
        if value == (1 << 7 * width) - 1:
            value = -1
    return value, width, at + width


def _laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block whose header ends at ``at``."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == EBML_LACING:
        for k in range(n - 1):
            value, width, at = _vint(data, at, False)
            if value < 0:  # all ones: the largest difference
                value = (1 << 7 * width) - 1
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    else:
        if (end - at) % n:
            raise ValueError("frames of a fixed size don't fill the block")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames beyond the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def _uint(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _float(data: bytes, at: int, end: int) -> float:
    return struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0] if end - at in (4, 8) else 0.0


def parse(data: bytes) -> Media:
    """The packet table, tracks and cues of a file."""
    out = Media()
    scale, ticks, cluster, base, segment = 10**6, 0.0, 0, 0, 0
    track: dict[int, object] = {}
    cue_time, cue_track, cues = 0, 0, []
    ends: list[tuple[int, int]] = []  # (end, id) of the open masters; end -1: unknown
    at = 0
    try:
        while at < len(data):
            while ends and 0 <= ends[-1][0] <= at:
                if ends.pop()[1] == TRACK_ENTRY:
                    out.tracks[track.get(TRACK_NUMBER, 0)] = (track.get(CODEC_ID, ""), track.get(TRACK_TYPE, 0), track.get(DEFAULT_DURATION, 0))
            start = at
            number, _, at = _vint(data, at, True)
            size, _, at = _vint(data, at, False)
            while number in TOP and ends and ends[-1][0] < 0 and (ends[-1][1] == CLUSTER or number in (EBML, SEGMENT)):
                ends.pop()
            end = at + size if size >= 0 else -1
            if end > len(data):
                out.whole = False
            if number in MASTERS:
                ends.append((end, number))
                if number == SEGMENT:
                    segment = at
                elif number == CLUSTER:
                    cluster, base = start, 0
                    out.clusters += 1
                elif number == TRACK_ENTRY:
                    track = {}
                continue
            if end < 0 or end > len(data):
                raise ValueError("broken element")
            if number in (SIMPLE_BLOCK, BLOCK):
                own, _, place = _vint(data, at, False)
                relative, flags = struct.unpack(">hB", data[place : place + 3])
                step = out.tracks.get(own, ("", 0, 0))[2]
                time = (base + relative) * scale
                for k, (offset, length) in enumerate(_laced(data, place + 3, end, flags >> 1 & 3)):
                    out.packets.append(Packet(own, time + k * step, offset, length, bool(flags & 0x80) or number == BLOCK, cluster))
            elif number == CLUSTER_TIMESTAMP:
                base = _uint(data, at, end)
            elif number == TIMESTAMP_SCALE:
                scale = _uint(data, at, end)
            elif number == DURATION:
                ticks = _float(data, at, end)
            elif number in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION):
                track[number] = _uint(data, at, end)
            elif number == CODEC_ID:
                track[number] = data[at:end].rstrip(b"\0").decode("ascii", "replace")
            elif number == CUE_TIME:
                cue_time = _uint(data, at, end)
            elif number == CUE_TRACK:
                cue_track = _uint(data, at, end)
            elif number == CUE_CLUSTER_POSITION:
                cues.append((cue_track, cue_time, segment + _uint(data, at, end)))
            at = end
        for end, number in ends:
            if number == TRACK_ENTRY:
                out.tracks[track.get(TRACK_NUMBER, 0)] = (track.get(CODEC_ID, ""), track.get(TRACK_TYPE, 0), track.get(DEFAULT_DURATION, 0))
            out.whole &= end <= len(data)
    except (ValueError, IndexError, struct.error):
        out.whole = False
    out.duration = ticks * scale
    out.cues = [(t, time * scale, place) for t, time, place in cues]
    return out


def read(data: bytes, media: Media, track: int = 1) -> bytes:
    """The samples of a track, packet by packet."""
    return b"".join(data[p.offset : p.offset + p.size] for p in media.packets if p.track == track)


def padded(text: bytes) -> bytes:
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def feature(media: Media, samples: np.ndarray) -> str:
    """Figures of the container and the signal, as JSON."""
    x = samples.astype(np.float64) - 128
    seek = {(t, time): place for t, time, place in media.cues}
    cued = sum(seek.get((p.track, p.timestamp)) == p.cluster for p in media.packets)
    return json.dumps(
        {
            "codec": media.tracks.get(1, ("",))[0], "packets": len(media.packets), "clusters": media.clusters, "cues": len(media.cues), "cued_packets": cued, "duration_ms": round(media.duration / 1e6, 3),
            "last_ms": round(media.packets[-1].timestamp / 1e6, 3) if media.packets else 0, "mean": round(float(x.mean()), 6), "rms": round(float(np.sqrt((x * x).mean())), 6), "zero_crossings": int((np.signbit(x[1:]) != np.signbit(x[:-1])).sum()),
        },
        sort_keys=True,
    )


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of every row: its text as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, 1):
                texts = [t.encode() for t in pc.fill_null(part.column(1), "").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write(padded(t)) for t in texts], pa.binary())], [id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tokens.tidied(run), f"`{id_col}` {kind}, n_bytes long, media binary")


def packet_table(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each packet of each file: id, packet, track, timestamp_ns, offset, size, keyframe, cluster_offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                found = parse(batch.column(1)[i].as_py() or b"").packets
                if found:
                    key = batch.column(0).take(pa.array([i] * len(found)))
                    yield pa.RecordBatch.from_arrays(
                        [key, pa.array(range(len(found)), pa.int64()), pa.array([p.track for p in found], pa.int64()), pa.array([p.timestamp for p in found], pa.int64()), pa.array([p.offset for p in found], pa.int64()), pa.array([p.size for p in found], pa.int64()), pa.array([p.keyframe for p in found]), pa.array([p.cluster for p in found], pa.int64())],
                        [id_col, "packet", "track", "timestamp_ns", "offset", "size", "keyframe", "cluster_offset"],
                    )

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, media_col).mapInArrow(tokens.tidied(run), f"`{id_col}` {kind}, packet long, track long, timestamp_ns long, offset long, size long, keyframe boolean, cluster_offset long")


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            for part in tokens.slices(batch, 2, 4 * tokens.SLICE_BYTES):
                rows = []
                for data in part.column(2).to_pylist():
                    media = parse(data)
                    back = read(data, media)
                    rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, np.frombuffer(back, np.uint8))))
                made = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return media_column(docs).mapInArrow(tokens.tidied(run), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
