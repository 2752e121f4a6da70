"""Media columns: Matroska files as binary columns.

``mux`` writes a file whose single audio track holds raw 8-bit samples, one lace
of several frames for each block; ``packets`` parses any file of that container
family into one row for each frame: track, timestamp, byte range, key flag and
lacing. Nothing but the standard library and NumPy is used, and a file is only
ever held by the task that has its row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from leafmill.llm._shared import text_of

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that hold elements.
_PARENTS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
#: What ends an element of unknown size: one that can only stand beside or above it.
_TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}

FRAME_BYTES = 576
SAMPLE_RATE = 8000
FRAME_MS = FRAME_BYTES * 1000 // SAMPLE_RATE
FRAMES_IN_BLOCK = 16
BLOCKS_IN_CLUSTER = 16


def id_bytes(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def size_bytes(n: int, width: int = 0) -> bytes:
    """``n`` as a variable-length integer; the all-ones pattern of a width means unknown and is never used."""
    while width == 0 or n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return id_bytes(kind) + size_bytes(len(body)) + body


def unsigned(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace_sizes(sizes: list[int], lacing: int) -> bytes:
    """The sizes of all frames but the last: nothing for fixed, runs of 255 for Xiph, differences for EBML lacing."""
    if lacing == 2 or len(sizes) == 1:
        return b""
    if lacing == 1:
        return b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    out = [size_bytes(sizes[0])]
    for before, n in zip(sizes, sizes[1:-1]):
        d, width = n - before, 1
        while not -(1 << 7 * width - 1) < d < (1 << 7 * width - 1):
            width += 1
        out.append((d + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big"))
    return b"".join(out)


def block(track: int, ticks: int, frames: list[bytes], lacing: int = 0, key: bool = True) -> bytes:
    """The body of a simple block. lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    head = size_bytes(track) + struct.pack(">hB", ticks, (0x80 if key else 0) | lacing << 1)
    if not lacing:
        return head + frames[0]
    return head + bytes([len(frames) - 1]) + _lace_sizes([len(f) for f in frames], lacing) + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A file of one audio track of unsigned 8-bit samples. Frames have ``FRAME_BYTES`` bytes, the last maybe fewer."""
    head = element(EBML, unsigned(EBML_VERSION, 1) + unsigned(EBML_READ_VERSION, 1) + unsigned(EBML_MAX_ID, 4) + unsigned(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2))
    audio = element(SAMPLING_FREQUENCY, struct.pack(">d", SAMPLE_RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8)
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE)) + element(MUXING_APP, b"leafmill") + element(WRITING_APP, b"leafmill"))
    tracks = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + unsigned(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(AUDIO, audio)))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    in_block, in_cluster = FRAME_BYTES * FRAMES_IN_BLOCK, FRAME_BYTES * FRAMES_IN_BLOCK * BLOCKS_IN_CLUSTER
    for start in range(0, len(payload), in_cluster):
        ms, inner = start // FRAME_BYTES * FRAME_MS, []
        for k in range(start, min(start + in_cluster, len(payload)), in_block):
            frames = [payload[i : i + FRAME_BYTES] for i in range(k, min(k + in_block, len(payload)), FRAME_BYTES)]
            even = all(len(f) == FRAME_BYTES for f in frames)
            inner.append(element(SIMPLE_BLOCK, block(1, k // FRAME_BYTES * FRAME_MS - ms, frames, 0 if len(frames) == 1 else 2 if even else 3)))
        cluster = element(CLUSTER, unsigned(TIMESTAMP, ms) + b"".join(inner))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, ms) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    start: int
    length: int
    key: bool
    lacing: int
    cluster_start: int
    cued: bool


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, bool]:
    """(value, next place, all ones). keep: with the length marker, as ids are written."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - first.bit_length()
    raw = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise ValueError(f"cut off at {at}")
    value = raw & (1 << 7 * width) - 1
    return (raw if keep else value), at + width, value == (1 << 7 * width) - 1


def walk(data: bytes, at: int = 0, end: int | None = None, inside: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, element start, body start, body end) in file order, a parent before what it holds."""
    end = len(data) if end is None else end
    while at < end:
        kind, body, _ = _vint(data, at, keep=True)
        n, body, unknown = _vint(data, body)
        if unknown:
            if kind not in (SEGMENT, CLUSTER):
                raise ValueError(f"element {kind:#x} at {at} has no size")
            stop = end if kind == SEGMENT else _next_top(data, body, end)
        else:
            stop = body + n
            if stop > end:
                raise ValueError(f"element {kind:#x} at {at} ends beyond its parent")
        yield kind, at, body, stop
        if kind in _PARENTS:
            yield from walk(data, body, stop, kind)
        at = stop


def _next_top(data: bytes, at: int, end: int) -> int:
    while at < end:
        kind, body, _ = _vint(data, at, keep=True)
        if kind in _TOP:
            return at
        n, body, _ = _vint(data, body)
        at = body + n
    return end


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(start, length) of each frame after a block's head."""
    if not lacing:
        return [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        each, rest = divmod(end - at, n)
        if rest:
            raise ValueError("frames of a fixed lace don't share its bytes evenly")
        return [(at + i * each, each) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            start = at
            size, at, _ = _vint(data, at)
            if i:
                size += sizes[-1] - (1 << 7 * (at - start) - 1) + 1
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace is longer than its block")
    places, out = at, []
    for size in sizes:
        out.append((places, size))
        places += size
    return out


def parse(data: bytes) -> list[Packet]:
    """All frames in file order; times in nanoseconds. Frames of a lace follow each other by the track's default duration."""
    scale, segment, base, cluster, number = 1_000_000, 0, 0, 0, 0
    duration: dict[int, int] = {}
    cues: set[tuple[int, int]] = set()
    cue_track = 0
    found: list[list] = []
    group: list | None = None
    for kind, start, body, end in walk(data):
        if kind == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[body:end], "big")
        elif kind == SEGMENT:
            segment = body
        elif kind == TRACK_NUMBER:
            number = int.from_bytes(data[body:end], "big")
        elif kind == DEFAULT_DURATION:
            duration[number] = int.from_bytes(data[body:end], "big")
        elif kind == CLUSTER:
            cluster, base = start, 0
        elif kind == TIMESTAMP:
            base = int.from_bytes(data[body:end], "big")
        elif kind in (SIMPLE_BLOCK, BLOCK):
            track, at, _ = _vint(data, body)
            ticks, flags = struct.unpack_from(">hB", data, at)
            lacing = flags >> 1 & 3
            group = [track, (base + ticks) * scale, _frames(data, at + 3, end, lacing), bool(flags & 0x80) or kind == BLOCK, lacing, cluster]
            found.append(group)
        elif kind == REFERENCE_BLOCK and group is not None:
            group[3] = False
        elif kind == CUE_TRACK:
            cue_track = int.from_bytes(data[body:end], "big")
        elif kind == CUE_CLUSTER_POSITION:
            cues.add((cue_track, segment + int.from_bytes(data[body:end], "big")))
    return [Packet(t, ns + i * duration.get(t, 0), at, n, key, lacing, c, (t, c) in cues) for t, ns, frames, key, lacing, c in found for i, (at, n) in enumerate(frames)]


def payload_of(text: str) -> bytes:
    """UTF-8, filled with bytes 255 up to a positive multiple of ``FRAME_BYTES``."""
    raw = text.encode()
    return raw + b"\xff" * (max(FRAME_BYTES, -(-len(raw) // FRAME_BYTES) * FRAME_BYTES) - len(raw))


def feature(samples: bytes, found: list[Packet]) -> str:
    """Counts of packets, length in ms, mean level, energy and sign changes about 128, all as integers."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    changes = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"packets={len(found)};clusters={len({p.cluster_start for p in found})};cued={sum(p.cued for p in found)};ms={len(x) * 1000 // SAMPLE_RATE};sum={int(x.sum())};energy={int((x * x).sum())};crossings={changes}"


def packets(files: DataFrame, media: str = "media", id: str = "doc_id") -> DataFrame:
    """One row for each frame of each file.

    Null files give no rows; a damaged file gives one row with only its id and
    ``error``; repeated rows give their packets again; other columns are left out.
    """
    names = ["track", "timestamp_ns", "start", "length", "key", "lacing", "cluster_start", "cued"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for i, data in zip(x["id"], x["media"]):
                if data is None:
                    continue
                try:
                    rows += [(i, k, *p, None) for k, p in enumerate(parse(bytes(data)))]
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((i, None, *[None] * len(names), str(e)))
            out = pd.DataFrame(rows, columns=["id", "packet", *names, "error"], dtype=object)
            yield out

    kind = files.schema[id].dataType.simpleString()
    schema = f"id {kind}, packet int, track long, timestamp_ns long, start long, length long, key boolean, lacing int, cluster_start long, cued boolean, error string"
    return files.select(files[id].alias("id"), files[media].alias("media")).mapInPandas(run, schema).withColumnRenamed("id", id)


def to_media(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``(id, media binary)``: each whole text (null: empty) as a file; repeated rows stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"id": x["id"], "media": [mux(payload_of(t)) for t in x["text"]]})

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(docs[id].alias("id"), text_of(text).alias("text")).mapInPandas(run, f"id {kind}, media binary").withColumnRenamed("id", id)


def digest(docs: DataFrame) -> DataFrame:
    """Store each text as a file, parse the file, and describe what was read back from its byte ranges.

    One row for each row; null texts count as empty; null and repeated doc_ids
    stay; files are made and read row by row, so nothing is shuffled or gathered.
    """

    def one(text: str) -> tuple:
        media = mux(payload_of(text))
        found = parse(media)
        back = b"".join([media[p.start : p.start + p.length] for p in found])
        return len(text.encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, found)

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            out = pd.DataFrame([one(t) for t in x["text"]], columns=names)
            out.insert(0, "doc_id", x["doc_id"])
            yield out

    return docs.select("doc_id", text_of().alias("text")).mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
