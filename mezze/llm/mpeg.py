"""MPEG audio columns: writing payloads as frames, and indexing frames, tags, tables and checksums.

The payload goes, losslessly, into the ancillary bytes of Layer III frames whose side information is all zero: silence, to a
decoder. The index resynchronises on frame headers, so junk before, between and after frames is skipped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from mezze.llm.common import map_pandas

# Fixed values of the format: kilobits a second by version (1, then 2 and 2.5) and layer, and samples a second.
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Bytes of Layer III side information by (version 1 or not, mono or not).
SIDE = {(True, False): 32, (True, True): 17, (False, False): 17, (False, True): 9}
#: Frames are written in mono at this rate; 4.5 bytes a frame for each kilobit.
RATE = 32000
UNIT = 64


@lru_cache(maxsize=1 << 14)
def crc16(data: bytes) -> int:
    """The frames' checksum: polynomial 0x8005, from 0xFFFF, high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@lru_cache(maxsize=1 << 12)
def header(four: bytes) -> tuple[int, int, int, int, bool, int] | None:
    """bytes of the frame, samples, rate, layer, has a checksum, bytes of side information; None if it is no header."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bits, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3:
        return None
    kbps, hz, pad = KBPS[1 if version == 3 else 2, layer][bits - 1], RATES[version][rate], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    side = SIDE[version == 3, four[3] >> 6 == 3] if layer == 3 else 0
    return size, samples, hz, layer, not four[1] & 1, side


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _number(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


@lru_cache(maxsize=64)
def _head(kbps: int, checked: bool) -> bytes:
    """Header, checksum and zero side information of a mono frame."""
    four = bytes((0xFF, 0xFA if checked else 0xFB, (KBPS[1, 3].index(kbps) + 1) << 4 | 2 << 2, 0xC0))
    return four + (struct.pack(">H", crc16(four[2:] + bytes(17))) if checked else b"") + bytes(17)


def write(payload: bytes, tags: dict[str, str]) -> bytes:
    """An audio file with `payload` in its frames: a tag, a variable-bitrate table and as few frames as can be."""
    most, head = KBPS[1, 3][-1], len(_head(32, True))
    room = 9 * most // 2 - head
    frames = [_head(most, True) + payload[at : at + room] for at in range(0, len(payload) - len(payload) % room, room)]
    if rest := payload[len(frames) * room :]:
        kbps = next(k for k in KBPS[1, 3] if 9 * k // 2 - head >= len(rest))
        frames.append((_head(kbps, True) + rest).ljust(9 * kbps // 2, b"\0"))
    size = sum(map(len, frames)) + 144
    starts = [144]
    for f in frames:
        starts.append(starts[-1] + len(f))
    toc = bytes(min(255, starts[i * len(frames) // 100] * 256 // size) for i in range(100))
    table = (_head(32, False) + b"Xing" + struct.pack(">III", 15, len(frames), size) + toc + bytes(4)).ljust(144, b"\0")
    body = b""
    for key, value in tags.items():
        text = b"\3" + key.encode() + b"\0" + value.encode()
        body += b"TXXX" + _synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\4\0\0" + _synchsafe(len(body)) + body + table + b"".join(frames)


def _tags(body: bytes, version: int) -> dict[str, str]:
    """Text frames of an ID3v2.3 or 2.4 tag; user-defined ones under their own names."""
    out, at = {}, 0
    while at + 10 <= len(body) and body[at : at + 4].isalnum():
        size = _number(body[at + 4 : at + 8]) if version == 4 else int.from_bytes(body[at + 4 : at + 8], "big")
        name, text = body[at : at + 4].decode("latin-1"), body[at + 10 : at + 10 + size]
        if name[0] == "T" and text:
            said = text[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[text[0] & 3], "replace").rstrip("\0")
            key, _, value = said.partition("\0") if name == "TXXX" else (name, "", said)
            out[key] = value
        at += 10 + size
    return out


def _chained(data: bytes, at: int, end: int) -> bool:
    """Whether a whole frame starts at `at` and one of its kind, or the end, follows it."""
    h = header(data[at : at + 4])
    if not h or at + h[0] > end:
        return False
    n = header(data[at + h[0] : at + h[0] + 4])
    return at + h[0] == end or bool(n) and n[2:4] == h[2:4]


def _sound(data: bytes, at: int, h: tuple) -> bool | None:
    """Whether the checksum of a Layer III frame is right; None if it has none."""
    if not h[4] or h[3] != 3:
        return None
    return struct.unpack_from(">H", data, at + 4)[0] == crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h[5]])


def _frame(data: bytes, at: int, end: int, synced: bool) -> tuple | None:
    """The header at `at`, if a frame starts there: one in a chain, or, right after a frame, one with a right checksum or with
    no other chain inside it."""
    h = header(data[at : at + 4])
    if not h or at + h[0] > end or not (synced or _chained(data, at, end)):
        return None
    if _chained(data, at, end) or _sound(data, at, h):
        return h
    inner = data.find(b"\xff", at + 1, at + h[0])
    while inner >= 0:
        if _chained(data, inner, end):
            return None
        inner = data.find(b"\xff", inner + 1, at + h[0])
    return h


def index(data: bytes) -> dict:
    """What the frames, tags and tables of `data` say, and the payload of the frames' ancillary bytes.

    Where no frame starts, the search goes on at the next byte that may open one. Data without frames has none: counts and
    duration are 0.
    """
    tags: dict[str, str] = {}
    at, end = 0, len(data)
    if data[:3] == b"ID3" and end >= 10:
        size = _number(data[6:10])
        tags = _tags(data[10 : 10 + size], data[3])
        at = 10 + size
    if end >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    offsets, bodies, samples, rate, checked, bad, skipped, declared = [], [], 0, 0, 0, 0, 0, None
    synced = False
    while at + 4 <= end:
        h = _frame(data, at, end, synced)
        if not h:
            step = data.find(b"\xff", at + 1, end)
            skipped += (step if step >= 0 else end) - at
            at, synced = (step if step >= 0 else end), False
            continue
        size, n, rate, layer, protected, side = h
        if not offsets and declared is None and data[at + 4 + side : at + 8 + side] in (b"Xing", b"Info"):
            flags, *_ = struct.unpack_from(">I", data, at + 8 + side)
            declared = struct.unpack_from(">I", data, at + 12 + side)[0] if flags & 1 else -1
        elif not offsets and declared is None and size >= 54 and data[at + 36 : at + 40] == b"VBRI":  # at this place whatever the side information's size
            declared = struct.unpack_from(">I", data, at + 50)[0]
        else:
            body, sound = at + 4 + 2 * protected, _sound(data, at, h)
            checked += sound is not None
            bad += sound is False
            offsets.append(at)
            bodies.append(data[body + side : at + size])
            samples += n
        at += size
        synced = True
    return {"tags": tags, "offsets": offsets, "samples": samples, "rate": rate, "checked": checked, "bad": bad, "skipped": skipped, "declared": declared, "payload": b"".join(bodies)}


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, media (binary): each whole text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, as audio.

    A null text is an empty one: 64 zero bytes. The tag keeps the numbers of bytes without and with padding. One row per
    input row; equal texts give equal media.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            media = []
            for text in batch["text"]:
                raw = (text or "").encode("utf-8", "surrogatepass")
                padded = raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0")
                media.append(write(padded, {"n_bytes": str(len(raw)), "payload_bytes": str(len(padded)), "payload_crc32": f"{zlib.crc32(padded):08x}"}))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "media": media})

    return map_pandas(docs.select("doc_id", "text"), "doc_id", run, "doc_id long, media binary")


INDEXED = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, n_frames int, declared_frames int, n_samples long, sample_rate int, duration_us long, seek_offsets array<long>, n_checked int, n_bad int, n_skipped long, tags map<string,string>"


def index_media(media: DataFrame) -> DataFrame:
    """The columns of INDEXED for each row of doc_id, media; null media count as empty.

    duration_us is exact up to a microsecond (n_samples / sample_rate is exact), seek_offsets are the bytes at which frames
    start, n_bad counts frames whose checksum fails, n_skipped bytes that belong to no frame. n_bytes is null without a tag.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch["doc_id"], batch["media"]):
                data = data or b""
                x = index(data)
                size = x["tags"].get("payload_bytes", "")
                payload = x["payload"][: int(size)] if size.isdigit() else x["payload"]
                n_bytes = x["tags"].get("n_bytes", "")
                duration = x["samples"] * 1_000_000 // x["rate"] if x["rate"] else 0
                rows.append((doc_id, int(n_bytes) if n_bytes.isdigit() else None, payload, len(data), hashlib.sha256(data).hexdigest(), len(x["offsets"]), x["declared"], x["samples"], x["rate"], duration, x["offsets"], x["checked"], x["bad"], x["skipped"], x["tags"]))
            frame = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in INDEXED.split(", ")])
            yield frame.astype({"n_bytes": "Int64", "declared_frames": "Int32"})

    return map_pandas(media.select("doc_id", "media"), "doc_id", run, INDEXED)
