"""Ogg columns: write texts as 8-bit samples in a multiplexed Ogg file, and read any Ogg file back.

Reading finds pages by their capture pattern, verifies each page's checksum, rebuilds packets from lacing
values (over page borders too), separates logical streams by serial number and dates packets by granule
positions. A page whose checksum fails is skipped, reading goes on at the next capture pattern, and packets
that lost a part are left out and counted.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import slices

CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
_HEADER = struct.Struct("<4sBBqIIIB")
_IDENT = struct.Struct("<8sII")  # magic, samples a second, channels
MAGIC, NOTES = b"\x01pcm8\x00\x00\x00", b"\x02notes\x00\x00"
RATE, PACKET, BLOCK = 8000, 4096, 64
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """The container's checksum: polynomial 0x04C11DB7, most significant bit first, start 0. zlib's CRC is the
    same one with bits mirrored, so bytes and result are mirrored and zlib's inversions undone."""
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


class Writer:
    """Pages of one logical stream; a page closes at 255 lacing values, in mid-packet if need be."""

    def __init__(self, serial: int):
        self.serial, self.number, self.pages = serial, 0, []
        self._lacing, self._body, self._granule, self._continued = bytearray(), bytearray(), NO_GRANULE, False

    def _flush(self, last: bool = False, goes_on: bool = False) -> None:
        kind = CONTINUED * self._continued | FIRST * (self.number == 0) | LAST * last
        head = _HEADER.pack(b"OggS", 0, kind, self._granule, self.serial, self.number, 0, len(self._lacing))
        page = bytearray(head + self._lacing + self._body)
        page[22:26] = page_crc(bytes(page)).to_bytes(4, "little")
        self.pages.append(bytes(page))
        self.number += 1
        self._lacing, self._body, self._granule, self._continued = bytearray(), bytearray(), NO_GRANULE, goes_on

    def packet(self, data: bytes, granule: int, flush: bool = False) -> None:
        at, lacing = 0, [255] * (len(data) // 255) + [len(data) % 255]
        for value in lacing:
            if len(self._lacing) == 255:
                self._flush(goes_on=at > 0)
            self._lacing.append(value)
            self._body += data[at : at + value]
            at += value
        self._granule = granule
        if flush:
            self._flush()

    def close(self) -> list[bytes]:
        self._flush(last=True)
        return self.pages


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of the page that completes the packet
    pages: int = 0
    ended: bool = False
    lost: int = 0
    _next: int = 0
    _part: list[bytes] | None = None


def read(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and how many pages failed their checksum or were cut off."""
    streams: dict[int, Stream] = {}
    bad, at = 0, data.find(b"OggS")
    while at >= 0:
        if at + 27 > len(data):
            bad += 1
            break
        _, version, kind, granule, serial, number, crc, n = _HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        size = 27 + n + sum(lacing)
        if version or len(lacing) < n or at + size > len(data) or page_crc(data[at : at + 22] + bytes(4) + data[at + 26 : at + size]) != crc:
            bad += 1
            at = data.find(b"OggS", at + 4)
            continue
        s = streams.setdefault(serial, Stream(serial))
        if number != s._next:  # pages are missing: what was open can't be completed
            s.lost += s._part is not None or not kind & CONTINUED
            s._part = None
        s._next, s.pages, s.ended = number + 1, s.pages + 1, bool(kind & LAST)
        if not kind & CONTINUED:
            s.lost += s._part is not None
            s._part = []
        skip = bool(kind & CONTINUED) and s._part is None
        pos = at + 27 + n
        for value in lacing:
            if not skip:
                s._part.append(data[pos : pos + value])
            pos += value
            if value < 255:
                if skip:
                    s.lost += 1
                else:
                    s.packets.append(b"".join(s._part))
                    s.granules.append(granule)
                skip, s._part = False, []
        if not lacing or lacing[-1] < 255:
            s._part = None if not skip else s._part
        if not s._part:
            s._part = None
        at = data.find(b"OggS", at + size)
    return streams, bad


def timestamps(granules: list[int], rate: int) -> list[int | None]:
    """Microseconds at which packets end; a packet whose page has no granule of its own gets None."""
    return [None if g == NO_GRANULE else g * 1_000_000 // rate for g in granules]


def write_pcm8(payload: bytes, notes: bytes) -> bytes:
    """An Ogg file of two logical streams: 8-bit samples in packets of 4096, and one packet of notes."""
    serial = zlib.crc32(payload)
    audio, text = Writer(serial), Writer((serial + 1) & 0xFFFFFFFF)
    audio.packet(_IDENT.pack(MAGIC, RATE, 1), 0, flush=True)
    text.packet(NOTES, 0, flush=True)
    for at in range(0, len(payload), PACKET):
        end = min(len(payload), at + PACKET)
        audio.packet(payload[at:end], end)
    text.packet(notes, len(payload))
    a, b = audio.close(), text.close()
    return b"".join([a[0], b[0], *a[1:2], *b[1:], *a[2:]])


def read_pcm8(data: bytes) -> tuple[bytes, dict[str, float]]:
    """Samples and measures of the sample stream of a file; raises ValueError if it isn't whole."""
    streams, bad = read(data)
    audio = next((s for s in streams.values() if s.packets and s.packets[0][:8] == MAGIC), None)
    notes = next((s for s in streams.values() if s.packets and s.packets[0][:8] == NOTES), None)
    if bad or audio is None or notes is None or not audio.ended or any(s.lost for s in streams.values()):
        raise ValueError(f"{bad} bad pages, or a stream is missing or incomplete")
    _, rate, _ = _IDENT.unpack(audio.packets[0])
    payload = b"".join(audio.packets[1:])
    if audio.granules[-1] != len(payload):
        raise ValueError("the last granule position is not the number of samples")
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    return payload, {
        "streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": len(audio.packets) - 1,
        "end_us": timestamps(audio.granules, rate)[-1], "mean_x1000": int(x.sum() * 1000 // len(x)), "power": int((x * x).sum() // len(x)),
        "peak": int(x.max()), "crossings": int(np.count_nonzero(np.diff(x >= 128))),
    }


def ogg_packets(media: DataFrame, id_col: str, media_col: str, rate: int = RATE) -> DataFrame:
    """Every packet of every Ogg file: (doc_id, serial, packet, granule, end_us, bytes), by stream and position.

    Null or empty media, or bytes without a page, give no rows; damaged pages are skipped as read() says.
    A null id stays null, repeated rows give repeated packets, other columns are not read.
    """
    src = media.select(F.col(id_col).alias("doc_id"), F.col(media_col).cast("binary").alias("media"))

    def work(batches):
        for batch in slices(batches):
            rows = []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                for serial, s in read(value.as_py() or b"")[0].items():
                    rows += [(i, serial, k, g, t, p) for k, (g, t, p) in enumerate(zip(s.granules, timestamps(s.granules, rate), s.packets, strict=True))]
            names = ["doc_id", "serial", "packet", "granule", "end_us", "bytes"]
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return src.mapInArrow(work, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, serial long, packet int, granule long, end_us long, bytes binary")


def texts_as_ogg(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media: bool = False) -> DataFrame:
    """Each text as samples in an Ogg file, read back: sizes, digests and measures of what was stored.

    The payload is the text in UTF-8 (null: empty) with bytes 0 up to a positive multiple of 64. Equal texts
    give equal files. media=True adds the file itself. A null id stays null, repeated rows give repeated
    results, other columns are not read. One pass, no shuffle; memory follows the longest text.
    """

    def work(batches):
        for batch in slices(batches):
            rows = []
            for value in batch.column(1):
                raw = value.as_py() or b""
                payload = raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))
                stored = write_pcm8(payload, b"bytes=%d" % len(raw))
                back, found = read_pcm8(stored)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), ";".join(f"{k}={v}" for k, v in found.items()), stored))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()][: 8 if media else 7]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names)

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * media
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return src.mapInArrow(work, schema + ", media binary" * media)
