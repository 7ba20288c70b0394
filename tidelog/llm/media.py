"""Ogg: payloads multiplexed into pages and read back.

Writing puts a payload's frames into one logical stream and their index into another, interleaved page by page.
Reading trusts nothing: it finds pages by their capture pattern, verifies each page's checksum, demultiplexes by serial
number, follows page sequence numbers, reassembles packets from lacing values across pages, and derives times from
granule positions.
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

from .common import Scratch

_CONTINUED, _FIRST, _LAST = 1, 2, 4
_HEADER = struct.Struct("<4sBBqIIIB")
_BITS = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
FRAME, RATE = 576, 8000
_NO_PACKET = -1


def ogg_crc(data: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from 0: the mirror image of zlib's."""
    mirrored = zlib.crc32(data.translate(_BITS), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_BITS), "big")


def page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    raw = _HEADER.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing + body
    return raw[:22] + struct.pack("<I", ogg_crc(raw)) + raw[26:]


def _laced(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


class _Stream:
    def __init__(self, serial: int):
        self.serial, self.sequence, self.out = serial, 0, []
        self.lacing, self.body, self.granule, self.open = b"", b"", _NO_PACKET, False

    def put(self, packet: bytes, granule: int) -> list[bytes]:
        """Pages that are full with this packet; it may go on in the next."""
        done = []
        lacing, at = _laced(len(packet)), 0
        while lacing:
            if len(self.lacing) == 255:
                done.append(self.flush(at > 0))
            room = 255 - len(self.lacing)
            piece, lacing = lacing[:room], lacing[room:]
            size = sum(piece)
            self.lacing += piece
            self.body += packet[at : at + size]
            at += size
        self.granule = granule
        return done

    def flush(self, continues: bool = False, last: bool = False) -> bytes:
        flags = _CONTINUED * self.open | _FIRST * (self.sequence == 0) | _LAST * last
        out = page(self.serial, self.sequence, self.granule, flags, self.lacing, self.body)
        self.sequence += 1
        self.lacing, self.body, self.granule, self.open = b"", b"", _NO_PACKET, continues
        return out


def mux(payload: bytes, frame: int = FRAME, rate: int = RATE) -> bytes:
    """8-bit mono samples in packets of ``frame``, and an index stream with the running checksum of every 64th packet."""
    seed = zlib.crc32(payload)
    audio, index = _Stream(seed), _Stream(seed ^ 0xFFFFFFFF)
    out = audio.put(b"PCM8" + struct.pack("<II", rate, frame), 0) + [audio.flush()]
    out += index.put(b"INDX" + struct.pack("<I", frame), 0) + [index.flush()]
    crc = 0
    for k, at in enumerate(range(0, len(payload), frame)):
        packet = payload[at : at + frame]
        crc = zlib.crc32(packet, crc)
        out += audio.put(packet, at + len(packet))
        if k % 64 == 63:
            out += index.put(struct.pack("<QI", at + len(packet), crc), at + len(packet))
            out.append(index.flush())
    out.append(audio.flush(last=True))
    out += index.put(struct.pack("<QI", len(payload), crc), len(payload)) + [index.flush(last=True)]
    return b"".join(out)


@dataclass
class Logical:
    """One demultiplexed stream: packets, and for each page that ends a packet its granule position."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _part: list[bytes] = field(default_factory=list)


class OggError(ValueError):
    pass


def demux(data: bytes) -> dict[int, Logical]:
    """Logical streams by serial number. Raises OggError on lost, damaged or misplaced pages."""
    streams: dict[int, Logical] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError("a page header is cut off")
        mark, version, flags, granule, serial, sequence, crc, n = _HEADER.unpack_from(data, at)
        if mark != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError("a page is cut off")
        raw = data[at:end]
        if ogg_crc(raw[:22] + b"\0\0\0\0" + raw[26:]) != crc:
            raise OggError(f"a page at byte {at} has a wrong checksum")
        s = streams.setdefault(serial, Logical())
        if s.ended or sequence != s.pages or bool(flags & _FIRST) != (sequence == 0):
            raise OggError(f"page {sequence} of stream {serial} is out of order")
        if bool(flags & _CONTINUED) != bool(s._part):
            raise OggError("a packet's continuation is missing")
        finished = False
        for size in lacing:
            s._part.append(data[body : body + size])
            body += size
            if size < 255:
                s.packets.append(b"".join(s._part))
                s._part.clear()
                finished = True
        if finished != (granule != _NO_PACKET):
            raise OggError("a granule position without a packet's end")
        if finished:
            if s.granules and granule < s.granules[-1]:
                raise OggError("granule positions run backwards")
            s.granules.append(granule)
        s.pages += 1
        s.ended = bool(flags & _LAST)
        at = end
    for s in streams.values():
        if not s.ended or s._part:
            raise OggError("a stream has no end")
    return streams


def read(media: bytes) -> tuple[bytes, str]:
    """The payload, and features of the stored form."""
    streams = demux(media)
    audio = next(s for s in streams.values() if s.packets[0][:4] == b"PCM8")
    index = next(s for s in streams.values() if s.packets[0][:4] == b"INDX")
    rate, frame = struct.unpack_from("<II", audio.packets[0], 4)
    payload = b"".join(audio.packets[1:])
    total, crc = struct.unpack("<QI", index.packets[-1])
    if audio.granules[-1] != len(payload) or total != len(payload) or crc != zlib.crc32(payload):
        raise OggError("granule positions, index and samples disagree")
    x = np.frombuffer(payload, np.uint8)
    mean = int(x.sum(dtype=np.int64)) * 1000 // len(x)
    turns = int(np.count_nonzero((x[1:] ^ x[:-1]) & 0x80))
    return payload, f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={sum(len(s.packets) for s in streams.values())};frame={frame};rate={rate};ms={audio.granules[-1] * 1000 // rate};mean_milli={mean};sign_changes={turns}"


def _store(batches):
    for batch in batches:
        for row in range(0, batch.num_rows, 256):
            part = batch.slice(row, 256)
            media, sizes = [], []
            for t in part.column(1):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                sizes.append(len(raw))
                media.append(mux(raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _features(batches):
    for batch in batches:
        rows = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for m in batch.column("media"):
            raw = m.as_buffer().to_pybytes()
            payload, feature = read(raw)
            for k, v in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), feature), strict=True):
                rows[k].append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(v, t) for v, t in zip(rows.values(), kinds, strict=True))], ["doc_id", "n_bytes", *rows])


def store(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The media table: doc_id, n_bytes, media (an Ogg file), read back from the shared folder."""
    scratch = scratch or Scratch(docs.sparkSession, "media")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "UTF-8").alias("raw"))
    return scratch.keep(raw.mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media")


def round_trip(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), from its stored Ogg file.

    The payload is the text's UTF-8 bytes, padded with bytes 255 to a positive multiple of 576; a null text is empty
    and stored as one packet of padding. Equal texts give equal files and values. Null and repeated doc_ids are kept.
    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return store(docs, scratch).mapInArrow(_features, schema)
