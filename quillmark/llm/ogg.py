"""Media columns: texts stored as 8-bit samples in Ogg streams and read back.

A stored value is a physical stream of two logical streams. Payload packets of ``PACKET`` bytes go to them in turn,
so reading has to demultiplex. Each logical stream begins with a header packet on a page of its own (magic, stream
number, rate, packet size); data pages follow, with packets continued over pages where they don't fit. A page's
granule position is the number of payload samples that are complete when the last packet ending on it is decoded, and so
the time stamp is that number over the rate. Reading verifies the checksum and the sequence number of every page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from quillmark.llm._spark import bounded_batches
from quillmark.llm._words import trimmed

# Fixed values of the container format.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET_ENDS = 0xFFFFFFFFFFFFFFFF
MAGIC = b"QMPCM8"

RATE = 8000
PACKET = 24_000
PAD = 64
SERIALS = (0x51, 0x4D)
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The bytes are no whole, undamaged stream."""


def checksum(page: bytes) -> int:
    """The format's CRC (polynomial 0x04c11db7, most significant bit first, from 0), by the mirrored CRC of mirrored bytes."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBQIII", CAPTURE, 0, flags, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


class _Writer:
    """One logical stream: packets go in, whole pages come out."""

    def __init__(self, serial: int):
        self.serial, self.number, self.out = serial, 0, []
        self.lacing, self.body, self.granule, self.open = bytearray(), bytearray(), NO_PACKET_ENDS, False

    def flush(self, flags: int = 0) -> None:
        flags |= CONTINUED if self.open else 0
        self.open = bool(self.lacing) and self.lacing[-1] == 255
        self.out.append(_page(flags | (FIRST if self.number == 0 else 0), self.granule, self.serial, self.number, bytes(self.lacing), bytes(self.body)))
        self.number += 1
        self.lacing, self.body, self.granule = bytearray(), bytearray(), NO_PACKET_ENDS

    def put(self, packet: bytes, granule: int) -> None:
        values = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        while values:
            if len(self.lacing) == 255:
                self.flush()
            take = values[: 255 - len(self.lacing)]
            values = values[len(take) :]
            size = sum(take)
            self.lacing += bytes(take)
            self.body += packet[at : at + size]
            at += size
        self.granule = granule


def write_ogg(payload: bytes, rate: int = RATE) -> bytes:
    """The payload as a multiplexed stream; pages of the logical streams come in turn."""
    streams = [_Writer(s) for s in SERIALS]
    for i, s in enumerate(streams):
        s.put(MAGIC + struct.pack("<BII", i, rate, PACKET), 0)
        s.flush()
    for k, at in enumerate(range(0, len(payload), PACKET)):
        packet = payload[at : at + PACKET]
        streams[k % len(streams)].put(packet, at + len(packet))
    for s in streams:
        s.flush(LAST)
    width = max(len(s.out) for s in streams)
    return b"".join(s.out[i] for i in range(width) for s in streams if i < len(s.out))


def pages(media: bytes):
    """(flags, granule, serial, number, lacing, body) of each page, verified."""
    at = 0
    while at < len(media):
        if media[at : at + 4] != CAPTURE or len(media) < at + 27:
            raise OggError(f"no page at byte {at}")
        version, flags, granule, serial, number, crc = struct.unpack_from("<BBQIII", media, at + 4)
        lacing = media[at + 27 : at + 27 + media[at + 26]]
        start = at + 27 + len(lacing)
        end = start + sum(lacing)
        if version or len(lacing) != media[at + 26] or end > len(media):
            raise OggError(f"cut page at byte {at}")
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        yield flags, granule, serial, number, lacing, media[start:end]
        at = end


def demultiplex(media: bytes) -> dict[int, list[tuple[bytes, int | None]]]:
    """Packets of each logical stream by serial number, in order, with the granule position where a page gives one."""
    found: dict[int, list] = {}
    parts: dict[int, bytearray | None] = {}
    wanted: dict[int, int] = {}
    ended: set[int] = set()
    for flags, granule, serial, number, lacing, body in pages(media):
        if bool(flags & FIRST) != (serial not in found) or number != wanted.get(serial, 0) or serial in ended:
            raise OggError(f"page {number} of stream {serial} out of order")
        wanted[serial] = number + 1
        packets = found.setdefault(serial, [])
        if bool(flags & CONTINUED) != (parts.get(serial) is not None):
            raise OggError(f"page {number} of stream {serial} doesn't continue its packet")
        part, at, last = parts.get(serial), 0, None
        for v in lacing:
            part = bytearray() if part is None else part
            part += body[at : at + v]
            at += v
            if v < 255:
                packets.append((bytes(part), None))
                part, last = None, len(packets) - 1
        parts[serial] = part
        if last is not None:
            packets[last] = (packets[last][0], granule)
        if flags & LAST:
            ended.add(serial)
    if ended != set(found) or any(x is not None for x in parts.values()):
        raise OggError("a stream doesn't end")
    return found


def read_ogg(media: bytes) -> tuple[bytes, int, list[float]]:
    """The payload, its rate, and the times in seconds that pages give, in payload order."""
    heads, queues = {}, {}
    for serial, packets in demultiplex(media).items():
        head = packets[0][0]
        if head[: len(MAGIC)] != MAGIC:
            raise OggError("unknown header packet")
        i, rate, size = struct.unpack_from("<BII", head, len(MAGIC))
        heads[i], queues[i] = (rate, size), packets[1:]
    if not heads or sorted(heads) != list(range(len(heads))):
        raise OggError("a logical stream is missing")
    out, times, done = [], [], 0
    for k in range(sum(len(q) for q in queues.values())):
        q = queues[k % len(queues)]
        if k // len(queues) >= len(q):
            raise OggError("a packet is missing")
        packet, granule = q[k // len(queues)]
        out.append(packet)
        done += len(packet)
        if granule is not None:
            if granule != done:
                raise OggError("a granule position doesn't fit its packets")
            times.append(granule / heads[0][0])
    return b"".join(out), heads[0][0], times


def pad(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % PAD if text else PAD)


def features(payload: bytes, rate: int, times: list[float]) -> str:
    """Duration from granule positions, level, zero crossings and spectral balance of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    power = int((x * x).sum(dtype=np.int64))
    edge = int(((x[1:] - x[:-1]) ** 2).sum(dtype=np.int64))
    last = times[-1] if times else 0.0
    return f"rate={rate};seconds={last:.6f};pages={len(times)};mean={x.mean():.6f};rms={(power / len(x)) ** 0.5:.6f};peak={int(np.abs(x).max())};crossings={crossings};tilt={edge / max(power, 1):.6f}"


def store_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text (null reads as empty) as a stored Ogg value."""

    bounded_batches(docs)
    def store(batches):
        for b in trimmed(batches):
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([write_ogg(pad(x)) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(store, f"doc_id {kind}, n_bytes bigint, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload, tail_crc32, media, feature) of stored values; damaged bytes fail with OggError."""

    def read(batches):
        for b in trimmed(batches):
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = [read_ogg(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([p for p, _, _ in got], pa.binary()), pa.array([zlib.crc32(p[-PAD:]) for p, _, _ in got], pa.int64()), part.column(2), pa.array([features(*x) for x in got], pa.string())],
                    names=["doc_id", "n_bytes", "payload", "tail_crc32", "media", "feature"],
                )

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(read, f"doc_id {kind}, n_bytes bigint, payload binary, tail_crc32 bigint, media binary, feature string")


def media_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the text stored, read back, and digested.

    Null and empty texts store 64 zero bytes. Equal texts give equal values; repeated rows repeat; a null id stays null;
    other columns are ignored. The digests are taken beside the reader, so the media don't travel back to the JVM.
    """

    bounded_batches(docs)
    def digest(batches):
        for b in trimmed(batches):
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                media = part.column(2).to_pylist()
                got = [read_ogg(x) for x in media]
                sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(p) for p, _, _ in got], pa.int64()),
                        sha([p for p, _, _ in got]),
                        pa.array([zlib.crc32(p[-PAD:]) for p, _, _ in got], pa.int64()),
                        pa.array([len(m) for m in media], pa.int64()),
                        sha(media),
                        pa.array([features(*x) for x in got], pa.string()),
                    ],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    stored = store_media(docs, id_col=id_col, text_col=text_col)
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(digest, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
