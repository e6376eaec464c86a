"""Media column in the Ogg container: texts as 8-bit samples, and a reader for such streams.

The writer makes one file a row with two logical streams: a PCM stream (unsigned 8-bit, one channel),
whose packets may run over several pages, and a comment stream that carries the unpadded length. The
reader works for any number of interleaved streams: it verifies each page's checksum, joins packets
from lacing values over page ends, deals them out by serial number and takes times from granule
positions.

Defined cases: a null text counts as empty; an empty text is one unit of spaces. Repeated rows give
repeated rows. Damaged bytes raise OggError rather than give a payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import arrow_map, pick

UNIT = 192
RATE = 8000
PACKET = 4096
PAGE_SEGMENTS = 255
SERIAL_PCM, SERIAL_NOTE = 0x50434D31, 0x4E4F5445
CONTINUED, FIRST, LAST = 1, 2, 4
NO_POSITION = -1

HEADER = struct.Struct("<4sBBqIII B")
#: Ogg's checksum is CRC-32 without reflection, initial value or final inversion; zlib's reflected one
#: gives it over bytes with their bits turned round.
TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    reflected = zlib.crc32(page.translate(TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(TURNED), "big")


def page(flags: int, position: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, flags, position, serial, number, 0, len(lacing))
    whole = head + lacing + body
    return whole[:22] + checksum(whole).to_bytes(4, "little") + whole[26:]


def lacing_of(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def pcm_header() -> bytes:
    """Head packet of 8-bit unsigned samples: name, version, format, rate, bits, channels, packet size."""
    return b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, RATE, 8, 1, PACKET, 0)


def write_ogg(payload: bytes, n_bytes: int) -> bytes:
    """The payload as one Ogg file. A page's position is the count of samples in packets that end on it."""
    out = [page(FIRST, 0, SERIAL_PCM, 0, lacing_of(28), pcm_header())]
    note = b"NOTE" + struct.pack("<Q", n_bytes)
    out.append(page(FIRST | LAST, 0, SERIAL_NOTE, 0, lacing_of(len(note)), note))
    ends = list(range(PACKET, len(payload), PACKET)) + [len(payload)]
    lacing, owner, start = bytearray(), [], 0
    for end in ends:
        values = lacing_of(end - start)
        lacing += values
        owner += [NO_POSITION] * (len(values) - 1) + [end]
        start = end
    at, done, number = 0, 0, 1
    while done < len(lacing):
        part = bytes(lacing[done : done + PAGE_SEGMENTS])
        ended = [x for x in owner[done : done + len(part)] if x >= 0]
        flags = (CONTINUED if done and owner[done - 1] < 0 else 0) | (LAST if done + len(part) == len(lacing) else 0)
        size = sum(part)
        out.append(page(flags, ended[-1] if ended else NO_POSITION, SERIAL_PCM, number, part, payload[at : at + size]))
        at, done, number = at + size, done + len(part), number + 1
    return b"".join(out)


@dataclass
class Stream:
    """One logical stream: its packets, each with the position of the page that ends it."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    positions: list[int] = field(default_factory=list)
    pages: int = 0
    joined: int = 0
    ended: bool = False
    open: list[bytes] = field(default_factory=list)

    def times(self, rate: int) -> list[float]:
        """Seconds at which the packets' pages end; of packets that end on one page the last has its time."""
        return [p / rate for p in self.positions if p != NO_POSITION]


def read_ogg(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError("cut off in a page head")
        mark, version, flags, position, serial, number, crc, n = HEADER.unpack_from(data, at)
        if mark != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError("cut off in a page")
        if checksum(b"%b\0\0\0\0%b" % (data[at : at + 22], data[at + 26 : end])) != crc:
            raise OggError(f"wrong checksum at byte {at}")
        if flags & FIRST:
            if serial in streams:
                raise OggError("a stream begins twice")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or s.ended or number != s.pages:
            raise OggError("a page is missing or out of order")
        if bool(flags & CONTINUED) != bool(s.open):
            raise OggError("a packet isn't continued where it broke off")
        s.pages, s.ended = s.pages + 1, bool(flags & LAST)
        ended_here, start, size = 0, body, 0
        for value in lacing:
            size += value
            if value < 255:
                s.joined += bool(s.open)
                s.open.append(data[start : start + size])
                s.packets.append(b"".join(s.open))
                s.positions.append(NO_POSITION)
                s.open, start, size, ended_here = [], start + size, 0, ended_here + 1
        if size:
            s.open.append(data[start : start + size])
        if ended_here:
            s.positions[-1] = position
        at = end
    if any(s.open or not s.ended for s in streams.values()):
        raise OggError("a stream isn't ended")
    return streams


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def encode_media(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, media): each whole text as an Ogg file."""

    def run(batches):
        for b in batches:
            media = [write_ogg(*payload_of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return arrow_map(pick(docs, doc_id="doc_id", text="text"), run, "doc_id long, media binary")


DECODED = "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, feature string"


def features(media: bytes) -> tuple[int, bytes, str]:
    """(unpadded length, payload, feature text) of a stored file."""
    streams = read_ogg(media)
    pcm, note = streams[SERIAL_PCM], streams[SERIAL_NOTE]
    rate = struct.unpack_from(">I", pcm.packets[0], 16)[0]
    payload = b"".join(pcm.packets[1:])
    if pcm.positions[-1] != len(payload):
        raise OggError("the last position isn't the count of samples")
    said = f"streams={len(streams)} pages={sum(s.pages for s in streams.values())} packets={sum(len(s.packets) for s in streams.values())}"
    said += f" joined={pcm.joined} rate={rate} samples={len(payload)} end_us={round(pcm.times(rate)[-1] * 1e6)}"
    return struct.unpack_from("<Q", note.packets[0], 4)[0], payload, said


def decode_media(media: DataFrame, with_payload: bool = True) -> DataFrame:
    """(doc_id, media) -> the payload read back, digests and features; see DECODED. Without the payload
    its digests stand in its place: payload_bytes, payload_sha256 and tail_crc32."""

    def run(batches):
        for b in batches:
            files = b.column(1).to_pylist()
            back = [features(x) for x in files]
            common = [[x[0] for x in back], [len(x) for x in files], [hashlib.sha256(x).hexdigest() for x in files], [x[2] for x in back]]
            cols = {"doc_id": b.column(0), "n_bytes": pa.array(common[0], pa.int64())}
            if with_payload:
                cols["payload"] = pa.array([x[1] for x in back], pa.binary())
            else:
                cols["payload_bytes"] = pa.array([len(x[1]) for x in back], pa.int64())
                cols["payload_sha256"] = pa.array([hashlib.sha256(x[1]).hexdigest() for x in back], pa.string())
                cols["tail_crc32"] = pa.array([zlib.crc32(x[1][-16:]) for x in back], pa.int64())
            cols |= {"media_bytes": pa.array(common[1], pa.int64()), "media_sha256": pa.array(common[2], pa.string()), "feature": pa.array(common[3], pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    schema = DECODED if with_payload else DECODED.replace("payload binary", "payload_bytes long, payload_sha256 string, tail_crc32 long")
    return arrow_map(pick(media, doc_id="doc_id", media="media"), run, schema)
