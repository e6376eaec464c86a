import hashlib
import random
import zlib

import pytest

from graphloom.llm import ogg


def plain_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1
            crc &= 0xFFFFFFFF
    return crc


def test_checksum():
    data = bytes(random.Random(1).randrange(256) for _ in range(500))
    assert ogg.checksum(data) == plain_checksum(data)
    assert ogg.checksum(b"") == 0


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 4095, 4096, 4097, 65025, 70000, 300000])
def test_round_trip(n):
    text = "x" * n
    payload, size = ogg.payload_of(text)
    assert size == n and len(payload) % 192 == 0 and payload[:n] == text.encode()
    media = ogg.write_ogg(payload, size)
    got_size, got, said = ogg.features(media)
    assert (got_size, got) == (n, payload) and f"samples={len(payload)}" in said
    streams = ogg.read_ogg(media)
    assert len(streams) == 2 and streams[ogg.SERIAL_PCM].positions[-1] == len(payload)
    assert streams[ogg.SERIAL_PCM].times(ogg.RATE)[-1] == len(payload) / ogg.RATE


def test_damage_is_found():
    media = bytearray(ogg.write_ogg(*ogg.payload_of("hello " * 20000)))
    for at in (30, 200, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.read_ogg(bytes(bad))
    with pytest.raises(ogg.OggError):
        ogg.read_ogg(bytes(media[:-1]))


def test_query_shape(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "é" * 100), (3, "é" * 100), (None, "x"), (4, "y" * 90000)]
    got = ogg.decode_media(ogg.encode_media(docs_of(rows)), with_payload=False).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        payload, n = ogg.payload_of(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert len({tuple(r) for r in got if r.doc_id == 3}) == 1
    back = ogg.decode_media(ogg.encode_media(docs_of([(7, "hi")]))).first()
    assert bytes(back.payload).rstrip() == b"hi"
    assert ogg.encode_media(docs_of([])).count() == 0
