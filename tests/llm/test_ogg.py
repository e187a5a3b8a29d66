import hashlib
import zlib

from riskgraph.llm.ogg import op8_ogg, page_checksum, read_media, read_ogg, write_ogg

from .cases import awkward, empty, write


def plain_checksum(page):
    x = 0
    for b in page:
        x ^= b << 24
        for _ in range(8):
            x = (x << 1 ^ 0x04C11DB7 if x & 1 << 31 else x << 1) & 0xFFFFFFFF
    return x


def test_checksum():
    for p in (b"", b"OggS\0\2", bytes(range(256)) * 3):
        assert page_checksum(p) == plain_checksum(p)


def test_round_trip_and_times():
    for n in (64, 2048, 4096, 4160, 64 * 3000, 64 * 20001):
        p = bytes((i * 7 + i // 251) % 256 for i in range(n))
        m = read_ogg(write_ogg(p))
        assert m.payload == p and m.error is None and len(m.streams) == 2
        assert abs(sum(s.times[-1] for s in m.streams.values() if s.times) - n / 8000) < 1e-9


def test_damage_is_reported():
    p = bytes(range(256)) * 1000
    good = write_ogg(p)
    for at in (30, 5000, len(good) - 3):
        m = read_ogg(good[:at] + bytes([good[at] ^ 255]) + good[at + 1 :])
        assert m.error and m.payload != p
    assert read_ogg(good[:-100]).error and read_ogg(None).error and read_ogg(b"junk").error
    assert read_ogg(b"xx" + good + b"OggS").payload == p


def test_query(spark, tmp_path):
    rows = awkward(spark)
    got = {}
    for r in op8_ogg(spark, write(spark, tmp_path, rows)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in rows.collect():
        raw = (r.text or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        for x in got[r.doc_id]:
            assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32, x.error) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), None)
            assert x.media_sha256 == hashlib.sha256(write_ogg(p)).hexdigest()
    assert op8_ogg(spark, write(spark, tmp_path, empty(spark))).count() == 0
    bad = spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"junk"))], "doc_id long, n_bytes long, media binary")
    assert all(r.error for r in read_media(bad).collect())
