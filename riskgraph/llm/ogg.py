"""Media columns in Ogg (RFC 3533): write, check, reassemble, demultiplex, and derive times.

A payload is stored as unsigned 8-bit samples at RATE a second, dealt frame by frame over two logical streams
whose pages alternate. Each stream opens with a header packet (magic, rate, number of streams, place) on a page
of its own, as the format asks. Reading trusts nothing: it looks for page marks, verifies checksums, follows lacing
values across pages, separates streams by serial number, and takes times from granule positions (samples of the
stream that end on a page; -1 where no packet ends).

Cases: a null text counts as empty (64 zero bytes); a null or damaged media value gives a result with its fault in
`error` and what could be read; repeated rows each get a row; an empty table gives an empty result; other columns
are ignored. Equal texts give equal bytes: serial numbers are fixed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

RATE, FRAME, STREAMS, MAGIC = 8000, 2048, 2, b"RawU8\0\0\0"
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")


def page_checksum(page: bytes) -> int:
    """The format's CRC-32 (polynomial 04c11db7, start 0, not reflected), from zlib's by reversing bits."""
    x = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_FLIP), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + page_checksum(head + body).to_bytes(4, "little") + head[26:] + body


def _pages(serial: int, packets: list[bytes], ends: list[int]) -> list[bytes]:
    """A stream's pages: the header packet alone, then packets over pages of up to 255 lacing values."""
    out = [_page(2, 0, serial, 0, bytes([255] * (len(packets[0]) // 255) + [len(packets[0]) % 255]), packets[0])]
    lacing, body = bytearray(), bytearray()
    goes_on, granule = 0, -1

    def close(kind: int) -> None:
        nonlocal goes_on, granule
        out.append(_page(kind | goes_on, granule, serial, len(out), bytes(lacing), bytes(body)))
        goes_on = int(bool(lacing) and lacing[-1] == 255)
        granule = -1
        lacing.clear()
        body.clear()

    for packet, end in zip(packets[1:], ends[1:], strict=True):
        k, n = 0, len(packet)
        while True:
            if len(lacing) == 255:
                close(0)
            size = min(255, n - k)
            lacing.append(size)
            body += packet[k : k + size]
            k += size
            if size < 255:
                break
        granule = end
    close(4)
    return out


def write_ogg(payload: bytes) -> bytes:
    """The payload as an Ogg file of STREAMS logical streams, their pages in turn."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    per = []
    for s in range(STREAMS):
        own = frames[s::STREAMS]
        packets = [MAGIC + struct.pack("<IBB", RATE, STREAMS, s), *own]
        per.append(_pages(0x5247_0000 + s, packets, [0, *np.cumsum([len(x) for x in own]).tolist()]))
    out = [p[0] for p in per]
    for k in range(1, max(map(len, per))):
        out += [p[k] for p in per if k < len(p)]
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    times: list[float] = field(default_factory=list)  # seconds at which a page's last packet ends
    partial: bytes = b""
    next_page: int = 0
    ended: bool = False


@dataclass
class Media:
    streams: dict[int, Stream]
    pages: int
    bad_pages: int
    error: str | None

    @property
    def payload(self) -> bytes:
        order = {}
        for s in self.streams.values():
            if s.packets and s.packets[0][:8] == MAGIC and len(s.packets[0]) == 14:
                order[s.packets[0][13]] = s.packets[1:]
        n = max(map(len, order.values()), default=0)
        return b"".join(order[k][i] for i in range(n) for k in sorted(order) if i < len(order[k]))


def read_ogg(data: bytes | None) -> Media:
    data, at, out = data or b"", 0, Media({}, 0, 0, None)
    rates: dict[int, int] = {}
    while (at := data.find(b"OggS", at)) >= 0 and at + 27 <= len(data):
        _, version, kind, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = data[at:end]
        if version or len(lacing) < n or end > len(data) or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            out.bad_pages += 1
            at += 4
            continue
        out.pages += 1
        s = out.streams.setdefault(serial, Stream())
        if number != s.next_page:
            s.partial, out.error = b"", out.error or f"stream {serial:x}: page {s.next_page} is missing"
        s.next_page = number + 1
        if not kind & 1 and s.partial:
            s.partial, out.error = b"", out.error or f"stream {serial:x}: a packet does not end"
        body, lost = at + 27 + n, bool(kind & 1) and not s.partial
        start, size = body, 0
        for x in lacing:
            size += x
            if x < 255:
                if not lost:
                    s.packets.append(s.partial + data[start : start + size])
                s.partial, lost = b"", False
                start, size = start + size, 0
        if size and not lost:
            s.partial += data[start : start + size]
        if len(s.packets) == 1 and serial not in rates and s.packets[0][:8] == MAGIC:
            rates[serial] = struct.unpack_from("<I", s.packets[0], 8)[0]
        if granule >= 0 and rates.get(serial):
            s.times.append(granule / rates[serial])
        s.ended |= bool(kind & 4)
        at = end
    if out.bad_pages:
        out.error = out.error or f"{out.bad_pages} pages fail their checksum"
    if not out.streams or not all(s.ended for s in out.streams.values()):
        out.error = out.error or "the file ends early"
    return out


def _padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as an Ogg file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "n_bytes": pa.array([len((x or "").encode()) for x in texts], pa.int64()),
                "media": pa.array([write_ogg(_padded(x)) for x in texts], pa.binary()),
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Adds payload, feature and error, all from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            payloads, features, errors = [], [], []
            for data in b.column("media").to_pylist():
                m = read_ogg(data)
                p = m.payload
                x = np.frombuffer(p, np.uint8).astype(float) - 128.0
                last = [s.times[-1] if s.times else 0.0 for s in m.streams.values()]
                edges = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
                payloads.append(p)
                features.append(
                    f"streams={len(m.streams)};pages={m.pages};packets={sum(len(s.packets) for s in m.streams.values())};seconds={sum(last):.6f};"
                    f"mean={x.mean() if len(x) else 0:.4f};rms={np.sqrt((x * x).mean()) if len(x) else 0:.4f};crossings={edges}"
                )
                errors.append(m.error)
            yield pa.record_batch([*b.columns, pa.array(payloads, pa.binary()), pa.array(features), pa.array(errors, pa.string())], names=[*b.schema.names, "payload", "feature", "error"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string, error string")


def op8_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_media(write_media(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", "error",
    )
