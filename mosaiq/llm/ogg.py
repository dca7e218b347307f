"""Ogg media columns: a writer, a reader that checks everything, and features.

The reader verifies each page's checksum and sequence number, reassembles packets
from lacing values (also across pages), separates the logical streams by serial
number, and derives each packet's time from granule positions. A broken file gives
a row with its error and what was read before the break, up to the first gap in time;
no file stops the job. Streams of other codecs are demultiplexed and timed, not decoded.

The writer stores 8-bit samples in an own mapping: a header packet for each logical
stream, then data packets dealt to the streams in turn. A page's granule position
is the number of samples, over all streams, up to the end of the last packet that
ends on that page, or -1 if none does.

Defined results: null and empty payloads become the padding alone; equal payloads
give equal files, since serial numbers come from the content; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PACKET = 6000
RATE = 8000
STREAMS = 2
MAGIC = b"PCM8"
HEADER = struct.Struct("<4sBBqIIIB")
SETUP = struct.Struct("<4sBBBxII")  # of the first packet: magic, version, streams, this one's place, rate, packet size
CONTINUED, FIRST, LAST = 1, 2, 4

_REVERSE = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """CRC with polynomial 0x04C11DB7, most significant bit first, from 0, without a final xor.

    It is the bit-reversed counterpart of zlib's, so zlib does the work on reversed bits.
    """
    c = zlib.crc32(page.translate(_REVERSE), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSE), "big")


def _page(flags: int, granule: int, serial: int, seq: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, flags, granule, serial, seq, 0, len(lacing))
    crc = checksum(head + lacing + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + lacing + body


def _pages(packets: list[tuple[bytes, int]], serial: int) -> Iterator[tuple[int, bytes]]:
    """Pages of one logical stream as (time of the page's start, bytes)."""
    lacing, body, flags, granule, seq, begin = bytearray(), bytearray(), FIRST, -1, 0, 0
    for k, (packet, end) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while at < len(values):
            part = values[at : at + 255 - len(lacing)]
            lo = at * 255
            lacing += part
            body += packet[lo : lo + sum(part)]
            at += len(part)
            done = at == len(values)
            if done:
                granule = end
            last = done and k == len(packets) - 1
            if k == 0 or last or len(lacing) == 255:  # the header packet has a page of its own
                yield begin, _page(flags | LAST * last, granule, serial, seq, bytes(lacing), bytes(body))
                lacing, body, flags, granule, seq, begin = bytearray(), bytearray(), 0 if done else CONTINUED, -1, seq + 1, end


def write(payload: bytes, packet: int = PACKET, rate: int = RATE, streams: int = STREAMS) -> bytes:
    """The payload as one physical stream of ``streams`` interleaved logical streams."""
    serial = zlib.crc32(payload)
    parts = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    out = []
    for s in range(streams):
        head = SETUP.pack(MAGIC, 1, streams, s, rate, packet)
        own = [(head, 0)] + [(p, k * packet + len(p)) for k, p in enumerate(parts) if k % streams == s]
        out += [(t, 0 if i == 0 else 1, s, i, page) for i, (t, page) in enumerate(_pages(own, (serial + s) & 0xFFFFFFFF))]
    out.sort(key=lambda x: (x[1], x[0], x[2], x[3]))
    return b"".join(x[4] for x in out)


@dataclass
class Stream:
    """One logical stream: its packets, each with the granule position of its page if it is the last one that ends there."""

    serial: int
    packets: list[tuple[bytes, int | None]] = field(default_factory=list)
    open: bytearray | None = None
    pages: int = 0
    ended: bool = False


def demultiplex(media: bytes) -> tuple[dict[int, Stream], int, str | None]:
    """The logical streams by serial number, the number of good pages, and what stopped the walk, if anything did."""
    streams: dict[int, Stream] = {}
    at, pages = 0, 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            return streams, pages, "truncated page header"
        magic, version, flags, granule, serial, seq, crc, n = HEADER.unpack_from(media, at)
        if magic != b"OggS" or version:
            return streams, pages, "no capture pattern"
        lacing = media[at + HEADER.size : at + HEADER.size + n]
        end = at + HEADER.size + n + sum(lacing)
        if len(lacing) < n or end > len(media):
            return streams, pages, "truncated page"
        if checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            return streams, pages, "page checksum"
        s = streams.get(serial) or Stream(serial)
        if s.pages != seq or s.ended or bool(flags & FIRST) != (seq == 0):
            return streams, pages, "page order"
        if bool(flags & CONTINUED) != (s.open is not None):
            return streams, pages, "packet continuation"
        streams[serial] = s
        body, complete, held = at + HEADER.size + n, [], s.open
        for v in lacing:
            held = bytearray() if held is None else held
            held += media[body : body + v]
            body += v
            if v < 255:
                complete.append(bytes(held))
                held = None
        if (granule == -1) != (not complete):
            return streams, pages, "granule position"
        s.packets += [(p, granule if k == len(complete) - 1 else None) for k, p in enumerate(complete)]
        s.open, s.pages, s.ended = held, seq + 1, bool(flags & LAST)
        at, pages = end, pages + 1
    if any(s.open is not None or not s.ended for s in streams.values()):
        return streams, pages, "stream without end"
    return streams, pages, None if pages else "empty"


def samples(streams: dict[int, Stream]) -> tuple[bytes, int, int, str | None]:
    """Of this writer's streams: the payload in time order up to the first gap, its packets, its rate, and what is wrong."""
    timed, rate, wrong = [], RATE, None
    for s in streams.values():
        first = s.packets[0][0] if s.packets else b""
        if len(first) != SETUP.size or first[:4] != MAGIC:
            wrong = wrong or "stream header"
            continue
        _, version, count, place, own_rate, packet = SETUP.unpack(first)
        if version != 1 or not own_rate or not packet or place >= count:
            wrong = wrong or "stream header"
            continue
        rate, stride, page = own_rate, (count - 1) * packet, []
        for p, granule in s.packets[1:]:
            page.append(p)
            if granule is not None:  # times from the page's last packet back
                stop = granule
                for q in reversed(page):
                    timed.append((stop - len(q), q))
                    stop -= len(q) + stride
                page = []
    timed.sort(key=lambda x: x[0])
    at, kept = 0, []
    for start, p in timed:
        if start != at:
            return b"".join(kept), len(kept), rate, wrong or "gap in time"
        kept.append(p)
        at += len(p)
    return b"".join(kept), len(kept), rate, wrong


# How the first packet of a public codec's stream begins, and where its clock stands.
CODECS = {b"\x01vorbis": "vorbis", b"OpusHead": "opus", b"\x7fFLAC": "flac", b"Speex   ": "speex", b"\x80theora": "theora"}


def codec(first: bytes) -> tuple[str, float, int]:
    """Name, granules a second (0 if unknown) and granules before the start, from the first packet of a stream."""
    name = next((v for k, v in CODECS.items() if first.startswith(k)), "unknown")
    number = lambda at, n, order="little": int.from_bytes(first[at : at + n], order)
    if name == "vorbis":
        return name, number(12, 4), 0
    if name == "opus":
        return name, 48_000, number(10, 2)
    if name == "flac":
        return name, number(27, 3, "big") >> 4, 0
    if name == "speex":
        return name, number(36, 4), 0
    if name == "theora" and number(26, 4, "big"):
        return name, number(22, 4, "big") / number(26, 4, "big"), 0
    return name, 0, 0


def duration_us(s: Stream) -> int:
    """When the stream ends, from its last granule position; 0 where its clock is not known."""
    first = s.packets[0][0] if s.packets else b""
    name, rate, skip = codec(first)
    last = next((g for _, g in reversed(s.packets) if g is not None), 0)
    if name == "theora" and len(first) >= 42:
        shift = int.from_bytes(first[40:42], "big") >> 5 & 31
        last = (last >> shift) + (last & (1 << shift) - 1)
    return max(0, int((last - skip) * 1_000_000 // rate)) if rate else 0


class Broken(ValueError):
    """A rule of the container is violated."""


def read(media: bytes) -> tuple[bytes, dict]:
    """The payload in time order, and what the container says; of a broken file neither."""
    streams, pages, error = demultiplex(media)
    payload, packets, rate, wrong = samples(streams)
    if error or wrong:
        raise Broken(error or wrong)
    return payload, said(streams, pages, packets, len(payload), rate)


def said(streams: dict[int, Stream], pages: int, packets: int, n: int, rate: int) -> dict:
    return {"streams": len(streams), "pages": pages, "packets": packets, "samples": n, "rate": rate, "duration_us": n * 1_000_000 // rate}


def _batches(cols: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _encode(it: Iterator[pa.RecordBatch], unit: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            sizes, media = [], []
            for x in part.column(1):
                raw = (x.as_py() or "").encode()
                sizes.append(len(raw))
                media.append(write(raw + bytes(unit * max(1, -(-len(raw) // unit)) - len(raw))))
            yield _batches([part.column(0).to_pylist(), sizes, media], ENCODED)


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: int = 64) -> DataFrame:
    """doc_id, n_bytes (of the text) and media: the padded UTF-8 text as an Ogg file."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(partial(_encode, unit=unit), "doc_id bigint, n_bytes bigint, media binary")


DECODED = pa.schema(
    [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())]
)


def describe(media: bytes | None, tail: int = 64) -> tuple:
    """The DECODED values of one file. Of a broken one they show what was read before the break; of other codecs' streams only the container."""
    media = media or b""
    sha = hashlib.sha256(media).hexdigest()
    streams, pages, error = demultiplex(media)
    own = not streams or any(s.packets and s.packets[0][0].startswith(MAGIC) for s in streams.values())
    if not own:
        names = ",".join(sorted(codec(s.packets[0][0] if s.packets else b"")[0] for s in streams.values()))
        feature = f"streams={len(streams)} pages={pages} packets={sum(len(s.packets) for s in streams.values())} codecs={names} duration_us={max(map(duration_us, streams.values()))}"
        return None, None, None, len(media), sha, feature, error
    payload, packets, rate, wrong = samples(streams)
    error = error or wrong
    if error and not packets:
        return None, None, None, len(media), sha, None, error
    x = np.frombuffer(payload, np.uint8)
    feature = " ".join(f"{k}={v}" for k, v in said(streams, pages, packets, len(payload), rate).items())
    if len(x):
        feature += f" mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)} peak={int(x.max())} zero={int((x == 0).sum())} turns={int((np.diff((x & 128) > 0)).sum())}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-tail:]), len(media), sha, feature, error


def _decode(it: Iterator[pa.RecordBatch], keep: list[str], tail: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        i = batch.schema.get_field_index("media")
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            rows = [describe(x.as_py(), tail) for x in part.column(i)]
            cols = [[r[k] for r in rows] for k in range(len(DECODED))]
            own = [part.column(part.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays(own + [pa.array(c, f.type) for c, f in zip(cols, DECODED, strict=True)], names=[*keep, *DECODED.names])


def media_features(files: DataFrame, keep: list[str], media: str = "media", tail: int = 64) -> DataFrame:
    """The columns ``keep`` of a table of Ogg files, with what reading each file back shows."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema)
    schema = kept + ", payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, error string"
    return files.select(*keep, F.col(media).alias("media")).mapInArrow(partial(_decode, keep=keep, tail=tail), schema)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media_features(encode_texts(docs), ["doc_id", "n_bytes"])
