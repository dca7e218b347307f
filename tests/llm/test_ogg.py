import hashlib
import random
import zlib

import pytest

from mosaiq.llm import ogg


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 1 << 31 else c << 1) & 0xFFFFFFFF
    return c


def test_checksum():
    for n in (0, 1, 27, 300):
        x = random.Random(n).randbytes(n)
        assert ogg.checksum(x) == slow_crc(x)


@pytest.mark.parametrize("n", [1, 64, 255, 5999, 6000, 6001, 12000, 65024, 65025, 200_000, 1_000_003])
@pytest.mark.parametrize("streams,packet", [(2, 6000), (1, 255), (3, 70_000)])
def test_round_trip(n, streams, packet):
    x = random.Random(n).randbytes(n)
    media = ogg.write(x, packet, streams=streams)
    back, info = ogg.read(media)
    assert back == x
    assert info["samples"] == n and info["streams"] == streams and info["packets"] == -(-n // packet)
    assert info["duration_us"] == n * 1_000_000 // ogg.RATE


def test_every_damage_is_found():
    media = bytearray(ogg.write(random.Random(1).randbytes(9000)))
    whole = ogg.read(bytes(media))[0]
    for at in range(0, len(media), 101):
        bad = bytearray(media)
        bad[at] ^= 4
        assert ogg.describe(bytes(bad))[-1] is not None
    for end in (1, 26, 40, len(media) - 1):
        assert ogg.describe(bytes(media[:end]))[-1] is not None
    assert whole == random.Random(1).randbytes(9000)
    assert ogg.describe(None)[-1] == "empty" and ogg.describe(b"RIFF" + bytes(60))[-1] == "no capture pattern"


def test_missing_page_is_found():
    media = ogg.write(bytes(200_000))
    second = media.index(b"OggS", media.index(b"OggS", 4) + 4)
    third = media.index(b"OggS", second + 4)
    assert ogg.describe(media[:second] + media[third:])[-1] in ("page order", "packet continuation")


def page_bounds(media):
    at = [k for k in range(len(media)) if media[k : k + 4] == b"OggS"]
    return list(zip(at, at[1:] + [len(media)], strict=True))


def sealed(page):
    return page[:22] + ogg.checksum(page[:22] + bytes(4) + page[26:]).to_bytes(4, "little") + page[26:]


def test_no_page_with_a_good_checksum_stops_the_reader():
    """Bytes of pages are changed, dropped and repeated, and the checksums made right again."""
    rnd = random.Random(4)
    media = ogg.write(bytes(k % 251 for k in range(40_000)), 700, streams=2)
    pages = [media[a:b] for a, b in page_bounds(media)]
    errors = set()
    for _ in range(1500):
        out = [bytearray(p) for p in pages]
        for _ in range(rnd.randint(1, 3)):
            p = rnd.choice(out[:4])
            p[rnd.choice([5, 6, 13, 14, 18, 26, 27, rnd.randrange(len(p))])] = rnd.choice([0, 1, 255, rnd.randrange(256)])
        if rnd.random() < 0.2:
            out[rnd.randrange(4)] = bytearray(rnd.choice(pages))
        n, sha, _, _, _, feature, error = ogg.describe(b"".join(sealed(bytes(p)) for p in out))
        errors.add(error)
        assert (sha is None) == (n is None) and (n is None or feature.startswith("streams="))
    assert {None, "page order", "stream header", "gap in time", "packet continuation"} <= errors


@pytest.mark.parametrize("rate,packet,head", [(0, 6000, None), (8000, 0, None), (8000, 6000, b"PCM8"), (8000, 6000, b"")])
def test_odd_headers(rate, packet, head):
    head = ogg.SETUP.pack(b"PCM8", 1, 1, 0, rate, packet) if head is None else head
    media = b"".join(page for _, page in ogg._pages([(head, 0), (b"abc", 3)], 7))
    assert ogg.describe(media)[-1] == ("stream header" if head else None)


def test_what_was_read_before_the_break_is_kept():
    x = random.Random(9).randbytes(400_000)
    media = bytearray(ogg.write(x))
    bounds = page_bounds(media)
    bounds = [b for b in bounds if b[0] < 200_000]
    media[bounds[-1][0] + 60] ^= 1
    n, sha, _, _, _, feature, error = ogg.describe(bytes(media))
    assert error == "page checksum" and 0 < n < len(x) and sha == hashlib.sha256(x[:n]).hexdigest() and f"samples={n}" in feature


def test_streams_of_other_codecs_are_timed():
    vorbis = b"\x01vorbis" + bytes(5) + (44_100).to_bytes(4, "little") + bytes(14)
    opus = b"OpusHead\x01\x02" + (312).to_bytes(2, "little") + bytes(7)
    theora = b"\x80theora" + bytes(15) + (25).to_bytes(4, "big") + (1).to_bytes(4, "big") + bytes(10) + (6 << 5).to_bytes(2, "big")
    for head, end, name, us in ((vorbis, 44_100 * 3, "vorbis", 3_000_000), (opus, 48_312, "opus", 1_000_000), (theora, 2 << 6 | 48, "theora", 2_000_000), (b"what", 5, "unknown", 0)):
        media = b"".join(page for _, page in ogg._pages([(head, 0), (b"x" * 70_000, end)], 3))
        assert ogg.describe(media)[5:] == (f"streams=1 pages={media.count(b'OggS')} packets=2 codecs={name} duration_us={us}", None)
    two = b"".join(page for _, page in ogg._pages([(vorbis, 0), (b"x", 44_100)], 3)) + b"".join(page for _, page in ogg._pages([(opus, 0), (b"y", 312)], 4))
    assert "streams=2" in ogg.describe(two)[5] and "codecs=opus,vorbis duration_us=1000000" in ogg.describe(two)[5]


def test_table(edge_docs, edge_rows, no_docs):
    out = ogg.media_features(ogg.encode_texts(edge_docs), ["doc_id", "n_bytes"]).collect()
    expected = []
    for r in edge_rows:
        raw = (r[1] or "").encode()
        pad = raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))
        expected.append((str(r[0]), len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == sorted(expected)
    assert all(r.error is None and r.feature.startswith("streams=2 ") for r in out)
    assert len({r.media_sha256 for r in out}) == len({r.payload_sha256 for r in out})
    assert ogg.media_features(ogg.encode_texts(no_docs), ["doc_id"]).collect() == []
