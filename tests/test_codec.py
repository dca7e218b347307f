import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import color, standard, words
from mosaiq.operators import bitstream, entropy, jpeg, tiles, transform
from mosaiq.sources import images

from . import model

FRAME = "frame_id bigint, width int, height int, quality int, restart_interval int, subsample boolean, emit_jfif boolean"


def test_golden_colours(spark):
    golden = {(0, 0, 0): (0, 128, 128), (255, 255, 255): (255, 128, 128), (255, 0, 0): (76, 85, 255), (0, 255, 0): (149, 43, 21), (0, 0, 255): (28, 255, 107), (128, 128, 128): (128, 128, 128)}
    df = spark.createDataFrame(list(golden), "r int, g int, b int")
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    out = df.select("r", "g", "b", color.luma(r, g, b), color.blue(r, g, b), color.red(r, g, b)).collect()
    assert {tuple(x)[:3]: tuple(x)[3:] for x in out} == golden


def test_tables():
    assert [standard.quant(q, True)[0] for q in (95, 90, 100, 0)] == [2, 3, 1, 255]
    assert [len(standard.header(16, 16, 50, i, jfif=j)) for i, j in ((0, True), (1, True), (0, False))] == [623, 629, 605]
    assert sorted(standard.ZIGZAG) == list(range(64))
    for luma in (True, False):
        for dc in (True, False):
            codes = [format(c, f"0{n}b") for c, n in standard.codes(luma, dc).values()]
            assert not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_dct_and_quantization_against_the_model():
    rnd = np.random.default_rng(1)
    samples = np.concatenate((rnd.integers(-128, 128, (40, 64)), np.full((1, 64), -128), np.full((1, 64), 127), np.arange(64)[None] - 32))
    for quality in (1, 50, 75, 100):
        z = transform.quantized(transform.forward(samples), np.array(standard.quant(quality, True)))[:, standard.ZIGZAG]
        for got, s in zip(z.tolist(), samples.tolist(), strict=True):
            assert got == model.coded(s, quality, True)


def test_segments_of_random_sparse_blocks():
    rnd = random.Random(0x4AC5EED)
    blocks = [[rnd.randint(-15, 15) if rnd.random() < 0.2 else 0 for _ in range(64)] for _ in range(24)]
    blocks += [[0] * 63 + [-11], [1023] + [0] * 63, [-1024] + [1] * 63, [0] * 64]
    component = [k % 3 for k in range(len(blocks))]
    last, text = [0, 0, 0], ""
    for c, z in zip(component, blocks, strict=True):
        text += model.block_bits(z[0] - last[c], z, c == 0)
        last[c] = z[0]
    one = np.zeros(len(blocks), np.int64)
    assert entropy.encode_segments(one, np.array(component), np.array(blocks)) == [model.packed(text)]
    parts = np.arange(len(blocks)) // 5
    alone = [entropy.encode_segments(parts[parts == p], np.array(component)[parts == p], np.array(blocks)[parts == p])[0] for p in range(6)]
    assert entropy.encode_segments(parts, np.array(component), np.array(blocks)) == alone == entropy.encode_segments(parts, np.array(component), np.array(blocks), step=7)
    assert entropy.encode_segments(one[:0], one[:0], np.zeros((0, 64), int)) == []
    with pytest.raises(ValueError):
        entropy.encode_segments(np.array([0]), np.array([0]), np.array([[0, 5000] + [0] * 62]))


CASES = [(8, 8, 50, 0, False, True), (10, 10, 50, 0, False, False), (16, 16, 90, 1, True, True), (17, 33, 100, 3, True, True), (33, 9, 1, 2, False, True), (40, 24, 75, 0, True, False), (1, 1, 30, 5, True, True)]


def _pixel(k):
    return lambda x, y: ((x * 13 + y * 17 + k * 5) & 255, (x * x + 7 * y) & 255, (x * 31 ^ y * 11) & 255)


@pytest.fixture(scope="module")
def encoded(spark):
    rows = [(k, *c) for k, c in enumerate(CASES)] + [(90, 0, 8, 50, 0, False, True), (91, 1921, 8, 50, 0, False, True)]
    frames = spark.createDataFrame(rows, FRAME)
    px = [(k, x, y, *_pixel(k)(x, y)) for k, (w, h, *_) in enumerate(CASES) for y in range(h) for x in range(w)]
    px += [(0, 8, 0, 1, 1, 1), (0, 0, 9, 1, 1, 1), (90, 0, 0, 1, 1, 1)]
    random.Random(1).shuffle(px)
    pixels = spark.createDataFrame(px, "frame_id bigint, x int, y int, r int, g int, b int")
    return pixels, frames, {r.frame_id: bytes(r.jpeg) for r in jpeg.encode(pixels, frames).collect()}


def test_streams_equal_the_model_byte_for_byte(encoded):
    _, _, out = encoded
    assert out.keys() == set(range(len(CASES)))
    for k, c in enumerate(CASES):
        assert out[k] == model.encode(_pixel(k), *c), c


def test_streams_decode_to_the_coefficients(encoded):
    for k, (w, h, q, _, sub, _) in enumerate(CASES):
        width, height, blocks = model.decode(encoded[2][k])
        assert (width, height) == (w, h)
        assert blocks == [(c, model.coded(s, q, c == 0)) for _, _, c, s in model.blocks(_pixel(k), w, h, sub)]


def test_staged_operators_make_the_same_streams(encoded):
    pixels, frames, out = encoded
    assert {r.frame_id: bytes(r.jpeg) for r in jpeg.encode_staged(pixels, frames).collect()} == out


def test_partitions_do_not_matter(encoded):
    pixels, frames, out = encoded
    again = jpeg.encode(pixels.repartition(7, "x"), frames.repartition(2)).collect()
    assert {r.frame_id: bytes(r.jpeg) for r in again} == out


def test_out_of_range_pixels_mark_their_frame(encoded):
    pixels, frames, _ = encoded
    found = {r.frame_id: r for r in tiles.protocol_errors(pixels, frames).collect()}
    assert found[0].protocol_error and found[0].dropped == 2 and found[0].accepted == 64
    assert not found[1].protocol_error


def test_flat_gray_edge_padding(spark):
    frames = spark.createDataFrame([(1, 10, 10, False)], "frame_id bigint, width int, height int, subsample boolean")
    px = images.grid(spark, 10, 10).select(F.lit(1).cast("bigint").alias("frame_id"), "x", "y", *[F.lit(128).alias(c) for c in "rgb"])
    out = tiles.blocks(px, frames).collect()
    assert sorted((r.mcu, r.blk) for r in out) == [(m, b) for m in range(4) for b in range(3)]
    assert all(r.samples == [0] * 64 for r in out)


@pytest.fixture(scope="module")
def good():
    return model.encode(_pixel(3), 40, 24, 50, 2, False, True)


def mutations(data):
    """(rule that must fail, stream) for single faults."""
    find = lambda m: data.index(bytes([0xFF, m]))
    put = lambda at, *v: data[:at] + bytes(v) + data[at + len(v) :]
    cut = lambda at, n: data[:at] + data[at + n :]
    dqt, sof, dht, dri, sos = (find(m) for m in (0xDB, 0xC0, 0xC4, 0xDD, 0xDA))
    second = data.index(b"\xff\xdb", dqt + 2)
    rst = data.index(b"\xff\xd1")
    yield "soi", put(1, 0xD9)
    yield "eoi", data[:-2]
    yield "no_trailing_bytes", data + b"\0"
    yield "walk", put(dri + 1, 0xE5)
    yield "header_order", data[:dqt] + data[dri : dri + 6] + data[dqt:dri] + data[dri + 6 :]
    yield "app0_count", data[:20] + data[2:20] + data[20:]
    yield "app0_is_jfif", put(6, ord("X"))
    yield "sof_count", data[:sof] + data[sof : sof + 19] + data[sof:]
    yield "precision", put(sof + 4, 12)
    yield "size", put(sof + 5, 0, 0)
    yield "component_ids", put(sof + 10, 4)
    yield "sampling", put(sof + 11, 0x21)
    yield "quantizer_selection", put(sof + 12, 1)
    yield "dqt_tables", put(second + 4, 0)
    yield "dqt_nonzero", put(dqt + 30, 0)
    yield "dht_tables", put(dht + 4, 1)
    yield "dht_counts", put(dht + 6, 7)
    yield "dht_prefix_code", put(dht + 5, 3, 9, 0, 0, 0, 0, 0, 0, 0)
    yield "dri_positive", put(dri + 4, 0, 0)
    yield "restarts_need_dri", cut(dri, 6)
    yield "restart_sequence", put(rst + 1, 0xD5)
    yield "restart_count", put(dri + 5, 3)
    yield "scan_components", put(sos + 5, 3)
    yield "scan_tables", put(sos + 6, 0x10)
    yield "spectral", put(sos + 12, 62)
    yield "scan_not_empty", data[: sos + 14] + b"\xff\xd9"


def test_every_fault_fails_its_rule(spark, good):
    rows = [("good", good), ("empty", b""), *mutations(good)]
    df = spark.createDataFrame([(n, bytearray(d)) for n, d in rows], "path string, content binary")
    checked = bitstream.checked(bitstream.walked(df)).where("NOT passed").groupBy("path").agg(F.collect_set("rule").alias("failed"))
    failed = {r.path: set(r.failed) for r in checked.collect()}
    assert "good" not in failed and {"soi", "eoi"} <= failed["empty"]
    for name, _ in rows[2:]:
        assert name in failed.get(name, ()), (name, failed.get(name))


def test_expectations(spark, good):
    df = spark.createDataFrame([("a", bytearray(good))], "path string, content binary")
    right = ("a", 40, 24, 50, 2, False, True)
    schema = FRAME.replace("frame_id bigint", "path string")
    for k, (wrong, rule) in enumerate([(None, None), (41, "expected_size"), (25, "expected_size"), (51, "expected_quantizers"), (4, "expected_interval"), (True, "expected_mode"), (False, "expected_jfif")]):
        e = list(right)
        if k:
            e[k] = wrong
        out = bitstream.expected(bitstream.walked(df), spark.createDataFrame([tuple(e)], schema)).where("NOT passed").collect()
        assert (rule in {r.rule for r in out}) if k else not out


def test_header_payload_may_hold_an_end_marker(spark):
    """At quality 6 the quantization tables hold FF D9; the walk is structural."""
    data = model.encode(_pixel(1), 8, 8, 6, 0, False, True)
    assert data.index(b"\xff\xd9") < len(data) - 2
    df = spark.createDataFrame([("a", bytearray(data))], "path string, content binary")
    assert bitstream.checked(bitstream.walked(df)).where("NOT passed").count() == 0


def test_ppm_rules_and_round_trip(spark):
    body = bytes(range(18))
    files = [("ok", images.ppm_bytes(3, 2, body)), ("comment", b"P6#c\n3 # w\n2\n#x\n255\n" + body), ("magic", b"P5 3 2 255\n" + body), ("top", b"P6 3 2 15\n" + body), ("zero", b"P6 0 2 255\n"), ("word", b"P6 a 2 255\n"), ("short", b"P6 3 2 255\n" + body[:-1]), ("long", b"P6 3 2 255\n" + body + b"x"), ("large", b"P6 5000 2 255\n"), ("cut", b"P6 3"), ("none", None)]
    df = spark.createDataFrame([(n, None if d is None else bytearray(d)) for n, d in files], "path string, content binary")
    found = {r.path: r for r in images.ppm(df).collect()}
    assert bytes(found["ok"].rgb) == bytes(found["comment"].rgb) == body
    assert {n: found[n].error for n, _ in files[2:]} == {"magic": "magic is not P6", "top": "maximum value is not 255", "zero": "dimensions are not positive", "word": "header is not numeric", "short": "payload is truncated", "long": "bytes after the payload", "large": "image is too large", "cut": "truncated header", "none": "truncated header"}
    px = images.pixels(images.ppm(df).where("path = 'ok'")).orderBy("y", "x").collect()
    assert [(r.x, r.y, r.r, r.g, r.b) for r in px] == [(k % 3, k // 3, *body[3 * k : 3 * k + 3]) for k in range(6)]
    w = images.packed_words(images.pixels(images.ppm(df).where("path = 'ok'")), "path").first().words
    assert bytes(w) == b"".join(body[3 * k : 3 * k + 3] + b"\0" for k in range(6))


def test_files_are_written_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a.jpg", bytearray(b"one")), ("b.jpg", bytearray(b"two"))], "name string, content binary")
    images.write_files(rows, f"file://{tmp_path}")
    images.write_files(rows.where("name = 'a.jpg'").withColumn("content", F.lit(b"new")), f"file://{tmp_path}")
    assert (tmp_path / "a.jpg").read_bytes() == b"new" and (tmp_path / "b.jpg").read_bytes() == b"two"
    assert not list(tmp_path.glob("*.part"))


def test_restart_numbers_and_words(spark):
    row = spark.range(1).select(words.restarts(F.lit(11), F.lit(1)), words.restarts(F.lit(1), F.lit(1)), words.restarts(F.lit(5), F.lit(0)), words.merged(F.lit(0x11223344).cast("bigint"), F.lit(0xAABBCCDD), F.lit(0b0101))).first()
    assert row[0] == [*range(8), 0, 1] and row[1] == [] and row[2] == [] and row[3] == 0x11BB33DD
