from mosaiq.sources import files


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é\nx".encode())
    (tmp_path / "b.txt").write_bytes(b"")
    found = files.binaries(spark, str(tmp_path))
    assert {r.path: bytes(r.content) for r in found.collect()} == {f"{tmp_path}/a.txt": "é\nx".encode()}
    assert {r.text for r in files.texts(spark, str(tmp_path)).collect()} == {"é\nx"}
    wanted = spark.createDataFrame([(f"{tmp_path}/{n}.txt",) for n in "abc"], "path string")
    assert sorted(r.path[-5:] for r in files.missing(found, wanted).collect()) == ["b.txt", "c.txt"]


def test_captured_streams(spark):
    end = b"\xff\xd9"
    rows = [("ok", b"ab" + end), ("tail", b"ab" + end + b"x"), ("none", b"abc"), ("next", b"a" * 4094 + end + b"more"), ("cap", b"a" * 99 + end), ("odd", b"\x0f\xfd\x90" + end), ("split", b"a" * 4095 + end)]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    out = {r.path: (r.jpeg and len(r.jpeg), r.error) for r in files.captured(df, 5000).collect()}
    assert out["ok"] == (4, None) and out["next"] == (4096, None) and out["odd"] == (5, None) and out["cap"] == (101, None) and out["split"] == (4097, None)
    assert out["tail"] == (None, "bytes after the end marker") and out["none"] == (None, "no end marker within 5000 bytes")
    assert {r.path for r in files.captured(df, 100).where("error IS NOT NULL").collect()} == {"tail", "none", "next", "cap", "split"}


def test_stream_end_is_byte_aligned(spark):
    rows = [(bytearray(b"\xff\xd8\x0f\xfd\x9f\xff\xd9tail"),), (bytearray(b"\x1f\xfd\x90"),)]
    df = spark.createDataFrame(rows, "content binary")
    assert [r[0] for r in df.select(files.stream_end(df.content)).collect()] == [7, 0]
