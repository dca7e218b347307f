"""Queries of the image encoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color, standard, words
from ..operators import bitstream, entropy, jpeg, tiles, transform
from ..sources import images
from . import inputs as i

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {i.YCC} SELECT frame_id, y // 8 * 2 + x // 8 AS mcu, count(*) AS n,
  CAST(sum((luma - 128) * ((y % 8) * 8 + x % 8 + 1)) AS BIGINT) AS y_sum, CAST(sum((cb - 128) * ((y % 8) * 8 + x % 8 + 1)) AS BIGINT) AS cb_sum, CAST(sum((cr - 128) * ((y % 8) * 8 + x % 8 + 1)) AS BIGINT) AS cr_sum,
  min(luma - 128) AS y_min, max(luma - 128) AS y_max FROM ycc GROUP BY 1, 2""")
def tile_color_sums(spark, sf):
    px = tiles.shifted(i.pixels(spark, sf)).withColumn("pos", (F.col("y") % 8) * 8 + F.col("x") % 8 + 1)
    mcu = (F.floor(F.col("y") / 8) * 2 + F.floor(F.col("x") / 8)).alias("mcu")
    weighted = [F.sum(F.col(c).cast("bigint") * F.col("pos")).alias(n) for c, n in (("ys", "y_sum"), ("cb", "cb_sum"), ("cr", "cr_sum"))]
    return px.groupBy("frame_id", mcu).agg(F.count(F.lit(1)).alias("n"), *weighted, F.min("ys").cast("bigint").alias("y_min"), F.max("ys").cast("bigint").alias("y_max"))


@query(f"WITH {i.YCC} SELECT frame_id, x, y, luma, cb, cr FROM ycc")
def rgb_to_ycbcr(spark, sf):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return i.pixels(spark, sf).select("frame_id", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"), *[c.cast("bigint").alias(n) for c, n in ((color.luma(r, g, b), "luma"), (color.blue(r, g, b), "cb"), (color.red(r, g, b), "cr"))])


@query("""SELECT l_suppkey, w & 255 AS r, (w >> 8) & 255 AS g, (w >> 16) & 255 AS b, w & 16777215 AS word24, w >> 24 & 7 AS keep3, count(*) AS n
  FROM (SELECT l_suppkey, (l_partkey * 65536 + l_orderkey * 7) % 4294967296 AS w FROM lineitem) GROUP BY ALL""")
def pixel_word_unpack(spark, sf):
    w = i.table(spark, sf, "lineitem").select("l_suppkey", ((F.col("l_partkey") * 65536 + F.col("l_orderkey") * 7) % 4294967296).alias("w"))
    r, g, b = words.rgb_of(F.col("w"))
    word, keep = words.trim(F.col("w"), F.shiftrightunsigned("w", 24))
    out = w.select("l_suppkey", r.alias("r"), g.alias("g"), b.alias("b"), word.alias("word24"), keep.alias("keep3"))
    return out.groupBy(out.columns).agg(F.count(F.lit(1)).alias("n"))


def _gen(kind: str, r: str, g: str, b: str) -> str:
    return f"SELECT '{kind}' AS kind, x, y, CAST({r} AS INT) AS r, CAST({g} AS INT) AS g, CAST({b} AS INT) AS b FROM grid"


@query("WITH grid AS (SELECT CAST(k % 40 AS INT) AS x, CAST(k // 40 AS INT) AS y, k FROM range(40 * 24) t(k)), s1 AS (SELECT x, y, xor(k, 1592594996) AS s FROM grid), s2 AS (SELECT x, y, xor(s, (s << 13) & 4294967295) AS s FROM s1), s3 AS (SELECT x, y, xor(s, s >> 17) AS s FROM s2), s4 AS (SELECT x, y, xor(s, (s << 5) & 4294967295) AS s FROM s3) " + " UNION ALL ".join([
    _gen("host", "x * 255 // 39", "y * 255 // 23", "least(255, (x + y) * 127 // 62 + CASE WHEN xor(x // 8, y // 8) & 1 = 1 THEN 48 ELSE 0 END)"),
    _gen("flat", "96", "144", "192"),
    _gen("smooth-gradient", "x * 255 // 39", "y * 255 // 23", "(x + y) * 255 // 62"),
    _gen("checkerboard", "CASE WHEN (x // 4 + y // 4) % 2 = 0 THEN 240 ELSE 16 END", "CASE WHEN (x // 4 + y // 4) % 2 = 0 THEN 32 ELSE 224 END", "CASE WHEN (x // 4 + y // 4) % 2 = 0 THEN 208 ELSE 48 END"),
    _gen("gradient", "(x * 13 + y * 17) & 255", "255 - ((x * 13 + y * 17) & 255)", "((x * 13 + y * 17) & 255) // 2 + 64"),
    "SELECT 'seeded-random', x, y, CAST(s & 255 AS INT), CAST((s >> 8) & 255 AS INT), CAST((s >> 16) & 255 AS INT) FROM s4",
]))
def image_generators(spark, sf):
    out = None
    for kind in ("host", "flat", "smooth-gradient", "checkerboard", "gradient", "seeded-random"):
        part = images.generated(spark, kind, 40, 24).select(F.lit(kind).alias("kind"), "x", "y", "r", "g", "b")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT o_orderkey, w, h, w > 0 AND w <= 1920 AND h > 0 AND h <= 1080 AS ok, CAST(CASE WHEN s THEN ((w + 15) // 16) * ((h + 15) // 16) ELSE ((w + 7) // 8) * ((h + 7) // 8) END AS BIGINT) AS mcus
  FROM (SELECT o_orderkey, CAST(o_custkey * 13 % 2100 AS INT) AS w, CAST(o_orderkey * 7 % 1200 AS INT) AS h, o_orderkey % 2 = 0 AS s FROM orders)""")
def frame_support(spark, sf):
    f = i.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") * 13 % 2100).cast("int").alias("width"), (F.col("o_orderkey") * 7 % 1200).cast("int").alias("height"), (F.col("o_orderkey") % 2 == 0).alias("s"))
    return tiles.supported(f).select("o_orderkey", F.col("width").alias("w"), F.col("height").alias("h"), "ok", words.mcus(F.col("width"), F.col("height"), F.col("s")).alias("mcus"))


@query(f"""WITH {i.PIXELS}, {i.FRAMES} SELECT px.frame_id, bool_or(NOT (x < width AND y < height)) AS protocol_error, CAST(count(*) FILTER (x < width AND y < height) AS BIGINT) AS accepted, CAST(count(*) FILTER (NOT (x < width AND y < height)) AS BIGINT) AS dropped
  FROM px JOIN fr USING (frame_id) GROUP BY 1""")
def pixel_range_errors(spark, sf):
    return tiles.protocol_errors(i.pixels(spark, sf), i.frames(spark, sf))


BLOCK_SQL = f"""WITH {i.YCC}, {i.FRAMES}, side AS (SELECT *, CASE WHEN subsample THEN 16 ELSE 8 END AS sd FROM fr),
  pad AS (SELECT frame_id, subsample, sd, width, ax.v AS x, ay.v AS y, least(ax.v, width - 1) AS sx, least(ay.v, height - 1) AS sy FROM side, LATERAL (SELECT unnest(range(CAST((width + sd - 1) // sd * sd AS BIGINT))) AS v) ax, LATERAL (SELECT unnest(range(CAST((height + sd - 1) // sd * sd AS BIGINT))) AS v) ay),
  s AS (SELECT pad.*, luma - 128 AS ys, cb - 128 AS cb, cr - 128 AS cr, (pad.y // sd) * ((width + sd - 1) // sd) + pad.x // sd AS mcu FROM pad JOIN ycc ON ycc.frame_id = pad.frame_id AND ycc.x = sx AND ycc.y = sy),
  pl AS (SELECT frame_id, mcu, CASE WHEN subsample THEN 2 * ((y % 16) // 8) + (x % 16) // 8 ELSE 0 END AS blk, 0 AS component, (y % 8) * 8 + x % 8 AS pos, ys AS v FROM s
    UNION ALL SELECT frame_id, mcu, 1, 1, (y % 8) * 8 + x % 8, cb FROM s WHERE NOT subsample UNION ALL SELECT frame_id, mcu, 2, 2, (y % 8) * 8 + x % 8, cr FROM s WHERE NOT subsample
    UNION ALL SELECT frame_id, mcu, 4, 1, ((y % 16) // 2) * 8 + (x % 16) // 2, CAST(sum(cb) AS BIGINT) >> 2 FROM s WHERE subsample GROUP BY 1, 2, 5 UNION ALL SELECT frame_id, mcu, 5, 2, ((y % 16) // 2) * 8 + (x % 16) // 2, CAST(sum(cr) AS BIGINT) >> 2 FROM s WHERE subsample GROUP BY 1, 2, 5)"""


@query(BLOCK_SQL + " SELECT frame_id, CAST(mcu AS BIGINT) AS mcu, CAST(blk AS INT) AS blk, CAST(component AS INT) AS component, string_agg(CAST(v AS VARCHAR), ',' ORDER BY pos) AS samples FROM pl GROUP BY ALL")
def tiled_blocks(spark, sf):
    out = tiles.blocks(i.pixels(spark, sf), i.frames(spark, sf))
    return out.select("frame_id", "mcu", "blk", "component", F.array_join("samples", ",").alias("samples"))


@query(SQL["tiled_blocks"])
def tiled_blocks_relational(spark, sf):
    out = tiles.blocks_relational(i.pixels(spark, sf), i.frames(spark, sf))
    return out.select("frame_id", "mcu", "blk", "component", F.array_join("samples", ",").alias("samples"))


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows) + ")"


BASE = _values([(k, a, b, standard.ZIGZAG.index(k)) for k, (a, b) in enumerate(zip(standard.LUMA, standard.CHROMA, strict=True))]) + " base(pos, l, c, zigzag)"
QUANT = f"""qt AS (SELECT quality, luma, CAST(pos AS INT) AS pos, CAST(zigzag AS INT) AS zigzag, CAST(greatest(1, least(255, (CASE WHEN luma THEN l ELSE c END * scale + 50) // 100)) AS INT) AS q
  FROM (SELECT CAST(k AS INT) AS quality, CASE WHEN greatest(k, 1) < 50 THEN 5000 // greatest(k, 1) ELSE 200 - 2 * least(k, 100) END AS scale FROM range(0, 128) t(k)), {BASE}, (VALUES (true), (false)) m(luma))"""


@query(f"WITH {QUANT} SELECT * FROM qt")
def quantization_tables(spark, sf):
    base = spark.createDataFrame([(p, l, v, standard.ZIGZAG.index(p)) for l, t in ((True, standard.LUMA), (False, standard.CHROMA)) for p, v in enumerate(t)], "pos int, luma boolean, base int, zigzag int")
    each = spark.range(128).select(F.col("id").cast("int").alias("quality")).crossJoin(F.broadcast(base))  # 128 rows of the standard
    return each.select("quality", "luma", "pos", "zigzag", color.quant_entry(F.col("base"), F.col("quality")).alias("q"))


COSINE = _values([(u, x, w) for u, row in enumerate(standard.COSINE) for x, w in enumerate(row)]) + " cos(u, x, w)"
DCT = f"""WITH {i.BLOCKS}, cs AS (SELECT * FROM {COSINE}), p1 AS (SELECT vec_id, component, quality, pos // 8 AS y, u AS vv, CAST(sum(w * v) AS BIGINT) AS p FROM b JOIN cs ON cs.x = pos % 8 GROUP BY ALL),
  p2 AS (SELECT vec_id, component, quality, u * 8 + vv AS pos, CAST(sum(w * p) AS BIGINT) AS t FROM p1 JOIN cs ON cs.x = y GROUP BY ALL),
  f AS (SELECT vec_id, component, quality, CAST(pos AS INT) AS pos, CASE WHEN t < 0 THEN -((-t + 134217728) >> 28) ELSE (t + 134217728) >> 28 END AS f FROM p2)"""


@query(DCT + " SELECT vec_id, pos, f FROM f")
def dct_coefficients(spark, sf):
    return transform.dct_relational(i.block_places(spark, sf), ["vec_id"])


CODED = DCT + f""", {QUANT}, z AS (SELECT vec_id, f.component, zigzag AS k, CASE WHEN f < 0 THEN -((-f + q // 2) // q) ELSE (f + q // 2) // q END AS c FROM f JOIN qt ON qt.quality = f.quality AND qt.luma = (f.component = 0) AND qt.pos = f.pos)"""


@query(CODED + " SELECT vec_id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY k) AS coeffs FROM z GROUP BY 1")
def quantized_blocks(spark, sf):
    out = transform.coded(i.block_samples(spark, sf))
    return out.select((F.col("frame_id") * 32 + F.col("mcu")).alias("vec_id"), F.array_join("coeffs", ",").alias("coeffs"))


@query(CODED + " SELECT vec_id, k, c FROM z WHERE c <> 0")
def quantized_relational(spark, sf):
    f = transform.dct_relational(i.block_places(spark, sf).withColumn("luma", F.col("component") == 0), ["vec_id", "quality", "luma"])
    z = transform.quantized_relational(f, transform.quant_tables(spark, list(range(1, 101))))
    return z.where("c <> 0").select("vec_id", F.col("zigzag").alias("k"), "c")


@query("""SELECT v, CASE WHEN v = 0 THEN 0 ELSE CAST(length(ltrim(CAST(CAST(abs(v) AS BIT) AS VARCHAR), '0')) AS INT) END AS category,
  CASE WHEN v >= 0 THEN v ELSE (1 << CAST(length(ltrim(CAST(CAST(abs(v) AS BIT) AS VARCHAR), '0')) AS INT)) - 1 + v END AS amplitude FROM (SELECT k - 2047 AS v FROM range(0, 4095) t(k))""")
def magnitude_codes(spark, sf):
    v = spark.range(4095).select((F.col("id") - 2047).alias("v"))
    return v.select("v", color.category(F.col("v")).alias("category"), color.amplitude(F.col("v")).alias("amplitude"))


def _huffman_rows():
    for luma in (True, False):
        for dc in (True, False):
            bits, symbols = standard.huffman(luma, dc)
            lengths = [n for n, k in enumerate(bits, 1) for _ in range(k)]
            yield from ((str(luma).lower(), str(dc).lower(), at, s, n) for at, (s, n) in enumerate(zip(symbols, lengths, strict=True)))


HUFFMAN = f"""hf AS (SELECT luma, dc, CAST(symbol AS INT) AS symbol, CAST(coalesce(sum(1 << (16 - len)) OVER (PARTITION BY luma, dc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) >> CAST(16 - len AS INT) AS code, CAST(len AS INT) AS length
  FROM {_values(_huffman_rows())} h(luma, dc, ord, symbol, len))"""


@query(f"WITH {HUFFMAN} SELECT luma, dc, symbol, code, length FROM hf")
def huffman_codes(spark, sf):
    return entropy.huffman_table(spark).select("luma", "dc", "symbol", F.col("code").cast("bigint").alias("code"), "length")


TOKENS = CODED + f""", {HUFFMAN}, seg AS (SELECT vec_id // 32 AS frame_id, CAST((vec_id % 32) // 8 AS INT) AS segment, vec_id % 32 AS mcu, component, k, c FROM z),
  dc AS (SELECT frame_id, segment, mcu, component, 0 AS tok, true AS dc, c - coalesce(lag(c) OVER (PARTITION BY frame_id, segment, component ORDER BY mcu), 0) AS value FROM seg WHERE k = 0),
  gp AS (SELECT *, k - coalesce(lag(k) OVER (PARTITION BY frame_id, mcu ORDER BY k), 0) - 1 AS gap FROM seg WHERE k > 0 AND c <> 0),
  cat AS (SELECT frame_id, segment, mcu, component, tok, dc, value, CASE WHEN value = 0 THEN 0 ELSE length(ltrim(CAST(CAST(abs(value) AS BIT) AS VARCHAR), '0')) END AS size, run, sym FROM (
    SELECT frame_id, segment, mcu, component, tok, dc, value, 0 AS run, NULL AS sym FROM dc
    UNION ALL SELECT frame_id, segment, mcu, component, k * 2, false, c, gap % 16, NULL FROM gp
    UNION ALL SELECT frame_id, segment, mcu, component, (k - gap + n * 16) * 2 - 1, false, 0, 15, 240 FROM gp, LATERAL (SELECT unnest(range(1, CAST(gap // 16 + 1 AS BIGINT))) AS n) r
    UNION ALL SELECT frame_id, segment, mcu, component, 999, false, 0, 0, 0 FROM (SELECT frame_id, segment, mcu, component, max(CASE WHEN k > 0 AND c <> 0 THEN k ELSE 0 END) AS last FROM seg GROUP BY ALL) WHERE last < 63)),
  tk AS (SELECT frame_id, segment, mcu, tok, lpad(ltrim(CAST(CAST(code AS BIT) AS VARCHAR), '0'), length, '0') || CASE WHEN size = 0 THEN '' ELSE lpad(ltrim(CAST(CAST(CASE WHEN value >= 0 THEN value ELSE (1 << CAST(size AS INT)) - 1 + value END AS BIT) AS VARCHAR), '0'), CAST(size AS INT), '0') END AS bits
    FROM cat JOIN hf ON hf.luma = (component = 0) AND hf.dc = cat.dc AND hf.symbol = coalesce(sym, CASE WHEN cat.dc THEN size ELSE run * 16 + size END))"""


@query(TOKENS + " SELECT frame_id, segment, mcu, CAST(tok AS INT) AS tok, bits, CAST(coalesce(sum(length(bits)) OVER (PARTITION BY frame_id, segment ORDER BY mcu, tok ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bit_offset FROM tk")
def entropy_tokens(spark, sf):
    out = entropy.bit_offsets(entropy.tokens(transform.coded(i.block_samples(spark, sf))))
    return out.select("frame_id", "segment", "mcu", "tok", "bits", F.col("offset").cast("bigint").alias("bit_offset"))


PACKED = TOKENS + """, bs AS (SELECT frame_id, segment, string_agg(bits, '' ORDER BY mcu, tok) AS bits FROM tk GROUP BY ALL), pd AS (SELECT frame_id, segment, rpad(bits, CAST((length(bits) + 7) // 8 * 8 AS INT), '1') AS bits FROM bs),
  bt AS (SELECT frame_id, segment, n, list_sum([CAST(substr(bits, CAST(n * 8 + j + 1 AS INT), 1) AS INT) << CAST(7 - j AS INT) for j in range(8)]) AS v FROM pd, LATERAL (SELECT unnest(range(length(bits) // 8)) AS n) r)"""


@query(PACKED + " SELECT frame_id, segment, string_agg(CASE WHEN v = 255 THEN 'FF00' ELSE lpad(upper(to_hex(CAST(v AS BIGINT))), 2, '0') END, '' ORDER BY n) AS scan_hex FROM bt GROUP BY ALL")
def packed_segments(spark, sf):
    """The production form, one call for each segment."""
    out = entropy.segments(transform.coded(i.block_samples(spark, sf)))
    return out.select("frame_id", "segment", F.hex("scan").alias("scan_hex"))


@query(SQL["packed_segments"])
def packed_relational(spark, sf):
    return entropy.packed_relational(entropy.tokens(transform.coded(i.block_samples(spark, sf))))


@query("""SELECT n, v, CASE WHEN v > 0 THEN list_transform(range((n - 1) // v), lambda k: k % 8) ELSE [] END::VARCHAR AS restarts FROM (SELECT DISTINCT l_partkey % 40 + 1 AS n, l_linenumber % 5 AS v FROM lineitem)""")
def restart_numbers(spark, sf):
    rows = i.table(spark, sf, "lineitem").select((F.col("l_partkey") % 40 + 1).alias("n"), (F.col("l_linenumber") % 5).alias("v")).distinct()
    return rows.select("n", "v", F.concat(F.lit("["), F.array_join(words.restarts(F.col("n"), F.col("v")), ", "), F.lit("]")).alias("restarts"))


def _hex(v: str, digits: int) -> str:
    return f"lpad(upper(to_hex(CAST({v} AS BIGINT))), {digits}, '0')"


SETTINGS = ", fs AS (SELECT *, CAST(frame_id % 100 + 1 AS INT) AS quality, CAST(frame_id % 4 AS INT) AS ri, frame_id % 5 <> 0 AS jfif, CASE WHEN subsample THEN 16 ELSE 8 END AS sd FROM fr), fm AS (SELECT *, ((width + sd - 1) // sd) * ((height + sd - 1) // sd) AS mcus FROM fs)"
CODES = "".join(f"FFC4{len(s) + 19:04X}{info:02X}{bytes(b).hex().upper()}{bytes(s).hex().upper()}" for info, (b, s) in ((0, standard.huffman(True, True)), (1, standard.huffman(False, True)), (16, standard.huffman(True, False)), (17, standard.huffman(False, False))))
#: The whole encoder, composed of the parts above: a block's key is (frame * 1000000 + MCU) * 8 + block.
STREAMS = (
    BLOCK_SQL + SETTINGS + ", b AS (SELECT (pl.frame_id * 1000000 + mcu) * 8 + blk AS vec_id, component, quality, pos, v FROM pl JOIN fm USING (frame_id))" + CODED.partition(i.BLOCKS)[2] + f", {HUFFMAN}"
    + ", seg AS (SELECT vec_id // 8000000 AS frame_id, CASE WHEN ri > 0 THEN (vec_id // 8 % 1000000) // ri ELSE 0 END AS segment, vec_id % 8000000 AS mcu, component, k, c FROM z JOIN fm ON fm.frame_id = vec_id // 8000000),"
    + PACKED.partition("FROM z),")[2]
    + ", sh AS (SELECT frame_id, segment, string_agg(CASE WHEN v = 255 THEN 'FF00' ELSE lpad(upper(to_hex(CAST(v AS BIGINT))), 2, '0') END, '' ORDER BY n) AS x FROM bt GROUP BY ALL)"
    + ", sn AS (SELECT frame_id, string_agg(CASE WHEN segment > 0 THEN 'FFD' || ((segment - 1) % 8) ELSE '' END || x, '' ORDER BY segment) AS scan FROM sh GROUP BY 1)"
    + f", qh AS (SELECT quality, string_agg({_hex('q', 2)}, '' ORDER BY zigzag) FILTER (luma) AS lq, string_agg({_hex('q', 2)}, '' ORDER BY zigzag) FILTER (NOT luma) AS cq FROM qt GROUP BY 1)"
    + f", js AS (SELECT fm.*, 'FFD8' || CASE WHEN jfif THEN 'FFE000104A46494600010100000100010000' ELSE '' END || 'FFDB004300' || lq || 'FFDB004301' || cq || 'FFC0001108' || {_hex('height', 4)} || {_hex('width', 4)} || '0301' || CASE WHEN subsample THEN '22' ELSE '11' END || '00021101031101{CODES}' || CASE WHEN ri > 0 THEN 'FFDD0004' || {_hex('ri', 4)} ELSE '' END || 'FFDA000C03010002110311003F00' || scan || 'FFD9' AS jpeg FROM fm JOIN sn USING (frame_id) JOIN qh USING (quality))"
)


@query(STREAMS + " SELECT frame_id, CAST(length(jpeg) // 2 AS BIGINT) AS n_bytes, sha256(unhex(jpeg)) AS sha256 FROM js")
def jpeg_streams(spark, sf):
    """Whole encoder, from pixels to streams."""
    return jpeg.sizes(jpeg.encode(i.pixels(spark, sf), i.frames(spark, sf)))


def _files(spark, sf):
    return jpeg.encode(i.pixels(spark, sf), i.frames(spark, sf)).select(F.col("frame_id").cast("string").alias("path"), F.col("jpeg").alias("content"))


#: Damage for each remainder of the frame's number: what is replaced in the stream's hex text, and the rules that then fail.
DAMAGE = {
    1: ("(?s)^(.*)$", "$100", ["no_trailing_bytes"]),
    2: ("FFD9$", "", ["eoi"]),
    3: ("FFC0001108", "FFC000110C", ["precision"]),
    4: ("FFDB004300..", "FFDB00430000", ["dqt_nonzero"]),
    5: ("00021101031101", "00021101041101", ["component_ids"]),
    6: ("03010002110311003F00", "03010002110311003E00", ["spectral"]),
    7: ("FFC4001F0000", "FFC4001F0001", ["dht_counts", "dht_prefix_code"]),
    8: ("0301(..)00021101", "0401$100021101", ["component_count"]),
    9: ("03010002110311", "03010002100311", ["scan_tables"]),
}


def _damaged(spark, sf):
    out = F.hex("content")
    for k, (pattern, plain, _) in DAMAGE.items():
        out = F.when(F.col("path").cast("bigint") % 11 == k, F.regexp_replace(F.hex("content"), f"^((?:..)*?){pattern}" if k > 2 else pattern, plain if k < 3 else "$1" + plain.replace("$1", "$2"))).otherwise(out)
    return _files(spark, sf).select("path", F.unhex(out).alias("content"))


FAILS = "CASE frame_id % 11 " + " ".join(f"WHEN {k} THEN rule NOT IN ({', '.join(repr(r) for r in rules)})" for k, (_, _, rules) in DAMAGE.items()) + " ELSE true END"


@query(f"WITH {i.PIXELS}, {i.FRAMES} SELECT CAST(frame_id AS VARCHAR) AS path, rule, {FAILS} AS passed FROM fr, (VALUES " + ", ".join(f"('{r}')" for r in ("soi", "eoi", "no_trailing_bytes", "walk", "header_order", "app0_count", "app0_is_jfif", "sof_count", "sof_length", "precision", "size", "component_count", "component_ids", "sampling", "quantizer_selection", "dqt_tables", "dqt_length", "dqt_nonzero", "dht_tables", "dht_counts", "dht_prefix_code", "dri_count", "dri_positive", "restarts_need_dri", "restart_sequence", "restart_count", "sos_count", "sos_length", "scan_components", "scan_tables", "spectral", "scan_not_empty")) + ") r(rule)")
def jpeg_rules(spark, sf):
    """Every rule over every encoded stream; nine of eleven streams are damaged, each kind in its own way."""
    return bitstream.checked(bitstream.walked(_damaged(spark, sf)))


@query(f"""WITH {i.PIXELS}, {i.FRAMES}{SETTINGS}, e AS (SELECT *, frame_id % 7 AS k, CASE WHEN ri > 0 THEN (mcus - 1) // ri ELSE 0 END AS n FROM fm), x AS (SELECT *, CASE WHEN k = 1 THEN width + 40 ELSE width END AS ew, CASE WHEN (k = 4) <> subsample THEN 16 ELSE 8 END AS ed, CASE WHEN k = 5 THEN ri + 1 ELSE ri END AS ei FROM e)
  SELECT CAST(frame_id AS VARCHAR) AS path, rule, CASE rule WHEN 'expected_size' THEN k <> 1 WHEN 'expected_mode' THEN k <> 4 WHEN 'expected_quantizers' THEN k <> 2 WHEN 'expected_interval' THEN k <> 5 WHEN 'expected_jfif' THEN k <> 3
    WHEN 'expected_restarts' THEN n = CASE WHEN ei > 0 THEN (((ew + ed - 1) // ed) * ((height + ed - 1) // ed) - 1) // ei ELSE 0 END ELSE true END AS passed FROM x, (VALUES ('expected_size'), ('expected_mode'), ('expected_quantizers'), ('expected_codes'), ('expected_interval'), ('expected_restarts'), ('expected_jfif')) r(rule)""")
def jpeg_expectations(spark, sf):
    """Streams against their settings, of which one differs for five of seven frames."""
    k, of = F.col("frame_id") % 7, F.col
    wrong = i.frames(spark, sf).withColumns({
        "path": of("frame_id").cast("string"), "width": F.when(k == 1, of("width") + 40).otherwise(of("width")), "quality": F.when(k != 2, of("quality")).when(of("quality") > 50, of("quality") - 30).otherwise(of("quality") + 30),
        "emit_jfif": of("emit_jfif") != (k == 3), "subsample": of("subsample") != (k == 4), "restart_interval": F.when(k == 5, of("restart_interval") + 1).otherwise(of("restart_interval")),
    })
    return bitstream.expected(bitstream.walked(_files(spark, sf)), wrong.drop("frame_id"))


@query(STREAMS + f", tb AS (SELECT js.frame_id, t.seq, t.kind, t.id, unhex(CASE t.kind WHEN 'DQT' THEN CASE t.id WHEN 0 THEN '00' || lq ELSE '01' || cq END ELSE '' END) AS payload FROM js JOIN qh USING (quality), (VALUES (0, 'DQT', 0), (1, 'DQT', 1)) t(seq, kind, id)) SELECT CAST(frame_id AS VARCHAR) AS path, kind, CAST(id AS INT) AS id, CAST(octet_length(payload) AS INT) AS n_bytes, sha256(payload) AS sha256 FROM tb UNION ALL SELECT CAST(frame_id AS VARCHAR), 'DHT', CAST(id AS INT), CAST(octet_length(unhex(x)) AS INT), sha256(unhex(x)) FROM js, (VALUES " + ", ".join(f"({n}, '{n:02X}{bytes(b).hex().upper()}{bytes(s).hex().upper()}')" for n, (b, s) in ((0, standard.huffman(True, True)), (1, standard.huffman(False, True)), (16, standard.huffman(True, False)), (17, standard.huffman(False, False)))) + ") h(id, x)")
def table_hashes(spark, sf):
    return bitstream.table_hashes(bitstream.walked(_files(spark, sf)))


@query(f"WITH {i.PIXELS}, {i.FRAMES}{SETTINGS} SELECT CAST(frame_id AS VARCHAR) AS path, '{{{{\"app0_segments\":' || CASE WHEN jfif THEN '1' ELSE '0' END || ',\"height\":' || height || ',\"mode\":\"' || CASE WHEN subsample THEN '4:2:0' ELSE '4:4:4' END || '\",\"quality\":' || quality || ',\"restart_interval\":' || ri || ',\"restarts\":' || CASE WHEN ri > 0 THEN (mcus - 1) // ri ELSE 0 END || ',\"standard_codes\":true,\"width\":' || width || '}}}}' AS record FROM fm".replace("{{", "{").replace("}}", "}"))
def expectation_records(spark, sf):
    frames = i.frames(spark, sf).withColumn("path", F.col("frame_id").cast("string")).drop("frame_id")
    return bitstream.expectations(frames)


@query(f"""WITH {i.PIXELS}, {i.FRAMES} SELECT CAST(frame_id AS VARCHAR) AS path, CAST(height AS INT) AS height, CAST(width AS INT) AS width, CASE WHEN subsample THEN '4:2:0' ELSE '4:4:4' END AS mode, list_concat(['APP0'], ['x'])[1] = 'APP0' AS walked,
  CASE WHEN frame_id % 5 <> 0 THEN 'APP0,' ELSE '' END || 'DQT,DQT,SOF0,DHT,DHT,DHT,DHT,' || CASE WHEN frame_id % 4 > 0 THEN 'DRI,' ELSE '' END || 'SOS' AS markers FROM fr""")
def jpeg_segments(spark, sf):
    f = bitstream.facts(bitstream.walked(_files(spark, sf)))
    names = F.transform("segments", lambda s: words.marker_name(s.marker))
    mode = F.when(F.get("components", F.lit(0)).sampling == 0x22, "4:2:0").when(F.get("components", F.lit(0)).sampling == 0x11, "4:4:4").otherwise("unknown")
    return f.select("path", "height", "width", mode.alias("mode"), F.col("error").isNull().alias("walked"), F.array_join(names, ",").alias("markers"))


@query(f"WITH {i.PIXELS} SELECT frame_id, min(r) AS r_min, max(r) AS r_max, min(g) AS g_min, max(g) AS g_max, min(b) AS b_min, max(b) AS b_max, count(DISTINCT (r, g, b)) > 1 AS non_flat, bool_or(r <> g OR r <> b) AS has_color, round(avg(r) FILTER (x < 8), 6) AS left_r, round(avg(r) FILTER (x >= 8), 6) AS right_r FROM px GROUP BY 1")
def image_statistics(spark, sf):
    px = i.pixels(spark, sf)
    edges = [f(F.col(c)).cast("bigint").alias(f"{c}_{n}") for c in "rgb" for n, f in (("min", F.min), ("max", F.max))]
    side = lambda cond: F.round(F.avg(F.when(cond, F.col("r"))), 6)
    return px.groupBy("frame_id").agg(*edges, (F.count_distinct(F.struct("r", "g", "b")) > 1).alias("non_flat"), F.bool_or((F.col("r") != F.col("g")) | (F.col("r") != F.col("b"))).alias("has_color"), side(F.col("x") < 8).alias("left_r"), side(F.col("x") >= 8).alias("right_r"))


@query(f"WITH {i.PIXELS} SELECT frame_id, sha256(string_agg(chr(65 + CAST(r % 16 AS INT)) || chr(65 + CAST(g % 16 AS INT)) || chr(65 + CAST(b % 16 AS INT)) || chr(0), '' ORDER BY y, x)) AS sha256 FROM px GROUP BY 1")
def packed_pixel_words(spark, sf):
    px = i.pixels(spark, sf)
    small = px.withColumns({c: (65 + F.col(c) % 16).cast("int") for c in "rgb"})
    return images.packed_words(small).select("frame_id", F.sha2("words", 256).alias("sha256"))


@query("WITH c AS (SELECT p_partkey, k, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE (p_partkey * k // 7 + p_size) % (1 + k // 2) END AS n FROM part, range(1, 17) t(k)) SELECT p_partkey, sum(n * (1 << (16 - k))) <= 65536 AS fits FROM c GROUP BY 1")
def kraft_check(spark, sf):
    """Code counts by length, made up from the parts' keys, of which some fit a prefix code."""
    n = lambda k: F.when(F.col("p_partkey") % 3 == 0, 0).otherwise((F.floor(F.col("p_partkey") * k / 7) + F.col("p_size")) % (1 + k // 2)).cast("int")
    return i.table(spark, sf, "part").select("p_partkey", bitstream.kraft(F.array(*[n(k) for k in range(1, 17)])).alias("fits"))
