"""A plain integer model of the encoder, and a baseline decoder of what it writes."""

from mosaiq.functions import standard


def clamp(v):
    return max(0, min(255, v))


def ycc(r, g, b):
    return clamp((77 * r + 150 * g + 29 * b) >> 8) - 128, clamp(((-43 * r - 85 * g + 128 * b) >> 8) + 128) - 128, clamp(((128 * r - 107 * g - 21 * b) >> 8) + 128) - 128


def blocks(pixel, width, height, subsample):
    """(mcu, blk, component, 64 samples) in scan order; pixel(x, y) gives r, g, b."""
    at = lambda x, y: ycc(*pixel(min(x, width - 1), min(y, height - 1)))
    side = 16 if subsample else 8
    out = []
    for my in range(-(-height // side)):
        for mx in range(-(-width // side)):
            mcu, x0, y0 = my * -(-width // side) + mx, mx * side, my * side
            if subsample:
                for blk in range(4):
                    out.append((mcu, blk, 0, [at(x0 + blk % 2 * 8 + x, y0 + blk // 2 * 8 + y)[0] for y in range(8) for x in range(8)]))
                for c in (1, 2):
                    out.append((mcu, c + 3, c, [sum(at(x0 + 2 * x + i, y0 + 2 * y + j)[c] for i in (0, 1) for j in (0, 1)) >> 2 for y in range(8) for x in range(8)]))
            else:
                out += [(mcu, c, c, [at(x0 + x, y0 + y)[c] for y in range(8) for x in range(8)]) for c in range(3)]
    return out


def coded(samples, quality, luma):
    c, q = standard.COSINE, standard.quant(quality, luma)
    rows = [[sum(c[v][x] * samples[y * 8 + x] for x in range(8)) for v in range(8)] for y in range(8)]
    out = []
    for k in standard.ZIGZAG:
        u, v = divmod(k, 8)
        t = sum(c[u][y] * rows[y][v] for y in range(8))
        f = (abs(t) + (1 << 27)) >> 28
        f = (f + q[k] // 2) // q[k]
        out.append(-f if t < 0 else f)
    return out


def bits(value, size):
    if not size:
        return ""
    return format(value if value >= 0 else (1 << size) - 1 + value, f"0{size}b")


def block_bits(diff, coeffs, luma):
    dc, ac = standard.codes(luma, True), standard.codes(luma, False)
    code = lambda t, s: format(t[s][0], f"0{t[s][1]}b")
    out = code(dc, abs(diff).bit_length()) + bits(diff, abs(diff).bit_length())
    run = 0
    for v in coeffs[1:]:
        if not v:
            run += 1
            continue
        while run > 15:
            out += code(ac, 0xF0)
            run -= 16
        size = abs(v).bit_length()
        out += code(ac, run * 16 + size) + bits(v, size)
        run = 0
    return out + (code(ac, 0) if run else "")


def packed(text):
    text += "1" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")


def encode(pixel, width, height, quality, interval, subsample, jfif):
    parts, text, last, segment = [], "", [0, 0, 0], 0
    for mcu, _, c, samples in blocks(pixel, width, height, subsample):
        if interval and mcu // interval != segment:
            parts.append(packed(text))
            text, last, segment = "", [0, 0, 0], mcu // interval
        z = coded(samples, quality, c == 0)
        text += block_bits(z[0] - last[c], z, c == 0)
        last[c] = z[0]
    parts.append(packed(text))
    body = parts[0] + b"".join(bytes([0xFF, 0xD0 + k % 8]) + p for k, p in enumerate(parts[1:]))
    return standard.header(width, height, quality, interval, subsample, jfif) + body + b"\xff\xd9"


def decode(data):
    """Zig-zag blocks (component, 64 values) of a stream, from its own tables."""
    at, tables, interval, components = 2, {}, 0, []
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        p = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            code, k, table = 0, 17, {}
            for length, n in enumerate(p[1:17], 1):
                for s in p[k : k + n]:
                    table[length, code] = s
                    code += 1
                k += n
                code <<= 1
            tables[p[0]] = table
        elif marker == 0xC0:
            height, width = int.from_bytes(p[1:3], "big"), int.from_bytes(p[3:5], "big")
            components = [(p[7 + 3 * k] >> 4) * (p[7 + 3 * k] & 15) for k in range(3)]
        elif marker == 0xDD:
            interval = int.from_bytes(p, "big")
        elif marker == 0xDA:
            break
    side = 16 if components[0] == 4 else 8
    mcus = -(-width // side) * -(-height // side)
    out, raw = [], data[at:-2]
    text, k, last = "", 0, [0, 0, 0]

    def segment_bits():
        nonlocal raw
        own = bytearray()
        i = 0
        while i < len(raw):
            if raw[i] == 0xFF:
                if raw[i + 1] != 0:
                    break
                own.append(0xFF)
                i += 2
            else:
                own.append(raw[i])
                i += 1
        raw = raw[i + 2 :]
        return "".join(f"{b:08b}" for b in own)

    def symbol(table):
        nonlocal k
        for length in range(1, 17):
            if (s := table.get((length, int(text[k : k + length], 2)))) is not None:
                k += length
                return s
        raise ValueError("no code")

    def value(size):
        nonlocal k
        if not size:
            return 0
        v = int(text[k : k + size], 2)
        k += size
        return v if v >> (size - 1) else v - (1 << size) + 1

    text = segment_bits()
    for mcu in range(mcus):
        if interval and mcu and mcu % interval == 0:
            assert set(text[k:]) <= {"1"} and len(text) - k < 8
            text, k, last = segment_bits(), 0, [0, 0, 0]
        for c, n in enumerate(components):
            for _ in range(n):
                z = [0] * 64
                last[c] += value(symbol(tables[0x00 | (c > 0)]))
                z[0], i = last[c], 1
                while i < 64:
                    s = symbol(tables[0x10 | (c > 0)])
                    if not s:
                        break
                    i += s >> 4
                    if s == 0xF0:
                        i += 1
                        continue
                    z[i] = value(s & 15)
                    i += 1
                out.append((c, z))
    assert not raw and set(text[k:]) <= {"1"} and len(text) - k < 8
    return width, height, out
