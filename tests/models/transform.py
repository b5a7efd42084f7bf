"""The cosine-transform codec block by block and bit by bit, in plain Python."""

import math
from collections import Counter

from frameloom.functions.scalars import jpeg_table
from frameloom.functions.tables import CHROMA, LUMA, ZIGZAG
from frameloom.operators.transform_codec import code_lengths, codes, mutate, splitmix

COS = [[(math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]


def away(v):
    return math.copysign(math.floor(abs(v) + 0.5), v)


def held(v):
    return max(-32768, min(32767, int(v)))


def byte(v):
    return max(0, min(255, v))


def forward(s):
    half = [[sum(s[y][x] * COS[u][x] for x in range(8)) for u in range(8)] for y in range(8)]
    return [[sum(half[y][u] * COS[v][y] for y in range(8)) for u in range(8)] for v in range(8)]


def inverse(f):
    half = [[sum(f[v][u] * COS[v][y] for v in range(8)) for u in range(8)] for y in range(8)]
    return [[sum(half[y][u] * COS[u][x] for u in range(8)) for x in range(8)] for y in range(8)]


def blocks(plane, w, h):
    """Rows of blocks of 8 x 8 samples, edges repeated."""
    return [[[[plane[min(h - 1, 8 * j + y)][min(w - 1, 8 * i + x)] for x in range(8)] for y in range(8)] for i in range(-(-w // 8))] for j in range(-(-h // 8))]


def edited(flat, columns, rows, p, channel):
    """Blocks of 64 coefficients in zig-zag order, as the parameters change them."""
    due = lambda name, no: p[name] and no % p[name] == 0
    out, drift, triggers = [], 0, 0
    for i in range(len(flat)):
        no, source = i + 1, i
        if (p["block_shift_x"] or p["block_shift_y"]) and due("block_shift_every", no):
            source = (i // columns + p["block_shift_y"]) % rows * columns + (i % columns + p["block_shift_x"]) % columns
        elif due("block_repeat_every", no):
            source = max(0, i - 1)
        z = list(flat[source])
        if p["coeff_shift"] and due("coeff_shift_every", no):
            k = p["coeff_shift"] % 63
            z = z[:1] + (z[1:] + z[1:])[k : k + 63]
        if due("zigzag_reverse_every", no):
            z = z[:1] + z[:0:-1]
        if due("block_transpose_every", no):
            square = [0] * 64
            for k, n in enumerate(ZIGZAG):
                square[n % 8 * 8 + n // 8] = z[k]
            z = [square[n] for n in ZIGZAG]
        cut = p["ac_zero_above"]
        for k in range(64):
            if cut and k > cut:
                z[k] = 0
            elif p["quant_scale"] > 1:
                import numpy as np

                s = float(np.float32(p["quant_scale"]))
                z[k] = math.trunc(max(-32768, min(32767, away(z[k] / s) * s)))
        if due("coeff_sign_flip_every", no):
            z[1:] = [min(32767, -v) for v in z[1:]]
        if p["dc_block_offset"] and due("dc_block_offset_every", no):
            z[0] = held(z[0] + p["dc_block_offset"])
        if p["dc_drift"] and due("dc_drift_every", no):
            triggers += 1
            drift += -p["dc_drift"] if splitmix(triggers) >> channel & 1 else p["dc_drift"]
        z[0] = held(z[0] + drift)
        out.append([held(v) for v in z])
    return out


def bits_of(v):
    return abs(v).bit_length()


def coded(planes):
    """(books, bits as text) of the planes' blocks."""
    rows = []
    for flat in planes:
        before = 0
        for z in flat:
            d, before = z[0] - before, z[0]
            rows.append((0, bits_of(d), d, bits_of(d)))
            run = 0
            for k in range(1, 64):
                if not any(z[k:]):
                    rows.append((1, 0, 0, 0))
                    break
                if z[k] == 0:
                    run += 1
                    continue
                while run > 15:
                    rows.append((1, 0xF0, 0, 0))
                    run -= 16
                s = bits_of(z[k])
                rows.append((1, 256 + run if s == 16 else run * 16 + s, z[k], s))
                run = 0
    tables = [code_lengths(Counter(s for kind, s, *_ in rows if kind == k)) for k in (0, 1)]
    books = [codes(*t) for t in tables]
    text = ""
    for kind, s, v, n in rows:
        code, length = books[kind][s]
        text += format(code, f"0{length}b") + (format(v if v >= 0 else v + 2**n - 1, f"0{n}b") if n else "")
    return tables, books, text


def decoded(books, text, counts):
    """Blocks from bits, one at a time; what fails ends its plane, and the next goes on at the same bit."""
    back = [{format(c, f"0{n}b"): s for s, (c, n) in book.items()} for book in books]
    at, out = 0, []

    def take(n):
        nonlocal at
        if at + n > len(text):
            at = len(text)
            raise EOFError
        at += n
        return text[at - n : at]

    def symbol(book):
        code = ""
        while len(code) < 16:
            code += take(1)
            if code in book:
                return book[code]
        raise EOFError

    def value(n):
        if not n:
            return 0
        v = int(take(n), 2)
        return v if v >> n - 1 else v - 2**n + 1

    for count in counts:
        flat, before = [[0] * 64 for _ in range(count)], 0
        out.append(flat)
        try:
            for z in flat:
                s = symbol(back[0])
                if s > 17:
                    raise EOFError
                before += value(s)
                z[0] = held(before)
                k = 1
                while k < 64:
                    s = symbol(back[1])
                    if s == 0:
                        break
                    if s == 0xF0:
                        k += 16
                        continue
                    run, size = (s - 256, 16) if s >= 256 else (s // 16, s % 16)
                    k += run
                    if k > 63:
                        break
                    z[k] = held(value(size))
                    k += 1
        except EOFError:
            continue
    return out


def run(frames, w, h, p, quality=50):
    tables = [jpeg_table(t, quality) for t in (LUMA, CHROMA, CHROMA)]
    sizes = [(w, h), ((w + 1) // 2, (h + 1) // 2), ((w + 1) // 2, (h + 1) // 2)]
    feedback, out = None, []
    counts = Counter()
    for f, frame in enumerate(frames):
        keep = min(max(p["persistence"], 0.0), 0.98)
        if keep > 0 and feedback:
            frame = [[tuple(int(max(0, min(255, away(a * (1 - keep) + b * keep)))) for a, b in zip(s, t)) for s, t in zip(row, old)] for row, old in zip(frame, feedback)]
        y = [[byte((77 * r + 150 * g + 29 * b + 128) >> 8) - 128 for r, g, b in row] for row in frame]
        cb = [[byte(((-43 * r - 85 * g + 128 * b + 128) >> 8) + 128) - 128 for r, g, b in row] for row in frame]
        cr = [[byte(((128 * r - 107 * g - 21 * b + 128) >> 8) + 128) - 128 for r, g, b in row] for row in frame]
        planes = [y]
        for c in (cb, cr):
            small = []
            for j in range(0, h, 2):
                row = []
                for i in range(0, w, 2):
                    cell = [c[a][b] for a in (j, j + 1) if a < h for b in (i, i + 1) if b < w]
                    row.append(sum(cell) / len(cell))
                small.append(row)
            planes.append(small)
        flats = []
        for k, plane in enumerate(planes):
            grid = blocks(plane, *sizes[k])
            flat = []
            for row in grid:
                for s in row:
                    c = forward(s)
                    flat.append([held(away(round(c[n // 8][n % 8] / tables[k][n], 9))) for n in ZIGZAG])
            flats.append(edited(flat, len(grid[0]), len(grid), p, k))
        if n := p["chroma_swap_every"]:
            for i in range(n - 1, len(flats[1]), n):
                flats[1][i], flats[2][i] = flats[2][i], flats[1][i]
        if p["bs.enabled"]:
            (_, books, text) = coded(flats)
            text += "0" * (-len(text) % 8)
            body = bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))
            import struct

            data = bytes(21) + struct.pack("<I", 25) + body
            data = mutate(data, {k[3:]: v for k, v in p.items() if k.startswith("bs.")}, splitmix(f + 1), counts)[25:]
            flats = decoded(books, "".join(format(b, "08b") for b in data), [len(flat) for flat in flats])
        shown = [[None] * w for _ in range(h)]
        back = []
        for k, flat in enumerate(flats):
            pw, ph = sizes[k]
            plane = [[0.0] * pw for _ in range(ph)]
            for i, z in enumerate(flat):
                c = [[0] * 8 for _ in range(8)]
                for v, n in zip(z, ZIGZAG):
                    c[n // 8][n % 8] = v * tables[k][n]
                s, across = inverse(c), -(-pw // 8)
                for yy in range(8):
                    for xx in range(8):
                        if i // across * 8 + yy < ph and i % across * 8 + xx < pw:
                            plane[i // across * 8 + yy][i % across * 8 + xx] = s[yy][xx]
            back.append(plane)
        for j in range(h):
            for i in range(w):
                a, b, c = math.trunc(round(back[0][j][i] + 128, 6)), math.trunc(round(back[1][j // 2][i // 2], 6)), math.trunc(round(back[2][j // 2][i // 2], 6))
                shown[j][i] = tuple(byte(v) for v in (a + ((359 * c + 128) >> 8), a - ((88 * b + 183 * c + 128) >> 8), a + ((454 * b + 128) >> 8)))
        feedback = shown
        out.append(shown)
    return out
