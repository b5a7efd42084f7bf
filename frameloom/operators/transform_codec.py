"""The cosine-transform codec on whole frames, with its entropy stage: numpy kernels for a fold over a stream."""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np

from frameloom.functions.scalars import jpeg_table
from frameloom.functions.tables import CHROMA, LUMA, ZIGZAG, cosine
from frameloom.plans.presets import ENTROPY_DEFAULTS, TRANSFORM_DEFAULTS

BASIS = np.array([[cosine(u, x) for x in range(8)] for u in range(8)])
ZZ = np.array(ZIGZAG)
MASK = (1 << 64) - 1


def splitmix(v: int) -> int:
    v = v + 0x9E3779B97F4A7C15 & MASK
    v = (v ^ v >> 30) * 0xBF58476D1CE4E5B9 & MASK
    v = (v ^ v >> 27) * 0x94D049BB133111EB & MASK
    return v ^ v >> 31


def half_away(v: np.ndarray) -> np.ndarray:
    return np.sign(v) * np.floor(np.abs(v) + 0.5)


def short(v: np.ndarray) -> np.ndarray:
    return np.clip(v, -32768, 32767).astype(np.int16)


def blocks_of(plane: np.ndarray) -> np.ndarray:
    """(rows, columns, 8, 8) blocks, edges repeated."""
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge")
    return p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).swapaxes(1, 2)


def plane_of(blocks: np.ndarray, h: int, w: int) -> np.ndarray:
    r, c = blocks.shape[:2]
    return blocks.swapaxes(1, 2).reshape(r * 8, c * 8)[:h, :w]


class TransformCodec:
    """Encode, coefficient edits, optional damage of the coded bytes, decode, feedback."""

    defaults = {**TRANSFORM_DEFAULTS, **{f"bs.{k}": v for k, v in ENTROPY_DEFAULTS.items()}}

    def __init__(self, width: int, height: int, quality: int = 50, **params):
        if width < 1 or height < 1 or not 1 <= quality <= 100:
            raise ValueError("width and height are at least 1, quality is 1 to 100")
        self.width, self.height = width, height
        self.tables = [np.array(jpeg_table(t, quality)).reshape(8, 8) for t in (LUMA, CHROMA, CHROMA)]
        self.params = {**self.defaults, **params}
        self.reset()

    def tune(self, params: dict) -> None:
        """Other parameters from the next frame on; the state stays."""
        self.params = dict(params)

    def reset(self) -> None:
        self.feedback, self.counts = None, Counter()

    def encode(self, frame: np.ndarray) -> list[np.ndarray]:
        """Quantized coefficients (blocks down, across, 64) of luma and of the two halved colour planes."""
        r, g, b = (frame[..., k].astype(np.int64) for k in range(3))
        y = np.clip((77 * r + 150 * g + 29 * b + 128) >> 8, 0, 255) - 128
        cb = np.clip(((-43 * r - 85 * g + 128 * b + 128) >> 8) + 128, 0, 255) - 128
        cr = np.clip(((128 * r - 107 * g - 21 * b + 128) >> 8) + 128, 0, 255) - 128
        out = []
        for k, plane in enumerate((y, cb, cr)):
            if k:
                h, w = plane.shape
                odd = np.pad(plane.astype(float), ((0, h % 2), (0, w % 2)), constant_values=np.nan)
                plane = np.nanmean(odd.reshape(odd.shape[0] // 2, 2, odd.shape[1] // 2, 2), axis=(1, 3))
            f = BASIS @ blocks_of(plane.astype(float)) @ BASIS.T
            out.append(short(half_away(np.round(f / self.tables[k], 9))).reshape(*f.shape[:2], 64))
        return out

    def _edit(self, plane: np.ndarray, channel: int) -> np.ndarray:
        p, (rows, columns) = self.params, plane.shape[:2]
        c = plane.reshape(-1, 64).astype(np.int64)
        n = len(c)
        no = np.arange(1, n + 1)
        due = lambda every: no % every == 0 if every else np.zeros(n, bool)
        source = np.arange(n)
        shift = due(p["block_shift_every"]) if p["block_shift_x"] or p["block_shift_y"] else np.zeros(n, bool)
        repeat = due(p["block_repeat_every"]) & ~shift
        moved = (source // columns + p["block_shift_y"]) % rows * columns + (source % columns + p["block_shift_x"]) % columns
        source = np.where(shift, moved, np.where(repeat, np.maximum(source - 1, 0), source))
        self.counts["blocks_remapped"] += int(shift.sum())
        self.counts["blocks_repeated"] += int(repeat.sum())
        z = c[source][:, ZZ]  # along the zig-zag
        if p["coeff_shift"]:
            m = due(p["coeff_shift_every"])
            z[m, 1:] = np.roll(z[m, 1:], -(p["coeff_shift"] % 63), axis=1)
            self.counts["blocks_coeff_shifted"] += int(m.sum())
        m = due(p["zigzag_reverse_every"])
        z[m, 1:] = z[m, :0:-1]
        c = np.empty_like(z)
        c[:, ZZ] = z
        m = due(p["block_transpose_every"])
        c[m] = c[m].reshape(-1, 8, 8).swapaxes(1, 2).reshape(-1, 64)
        z = c[:, ZZ]
        cut = p["ac_zero_above"]
        keep = np.arange(64) <= cut if cut else np.ones(64, bool)
        if p["quant_scale"] > 1:
            s = np.float32(p["quant_scale"])
            z = np.where(keep, np.trunc(np.clip(half_away(z / s) * s, -32768, 32767)), z).astype(np.int64)
            self.counts["blocks_requantized"] += n
        z[:, ~keep] = 0
        self.counts["blocks_low_passed"] += n * bool(cut)
        m = due(p["coeff_sign_flip_every"])
        z[m, 1:] = np.minimum(-z[m, 1:], 32767)
        self.counts["blocks_sign_flipped"] += int(m.sum())
        if p["dc_block_offset"]:
            m = due(p["dc_block_offset_every"])
            z[m, 0] = np.clip(z[m, 0] + p["dc_block_offset"], -32768, 32767)
            self.counts["dc_offsets"] += int(m.sum())
        if p["dc_drift"] and p["dc_drift_every"]:
            m = due(p["dc_drift_every"])
            signs = np.array([-1 if splitmix(t) >> channel & 1 else 1 for t in range(1, int(m.sum()) + 1)], np.int64)
            step = np.zeros(n, np.int64)
            step[m] = signs * p["dc_drift"]
            z[:, 0] = np.clip(z[:, 0] + np.cumsum(step), -32768, 32767)
            self.counts["dc_drifts"] += int(m.sum())
        c[:, ZZ] = z
        return short(c).reshape(plane.shape)

    def glitch(self, coefficients: list[np.ndarray]) -> list[np.ndarray]:
        out = [self._edit(c, k) for k, c in enumerate(coefficients)]
        if n := self.params["chroma_swap_every"]:
            a, b = out[1].reshape(-1, 64), out[2].reshape(-1, 64)
            m = np.arange(1, len(a) + 1) % n == 0
            a[m], b[m] = b[m].copy(), a[m].copy()
        return out

    def decode(self, coefficients: list[np.ndarray]) -> np.ndarray:
        h, w = self.height, self.width
        planes = []
        for k, c in enumerate(coefficients):
            f = c.reshape(*c.shape[:2], 8, 8) * self.tables[k]
            size = (h, w) if k == 0 else ((h + 1) // 2, (w + 1) // 2)
            planes.append(plane_of(BASIS.T @ f @ BASIS, *size))
        up = [p.repeat(2, 0).repeat(2, 1)[:h, :w] for p in planes[1:]]
        y, cb, cr = (np.trunc(np.round(v, 6)).astype(np.int64) for v in (planes[0] + 128, *up))
        rgb = (y + ((359 * cr + 128) >> 8), y - ((88 * cb + 183 * cr + 128) >> 8), y + ((454 * cb + 128) >> 8))
        return np.clip(np.stack(rgb, axis=-1), 0, 255).astype(np.uint8)

    def process(self, frame: np.ndarray) -> np.ndarray:
        keep = min(max(self.params["persistence"], 0.0), 0.98)
        if keep > 0 and self.feedback is not None:
            frame = np.clip(half_away(frame * (1 - keep) + self.feedback * keep), 0, 255).astype(np.uint8)
        coefficients = self.glitch(self.encode(frame))
        if self.params["bs.enabled"]:
            data = mutate(encode_stream(coefficients, self.width, self.height), {k[3:]: v for k, v in self.params.items() if k.startswith("bs.")}, splitmix(self.counts["frames_in"] + 1), self.counts)
            coefficients = decode_stream(data, [c.shape for c in coefficients])
        self.feedback = self.decode(coefficients)
        self.counts["frames_in"] += 1
        self.counts["blocks_encoded"] += sum(c.shape[0] * c.shape[1] for c in coefficients)
        return self.feedback


# Entropy stage


def category(v: int) -> int:
    return abs(v).bit_length()


def bit_lengths(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitudes, all below 2 ** 17."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def symbols(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, symbol, magnitude bits, their number) of a plane's blocks in order: DC differences, then AC runs.

    Every coefficient, every 16 zeros and every end is a row with its place; the rows are then put in order.
    """
    z = plane.reshape(-1, 64)[:, ZZ].astype(np.int64)
    n = len(z)
    diff = np.diff(z[:, 0], prepend=0)
    block, at = np.nonzero(z[:, 1:])
    at = at + 1
    v = z[block, at]
    new = np.ones(len(block), bool)
    new[1:] = block[1:] != block[:-1]
    run = at - np.where(new, 0, np.append(0, at[:-1])) - 1
    size = bit_lengths(v)
    long = np.flatnonzero(run >= 16)
    long = np.repeat(long, run[long] // 16)
    ends = np.flatnonzero(z[:, 63] == 0)
    code = lambda x, s: np.where(x >= 0, x, x + (1 << s) - 1)
    low = run % 16
    none = np.zeros(len(long) + len(ends), np.int64)
    parts = (
        (np.arange(n) * 256, np.zeros(n, np.int64), bit_lengths(diff), code(diff, bit_lengths(diff)), bit_lengths(diff)),
        (block * 256 + at * 2 + 1, np.ones(len(block), np.int64), np.where(size == 16, 256 + low, low << 4 | size), code(v, size), size),
        (np.concatenate([block[long] * 256 + at[long] * 2, ends * 256 + 255]), none + 1, np.concatenate([np.full(len(long), 0xF0), np.zeros(len(ends), np.int64)]), none, none),
    )
    place, kind, symbol, magnitude, bits = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(place, kind="stable")
    return kind[order], symbol[order], magnitude[order], bits[order]


def code_lengths(counts: dict[int, int], longest: int = 16) -> tuple[list[int], list[int]]:
    """(codes of each length 1 to 16, symbols by length, then value), as in Annex K of the JPEG standard.

    A reserved symbol with count 1 takes part, so that no code is all ones, and leaves at the end.
    """
    if not counts:
        return [0] * longest, []
    reserved = 1 << 20
    trees = {s: (n, [s]) for s, n in counts.items()} | {reserved: (1, [reserved])}
    length = dict.fromkeys(trees, 0)
    while len(trees) > 1:
        a, b = sorted(trees, key=lambda s: (trees[s][0], -s))[:2]
        members = trees[a][1] + trees[b][1]
        for s in members:
            length[s] += 1
        trees[a] = (trees[a][0] + trees[b][0], members)
        del trees[b]
    bits = Counter(length.values())
    for i in range(max(bits), longest, -1):
        while bits[i]:
            j = i - 2
            while not bits[j]:
                j -= 1
            bits[i] -= 2
            bits[i - 1] += 1
            bits[j + 1] += 2
            bits[j] -= 1
    top = max(k for k, n in bits.items() if n)
    bits[top] -= 1
    order = sorted((s for s in length if s != reserved), key=lambda s: (length[s], s))
    return [bits[i] for i in range(1, longest + 1)], order


def codes(bits: list[int], order: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical (code, length) of each symbol."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for s in order[at : at + n]:
            out[s] = (code, length)
            code += 1
        at += n
        code <<= 1
    return out


def encode_stream(coefficients: list[np.ndarray], width: int, height: int) -> bytes:
    """Header, the two tables, and the payload, most significant bits first."""
    kind, symbol, magnitude, extra = (np.concatenate(c) for c in zip(*(symbols(p) for p in coefficients), strict=True))
    tables = []
    code, length = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
    for k in (0, 1):
        own, counts = np.unique(symbol[kind == k], return_counts=True)
        tables.append(code_lengths(dict(zip(own.tolist(), counts.tolist(), strict=True))))
        book = codes(*tables[k])
        look = np.zeros((272, 2), np.int64)
        for s, pair in book.items():
            look[s] = pair
        code[kind == k], length[kind == k] = look[symbol[kind == k]].T
    packed = b"".join(struct.pack(f"<16H{len(order)}H", *counts, *order) for counts, order in tables)
    value, n = code << extra | magnitude, length + extra
    ends = np.cumsum(n)
    row = np.repeat(np.arange(len(n)), n)
    bits = value[row] >> (ends[row] - 1 - np.arange(len(row))) & 1
    payload = np.packbits(bits.astype(np.uint8)).tobytes()
    luma, chroma = (c.shape[0] * c.shape[1] for c in coefficients[:2])
    return b"DTE0\2" + struct.pack("<5I", width, height, luma, chroma, 25 + len(packed)) + packed + payload


def decode_stream(data: bytes, shapes: list[tuple]) -> list[np.ndarray]:
    """Coefficients of the three planes. Whatever fails ends its plane, the rest of which is zero; the next plane
    goes on at the same bit."""
    out = [np.zeros((s[0] * s[1], 64), np.int16) for s in shapes]
    start = struct.unpack_from("<I", data, 21)[0]
    at, books = 25, []
    for _ in range(2):
        counts = struct.unpack_from("<16H", data, at)
        order = struct.unpack_from(f"<{sum(counts)}H", data, at + 32)
        at += 32 + 2 * sum(counts)
        look = [(0, 0)] * 65536  # by the next 16 bits: symbol and length, 0 for no code
        for s, (c, n) in codes(list(counts), list(order)).items():
            if c >> n == 0:
                look[c << 16 - n : c + 1 << 16 - n] = [(s, n)] * (1 << 16 - n)
        books.append(look)
    payload = data[start:]
    total, place = 8 * len(payload), 0
    octets = np.frombuffer(payload + bytes(4), np.uint8).astype(np.int64)
    window = (octets[:-3] << 24 | octets[1:-2] << 16 | octets[2:-1] << 8 | octets[3:]).tolist()  # 32 bits from each byte on

    def ended():
        nonlocal place
        place = total
        raise EOFError

    def read(n: int) -> int:
        nonlocal place
        if place + n > total:
            ended()
        v = window[place >> 3] >> 32 - n - (place & 7) & (1 << n) - 1
        place += n
        return v

    def symbol(book: list) -> int:
        nonlocal place
        if place >= total:
            ended()
        s, n = book[window[place >> 3] >> 16 - (place & 7) & 0xFFFF]
        if place + (n or 16) > total:
            ended()
        place += n or 16
        if not n:
            raise EOFError
        return s

    def value(s: int) -> int:
        v = read(s) if s else 0
        return v if not s or v >> s - 1 else v - (1 << s) + 1

    for plane in out:
        before = 0
        try:
            for block in plane:
                s = symbol(books[0])
                if s > 17:
                    raise EOFError
                before += value(s)
                block[0] = max(-32768, min(32767, before))
                k = 1
                while k < 64:
                    s = symbol(books[1])
                    if s == 0:
                        break
                    run, size = (s - 256, 16) if s >= 256 else (s >> 4, s & 15)
                    if s == 0xF0:
                        k += 16
                        continue
                    k += run
                    if k > 63:
                        break
                    block[ZZ[k]] = max(-32768, min(32767, value(size)))
                    k += 1
        except EOFError:
            continue
    return [c.reshape(s) for c, s in zip(out, shapes, strict=True)]


def mutate(data: bytes, p: dict, seed: int, counts: Counter) -> bytes:
    """Damage of the payload alone: tail cut, windows rotated, bits flipped, bytes zeroed, in this order."""
    start = struct.unpack_from("<I", data, 21)[0]
    body = bytearray(data[start:])
    drop = min(len(body), int(np.floor(np.float32(len(body)) * np.float32(min(max(p["truncate_tail"], 0.0), 1.0)) + 0.5)))
    if drop:
        del body[len(body) - drop :]
        counts["bytes_truncated"] += drop
    if p["slip_every"] and p["slip_bytes"] and p["slip_window"] > 1:
        for no, at in enumerate(range(0, len(body), p["slip_window"]), 1):
            window = body[at : at + p["slip_window"]]
            by = p["slip_bytes"] % len(window)
            if no % p["slip_every"] == 0 and by:
                body[at : at + len(window)] = window[by:] + window[:by]
                counts["windows_slipped"] += 1
    for i in range(p["byte_flip_every"] - 1, len(body), p["byte_flip_every"]) if p["byte_flip_every"] else ():
        body[i] ^= 1 << splitmix(seed ^ i) % 8
        counts["bytes_flipped"] += 1
    for i in range(p["drop_every"] - 1, len(body), p["drop_every"]) if p["drop_every"] else ():
        body[i] = 0
        counts["bytes_dropped"] += 1
    return data[:start] + bytes(body)
