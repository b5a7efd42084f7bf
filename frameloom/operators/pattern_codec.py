"""A second motion codec with thirteen patterns of damage and eighteen overrides, not bit-compatible with the first.

A frame's samples are computed at once. Rings have fixed slots: frame n writes slot n mod slots, and a lag counts
back from there. Kernels work on blue, green, red.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

M32 = (1 << 32) - 1
#: Menu order and the pattern that each entry runs.
PATTERNS = {
    "clean": 8, "melt": 0, "slice-drift": 1, "plane-desync": 2, "residual-desync": 3, "vector-bank": 4, "entropy-slip": 5,
    "codebook": 6, "state-collapse": 7, "row-pitch": 9, "scale-mismatch": 10, "packet-loss": 11, "weave": 12,
}
VECTOR_DECODE = ("pattern", "original", "reverse", "vertical", "static", "radial")
#: What can be overridden, with the value that a set override starts from.
OVERRIDES = {
    "mv_scale": 1.0, "mv_jitter": 0, "vector_interpolation": 0.0, "sample_address_desync": 0.0, "reference_lag": 1, "reference_bleed": 0.0,
    "reference_latch_frames": 1, "temporal_slice_drift": 0, "residual_keep": 1.0, "residual_address_jitter": 0, "residual_channel_shift": 0,
    "entropy_slip_every": 0, "entropy_slip_windows": 1, "coeff_shift": 0, "coeff_quant": 1, "codebook_replace_every": 0, "codebook_stride": 1,
    "codebook_shuffle_every": 0,
}
#: Patterns that predict from the ring of outputs.
RECURSIVE = (0, 1, 2, 4, 7, 12)
F32 = np.float32


def mixed(v) -> np.ndarray:
    """A 32-bit mixer; the result is non-negative in 64 bits."""
    v = np.asarray(v, np.int64).astype(np.uint64) & np.uint64(M32)
    with np.errstate(over="ignore"):
        v = (v ^ v >> np.uint64(16)) * np.uint64(0x7FEB352D) & np.uint64(M32)
        v = (v ^ v >> np.uint64(15)) * np.uint64(0x846CA68B) & np.uint64(M32)
    return (v ^ v >> np.uint64(16)).astype(np.int64)


def away(v) -> np.ndarray:
    return (np.sign(v) * np.floor(np.abs(v) + F32(0.5))).astype(np.int64)


def short(v) -> np.ndarray:
    return np.clip(v, -32768, 32767)


class PatternCodec:
    """Overrides are given by name; one that is not given leaves the pattern as it is."""

    def __init__(self, width: int, height: int, pattern: str | int = "clean", *, intensity=1.0, motion=1.0, residual=1.0, temporal=1.0, bitstream=1.0, block_size=16, search_radius=8, search_step=4, slots=8, vector_decode: str = "pattern", seed=1, **overrides):
        unknown = overrides.keys() - OVERRIDES.keys()
        if unknown or min(width, height, block_size) < 1 or slots < 2:
            raise ValueError(f"sizes are over 0, slots are 2 or more, overrides are among {', '.join(OVERRIDES)}")
        self.pattern = PATTERNS[pattern] if isinstance(pattern, str) else pattern
        self.w, self.h, self.size, self.slots, self.seed = width, height, block_size, slots, seed
        self.radius, self.step, self.vectors_from = search_radius, max(1, search_step), VECTOR_DECODE.index(vector_decode)
        self.i, self.m, self.r, self.t, self.b = intensity, motion, residual, temporal, bitstream
        self.set, self.o = set(overrides), {**OVERRIDES, **overrides}
        self.columns, self.rows = -(-width // block_size), -(-height // block_size)
        self.y, self.x = np.mgrid[:height, :width]
        self.bx, self.by = self.x // block_size, self.y // block_size
        self.block = self.by * self.columns + self.bx
        self.pixel = self.y * width + self.x
        self.counts = Counter()
        self.reset()

    def reset(self) -> None:
        self.n = 0

    def _slot(self, lag, available: int):
        return (self.n + self.slots - np.clip(lag, 1, available)) % self.slots

    def _read(self, ring: np.ndarray, slot, x, y) -> np.ndarray:
        return ring[slot, np.clip(y, 0, self.h - 1), np.clip(x, 0, self.w - 1)].astype(np.int64)

    def _at(self, plane: np.ndarray, x, y) -> np.ndarray:
        return plane[y % self.h, x % self.w].astype(np.int64)

    def _strength(self, v: np.ndarray) -> np.ndarray:
        """How far a pattern moves: the vector's cost, within the radius, scaled."""
        cost = np.maximum(1, np.minimum(self.radius, np.abs(v[..., 0]) + np.abs(v[..., 1])))
        return np.maximum(1, (cost.astype(F32) * F32(self.m) * F32(self.i)).astype(np.int64))

    def _amount(self, control: float, factor: float) -> int:
        return max(1, int(F32(control) * F32(self.i) * F32(factor)))

    # Encoding

    def _search(self, frame: np.ndarray, ref: np.ndarray) -> np.ndarray:
        luma = lambda f: f.astype(np.int64) @ np.array([29, 150, 77]) >> 8
        now, then, each = luma(frame), luma(ref), max(2, self.size // 4)
        take = (self.y % self.size % each == 0) & (self.x % self.size % each == 0)
        y, x, block = self.y[take], self.x[take], self.block[take]
        best = None
        for dy in range(-self.radius, self.radius + 1, self.step):
            for dx in range(-self.radius, self.radius + 1, self.step):
                off = np.abs(now[y, x] - then[np.clip(y + dy, 0, self.h - 1), np.clip(x + dx, 0, self.w - 1)])
                key = np.bincount(block, off, self.rows * self.columns).astype(np.int64) * 65536 + abs(dx) + abs(dy)
                if best is None:
                    best, out = key, np.full((len(key), 2), (dx, dy))
                better = key < best
                best = np.where(better, key, best)
                out[better] = dx, dy
        return out

    def _decoded_vector(self, v: np.ndarray) -> np.ndarray:
        """The vector that the residual is taken against."""
        kind, s, zero = self.vectors_from, self._strength(v), np.zeros_like(v)
        if kind == 1 or (kind == 0 and self.pattern == 0):
            return v
        if kind == 2:
            return -v
        if kind == 3:
            return np.stack([0 * s, np.where((self.bx + self.by) & 1, s, -s)], axis=-1)
        if kind == 5:
            dx, dy = self.bx - self.columns // 2, self.by - self.rows // 2
            flat = np.abs(dx) >= np.abs(dy)
            return np.stack([np.where(flat, np.where(dx >= 0, s, -s), 0), np.where(flat, 0, np.where(dy >= 0, s, -s))], axis=-1)
        return zero

    # Decoding

    def _quarter(self, which: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Down, left, up or right by s."""
        return np.stack([np.select([which == 1, which == 3], [-s, s], 0), np.select([which == 0, which == 2], [s, -s], 0)], axis=-1)

    def _motion(self, vectors: np.ndarray, own: np.ndarray, noise: np.ndarray) -> np.ndarray:
        n, bx, by, s, p = self.n, self.bx, self.by, self._strength(own), self.pattern
        bank = lambda x, y: vectors[y % self.rows * self.columns + x % self.columns]
        upright = lambda odd: np.stack([0 * s, np.where(odd & 1, s, -s)], axis=-1)
        if p == 1:
            return upright(bx + n // 4)
        if p == 3:
            return upright(bx + by + n // 5)
        if p == 12:
            return upright(self.y // max(1, self.size // 2) + n // 3)
        if p == 4:
            stride, way = self._amount(self.m, 3.0), noise >> 2 & 3
            moved = bank(bx + np.select([way == 1, way == 3], [-stride, stride], 0), by + np.select([way == 0, way == 2], [stride, -stride], 0))
            return self._quarter(way, self._strength(moved))
        if p == 6:
            d = np.where((bx ^ by ^ n // 6) & 1, s, -s)
            return np.stack([d, -d], axis=-1)
        if p == 7:
            reach = self._amount(self.m, 4.0)
            moved = bank(bx + (noise >> 3) % (2 * reach + 1) - reach, by + (noise >> 11) % (2 * reach + 1) - reach)
            return self._quarter(noise >> 19 & 3, self._strength(moved))
        return np.zeros_like(own) if p in (2, 5, 9, 10, 11) else own

    def _overridden_motion(self, v: np.ndarray, vectors: np.ndarray, own: np.ndarray, latched: int) -> np.ndarray:
        o = self.o
        if "vector_interpolation" in self.set and o["vector_interpolation"] > 0:
            right = vectors[self.by * self.columns + np.minimum(self.bx + 1, self.columns - 1)]
            down = vectors[np.minimum(self.by + 1, self.rows - 1) * self.columns + self.bx]
            a = F32(min(1.0, o["vector_interpolation"]))
            v = short(away(v.astype(F32) * (F32(1) - a) + (own + right + down).astype(F32) / F32(3) * a))
        if "mv_scale" in self.set:
            v = short(away(v.astype(F32) * F32(o["mv_scale"])))
        if "mv_jitter" in self.set and o["mv_jitter"] > 0:
            noise, span = mixed(self.block * 2654435761 & M32 ^ latched ^ self.seed), 2 * o["mv_jitter"] + 1
            v = short(v + np.stack([noise % span, (noise >> 16) % span], axis=-1) - o["mv_jitter"])
        return v

    def _lag(self, span: int, available: int, latched: int) -> np.ndarray:
        n, x, y, p, o = self.n, self.x, self.y, self.pattern, self.o
        half = max(1, self.size // 2)
        lag = np.ones_like(x)
        if p == 0:
            lag = lag * span
        elif p == 1:
            lag = 1 + (x // half + n) % span
        elif p == 7:
            lag = 1 + mixed(self.bx * 73856093 & M32 ^ self.by * 19349663 & M32 ^ n // 2 ^ self.seed) % span
        elif p == 11:
            lag = 1 + mixed(self.block * 2654435761 & M32 ^ n // 2 ^ self.seed) % span
        elif p == 12:
            lag = 1 + (x // self.size + y // half + n) % span
        if "reference_lag" in self.set:
            lag = np.full_like(x, max(1, o["reference_lag"]))
        if "temporal_slice_drift" in self.set and o["temporal_slice_drift"]:
            lag = lag + (y // half + latched) * o["temporal_slice_drift"]
        return 1 + (lag - 1) % max(1, available)

    def _slipped(self, residual: np.ndarray, pixel, channel: int, slip) -> np.ndarray:
        """A residual read at a byte place: four 16-bit words a pixel, the last of them 0."""
        words = np.zeros((self.h * self.w, 4), np.int16)
        words[:, :3] = residual.reshape(-1, 3)
        data = words.view(np.uint8).ravel().astype(np.int64)
        at = (pixel * 8 + channel * 2 + slip) % len(data)
        value = data[at] | data[(at + 1) % len(data)] << 8
        return np.where(value > 32767, value - 65536, value)

    def _residual(self, residual: np.ndarray, noise: np.ndarray, available: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(residual as the pattern reads it, the pixel it reads, whether the packet is lost)."""
        n, x, y, bx, by, p, w, h = self.n, self.x, self.y, self.bx, self.by, self.pattern, self.w, self.h
        lost = np.zeros((h, w), bool)
        at = lambda x, y: y % h * w + x % w
        place = self.pixel
        if p == 3:
            s, way = self._amount(self.r, 13.0), bx + by + n // 4 & 3
            place = at(x + np.select([way == 1, way == 2], [-(s // 3), s // 2], 0), y + np.where((way == 0) | (way == 2), s, -s))
        elif p == 5:
            s, way = self._amount(self.b, 7.0), bx + by + n // 3 & 3
            read = np.select([way == 0, way == 1, way == 2], [(x * h + y) % (w * h), at(w - 1 - x, y), ((w - 1 - x) * h + y) % (w * h)], at(x, h - 1 - y))
            slip = np.where(noise & 1, s, -s)
            return np.stack([self._slipped(residual, read, 0, slip), self._slipped(residual, read, 1, -slip), self._slipped(residual, read, 2, slip + np.where(way & 1, 2, -2))], axis=-1), place, lost
        elif p == 6:
            tile = max(4, min(self.size, 16))
            lx, ly, way, stride = x % tile, y % tile, noise >> 8 & 3, self._amount(self.b, 3.0)
            sx = np.select([way == 1, way == 2, way == 3], [ly, tile - 1 - lx, tile - 1 - ly], lx)
            sy = np.select([way == 1, way == 2, way == 3], [tile - 1 - lx, tile - 1 - ly, lx], ly)
            tx, ty = x // tile + np.where(noise & 1, stride, -stride), y // tile + np.where(noise & 2, -stride, stride)
            slot = self._slot(1 + noise % max(1, available), available)
            return self.kept[slot, (ty * tile + sy) % h, (tx * tile + sx) % w].astype(np.int64), place, lost
        elif p == 7:
            reach = self._amount(self.r, 9.0)
            rx, ry = x + (noise >> 5) % (2 * reach + 1) - reach, y + (noise >> 13) % (2 * reach + 1) - reach
            lx, ly, turn = rx - bx * self.size, ry - by * self.size, (noise & 0x20000) != 0
            place = at(np.where(turn, bx * self.size + ly, rx), np.where(turn, by * self.size + self.size - 1 - lx, ry))
        elif p == 9:
            off = max(1, int(F32(self.size) * F32(self.b) * F32(self.i)))
            pitch = np.maximum(1, w + np.where(by + n // 3 & 1, off, -off))
            place = (y * pitch + x) % (w * h)
        elif p == 10:
            size = np.where(bx + by + n // 4 & 1, max(4, self.size // 2), min(64, self.size * 2))
            sx = x // size * self.size + x % size * self.size // size
            sy = y // size * self.size + y % size * self.size // size
            lx, ly, turn = sx % self.size, sy % self.size, (noise >> 7 & 1) == 1
            place = at(np.where(turn, sx - lx + ly, sx), np.where(turn, sy - ly + self.size - 1 - lx, sy))
        elif p == 11:
            drawn = mixed(self.block * 2246822519 & M32 ^ n // 2 ^ self.seed)
            lost = drawn % max(2, 8 - int(F32(self.b) * F32(self.i) * F32(2))) == 0
            slot = self._slot(1 + (drawn >> 8) % max(1, available), available)
            old = self.kept[slot, y, (x + np.where(drawn >> 16 & 1, self.size, -self.size)) % w].astype(np.int64)
            swapped = np.where((drawn & 1 == 1)[..., None], 0, old)
            return np.where(lost[..., None], swapped, residual), place, lost
        return residual.reshape(-1, 3)[place], place, lost

    def _overridden_residual(self, r: np.ndarray, residual: np.ndarray, place: np.ndarray, noise: np.ndarray, latched: int, available: int) -> np.ndarray:
        o, x, y = self.o, self.x, self.y
        due = lambda name: (self.block + latched) % o[name] == 0 if name in self.set and o[name] > 0 else np.zeros(x.shape, bool)
        if "residual_address_jitter" in self.set and (reach := o["residual_address_jitter"]) > 0:
            drawn, span = mixed(noise ^ latched * 2246822519 & M32), 2 * reach + 1
            place = (y + (drawn >> 16) % span - reach) % self.h * self.w + (x + drawn % span - reach) % self.w
            r = residual.reshape(-1, 3)[place]
        m = due("entropy_slip_every")
        if m.any():
            window = (x // max(1, self.size // 2) + self.by) % max(1, o["entropy_slip_windows"])
            slip = (window + 1) * np.where(noise & 1, 1, -1)
            slipped = np.stack([self._slipped(residual, place, 0, slip), self._slipped(residual, place, 1, -slip), self._slipped(residual, place, 2, slip + window)], axis=-1)
            r = np.where(m[..., None], slipped, r)
        m = due("codebook_replace_every")
        if m.any():
            stride = np.where(due("codebook_shuffle_every"), (noise >> 8) % max(1, self.columns) - self.columns // 2, o["codebook_stride"])
            down = np.sign(stride) * (np.abs(stride) // max(1, self.columns))
            sx = (self.bx + stride) % self.columns * self.size + x % self.size
            sy = (self.by + down) % self.rows * self.size + y % self.size
            old = self.kept[self._slot(max(1, o["reference_lag"]), available), sy % self.h, sx % self.w].astype(np.int64)
            r = np.where(m[..., None], old, r)
        if "coeff_shift" in self.set:
            r = np.roll(r, -(o["coeff_shift"] % 3), axis=-1)
        if "coeff_quant" in self.set and o["coeff_quant"] > 1:
            r = short(away(r.astype(F32) / F32(o["coeff_quant"])) * o["coeff_quant"])
        if "residual_channel_shift" in self.set:
            r = np.roll(r, -(o["residual_channel_shift"] % 3), axis=-1)
        return r

    def process(self, frame: np.ndarray) -> np.ndarray:
        """One rgb frame; the first after a reset fills all slots and comes out as it is."""
        now = frame[..., ::-1].astype(np.int64)
        self.counts["frames_in"] += 1
        if self.n == 0:
            self.clean, self.dirty = np.repeat(now[None].astype(np.uint8), self.slots, 0), np.repeat(now[None].astype(np.uint8), self.slots, 0)
            self.kept = np.zeros((self.slots, self.h, self.w, 3), np.int16)
            self.n = 1
            return frame.copy()
        n, x, y, p, o = self.n, self.x, self.y, self.pattern, self.o
        available, before = min(n, self.slots), (n - 1) % self.slots
        vectors = self._search(now, self.clean[before])
        own = vectors[self.block]
        base = self._decoded_vector(own)
        residual = now - self._read(self.clean, before, x + base[..., 0], y + base[..., 1])
        noise = mixed(self.pixel ^ n * 977 & M32 ^ self.seed)
        latched = n // (max(1, o["reference_latch_frames"]) if "reference_latch_frames" in self.set else 1)
        motion = base if self.vectors_from else self._motion(vectors, own, noise)
        motion = self._overridden_motion(motion, vectors, own, latched)
        span = max(1, min(available, 1 + int(F32(self.t) * F32(self.i) * F32(4))))
        slot = self._slot(self._lag(span, available, latched), available)
        active = np.abs(residual).sum(axis=-1) // 3 + 4 * np.abs(own).sum(axis=-1)
        corrupt = (active >= max(2, 18 - int(F32(self.i) * F32(6)))) & (p != 8)
        made, place, lost = self._residual(residual, noise, available)
        lost = lost & corrupt
        r = np.where(corrupt[..., None], made, residual)
        r = self._overridden_residual(r, residual, np.where(corrupt, place, self.pixel), noise, latched, available)
        keep = np.ones(x.shape, F32)
        soft = {0: max(F32(0), F32(0.35) - F32(self.r) * F32(self.i) * F32(0.3)), 7: F32(0.15), 10: F32(0.7), 12: F32(0.12)}
        soft[1] = soft[0]
        keep[corrupt] = soft.get(p, F32(1))
        keep[lost] = 0
        if "residual_keep" in self.set:
            keep[:] = min(2.0, max(-2.0, o["residual_keep"]))
        ox = oy = 0
        if "sample_address_desync" in self.set and (reach := max(0, int(away(F32(o["sample_address_desync"]))))) > 0:
            drawn, wide = mixed(noise ^ latched * 3266489917 & M32), 2 * reach + 1
            ox, oy = drawn % wide - reach, (drawn >> 16) % wide - reach
        dirty = self._read(self.dirty, slot, x + motion[..., 0] + ox, y + motion[..., 1] + oy)
        if self.vectors_from == 0 and p in (3, 5, 6):
            base = np.where(corrupt[..., None], 0 if p == 5 else motion, base)
        plain = self._read(self.clean, before, x + base[..., 0] + ox, y + base[..., 1] + oy)
        guess = np.where((corrupt & (p in RECURSIVE) | lost)[..., None], dirty, plain)
        if "reference_bleed" in self.set and o["reference_bleed"] > 0:
            a = F32(min(1.0, o["reference_bleed"]))
            guess = away(plain.astype(F32) * (F32(1) - a) + dirty.astype(F32) * a)
        values = guess + np.trunc(r.astype(F32) * keep[..., None]).astype(np.int64)
        if p == 2:
            s = self._strength(own)
            for c in range(3):
                v = motion if self.vectors_from else np.stack(((0 * s, s), (-s, 0 * s), (0 * s, -s))[c], axis=-1)
                old = self._read(self.dirty, self._slot(1 + (c + n) % span, available), x + v[..., 0], y + v[..., 1])[..., c]
                values[..., c] = np.where(corrupt, old + np.trunc(r[..., c].astype(F32) * F32(0.25)).astype(np.int64), values[..., c])
        out = np.clip(values, 0, 255).astype(np.uint8)
        here = n % self.slots
        self.dirty[here], self.clean[here], self.kept[here] = out, now, residual
        self.n += 1
        self.counts["damaged_samples"] += int(corrupt.sum())
        return out[..., ::-1].copy()
