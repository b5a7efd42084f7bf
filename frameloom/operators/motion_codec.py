"""The block-motion codec on whole frames: numpy kernels for a fold over the frames of a stream.

A frame is a keyframe or a packet of blocks with vectors and a residual. The packet's bytes may be damaged; the
decoder then reads a ring of its own past outputs, so damage feeds back. All samples of a frame are computed at
once, as flat arrays over pairs of a block and a pixel it covers.
"""

from __future__ import annotations

import struct
from collections import Counter, deque
from dataclasses import dataclass

import numpy as np

from frameloom.functions import u64
from frameloom.plans.presets import BITSTREAM_DEFAULTS, MOTION_DEFAULTS

MASK = (1 << 64) - 1
U = np.uint64
F32 = np.float32
#: What seeds are crossed with for a second draw, and default cells of samples.
SECOND = {"address_y": 0xA0761D6478BD642F, "residual_y": 0xE7037ED1A0B428DB, "slot": 0x1D8E4E27C47D124F, "codebook": 0x8EBC6AF09C88C6E3}
CELLS = {"switch": (5, 2), "slot": (7, 3), "address": (9, 1), "residual": (1, 1)}


def mix(v) -> np.ndarray:
    v = np.asarray(v, U)
    with np.errstate(over="ignore"):
        v = (v ^ v >> U(30)) * U(u64.MIX_A)
        v = (v ^ v >> U(27)) * U(u64.MIX_B)
    return v ^ v >> U(31)


def unit(v) -> np.ndarray:
    return (mix(v) >> U(40)).astype(F32) / F32(1 << 24)


def dot(*terms) -> np.ndarray:
    with np.errstate(over="ignore"):
        return sum((np.asarray(v).astype(np.int64).astype(U) * U(c & MASK) for v, c in terms), U(0))


def away(v) -> np.ndarray:
    """Rounded half away from zero, as 16 bits."""
    v = np.asarray(v, F32)
    return np.clip(np.sign(v) * np.floor(np.abs(v) + F32(0.5)), -32768, 32767).astype(np.int64)


def lerp(a, b, t):
    return a + (b - a) * np.clip(t, F32(0), F32(1))


@dataclass
class Packet:
    """blocks: (n, 6) integers x, y, w, h, dx, dy; residual (h, w, 3); or a keyframe."""

    width: int
    height: int
    keyframe: np.ndarray | None = None
    blocks: np.ndarray | None = None
    residual: np.ndarray | None = None

    def to_bytes(self) -> bytes:
        key = b"" if self.keyframe is None else self.keyframe.tobytes()
        n, res = (0, b"") if self.blocks is None else (len(self.blocks), self.residual.astype("<i2").tobytes())
        head = b"MSH0" + struct.pack("<BBHIIIII", 1, 0 if key else 1, 0, self.width, self.height, n, len(res) // 2, len(key))
        rows = b"" if self.blocks is None else b"".join(struct.pack("<4H2h", *map(int, b)) for b in self.blocks)
        return head + rows + res + key

    @classmethod
    def from_bytes(cls, data: bytes) -> Packet:
        """Checks the header; bytes after the sections are passed over; blocks are put inside the frame."""
        if len(data) < 28 or data[:4] != b"MSH0" or data[4] != 1 or data[5] > 1:
            raise ValueError("not a packet of this codec")
        w, h, n, samples, key = struct.unpack_from("<5I", data, 8)
        res_at = 28 + 12 * n
        key_at = res_at + 2 * samples
        if len(data) < key_at + key:
            raise ValueError("the packet ends early")
        if data[5] == 0:
            return cls(w, h, keyframe=np.frombuffer(data[key_at : key_at + key], np.uint8).reshape(h, w, 3))
        blocks = np.array([inside(struct.unpack_from("<4H2h", data, 28 + 12 * i), w, h) for i in range(n)], np.int64).reshape(-1, 6)
        residual = np.frombuffer(data[res_at:key_at], "<i2").reshape(h, w, 3)
        return cls(w, h, blocks=blocks, residual=residual)


def inside(b, width: int, height: int) -> tuple:
    x, y = min(b[0], width - 1), min(b[1], height - 1)
    return (x, y, min(max(b[2], 1), width - x), min(max(b[3], 1), height - y), b[4], b[5])


def _turn(a, by: int):
    """Rotated right by ``by``."""
    k = by % len(a) if len(a) else 0
    return a if k == 0 else type(a)(a[-k:] + a[:-k]) if not isinstance(a, np.ndarray) else np.roll(a, k)


def _signed_turn(by: int, n: int) -> int:
    return abs(by) % n * (1 if by > 0 else -1)


def hadamard(n: int) -> np.ndarray:
    h = np.array([[1]])
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def _round_div(v: np.ndarray, d: int) -> np.ndarray:
    return v if d <= 1 else np.sign(v) * ((np.abs(v) + d // 2) // d)


class MotionCodec:
    """Settings of the codec are block_size, search_radius, search_step, keyframe_interval, history_len, feedback."""

    defaults = {**MOTION_DEFAULTS, **{f"bs.{k}": v for k, v in BITSTREAM_DEFAULTS.items()}}

    def __init__(self, width: int, height: int, block_size=16, search_radius=8, search_step=4, keyframe_interval=0, history_len=8, feedback=False, **params):
        if min(width, height, block_size, search_step, history_len) < 1:
            raise ValueError("width, height, block_size, search_step and history_len are at least 1")
        self.width, self.height, self.size, self.radius, self.step = width, height, block_size, max(0, search_radius), search_step
        self.interval, self.depth, self.feedback = keyframe_interval, history_len, feedback
        self.tune({**self.defaults, **params})
        self.counts = Counter()
        self.last = np.zeros((height, width, 3), np.uint8)
        self.reset()
        self.columns, self.rows = -(-width // block_size), -(-height // block_size)
        y, x = np.mgrid[0:height:block_size, 0:width:block_size]
        x, y = x.ravel(), y.ravel()
        self.grid = np.stack([x, y, np.minimum(block_size, width - x), np.minimum(block_size, height - y), 0 * x, 0 * x], axis=1).astype(np.int64)

    def tune(self, params: dict) -> None:
        """Other parameters from the next frame on; the state stays."""
        self.p = {k: v for k, v in params.items() if not k.startswith("bs.")}
        self.bs = {k[3:]: v for k, v in params.items() if k.startswith("bs.")}

    def reset(self) -> None:
        """Rings and codebook go; the count of frames goes on."""
        self.clean: deque = deque(maxlen=self.depth)
        self.dirty: deque = deque(maxlen=self.depth)
        self.codebook: deque = deque()

    # Encoding

    def encode(self, frame: np.ndarray) -> Packet:
        self.counts["frames_in"] += 1
        n = self.counts["frames_in"]
        if not self.clean or (self.interval and (n - 1) % self.interval == 0):
            self.counts["keyframes"] += 1
            return Packet(self.width, self.height, keyframe=frame.copy())
        ref = self.clean[0]
        blocks = self.grid.copy()
        blocks[:, 4:] = self._search(frame, ref)
        dy, dx = (self._spread(blocks[:, k]) for k in (5, 4))
        y, x = np.mgrid[: self.height, : self.width]
        moved = ref[np.clip(y + dy, 0, self.height - 1), np.clip(x + dx, 0, self.width - 1)]
        self.counts["predicted"] += 1
        self.counts["blocks_encoded"] += len(blocks)
        return Packet(self.width, self.height, blocks=blocks, residual=frame.astype(np.int16) - moved.astype(np.int16))

    def _spread(self, values: np.ndarray) -> np.ndarray:
        """A value for each block as one for each pixel."""
        v = values.reshape(self.rows, self.columns)
        return v.repeat(self.size, 0).repeat(self.size, 1)[: self.height, : self.width]

    def _search(self, frame: np.ndarray, ref: np.ndarray) -> np.ndarray:
        each = max(2, self.size // 4)
        weights = np.array([77, 150, 29])
        now, then = (frame.astype(np.int64) @ weights >> 8, ref.astype(np.int64) @ weights >> 8)
        y, x = np.mgrid[: self.height, : self.width]
        take = (y % self.size % each == 0) & (x % self.size % each == 0)
        y, x = y[take], x[take]
        block = y // self.size * self.columns + x // self.size
        best = None
        steps = range(-self.radius, self.radius + 1, self.step)
        out = np.zeros((len(self.grid), 2), np.int64)
        for dy in steps:
            for dx in steps:
                off = np.abs(now[y, x] - then[np.clip(y + dy, 0, self.height - 1), np.clip(x + dx, 0, self.width - 1)])
                error = np.bincount(block, off, len(self.grid)).astype(np.int64)
                cost = np.full(len(error), abs(dx) + abs(dy))
                if best is None:
                    best, held = error, cost
                    out[:] = dx, dy
                    continue
                better = (error < best) | (error == best) & (cost < held)
                best, held = np.where(better, error, best), np.where(better, cost, held)
                out[better] = dx, dy
        return out

    # Damage of the packet

    def _codebook(self, packet: Packet) -> None:
        """Some tiles of the residual come from the codebook; then tiles of the clean residual enter it."""
        b, n = self.bs, 4 if self.bs["codebook_tile_size"] <= 4 else 8 if self.bs["codebook_tile_size"] <= 8 else 16
        if b["codebook_slots"] == 0 or self.width < n or self.height < n:
            return
        clean = packet.residual.copy()
        packet.residual = packet.residual.copy()
        places = [(y, x) for y in range(0, self.height - n + 1, n) for x in range(0, self.width - n + 1, n)]
        fit = [t for t in self.codebook if t.shape[0] == n]
        if b["codebook_replace_every"] and fit:
            for i in range(b["codebook_replace_every"] - 1, len(places), b["codebook_replace_every"]):
                seed = self.counts["frames_in"] * SECOND["address_y"] + i * SECOND["residual_y"] & MASK
                if b["codebook_shuffle_every"] and int(mix(seed)) % b["codebook_shuffle_every"] == 0:
                    tile = fit[int(mix(seed ^ SECOND["codebook"])) % len(fit)]
                else:
                    tile = fit[(i + b["codebook_stride"]) % len(fit)]
                y, x = places[i]
                packet.residual[y : y + n, x : x + n] = tile
                self.counts["codebook_tiles"] += 1
        every = max(1, b["codebook_update_every"])
        for i in range(every - 1, len(places), every):
            y, x = places[i]
            self.codebook.append(clean[y : y + n, x : x + n].copy())
            while len(self.codebook) > b["codebook_slots"]:
                self.codebook.popleft()

    def _slip(self, packet: Packet, seed: int) -> None:
        b = self.bs
        data = packet.residual.astype("<i2").tobytes()
        if b["entropy_slip_every"] == 0 or seed % b["entropy_slip_every"] or b["entropy_slip_bytes"] == 0 or len(data) < 2:
            return
        body = bytearray(data)
        n = len(body) if b["entropy_resync_bytes"] == 0 else min(max(b["entropy_resync_bytes"], 2), len(body))
        for i in range(b["entropy_slip_windows"]):
            at = int(mix(seed * SECOND["address_y"] + i * SECOND["residual_y"] & MASK)) % (len(body) - n + 1)
            body[at : at + n] = _turn(body[at : at + n], _signed_turn(b["entropy_slip_bytes"], n))
            self.counts["entropy_slips"] += 1
        packet.residual = np.frombuffer(bytes(body), "<i2").reshape(packet.residual.shape).astype(np.int16)

    def _coefficients(self, packet: Packet, seed: int) -> None:
        """Tiles of the residual under a Walsh-Hadamard transform: rotated, signs flipped, cut, quantized."""
        b, want = self.bs, self.bs["coeff_block_size"]
        n = 4 if want <= 4 else 8 if want <= 8 else 16
        if b["coeff_glitch_every"] == 0 or seed % b["coeff_glitch_every"] or self.width < n or self.height < n:
            return
        rows, columns = self.height // n, self.width // n
        area = packet.residual[: rows * n, : columns * n].astype(np.int64)
        tiles = area.reshape(rows, n, columns, n, 3).transpose(0, 2, 4, 1, 3).reshape(rows * columns, 3, n, n)
        h = hadamard(n)
        c = (h @ tiles @ h).reshape(rows * columns, 3, n * n)
        tile, channel = np.arange(rows * columns)[:, None], np.arange(3)[None, :]
        if b["coeff_shift"]:
            wobble = mix(U(seed) ^ dot((tile, u64.GOLDEN)) ^ dot((channel, SECOND["address_y"]))) % U(3)
            by = b["coeff_shift"] + wobble.astype(np.int64) - 1
            m = n * n - 1
            place = (np.arange(m) - (np.sign(by) * (np.abs(by) % m))[..., None]) % m
            c[..., 1:] = np.take_along_axis(c[..., 1:], place, 2)
        if b["coeff_sign_flip_every"]:
            no = (tile * n * n + channel * 17)[..., None] + np.arange(n * n) + 1
            flip = no % b["coeff_sign_flip_every"] == 0
            flip[..., 0] = False
            c = np.where(flip, -c, c)
        if b["coeff_zero_high"]:
            high = np.add.outer(np.arange(n), np.arange(n)).ravel() >= b["coeff_zero_high"]
            high[0] = False
            c[..., high] = 0
        q = max(1, b["coeff_quant"])
        c[..., 1:] = _round_div(c[..., 1:], q) * q
        back = np.clip(_round_div(h @ c.reshape(-1, 3, n, n) @ h, n * n), -32768, 32767)
        out = packet.residual.copy()
        out[: rows * n, : columns * n] = back.reshape(rows, columns, 3, n, n).transpose(0, 3, 1, 4, 2).reshape(rows * n, columns * n, 3)
        packet.residual = out
        self.counts["coeff_blocks"] += rows * columns * 3

    def damage(self, packet: Packet) -> Packet:
        """Entropy slips, coefficients, then block by block: sign, delta, address, zeroed and crossed residuals."""
        b, seed = self.bs, self.counts["frames_in"]
        self._slip(packet, seed)
        self._coefficients(packet, seed)
        blocks, residual = packet.blocks, packet.residual.copy()
        for i, row in enumerate(blocks):
            due = lambda name: b[name] and (i + 1) % b[name] == 0  # noqa: B023, E731
            if due("mv_sign_flip_every"):
                row[4:] = np.minimum(-row[4:], 32767)
                self.counts["mv_sign_flipped"] += 1
            if due("mv_delta_every"):
                row[4:] = np.clip(row[4:] + (b["mv_delta_x"], b["mv_delta_y"]), -32768, 32767)
                self.counts["mv_delta_applied"] += 1
            if due("block_address_shift_every"):
                free = np.maximum(0, (self.width - row[2], self.height - row[3]))
                row[:2] = (np.minimum(row[:2], free) + (b["block_address_shift_x"], b["block_address_shift_y"])) % (free + 1)
                self.counts["block_addresses_shifted"] += 1
            x, y, w, h, *_ = inside(row, self.width, self.height)
            if due("residual_zero_every"):
                residual[y : y + h, x : x + w] = 0
                self.counts["residual_blocks_zeroed"] += 1
            if due("residual_xor_every"):
                mask = b["residual_xor_mask"] + 17 * (seed & 255) + i & 255
                word = mask | ((mask << 1 | mask >> 7) & 255) << 8
                residual[y : y + h, x : x + w] ^= np.array(word, np.uint16).view(np.int16)
                self.counts["residual_blocks_xored"] += 1
        packet.residual = residual
        return packet

    # Decoding

    def _bucket(self) -> int:
        return self.counts["frames_in"] // max(1, self.p["reference_latch_frames"])

    def _seed(self, kind: str, block, x, y) -> np.ndarray:
        p, (cx, cy) = self.p, CELLS[kind]
        cx = p["glitch_cell_width"] or p["glitch_cell_size"] or cx
        cy = p["glitch_cell_height"] or p["glitch_cell_size"] or cy
        return dot((block, u64.GOLDEN), (np.full_like(block, self._bucket()), u64.MIX_A), (x // cx, u64.MIX_B), (y // cy, u64.CELL_Y))

    def _sources(self, n: int) -> np.ndarray:
        """The block whose vector each block takes: from a bank, else remapped, else its own."""
        p, i = self.p, np.arange(n)
        out = i.copy()
        if p["block_remap_every"] and p["block_remap_stride"]:
            out = np.where((i + 1) % p["block_remap_every"] == 0, (i + p["block_remap_stride"]) % n, i)
        bank = p["mv_bank_size"]
        if bank and (p["mv_bank_stride"] or p["mv_bank_shuffle_every"]):
            across, down = -(-self.columns // bank), -(-self.rows // bank)
            if across * down > 1:
                column, row = i % self.columns, i // self.columns
                own = row // bank * across + column // bank
                stride = np.full(n, p["mv_bank_stride"])
                if p["mv_bank_shuffle_every"]:
                    seed = dot((i, u64.SLOT_BLOCK), (own, u64.MIX_B), (np.full(n, self._bucket()), u64.SLOT_FRAME))
                    drawn = 1 + (mix(seed ^ U(u64.MIX_A)) % U(across * down - 1)).astype(np.int64)
                    stride = np.where(mix(seed) % U(p["mv_bank_shuffle_every"]) == 0, drawn, stride)
                to = (own + stride) % (across * down)
                out = np.minimum(to // across * bank + row % bank, self.rows - 1) * self.columns + np.minimum(to % across * bank + column % bank, self.columns - 1)
        return out

    def _chain(self, v: np.ndarray, i, around: np.ndarray | None) -> np.ndarray:
        """Scale, diffuse, quantize, jitter, for one block or all."""
        p = self.p
        v = away(np.asarray(v, F32) * np.array([p["mv_scale_x"], p["mv_scale_y"]], F32))
        if around is not None:
            v = away(v + (around - v) * F32(min(max(p["motion_diffusion"], 0.0), 1.0)))
        if p["mv_quant"] > 1:
            v = np.clip(away(v / F32(p["mv_quant"])) * p["mv_quant"], -32768, 32767)
        if p["mv_jitter"]:
            span = 2 * p["mv_jitter"] + 1
            wobble = np.stack([(np.asarray(i) * 1103515245 + axis * 2654435761 + 12345) % span for axis in (0, 1)], axis=-1)
            v = np.clip(v + wobble - p["mv_jitter"], -32768, 32767)
        return v

    def _around(self, blocks: np.ndarray) -> np.ndarray:
        """Mean scaled vector of the 3 x 3 blocks about each."""
        p = self.p
        v = np.zeros((self.rows + 2, self.columns + 2, 3))
        v[1:-1, 1:-1, :2] = away(blocks[:, 4:].astype(F32) * np.array([p["mv_scale_x"], p["mv_scale_y"]], F32)).reshape(self.rows, self.columns, 2)
        v[1:-1, 1:-1, 2] = 1
        s = sum(v[r : r + self.rows, c : c + self.columns] for r in range(3) for c in range(3))
        return (s[..., :2] / s[..., 2:]).reshape(-1, 2).astype(F32)

    def _vectors(self, blocks: np.ndarray) -> np.ndarray:
        p, n = self.p, len(blocks)
        around = self._around(blocks) if p["motion_diffusion"] else None
        taken = blocks[self._sources(n), 4:]
        if p["mv_predictor_desync_every"] == 0:
            return self._chain(taken, np.arange(n), around)
        out = np.zeros((n, 2), np.int64)
        own = blocks[:, 4:]

        def mean(v, i):
            near = ([v[i - 1]] if i % self.columns else []) + ([v[i - self.columns]] if i >= self.columns else [])
            return np.trunc(sum(near) / len(near)).astype(np.int64) if near else np.zeros(2, np.int64)

        for i in range(n):  # each block's vector stands on those decoded before it
            v = mean(out, i) + taken[i] - mean(own, i)
            if (i + 1) % p["mv_predictor_desync_every"] == 0:
                v = v + (p["mv_predictor_desync_x"], p["mv_predictor_desync_y"])
            out[i] = self._chain(np.clip(v, -32768, 32767), i, None if around is None else around[i])
        return out

    def _mix(self, score: np.ndarray) -> np.ndarray:
        p = self.p
        if p["activity_mode"] == "all":
            return np.ones(score.shape, F32)
        if p["activity_softness"] == 0:
            g = (score >= p["activity_threshold"]).astype(F32)
        else:
            t = np.clip((score.astype(F32) - F32(p["activity_threshold"])) / F32(p["activity_softness"]), F32(0), F32(1))
            g = t * t * (F32(3) - F32(2) * t)
        return g if p["activity_mode"] == "active" else F32(1) - g

    def _lag(self, offset: np.ndarray, limit: int) -> np.ndarray:
        return 1 + (max(1, self.p["reference_lag"]) - 1 + offset) % limit

    def _lags(self, block, x, y) -> list[np.ndarray]:
        """For each channel the lag that a dirty sample reads at: slices, else scan lines, else shuffled slots."""
        p, bucket, have = self.p, self._bucket(), len(self.dirty)
        held = lambda span: max(1, min(span, have))
        plain = np.full(len(x), max(1, p["reference_lag"]))
        if p["temporal_slice_height"] and p["temporal_slice_lag_span"]:
            n = held(p["temporal_slice_lag_span"])
            lag = self._lag((y // p["temporal_slice_height"] + bucket * p["temporal_slice_drift"]) % n, n)
        elif p["reference_scanline_height"] and p["reference_scanline_lag_span"]:
            n = held(p["reference_scanline_lag_span"])
            seed = dot((y // p["reference_scanline_height"], u64.SLOT_BLOCK), (x // 32, u64.MIX_B), (np.full_like(x, bucket), u64.SLOT_FRAME))
            lag = self._lag((mix(seed) % U(n)).astype(np.int64), n)
        elif p["reference_slot_count"] <= 1 or p["reference_slot_shuffle_every"] == 0:
            lag = plain
        else:
            n, seed = held(p["reference_slot_count"]), self._seed("slot", block, x, y)
            drawn = self._lag((mix(seed ^ U(SECOND["slot"])) % U(n)).astype(np.int64), n)
            lag = np.where(mix(seed) % U(p["reference_slot_shuffle_every"]) == 0, drawn, plain)
        out = [lag] * 3
        if span := p["reference_channel_lag_span"]:
            n = held(span)
            wobble = (mix(self._seed("slot", block, x, y)) % U(n)).astype(np.int64) if p["reference_slot_shuffle_every"] else 0
            out = [self._lag((c * p["reference_channel_lag_stride"] + bucket + wobble) % n, n) + 0 * x for c in range(3)]
        return [np.clip(lag, 1, have) - 1 for lag in out]

    def _field(self, vectors, block, x, y) -> np.ndarray:
        """The block's vector blended with the field that runs between block corners."""
        own = vectors[block].astype(F32)
        strength = F32(min(max(self.p["mv_field_interpolation"], 0.0), 1.0))
        if strength <= 0:
            return own
        c, r = np.minimum(x // self.size, self.columns - 1), np.minimum(y // self.size, self.rows - 1)
        c1, r1 = np.minimum(c + 1, self.columns - 1), np.minimum(r + 1, self.rows - 1)
        fx, fy = ((v % self.size).astype(F32)[:, None] / F32(self.size) for v in (x, y))
        at = lambda r, c: vectors[r * self.columns + c].astype(F32)
        field = lerp(lerp(at(r, c), at(r, c1), fx), lerp(at(r1, c), at(r1, c1), fx), fy)
        return lerp(own, field, strength)

    def _residual_place(self, block, x, y) -> tuple[np.ndarray, np.ndarray]:
        p, w, h = self.p, self.width, self.height
        sx, sy = x, y
        bank = p["residual_bank_size"]
        if bank and (p["residual_bank_stride"] or p["residual_bank_shuffle_every"]):
            across, down = -(-w // bank), -(-h // bank)
            if across * down > 1:
                own = y // bank * across + x // bank
                stride = np.full(len(x), p["residual_bank_stride"])
                if p["residual_bank_shuffle_every"]:
                    seed = dot((block, u64.GOLDEN), (own, u64.MIX_B), (np.full_like(x, self._bucket()), u64.MIX_A))
                    drawn = 1 + (mix(seed ^ U(SECOND["address_y"])) % U(across * down - 1)).astype(np.int64)
                    stride = np.where(mix(seed) % U(p["residual_bank_shuffle_every"]) == 0, drawn, stride)
                to = (own + stride) % (across * down)
                sx = np.minimum(to % across * bank + x % bank, w - 1)
                sy = np.minimum(to // across * bank + y % bank, h - 1)
        dx, dy = p["residual_address_shift_x"], p["residual_address_shift_y"]
        if (j := max(0, p["residual_address_jitter"])) > 0:
            seed = self._seed("residual", block, x, y)
            dx = dx + away((unit(seed) * F32(2) - F32(1)) * F32(j))
            dy = dy + away((unit(seed ^ U(SECOND["residual_y"])) * F32(2) - F32(1)) * F32(j))
        return np.clip(sx + dx, 0, w - 1), np.clip(sy + dy, 0, h - 1)

    def _sample(self, stack, lag, x, y, channel, wrap: bool) -> np.ndarray:
        """Bilinear reading of frames of the ring at real places."""
        x0, y0 = np.floor(x), np.floor(y)
        fx, fy = x - x0, y - y0
        x0, y0 = x0.astype(np.int64), y0.astype(np.int64)
        fit = (lambda v, n: v % n) if wrap else (lambda v, n: np.clip(v, 0, n - 1))
        xs, ys = [fit(x0 + k, self.width) for k in (0, 1)], [fit(y0 + k, self.height) for k in (0, 1)]
        p = [[stack[lag, ys[j], xs[i], channel].astype(F32) for i in (0, 1)] for j in (0, 1)]
        return lerp(lerp(p[0][0], p[0][1], fx), lerp(p[1][0], p[1][1], fx), fy)

    def _covered(self, blocks: np.ndarray, margin: int):
        """(block, x, y, whether in its core) of all pairs, block after block."""
        out = []
        for i, (bx, by, w, h, *_) in enumerate(blocks):
            y, x = np.mgrid[max(0, by - margin) : min(self.height, by + h + margin), max(0, bx - margin) : min(self.width, bx + w + margin)]
            out.append((np.full(x.size, i), x.ravel(), y.ravel()))
        block, x, y = (np.concatenate(c) for c in zip(*out, strict=True))
        b = blocks[block]
        return block, x, y, (x >= b[:, 0]) & (x < b[:, 0] + b[:, 2]) & (y >= b[:, 1]) & (y < b[:, 1] + b[:, 3])

    def decode(self, packet: Packet) -> np.ndarray:
        if packet.keyframe is not None:
            return packet.keyframe.copy()
        p, blocks, residual = self.p, packet.blocks, packet.residual.astype(np.int64)
        vectors = self._vectors(blocks)
        size = np.abs(residual)
        cost = np.abs(blocks[:, 4]) + np.abs(blocks[:, 5])
        scores = np.array([int(size[y : y + h, x : x + w].sum()) // max(1, 3 * w * h) for x, y, w, h, *_ in blocks]) + 4 * cost
        block_mix = self._mix(scores)
        invert = (block_mix > 0) & ((np.arange(len(blocks)) + 1) % p["residual_invert_every"] == 0) if p["residual_invert_every"] else np.zeros(len(blocks), bool)
        overlap = min(p["overlap"], self.size)
        block, x, y, core = self._covered(blocks, overlap)
        weight = np.ones(len(x), F32)
        if overlap:
            for v, at, n in ((x, 0, 2), (y, 1, 3)):
                start, end = blocks[block, at], blocks[block, at] + blocks[block, n]
                away_by = np.where(v < start, start - v, np.where(v >= end, v - end + 1, 0))
                weight = weight * np.clip(F32(1) - away_by.astype(F32) / F32(overlap + 1), F32(0), F32(1))
        activity = np.where(core, self._mix(size[y, x].sum(axis=1) // 3 + 2 * cost[block]), block_mix[block])
        bleed = F32(min(max(p["reference_bleed"], 0.0), 1.0))
        chance = bleed + np.clip(activity, F32(0), F32(1)) * (F32(1) - bleed)
        keep = (weight > 0) & (core | (chance > 0))
        block, x, y, weight, chance = (v[keep] for v in (block, x, y, weight, chance))
        use = np.where(chance >= 1, True, np.where(chance <= 0, False, unit(self._seed("switch", block, x, y)) < chance))
        field = self._field(vectors, block, x, y)
        if (reach := F32(min(max(p["sample_address_desync"], 0.0), 16.0))) > 0:
            seed = self._seed("address", block, x, y)
            field = field + np.stack([(unit(seed) * F32(2) - F32(1)) * reach, (unit(seed ^ U(SECOND["address_y"])) * F32(2) - F32(1)) * reach * F32(0.45)], axis=1)
        rx, ry = self._residual_place(block, x, y)
        turn = np.full(len(x), p["residual_channel_shift"])
        if p["residual_channel_shift"] and p["reference_latch_frames"] > 1:
            turn = turn + (mix(dot((block, u64.GOLDEN), (np.full_like(x, self._bucket()), u64.MIX_A))) % U(3)).astype(np.int64)
        gain = F32(min(max(p["residual_keep"], -2.0), 2.0))
        dirty, clean = np.stack(self.dirty), np.stack([self.clean[0] if self.clean else self.dirty[0]])
        own = blocks[block, 4:].astype(F32)
        none = np.zeros(len(x), np.int64)
        values = np.empty((len(x), 3), F32)
        lags = self._lags(block, x, y)
        for c in range(3):
            r = residual[ry, rx, (c + turn) % 3].astype(F32)
            moved = self._sample(dirty, lags[c], x.astype(F32) + field[:, 0] + F32(p["channel_shift"] * c), y.astype(F32) + field[:, 1], (c + p["reference_channel_shift"]) % 3, p["wrap_motion"])
            plain = self._sample(clean, none, x.astype(F32) + own[:, 0], y.astype(F32) + own[:, 1], c, False)
            values[:, c] = np.where(use, moved + r * gain * np.where(invert[block], F32(-1), F32(1)), plain + r)
        out = self.last.copy()
        if overlap == 0:
            out[y, x] = np.clip(np.sign(values) * np.floor(np.abs(values) + F32(0.5)), 0, 255).astype(np.uint8)  # a later block wins
            return out
        flat = y * self.width + x
        total = np.bincount(flat, weight, self.width * self.height)
        mean = np.stack([np.bincount(flat, values[:, c] * weight, self.width * self.height) for c in range(3)], axis=1) / np.where(total > 0, total, 1)[:, None]
        return np.clip(np.floor(np.where(total[:, None] > 0, mean, 0) + 0.5), 0, 255).astype(np.uint8).reshape(self.height, self.width, 3)

    def process(self, frame: np.ndarray) -> np.ndarray:
        packet = self.encode(frame)
        if packet.blocks is not None and (self.bs["enabled"] or any(v for k, v in self.bs.items() if k.endswith("_every") and k != "codebook_update_every" and k != "codebook_shuffle_every")):
            self._codebook(packet)
            packet = Packet.from_bytes(self.damage(packet).to_bytes())
        out = self.decode(packet)
        self.clean.appendleft(out if self.feedback else frame.copy())
        self.dirty.appendleft(out)
        self.last = out
        return out
