"""The wavelet codec on whole frames: numpy kernels for a fold over the frames of a stream."""

from __future__ import annotations

from collections import Counter, deque

import numpy as np

from frameloom.operators.wavelet import layout, level_sizes, max_levels
from frameloom.plans.presets import WAVELET_DEFAULTS


def to_planes(frame: np.ndarray) -> np.ndarray:
    """(3, h, w) luma, orange and green differences, reversible."""
    r, g, b = (frame[..., k].astype(np.int32) for k in range(3))
    co = r - b
    t = b + (co >> 1)
    cg = g - t
    return np.stack([t + (cg >> 1), co, cg])


def to_frame(planes: np.ndarray) -> np.ndarray:
    y, co, cg = planes
    t = y - (cg >> 1)
    b = t - (co >> 1)
    return np.clip(np.stack([b + co, cg + t, b], axis=-1), 0, 255).astype(np.uint8)


def lift(a: np.ndarray, axis: int) -> np.ndarray:
    """Low halves, then high halves, along an axis."""
    a = np.moveaxis(a, axis, -1)
    even, odd = a[..., 0::2], a[..., 1::2]
    high = odd - even[..., : odd.shape[-1]]
    low = even.copy()
    low[..., : odd.shape[-1]] += high >> 1
    return np.moveaxis(np.concatenate([low, high], axis=-1), -1, axis)


def unlift(a: np.ndarray, axis: int) -> np.ndarray:
    a = np.moveaxis(a, axis, -1)
    n = a.shape[-1]
    low, high = a[..., : (n + 1) // 2], a[..., (n + 1) // 2 :]
    even = low.copy()
    even[..., : high.shape[-1]] -= high >> 1
    out = np.empty_like(a)
    out[..., 0::2] = even
    out[..., 1::2] = even[..., : high.shape[-1]] + high
    return np.moveaxis(out, -1, axis)


def _round_div(v: np.ndarray, d: int) -> np.ndarray:
    return v if d <= 1 else np.sign(v) * ((np.abs(v) + d // 2) // d)


class WaveletCodec:
    """Encode, damaged decode, history. ``frame_index`` is 0 for the first frame after a reset."""

    defaults = WAVELET_DEFAULTS

    def __init__(self, width: int, height: int, levels: int = 3, quality: int = 82, history_len: int = 12, **params):
        if width < 1 or height < 1 or not 1 <= quality <= 100 or history_len < 1:
            raise ValueError("width, height and history_len are at least 1, quality is 1 to 100")
        self.width, self.height, self.quality = width, height, quality
        self.levels = max(1, min(levels, max_levels(width, height)))
        self.bands = layout(width, height, self.levels, quality)
        self.index = {(c, lv, o): i for i, c, lv, o, *_ in self.bands}
        self.sizes = level_sizes(width, height, self.levels)
        self.params = {**self.defaults, **params}
        self.history_len, self.counts = history_len, Counter()
        self.reset()

    def tune(self, params: dict) -> None:
        """Other parameters from the next frame on; the state stays."""
        self.params = dict(params)

    def reset(self) -> None:
        self.history: deque = deque(maxlen=self.history_len)
        self.frame_index = 0

    def _place(self, level: int, orientation: int) -> tuple[slice, slice]:
        (w, h), (lw, lh) = self.sizes[level - 1], self.sizes[level]
        return (slice(lh, h) if orientation & 2 else slice(0, lh)), (slice(lw, w) if orientation & 1 else slice(0, lw))

    def encode(self, frame: np.ndarray) -> list[np.ndarray]:
        planes = to_planes(frame)
        for w, h in self.sizes[:-1]:
            planes[:, :h, :w] = lift(lift(planes[:, :h, :w], 2), 1)
        return [np.clip(_round_div(planes[(c, *self._place(lv, o))], step), -32768, 32767).astype(np.int16) for _, c, lv, o, _, _, step in self.bands]

    def _source(self, i: int, packet: list, ordinal: int) -> np.ndarray | None:
        """The band that is read for band i: each rule from the band's own place, the last that applies wins."""
        p, (_, c, lv, o, *_) = self.params, self.bands[i]
        due = lambda name: p[name] != 0 and ordinal % p[name] == 0
        back = lambda lag: self.history[max(1, lag) - 1] if max(1, lag) <= len(self.history) else None
        source, own = packet[i], i
        lag = p["lowpass_history_lag"] if o == 0 and p["lowpass_history_lag"] else p["history_lag"] if due("history_band_every") else 0
        if lag and back(lag):
            source = back(lag)[i]
            self.counts["history_used"] += 1
        turned = (o - 1 + p["orientation_rotate"]) % 3 + 1 if o else 0
        rules = (
            ("orientation_rotate", self.index.get((c, lv, turned))),
            ("level_fold", self.index.get((c, (lv - 1 + p["level_fold"]) % self.levels + 1, o))),
            ("channel_route", self.index.get(((c + p["channel_route"]) % 3, lv, o))),
            ("packet_shift", (own + p["packet_shift"]) % len(packet)),
        )
        for name, to in rules:
            if p[name] and due(f"{name}_every") and to is not None:
                source = packet[to]
                self.counts[name] += 1
        if due("packet_loss_every"):
            self.counts["packets_lost"] += 1
            held = back(p["history_lag"]) if p["packet_loss_conceal"] else None
            if not held:
                return None
            source = held[i]
            self.counts["packets_concealed"] += 1
        return source

    def _edited(self, band: np.ndarray, i: int, ordinal: int) -> np.ndarray:
        p, (_, _, _, o, w, h, step) = self.params, self.bands[i]
        k = (ordinal * 1000003 + np.arange(h, dtype=np.uint64)[:, None] * np.uint64(w) + np.arange(w, dtype=np.uint64)).astype(np.uint64)
        hits = lambda n: (k % np.uint64(n) == 0) if n else np.zeros(k.shape, bool)
        v = band.astype(np.int64)
        sign = np.where(v < 0, -1, 1)
        if p["bitplane_clear"]:
            m = hits(p["bitplane_clear_every"])
            v = np.where(m, sign * (np.abs(v) >> p["bitplane_clear"] << p["bitplane_clear"]), v)
            self.counts["bitplanes_cleared"] += int(m.sum())
        if p["bitplane_xor"]:
            m = hits(p["bitplane_xor_every"])
            v = np.where(m, np.where(v < 0, -1, 1) * (np.abs(v) ^ 1 << p["bitplane_xor"] - 1), v)
            self.counts["bitplanes_xored"] += int(m.sum())
        m = hits(p["sign_flip_every"])
        v = np.where(m, -v, v) * step
        self.counts["signs_flipped"] += int(m.sum())
        if o and p["lifting_bias"]:
            m = hits(p["lifting_bias_every"])
            v = v + m * p["lifting_bias"]
            self.counts["samples_biased"] += int(m.sum())
        return np.clip(v, -(1 << 31), (1 << 31) - 1)

    def decode(self, packet: list[np.ndarray]) -> np.ndarray:
        planes = np.zeros((3, self.height, self.width), np.int64)
        for i, (_, c, lv, o, w, h, _) in enumerate(self.bands):
            ordinal = i + self.frame_index
            source = self._source(i, packet, ordinal)
            if source is None or w == 0 or h == 0 or source.size == 0:
                continue
            if source.shape != (h, w):
                source = source[np.arange(h)[:, None] * source.shape[0] // h, np.arange(w) * source.shape[1] // w]
            planes[(c, *self._place(lv, o))] = self._edited(source, i, ordinal)
        planes = planes.astype(np.int32)
        for w, h in reversed(self.sizes[:-1]):
            planes[:, :h, :w] = unlift(unlift(planes[:, :h, :w], 1), 2)
        return to_frame(planes)

    def process(self, frame: np.ndarray) -> np.ndarray:
        packet = self.encode(frame)
        out = self.decode(packet)
        self.history.appendleft(packet)
        self.frame_index += 1
        self.counts["frames_in"] += 1
        self.counts["blocks_encoded"] += len(packet)
        return out

    def estimated_bytes(self, packet: list[np.ndarray]) -> int:
        """Runs of zeros and folded values as variable-length numbers, 16 bytes a band and 16 more."""
        size = lambda v: np.maximum(1, np.ceil(np.log2(v.astype(np.float64) + 1) / 7)).astype(np.int64)
        total = 16 + 16 * len(packet)
        for band in packet:
            flat = band.ravel().astype(np.int64)
            at = np.flatnonzero(flat)
            v = flat[at]
            total += int((size(np.diff(at, prepend=-1) - 1) + size(np.where(v >= 0, 2 * v, -2 * v - 1))).sum())
        return total
