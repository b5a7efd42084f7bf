"""The line-signal codec on whole frames: a fold over the frames of a stream.

A frame becomes a signal of line records in interlaced order. The receiver is a machine whose phase, burst error and
lock outlive the frame. Recurrences along a line run over all lines of a frame at once.
"""

from __future__ import annotations

import struct
from collections import Counter, deque
from dataclasses import dataclass

import numpy as np

from frameloom.plans.presets import SCANLINE_DEFAULTS

#: Fixed values of the signal.
SYNC, VERSION, COLOUR_QUANT = b"\xa5\x5a", 7, 2
LEAST_LINES, MOST_LINES, TARGET_LINES = 6, 20, 10
HEAD, LINE_HEAD = 16, 14


def to_ycbcr(frame: np.ndarray) -> np.ndarray:
    r, g, b = (frame[..., k].astype(np.int64) for k in range(3))
    planes = ((77 * r + 150 * g + 29 * b + 128) >> 8, ((-43 * r - 85 * g + 128 * b + 128) >> 8) + 128, ((128 * r - 107 * g - 21 * b + 128) >> 8) + 128)
    return np.clip(np.stack(planes, axis=-1), 0, 255).astype(np.int64)


def to_rgb(p: np.ndarray) -> np.ndarray:
    y, cb, cr = p[..., 0], p[..., 1] - 128, p[..., 2] - 128
    out = (y + ((359 * cr + 128) >> 8), y - ((88 * cb + 183 * cr + 128) >> 8), y + ((454 * cb + 128) >> 8))
    return np.clip(np.stack(out, axis=-1), 0, 255).astype(np.uint8)


def div_round(v: np.ndarray, d: int) -> np.ndarray:
    return np.sign(v) * ((np.abs(v) + d // 2) // d)


def signed(b: int) -> int:
    return b - 256 if b > 127 else b


def byte_held(v: int) -> int:
    return max(-128, min(127, v))


def code_zeros(values: np.ndarray) -> list[bytes]:
    """Lines of values, each as runs of up to 128: a token with the high bit for zeros, a token and its bytes for others.

    All lines are coded at once: every value knows its run, every run its place in the output.
    """
    h, w = values.shape
    flat = values.ravel()
    zero = flat == 0
    place = np.arange(len(flat))
    turn = np.ones(len(flat), bool)
    turn[1:] = (zero[1:] != zero[:-1]) | (place[1:] % w == 0)
    begin = np.maximum.accumulate(np.where(turn, place, 0))
    turn |= (place - begin) % 128 == 0
    starts = np.flatnonzero(turn)
    length = np.diff(np.append(starts, len(flat)))
    size = 1 + np.where(zero[starts], 0, length)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[at] = np.where(zero[starts], 128, 0) | length - 1
    run = np.cumsum(turn) - 1
    own = np.flatnonzero(~zero)
    out[at[run[own]] + 1 + own - starts[run[own]]] = flat[own] & 255
    ends = np.append(at[np.searchsorted(starts, np.arange(h) * w)], len(out))
    return [out[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def read_zeros(data: bytes, n: int) -> np.ndarray:
    """At most ``n`` values; what is missing is zero."""
    out, i, at = np.zeros(n, np.int64), 0, 0
    while at < len(data) and i < n:
        run, zero = (data[at] & 127) + 1, data[at] > 127
        at += 1
        if not zero:
            own = np.frombuffer(data, np.int8, min(run, len(data) - at), at)[: n - i]
            out[i : i + len(own)] = own
            if at + run > len(data):
                break
            at += run
        i += run
    return out


def shift_runs(data: bytearray, delta: int) -> None:
    """Run lengths changed in their tokens; the walk follows the lengths as they were."""
    at = 0
    while at < len(data):
        run = (data[at] & 127) + 1
        zero = data[at] & 128
        data[at] = zero | max(1, min(128, run + delta)) - 1
        at += 1 if zero else 1 + run


def code_colours(values: np.ndarray) -> list[bytes]:
    """Lines of values: zero runs of 2 to 64, pairs of small values in a byte, or a value by itself behind an escape.

    A step writes the next token of every line that is not at its end.
    """
    h, n = values.shape
    far = np.arange(n)
    nonzero = np.where(values != 0, far, n)
    zeros = np.minimum(np.minimum.accumulate(nonzero[:, ::-1], axis=1)[:, ::-1] - far, 64) if n else values
    small = np.zeros((h, n + 1), bool)
    small[:, :n] = (values >= -4) & (values <= 3)
    at, line = np.zeros(h, np.int64), np.arange(h)
    tokens, line = [], line[: h if n else 0]
    while len(line):
        i = at[line]
        run, v = zeros[line, i], values[line, i]
        two = small[line, i] & small[line, i + 1]
        after = values[line, np.minimum(i + 1, n - 1)]
        first = np.where(run >= 2, 0x80 | run - 1, np.where(two, v + 4 << 4 | after + 4, 0xC0))
        second = np.where((run >= 2) | two, -1, v & 255)
        tokens.append((line, first, second))
        at[line] += np.where(run >= 2, run, np.where(two, 2, 1))
        line = line[at[line] < n]
    if not tokens:
        return [b""] * h
    lines = np.concatenate([np.repeat(t[0], 2) for t in tokens])
    data = np.concatenate([np.stack(t[1:], axis=1).ravel() for t in tokens])
    lines, data = lines[data >= 0], data[data >= 0].astype(np.uint8)
    data = data[np.argsort(lines, kind="stable")]
    ends = np.append(0, np.cumsum(np.bincount(lines, minlength=h)))
    return [data[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def read_colours(data: bytes, n: int) -> list[int]:
    out, at = [], 0
    while at < len(data) and len(out) < n:
        token = data[at]
        at += 1
        if token <= 0x77:
            out += [(token >> 4) - 4, (token & 15) - 4]
        elif 0x80 <= token <= 0xBF:
            out += [0] * ((token & 63) + 1)
        elif token == 0xC0:
            if at == len(data):
                break
            out.append(signed(data[at]))
            at += 1
        else:
            out.append(0)
    return (out + [0] * n)[:n]


def turned(a: np.ndarray, b: np.ndarray, phase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The carrier pair turned by quarters; the negative of -128 is 127."""
    c, d = np.minimum(127, -a), np.minimum(127, -b)
    phase = phase & 3
    return np.choose(phase, (a, b, c, d)), np.choose(phase, (b, c, d, a))


def scan_order(height: int) -> list[int]:
    return [*range(0, height, 2), *range(1, height, 2)]


@dataclass
class Record:
    head: int
    luma: slice
    colour: slice


def records_of(signal: bytes) -> list[Record]:
    """Records that the sync words lead to: what is no sync word is passed over byte by byte, a record that would
    reach beyond the signal by its sync word."""
    out, at = [], HEAD
    while True:
        at = signal.find(SYNC, at)
        if at < 0 or at + LINE_HEAD > len(signal):
            return out
        luma, colour = struct.unpack_from("<HH", signal, at + 10)
        middle, end = at + LINE_HEAD + luma, at + LINE_HEAD + luma + colour
        if end > len(signal):
            at += 2
            continue
        out.append(Record(at, slice(at + LINE_HEAD, middle), slice(middle, end)))
        at = end


def _turn(data: bytearray, part: slice, by: int) -> None:
    body = data[part]
    if len(body) > 1 and by:
        k = abs(by) % len(body)
        k = k if by > 0 else -k
        data[part] = body[-k:] + body[:-k] if k else body


class ScanlineCodec:
    defaults = SCANLINE_DEFAULTS

    def __init__(self, width: int, height: int, luma_quant: int = 2, chroma_group: int = 2, history_len: int = 8, **params):
        if not (1 <= width <= 65535 and 1 <= height <= 65535 and 0 < luma_quant < 256 and history_len > 0 and chroma_group > 0 and chroma_group & (chroma_group - 1) == 0):
            raise ValueError("width and height are 1 to 65535, luma_quant and history_len are over 0, chroma_group is a power of two")
        self.width, self.height, self.quant, self.group, self.depth = width, height, luma_quant, chroma_group, history_len
        self.p = {**self.defaults, **params}
        self.counts = Counter()
        self.reset()

    def tune(self, params: dict) -> None:
        """Other parameters from the next frame on; the state stays."""
        self.p = dict(params)

    def reset(self) -> None:
        """Rings and receiver start anew; the count of frames goes on."""
        self.clean: deque = deque(maxlen=self.depth)
        self.dirty: deque = deque(maxlen=self.depth)
        self.expected, self.last_line, self.phase, self.timing, self.burst, self.locked = 0, None, 0, 0, 0, False

    def _held(self, lag: int) -> np.ndarray | None:
        return self.dirty[min(max(1, lag), len(self.dirty)) - 1] if self.dirty else None

    # Encoding

    def _luma(self, luma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each line is predicted from the frame before, residuals): one walk along x for all lines."""
        left = np.concatenate([np.zeros((self.height, 1), np.int64), luma[:, :-1]], axis=1)
        temporal = np.zeros(self.height, bool)
        before = np.zeros_like(luma)
        if self.clean:
            before = self.clean[0][..., 0]
            temporal = np.abs(luma - before).sum(axis=1) < np.abs(luma - left).sum(axis=1)
        out, carried = np.empty_like(luma), np.zeros(self.height, np.int64)
        for x in range(self.width):
            guess = np.where(temporal, before[:, x], carried)
            out[:, x] = np.clip(div_round(luma[:, x] - guess, self.quant), -128, 127)
            carried = np.clip(guess + out[:, x] * self.quant, 0, 255)
        return temporal, out

    def _colours(self, planes: np.ndarray, n: int) -> list[tuple[bytes, bool]]:
        """For each line (seed pair and differences of the two carriers in turn, whether these are packed): one walk
        along the groups for all lines."""
        groups = -(-self.width // self.group)
        starts = np.arange(groups) * self.group
        size = np.minimum(starts + self.group, self.width) - starts
        total = np.add.reduceat(planes[..., 1:] - 128, starts, axis=1)
        cell = np.clip(np.sign(total) * (np.abs(total) // size[:, None]), -128, 127)
        phase = (n + np.arange(self.height)) & 3
        p, q = turned(cell[..., 0], cell[..., 1], np.broadcast_to(phase[:, None], cell.shape[:2]))
        a, b = p[:, 0].copy(), q[:, 0].copy()
        seeds = np.stack([a, b], axis=1).astype(np.uint8)
        steps = np.zeros((self.height, groups - 1), np.int64)
        for i in range(1, groups):
            first = (phase + i) & 1 == 0
            off = np.where(first, p[:, i] - a, q[:, i] - b)
            step = np.clip((np.abs(off) + COLOUR_QUANT // 2) // COLOUR_QUANT * np.where(off >= 0, 1, -1), -128, 127)
            steps[:, i - 1] = step
            a = np.where(first, np.clip(a + step * COLOUR_QUANT, -128, 127), a)
            b = np.where(first, b, np.clip(b + step * COLOUR_QUANT, -128, 127))
        plain = steps.astype(np.uint8)
        out = []
        for y, packed in enumerate(code_colours(steps)):
            short = len(packed) < groups - 1
            out.append((seeds[y].tobytes() + (packed if short else plain[y].tobytes()), short))
        return out

    def encode(self, planes: np.ndarray) -> bytes:
        n = self.counts["frames_in"]
        out = bytearray(b"SCN0" + struct.pack("<BBHHIBB", VERSION, COLOUR_QUANT, self.width, self.height, n & 0xFFFFFFFF, self.group.bit_length() - 1, 2))
        temporal, residual = self._luma(planes[..., 0])
        lines = size = 0
        lumas, colours = code_zeros(residual), self._colours(planes, n)
        for y in scan_order(self.height):
            phase = (n + y) & 3
            luma, (colour, packed) = lumas[y], colours[y]
            own = len(luma) + len(colour)
            mark = y <= 1 or lines >= MOST_LINES or (lines >= LEAST_LINES and size + own >= TARGET_LINES * self.width)
            lines, size = (1, own) if mark else (lines + 1, size + own)
            flags = int(temporal[y]) | phase << 1 | packed << 6 | mark << 7
            out += SYNC + struct.pack("<HBBhhHH", y, flags, self.quant, 0, 0, len(luma), len(colour)) + luma + colour
        return bytes(out)

    # Damage

    def damage(self, signal: bytes) -> bytes:
        p, out, n = self.p, bytearray(signal), self.counts["frames_in"]
        due = lambda name, k: p[f"{name}_every"] != 0 and k % p[f"{name}_every"] == 0
        found = records_of(signal)
        if p["chroma_group_delta"]:
            out[14] = max(0, min(6, out[14] + p["chroma_group_delta"]))
            self.counts["chroma_groups"] += 1
        burst, markers = p["phase_offset"], 0
        for i, r in enumerate(found):
            k, h = i + 1, r.head
            line = struct.unpack_from("<H", out, h + 2)[0]
            if line <= 1:
                markers += 1
                if due("field_sync_loss", markers):
                    out[h + 4] &= 0x7F
                    self.counts["field_sync_loss"] += 1
                if self.height > 1 and due("field_parity_flip", markers):
                    struct.pack_into("<H", out, h + 2, line ^ 1)
                    self.counts["field_parity_flip"] += 1
            if due("burst_loss", k):
                burst += 1 if (n + k) % 2 == 0 else -1
            if turn := burst + p["phase_drift"] * i:
                out[h + 4] = out[h + 4] & 0xF9 | ((out[h + 4] >> 1 & 3) + turn) % 4 << 1
                self.counts["phases"] += 1
            for name, bit in (("predictor_flip", 1), ("payload_swap", 8)):
                if due(name, k):
                    out[h + 4] ^= bit
                    self.counts[name] += 1
            if p["chroma_sequence_offset"] and due("chroma_sequence", k):
                out[h + 4] = out[h + 4] & 0xCF | ((out[h + 4] >> 4 & 3) + p["chroma_sequence_offset"]) % 4 << 4
                self.counts["chroma_sequence"] += 1
            if p["quant_offset"] and due("quant_offset", k):
                out[h + 5] = max(1, min(255, out[h + 5] + p["quant_offset"]))
                self.counts["quant_offset"] += 1
            if (p["line_shift"] or p["line_shift_drift"]) and due("line_shift", k):
                struct.pack_into("<h", out, h + 6, max(-32768, min(32767, p["line_shift"] + p["line_shift_drift"] * i)))
                self.counts["line_shift"] += 1
            if (p["line_index_offset"] or p["line_index_stride"]) and due("line_index", k):
                line = struct.unpack_from("<H", out, h + 2)[0]
                struct.pack_into("<H", out, h + 2, (line + p["line_index_offset"] + p["line_index_stride"] * i) % self.height)
                self.counts["line_index"] += 1
            if p["predictor_line_offset"] and due("predictor_line_offset", k):
                struct.pack_into("<h", out, h + 8, p["predictor_line_offset"])
                self.counts["predictor_line_offset"] += 1
            if p["luma_run_delta"] and due("luma_run_delta", k):
                body = out[r.luma]
                shift_runs(body, p["luma_run_delta"])
                out[r.luma] = body
                self.counts["luma_run_delta"] += 1
            for name, part in (("luma_payload_slip", r.luma), ("chroma_payload_slip", r.colour)):
                if p[name] and due(name, k):
                    _turn(out, part, p[name])
                    self.counts[name] += 1
            if due("chroma_seed_loss", k) and r.colour.start + 2 <= len(out):
                out[r.colour.start : r.colour.start + 2] = b"\0\0"
                self.counts["chroma_seed_loss"] += 1
            if p["chroma_xor_mask"] and due("chroma_xor", k):
                out[r.colour] = bytes(v ^ p["chroma_xor_mask"] for v in out[r.colour])
                self.counts["chroma_xor"] += 1
            if due("carrier_sign_flip", k):
                out[r.colour] = bytes(-v & 255 for v in out[r.colour])
                self.counts["carrier_sign_flip"] += 1
            if due("sync_loss", k):
                out[h : h + 2] = b"\0\0"
                self.counts["sync_loss"] += 1
            if p["packet_length_delta"] and due("packet_length_delta", k):
                length = struct.unpack_from("<H", out, h + 10)[0]
                struct.pack_into("<H", out, h + 10, max(0, min(65535, length + p["packet_length_delta"])))
                self.counts["packet_length_delta"] += 1
        return bytes(out)

    # Receiving

    def _after(self, line: int) -> int:
        return line + 2 if line + 2 < self.height else 1 if line % 2 == 0 and self.height > 1 else 0

    def _place(self, line: int) -> int:
        return line // 2 if line % 2 == 0 else (self.height + 1) // 2 + line // 2

    def _receive(self, signal: bytes, r: Record) -> tuple[int, int, int]:
        """(line that is written, shift to the right, phase of the carriers)."""
        line, flags, _, timing = struct.unpack_from("<HBBh", signal, r.head + 2)
        if line >= self.height:
            raise ValueError("a line lies outside the frame")
        mark = flags > 127
        if mark:
            self.expected, self.phase, self.timing, self.burst, self.locked = line, 0, 0, 0, True
        elif self.last_line is not None:
            missing = min((self._place(line) - self._place(self._after(self.last_line))) % self.height, MOST_LINES - 1)
            if missing:
                self.locked = False
                self.phase += missing * (self.timing + 2)
                self.burst = (self.burst + missing) % 4
        target = line if mark or self.locked else self.expected
        self.expected, self.last_line = self._after(target), line
        self.phase += timing
        self.timing = timing if timing else int(max(-32768, min(32767, self.timing * 3)) / 4)
        due = (self.counts["frames_in"] + line) & 3
        off = ((flags >> 1 & 3) - due) % 4
        self.burst = (self.burst + (off - 4 if off > 2 else off)) % 4
        return target, self.phase % self.width, (due + self.burst) % 4

    def _lumas(self, signal: bytes, rows: list[tuple]) -> np.ndarray:
        """The luma of each record, before its shift: one walk along x for all that follow the sample to the left."""
        residual = np.zeros((len(rows), self.width), np.int64)
        temporal = np.zeros(len(rows), bool)
        before = self._held(self.p["predictor_lag"])
        guess = np.zeros_like(residual)
        for k, (r, target, *_) in enumerate(rows):
            flags, q = signal[r.head + 4], max(1, signal[r.head + 5])
            residual[k] = read_zeros(signal[r.colour if flags & 8 else r.luma], self.width) * q
            temporal[k] = flags & 1
            if flags & 1 and before is not None:
                guess[k] = before[(target + struct.unpack_from("<h", signal, r.head + 8)[0]) % self.height, :, 0]
        out = np.clip(guess + residual, 0, 255)
        across = np.flatnonzero(~temporal)
        left = np.zeros(len(across), np.int64)
        for x in range(self.width):
            left = np.clip(left + residual[across, x], 0, 255)
            out[across, x] = left
        return out

    def _pairs(self, signal: bytes, rows: list[tuple], group: int, quant: int) -> list[np.ndarray | None]:
        """The colours of each record that has any, before its shift: one walk along the groups for all."""
        groups = -(-self.width // group)
        out: list[np.ndarray | None] = [None] * len(rows)
        live, seeds, steps, turns = [], [], [], []
        for k, (r, _, _, phase) in enumerate(rows):
            flags = signal[r.head + 4]
            colour = signal[r.luma if flags & 8 else r.colour]
            if len(colour) < 2:
                continue
            live.append(k)
            seeds.append((signed(colour[0]), signed(colour[1])))
            turns.append(phase + (flags >> 4 & 3) & 3)
            own = read_colours(colour[2:], groups - 1) if flags & 64 else np.frombuffer(colour, np.int8)[2 : 1 + groups].tolist()
            steps.append((own + [0] * groups)[: groups - 1])
        if not live:
            return out
        a, b = np.array(seeds, np.int64).T
        step, turn = np.array(steps, np.int64).reshape(len(live), groups - 1) * quant, np.array(turns)
        pair = np.empty((len(live), groups, 2), np.int64)
        for i in range(groups):
            if i:
                first = (turn + i) & 1 == 0
                a = np.where(first, np.clip(a + step[:, i - 1], -128, 127), a)
                b = np.where(first, b, np.clip(b + step[:, i - 1], -128, 127))
            pair[:, i, 0], pair[:, i, 1] = turned(a, b, -turn)
        for k, own in zip(live, pair.repeat(group, axis=1)[:, : self.width] + 128, strict=True):
            out[k] = own
        return out

    def decode(self, signal: bytes) -> np.ndarray:
        if len(signal) < HEAD or signal[:4] != b"SCN0" or signal[4] != VERSION or struct.unpack_from("<HH", signal, 6) != (self.width, self.height):
            raise ValueError("not a signal of this codec")
        group, quant = 1 << min(6, signal[14]), max(1, signal[5])
        before = self._held(self.p["predictor_lag"])
        out = before.copy() if before is not None else np.full((self.height, self.width, 3), (0, 128, 128), np.int64)
        rows = [(r, *self._receive(signal, r)) for r in records_of(signal)]
        weave, n = self.p["history_line_weave"], self.p["history_line_weave_every"]
        for (_, target, shift, _), luma, pairs in zip(rows, self._lumas(signal, rows), self._pairs(signal, rows, group, quant), strict=True):
            row = out[target]
            row[:, 0] = np.roll(luma, shift)
            if pairs is not None:
                row[:, 1:] = np.roll(pairs, shift, axis=0)
            if weave and n and (target + 1) % n == 0 and self.dirty:
                row[:] = self._held(weave)[target]
        written = {target for _, target, *_ in rows}
        self.counts["concealed_lines"] += self.height - len(written)
        return out

    def process(self, frame: np.ndarray) -> np.ndarray:
        planes = to_ycbcr(frame)
        signal = self.encode(planes)
        out = self.decode(self.damage(signal))
        self.clean.appendleft(planes)
        self.dirty.appendleft(out)
        self.counts["frames_in"] += 1
        self.counts["blocks_encoded"] += self.height
        self.counts["raw_bytes"] += frame.size
        self.counts["encoded_bytes"] += len(signal)
        return to_rgb(out)
