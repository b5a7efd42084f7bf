"""The line-signal codec value by value: every code, recurrence and line by itself, in plain Python."""

from __future__ import annotations

import struct

import numpy as np

from frameloom.operators.scanline_codec import COLOUR_QUANT, LEAST_LINES, MOST_LINES, SYNC, TARGET_LINES, VERSION, Record, ScanlineCodec, byte_held, records_of, scan_order, signed


def code_zeros(values: list[int]) -> bytes:
    """Runs of up to 128: a token with the high bit for zeros, a token and its bytes for other values."""
    out, i, n = bytearray(), 0, len(values)
    while i < n:
        zero, j = values[i] == 0, i + 1
        while j < n and j - i < 128 and (values[j] == 0) == zero:
            j += 1
        out.append((128 if zero else 0) | j - i - 1)
        if not zero:
            out += bytes(v & 255 for v in values[i:j])
        i = j
    return bytes(out)


def read_zeros(data: bytes, n: int) -> list[int]:
    """At most ``n`` values; what is missing is zero."""
    out, at = [], 0
    while at < len(data) and len(out) < n:
        run, zero = (data[at] & 127) + 1, data[at] > 127
        at += 1
        if zero:
            out += [0] * run
            continue
        out += [signed(b) for b in data[at : at + run]]
        if at + run > len(data):
            break
        at += run
    return (out + [0] * n)[:n]


def code_colours(values: list[int]) -> bytes:
    """Zero runs of 2 to 64, pairs of small values in a byte, or a value by itself behind an escape."""
    out, i, n = bytearray(), 0, len(values)
    small = lambda k: k < n and -4 <= values[k] <= 3
    while i < n:
        j = i
        while j < n and j - i < 64 and values[j] == 0:
            j += 1
        if j - i >= 2:
            out.append(0x80 | j - i - 1)
            i = j
        elif small(i) and small(i + 1):
            out.append(values[i] + 4 << 4 | values[i + 1] + 4)
            i += 2
        else:
            out += bytes((0xC0, values[i] & 255))
            i += 1
    return bytes(out)


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


def turned(a: int, b: int, phase: int) -> tuple[int, int]:
    minus = lambda v: min(127, -v)
    return ((a, b), (b, minus(a)), (minus(a), minus(b)), (minus(b), a))[phase & 3]


def rounded(v: int, d: int) -> int:
    return (1 if v > 0 else -1) * ((abs(v) + d // 2) // d)


class LineByLine(ScanlineCodec):
    """Encoder and line decoder anew; headers, damage and the receiver's state are the codec's own."""

    def _residual(self, luma, y: int) -> tuple[bool, list[int]]:
        own = luma[y].tolist()
        before = self.clean[0][y, :, 0].tolist() if self.clean else [0] * self.width
        across = sum(abs(a - b) for a, b in zip(own, [0, *own]))
        temporal = bool(self.clean) and sum(abs(a - b) for a, b in zip(own, before)) < across
        left, out = 0, []
        for x, v in enumerate(own):
            guess = before[x] if temporal else left
            out.append(byte_held(rounded(v - guess, self.quant)))
            left = max(0, min(255, guess + out[-1] * self.quant))
        return temporal, out

    def _colours_of(self, planes, y: int, phase: int) -> tuple[bytes, bool]:
        """(seed pair and differences of the two carriers in turn, whether these are packed)."""
        a = b = 0
        seed, steps = b"", []
        for i, x in enumerate(range(0, self.width, self.group)):
            cell = planes[y, x : x + self.group, 1:] - 128
            cb, cr = (byte_held(int(s / len(cell))) for s in cell.sum(axis=0))
            p, q = turned(cb, cr, phase)
            if i == 0:
                seed, a, b = bytes((p & 255, q & 255)), p, q
                continue
            first = (phase + i) & 1 == 0
            off = p - a if first else q - b
            step = byte_held((abs(off) + COLOUR_QUANT // 2) // COLOUR_QUANT * (1 if off >= 0 else -1))
            steps.append(step)
            if first:
                a = byte_held(a + step * COLOUR_QUANT)
            else:
                b = byte_held(b + step * COLOUR_QUANT)
        packed = code_colours(steps)
        return (seed + packed, True) if len(packed) < len(steps) else (seed + bytes(s & 255 for s in steps), False)

    def encode(self, planes: np.ndarray) -> bytes:
        n = self.counts["frames_in"]
        out = bytearray(b"SCN0" + struct.pack("<BBHHIBB", VERSION, COLOUR_QUANT, self.width, self.height, n & 0xFFFFFFFF, self.group.bit_length() - 1, 2))
        lines = size = 0
        for y in scan_order(self.height):
            phase = (n + y) & 3
            temporal, residual = self._residual(planes[..., 0], y)
            luma = code_zeros(residual)
            colour, packed = self._colours_of(planes, y, phase)
            own = len(luma) + len(colour)
            mark = y <= 1 or lines >= MOST_LINES or (lines >= LEAST_LINES and size + own >= TARGET_LINES * self.width)
            lines, size = (1, own) if mark else (lines + 1, size + own)
            flags = int(temporal) | phase << 1 | packed << 6 | mark << 7
            out += SYNC + struct.pack("<HBBhhHH", y, flags, self.quant, 0, 0, len(luma), len(colour)) + luma + colour
        return bytes(out)

    def _line(self, row: np.ndarray, signal: bytes, r: Record, target: int, shift: int, phase: int, group: int, quant: int) -> None:
        flags, q, offset = signal[r.head + 4], max(1, signal[r.head + 5]), struct.unpack_from("<h", signal, r.head + 8)[0]
        luma, colour = (signal[r.colour], signal[r.luma]) if flags & 8 else (signal[r.luma], signal[r.colour])
        residual = np.array(read_zeros(luma, self.width), np.int64) * q
        places = (np.arange(self.width) + shift) % self.width
        if flags & 1:
            before = self._held(self.p["predictor_lag"])
            guess = 0 if before is None else before[(target + offset) % self.height, :, 0]
            row[places, 0] = np.clip(guess + residual, 0, 255)
        else:
            left, values = 0, []
            for v in residual.tolist():
                left = max(0, min(255, left + v))
                values.append(left)
            row[places, 0] = values
        if len(colour) >= 2:
            groups = -(-self.width // group)
            a, b = signed(colour[0]), signed(colour[1])
            turn = phase + (flags >> 4 & 3) & 3
            steps = read_colours(colour[2:], groups - 1) if flags & 64 else ([signed(v) for v in colour[2 : 1 + groups]] + [0] * groups)[: groups - 1]
            pairs = []
            for i in range(groups):
                if i:
                    if (turn + i) & 1 == 0:
                        a = byte_held(a + steps[i - 1] * quant)
                    else:
                        b = byte_held(b + steps[i - 1] * quant)
                pairs.append(turned(a, b, -turn))
            row[places, 1:] = np.array(pairs).repeat(group, axis=0)[: self.width] + 128
        weave = self.p["history_line_weave"]
        n = self.p["history_line_weave_every"]
        if weave and n and (target + 1) % n == 0 and self.dirty:
            row[:] = self._held(weave)[target]

    def decode(self, signal: bytes) -> np.ndarray:
        group, quant = 1 << min(6, signal[14]), max(1, signal[5])
        before = self._held(self.p["predictor_lag"])
        out = before.copy() if before is not None else np.full((self.height, self.width, 3), (0, 128, 128), np.int64)
        for r in records_of(signal):
            target, shift, phase = self._receive(signal, r)
            self._line(out[target], signal, r, target, shift, phase, group, quant)
        return out
