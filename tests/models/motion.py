"""The block-motion codec sample by sample: search, vectors, addresses and samples one at a time, in 32-bit floats."""

import math

import numpy as np

from frameloom.functions import u64
from frameloom.operators.motion_codec import CELLS, SECOND, MotionCodec, Packet

F = np.float32
M = (1 << 64) - 1


def mixed(v):
    v &= M
    v = (v ^ v >> 30) * u64.MIX_A & M
    v = (v ^ v >> 27) * u64.MIX_B & M
    return v ^ v >> 31


def unit(v):
    return F(mixed(v) >> 40) / F(1 << 24)


def held(v, low, high):
    return max(low, min(high, v))


def away(v):
    v = F(v)
    n = math.floor(abs(v) + F(0.5))
    return held(-n if v < 0 else n, -32768, 32767)


def lerp(a, b, t):
    return F(a + F(F(b - a) * F(held(t, F(0), F(1)))))


class SampleBySample(MotionCodec):
    def encode(self, frame):
        self.counts["frames_in"] += 1
        if not self.clean or (self.interval and (self.counts["frames_in"] - 1) % self.interval == 0):
            return Packet(self.width, self.height, keyframe=frame.copy())
        now, ref, blocks = frame.astype(int).tolist(), self.clean[0].astype(int).tolist(), []
        luma = lambda p: (77 * p[0] + 150 * p[1] + 29 * p[2]) >> 8
        each = max(2, self.size // 4)
        residual = np.zeros((self.height, self.width, 3), np.int16)
        for by in range(0, self.height, self.size):
            for bx in range(0, self.width, self.size):
                w, h = min(self.size, self.width - bx), min(self.size, self.height - by)
                best = None
                for dy in range(-self.radius, self.radius + 1, self.step):
                    for dx in range(-self.radius, self.radius + 1, self.step):
                        sad = sum(abs(luma(now[y][x]) - luma(ref[held(y + dy, 0, self.height - 1)][held(x + dx, 0, self.width - 1)])) for y in range(by, by + h, each) for x in range(bx, bx + w, each))
                        if best is None or (sad, abs(dx) + abs(dy)) < best[:2]:
                            best = (sad, abs(dx) + abs(dy), dx, dy)
                blocks.append((bx, by, w, h, best[2], best[3]))
                for y in range(by, by + h):
                    for x in range(bx, bx + w):
                        old = ref[held(y + best[3], 0, self.height - 1)][held(x + best[2], 0, self.width - 1)]
                        residual[y, x] = [a - b for a, b in zip(now[y][x], old)]
        return Packet(self.width, self.height, blocks=np.array(blocks, np.int64), residual=residual)

    def _place_seed(self, kind, block, x, y):
        p, (cx, cy) = self.p, CELLS[kind]
        cx, cy = p["glitch_cell_width"] or p["glitch_cell_size"] or cx, p["glitch_cell_height"] or p["glitch_cell_size"] or cy
        return block * u64.GOLDEN + self._bucket() * u64.MIX_A + x // cx * u64.MIX_B + y // cy * u64.CELL_Y & M

    def _taken(self, i, n):
        p, out, bank = self.p, i, self.p["mv_bank_size"]
        if p["block_remap_every"] and p["block_remap_stride"] and (i + 1) % p["block_remap_every"] == 0:
            out = (i + p["block_remap_stride"]) % n
        if bank and (p["mv_bank_stride"] or p["mv_bank_shuffle_every"]):
            across, down = -(-self.columns // bank), -(-self.rows // bank)
            if across * down > 1:
                column, row, stride = i % self.columns, i // self.columns, p["mv_bank_stride"]
                own = row // bank * across + column // bank
                if p["mv_bank_shuffle_every"]:
                    seed = i * u64.SLOT_BLOCK + own * u64.MIX_B + self._bucket() * u64.SLOT_FRAME & M
                    if mixed(seed) % p["mv_bank_shuffle_every"] == 0:
                        stride = 1 + mixed(seed ^ u64.MIX_A) % (across * down - 1)
                to = (own + stride) % (across * down)
                out = min(to // across * bank + row % bank, self.rows - 1) * self.columns + min(to % across * bank + column % bank, self.columns - 1)
        return out

    def _moved(self, blocks):
        p, n, out = self.p, len(blocks), []
        own = [[int(b[4]), int(b[5])] for b in blocks]
        scaled = [[away(F(v) * F(s)) for v, s in zip(b, (p["mv_scale_x"], p["mv_scale_y"]))] for b in own]

        def mean(v, i):
            near = ([v[i - 1]] if i % self.columns else []) + ([v[i - self.columns]] if i >= self.columns else [])
            return [math.trunc(sum(c) / len(near)) for c in zip(*near)] if near else [0, 0]

        for i in range(n):
            v = own[self._taken(i, n)]
            if every := p["mv_predictor_desync_every"]:
                v = [a + b - c for a, b, c in zip(mean(out, i), v, mean(own, i))]
                if (i + 1) % every == 0:
                    v = [v[0] + p["mv_predictor_desync_x"], v[1] + p["mv_predictor_desync_y"]]
                v = [held(a, -32768, 32767) for a in v]
            done = []
            for axis, s in enumerate((p["mv_scale_x"], p["mv_scale_y"])):
                a = away(F(v[axis]) * F(s))
                if p["motion_diffusion"]:
                    r, c = divmod(i, self.columns)
                    near = [scaled[j * self.columns + k][axis] for j in range(max(0, r - 1), min(self.rows, r + 2)) for k in range(max(0, c - 1), min(self.columns, c + 2))]
                    a = away(F(a) + F(F(sum(near) / len(near)) - F(a)) * F(held(p["motion_diffusion"], 0.0, 1.0)))
                if p["mv_quant"] > 1:
                    a = held(away(F(a) / F(p["mv_quant"])) * p["mv_quant"], -32768, 32767)
                if p["mv_jitter"]:
                    a = held(a + (i * 1103515245 + axis * 2654435761 + 12345) % (2 * p["mv_jitter"] + 1) - p["mv_jitter"], -32768, 32767)
                done.append(a)
            out.append(done)
        return out

    def _amount(self, score):
        p = self.p
        if p["activity_mode"] == "all":
            return F(1)
        if p["activity_softness"] == 0:
            g = F(score >= p["activity_threshold"])
        else:
            t = held(F(F(score) - F(p["activity_threshold"])) / F(p["activity_softness"]), F(0), F(1))
            g = F(t * t * (F(3) - F(2) * t))
        return g if p["activity_mode"] == "active" else F(1) - g

    def _lag_of(self, channel, block, x, y):
        p, bucket, have = self.p, self._bucket(), len(self.dirty)
        first = max(1, p["reference_lag"])
        at = lambda offset, n: 1 + (first - 1 + offset) % n
        lag = first
        if p["temporal_slice_height"] and p["temporal_slice_lag_span"]:
            n = max(1, min(p["temporal_slice_lag_span"], have))
            lag = at((y // p["temporal_slice_height"] + bucket * p["temporal_slice_drift"]) % n, n)
        elif p["reference_scanline_height"] and p["reference_scanline_lag_span"]:
            n = max(1, min(p["reference_scanline_lag_span"], have))
            lag = at(mixed(y // p["reference_scanline_height"] * u64.SLOT_BLOCK + x // 32 * u64.MIX_B + bucket * u64.SLOT_FRAME) % n, n)
        elif p["reference_slot_count"] > 1 and p["reference_slot_shuffle_every"]:
            n, seed = max(1, min(p["reference_slot_count"], have)), self._place_seed("slot", block, x, y)
            if mixed(seed) % p["reference_slot_shuffle_every"] == 0:
                lag = at(mixed(seed ^ SECOND["slot"]) % n, n)
        if span := p["reference_channel_lag_span"]:
            n = max(1, min(span, have))
            wobble = mixed(self._place_seed("slot", block, x, y)) % n if p["reference_slot_shuffle_every"] else 0
            lag = at((channel * p["reference_channel_lag_stride"] + bucket + wobble) % n, n)
        return held(lag, 1, have) - 1

    def _read(self, frame, x, y, channel, wrap):
        x0, y0 = math.floor(x), math.floor(y)
        fx, fy = F(x - F(x0)), F(y - F(y0))
        fit = (lambda v, n: v % n) if wrap else (lambda v, n: held(v, 0, n - 1))
        get = lambda i, j: F(frame[fit(y0 + j, self.height)][fit(x0 + i, self.width)][channel])
        return lerp(lerp(get(0, 0), get(1, 0), fx), lerp(get(0, 1), get(1, 1), fx), fy)

    def decode(self, packet):
        if packet.keyframe is not None:
            return packet.keyframe.copy()
        p, blocks, w, h = self.p, packet.blocks.tolist(), self.width, self.height
        residual, bucket = packet.residual.astype(int).tolist(), self._bucket()
        dirty = [f.tolist() for f in self.dirty]
        clean = self.clean[0].tolist() if self.clean else dirty[0]
        vectors, overlap = self._moved(packet.blocks), min(p["overlap"], self.size)
        bleed, gain = F(held(p["reference_bleed"], 0.0, 1.0)), F(held(p["residual_keep"], -2.0, 2.0))
        reach, strength = F(held(p["sample_address_desync"], 0.0, 16.0)), F(held(p["mv_field_interpolation"], 0.0, 1.0))
        out = self.last.copy()
        sums = [[[0.0, 0.0, 0.0, 0.0] for _ in range(w)] for _ in range(h)]
        for i, (bx, by, bw, bh, dx, dy) in enumerate(blocks):
            cost = abs(dx) + abs(dy)
            total = sum(abs(v) for row in residual[by : by + bh] for px in row[bx : bx + bw] for v in px)
            block_amount = self._amount(total // max(1, 3 * bw * bh) + 4 * cost)
            invert = block_amount > 0 and p["residual_invert_every"] and (i + 1) % p["residual_invert_every"] == 0
            turn = p["residual_channel_shift"]
            if turn and p["reference_latch_frames"] > 1:
                turn += mixed(i * u64.GOLDEN + bucket * u64.MIX_A) % 3
            for y in range(max(0, by - overlap), min(h, by + bh + overlap)):
                for x in range(max(0, bx - overlap), min(w, bx + bw + overlap)):
                    core, weight = bx <= x < bx + bw and by <= y < by + bh, F(1)
                    for v, start, end in ((x, bx, bx + bw), (y, by, by + bh)) if overlap else ():
                        off = start - v if v < start else v - end + 1 if v >= end else 0
                        weight = F(weight * held(F(1) - F(off) / F(overlap + 1), F(0), F(1)))
                    amount = self._amount(sum(abs(v) for v in residual[y][x]) // 3 + 2 * cost) if core else block_amount
                    chance = F(bleed + held(amount, F(0), F(1)) * (F(1) - bleed))
                    if weight <= 0 or not (core or chance > 0):
                        continue
                    use = chance >= 1 or (chance > 0 and unit(self._place_seed("switch", i, x, y)) < chance)
                    field = [F(v) for v in vectors[i]]
                    if strength > 0:
                        c, r = min(x // self.size, self.columns - 1), min(y // self.size, self.rows - 1)
                        c1, r1 = min(c + 1, self.columns - 1), min(r + 1, self.rows - 1)
                        fx, fy = F(x % self.size) / F(self.size), F(y % self.size) / F(self.size)
                        at = lambda r, c, k: F(vectors[r * self.columns + c][k])
                        field = [lerp(field[k], lerp(lerp(at(r, c, k), at(r, c1, k), fx), lerp(at(r1, c, k), at(r1, c1, k), fx), fy), strength) for k in (0, 1)]
                    if reach > 0:
                        seed = self._place_seed("address", i, x, y)
                        field[0] = F(field[0] + F((unit(seed) * F(2) - F(1)) * reach))
                        field[1] = F(field[1] + F((unit(seed ^ SECOND["address_y"]) * F(2) - F(1)) * reach * F(0.45)))
                    rx, ry, bank = x, y, p["residual_bank_size"]
                    if bank and (p["residual_bank_stride"] or p["residual_bank_shuffle_every"]):
                        across, down = -(-w // bank), -(-h // bank)
                        if across * down > 1:
                            own, stride = y // bank * across + x // bank, p["residual_bank_stride"]
                            if p["residual_bank_shuffle_every"]:
                                seed = i * u64.GOLDEN + own * u64.MIX_B + bucket * u64.MIX_A & M
                                if mixed(seed) % p["residual_bank_shuffle_every"] == 0:
                                    stride = 1 + mixed(seed ^ SECOND["address_y"]) % (across * down - 1)
                            to = (own + stride) % (across * down)
                            rx, ry = min(to % across * bank + x % bank, w - 1), min(to // across * bank + y % bank, h - 1)
                    sx, sy = p["residual_address_shift_x"], p["residual_address_shift_y"]
                    if (j := max(0, p["residual_address_jitter"])) > 0:
                        seed = self._place_seed("residual", i, x, y)
                        sx += away((unit(seed) * F(2) - F(1)) * F(j))
                        sy += away((unit(seed ^ SECOND["residual_y"]) * F(2) - F(1)) * F(j))
                    rx, ry = held(rx + sx, 0, w - 1), held(ry + sy, 0, h - 1)
                    for c in range(3):
                        r = F(residual[ry][rx][(c + turn) % 3])
                        if use:
                            seen = self._read(dirty[self._lag_of(c, i, x, y)], F(F(x) + field[0] + F(p["channel_shift"] * c)), F(F(y) + field[1]), (c + p["reference_channel_shift"]) % 3, p["wrap_motion"])
                            v = F(seen + F(F(r * gain) * (F(-1) if invert else F(1))))
                        else:
                            v = F(self._read(clean, F(F(x) + F(dx)), F(F(y) + F(dy)), c, False) + r)
                        if overlap:
                            sums[y][x][c] += float(F(v * weight))
                        else:
                            out[y, x, c] = held(int(math.copysign(math.floor(abs(v) + F(0.5)), v)), 0, 255)
                    sums[y][x][3] += float(weight)
        if overlap:
            for y in range(h):
                for x in range(w):
                    *v, n = sums[y][x]
                    out[y, x] = [held(math.floor((a / n if n > 0 else 0) + 0.5), 0, 255) for a in v]
        return out
