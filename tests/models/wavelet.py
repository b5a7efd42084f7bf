"""The wavelet codec sample by sample, in plain Python."""

from frameloom.operators.wavelet import layout, level_sizes, max_levels


def lifted(line):
    low, high = [], []
    for i in range(0, len(line), 2):
        if i + 1 < len(line):
            d = line[i + 1] - line[i]
            high.append(d)
            low.append(line[i] + (d >> 1))
        else:
            low.append(line[i])
    return low + high


def unlifted(line):
    n = (len(line) + 1) // 2
    out = []
    for i in range(n):
        if n + i < len(line):
            even = line[i] - (line[n + i] >> 1)
            out += [even, even + line[n + i]]
        else:
            out.append(line[i])
    return out


def both_ways(plane, w, h, step, rows_first):
    for turn in (0, 1) if rows_first else (1, 0):
        if turn == 0:
            for y in range(h):
                plane[y][:w] = step(plane[y][:w])
        else:
            for x in range(w):
                column = step([plane[y][x] for y in range(h)])
                for y in range(h):
                    plane[y][x] = column[y]


def run(frames, w, h, p, levels=3, quality=82, history_len=12):
    """Frames (lists of rows of (r, g, b)) through the codec with parameters ``p``."""
    levels = max(1, min(levels, max_levels(w, h)))
    sizes, bands = level_sizes(w, h, levels), layout(w, h, levels, quality)
    find = {(c, lv, o): i for i, c, lv, o, *_ in bands}
    history, out = [], []

    def corner(lv, o):
        return (sizes[lv][1] if o & 2 else 0), (sizes[lv][0] if o & 1 else 0)

    for f, frame in enumerate(frames):
        planes = [[[0] * w for _ in range(h)] for _ in range(3)]
        for y in range(h):
            for x in range(w):
                r, g, b = frame[y][x]
                co = r - b
                t = b + (co >> 1)
                planes[0][y][x], planes[1][y][x], planes[2][y][x] = t + ((g - t) >> 1), co, g - t
        packet = []
        for plane in planes:
            for lw, lh in sizes[:-1]:
                both_ways(plane, lw, lh, lifted, True)
        for _, c, lv, o, bw, bh, step in bands:
            top, left = corner(lv, o)
            band = []
            for y in range(bh):
                row = []
                for x in range(bw):
                    v = planes[c][top + y][left + x]
                    q = v if step <= 1 else (1 if v > 0 else -1) * ((abs(v) + step // 2) // step)
                    row.append(max(-32768, min(32767, q)))
                band.append(row)
            packet.append(band)
        back = [[[0] * w for _ in range(h)] for _ in range(3)]
        for i, c, lv, o, bw, bh, step in bands:
            k = i + f
            due = lambda name: p[name] != 0 and k % p[name] == 0  # noqa: B023, E731
            past = lambda lag: history[-max(1, lag)] if max(1, lag) <= len(history) else None
            source = packet[i]
            if o == 0 and p["lowpass_history_lag"]:
                held = past(p["lowpass_history_lag"])
            else:
                held = past(p["history_lag"]) if due("history_band_every") and p["history_lag"] else None
            if held:
                source = held[i]
            if p["orientation_rotate"] and due("orientation_rotate_every") and o and (c, lv, (o - 1 + p["orientation_rotate"]) % 3 + 1) in find:
                source = packet[find[c, lv, (o - 1 + p["orientation_rotate"]) % 3 + 1]]
            elif p["orientation_rotate"] and due("orientation_rotate_every") and not o:
                source = packet[i]
            if p["level_fold"] and due("level_fold_every") and (c, (lv - 1 + p["level_fold"]) % levels + 1, o) in find:
                source = packet[find[c, (lv - 1 + p["level_fold"]) % levels + 1, o]]
            if p["channel_route"] and due("channel_route_every"):
                source = packet[find[(c + p["channel_route"]) % 3, lv, o]]
            if p["packet_shift"] and due("packet_shift_every"):
                source = packet[(i + p["packet_shift"]) % len(packet)]
            if due("packet_loss_every"):
                held = past(p["history_lag"]) if p["packet_loss_conceal"] else None
                if not held:
                    continue
                source = held[i]
            if not source or not source[0]:
                continue
            top, left = corner(lv, o)
            sh, sw = len(source), len(source[0])
            for y in range(bh):
                for x in range(bw):
                    v = source[y * sh // bh][x * sw // bw] if (sh, sw) != (bh, bw) else source[y][x]
                    n = k * 1000003 + y * bw + x
                    hit = lambda name: p[name] and n % p[name] == 0  # noqa: B023, E731
                    if p["bitplane_clear"] and hit("bitplane_clear_every"):
                        v = (-1 if v < 0 else 1) * (abs(v) >> p["bitplane_clear"] << p["bitplane_clear"])
                    if p["bitplane_xor"] and hit("bitplane_xor_every"):
                        v = (-1 if v < 0 else 1) * (abs(v) ^ 1 << p["bitplane_xor"] - 1)
                    if hit("sign_flip_every"):
                        v = -v
                    v *= step
                    if o and p["lifting_bias"] and hit("lifting_bias_every"):
                        v += p["lifting_bias"]
                    back[c][top + y][left + x] = v
        for plane in back:
            for lw, lh in reversed(sizes[:-1]):
                both_ways(plane, lw, lh, unlifted, False)
        shown = []
        for y in range(h):
            row = []
            for x in range(w):
                luma, co, cg = (back[c][y][x] for c in range(3))
                t = luma - (cg >> 1)
                b = t - (co >> 1)
                row.append(tuple(max(0, min(255, v)) for v in (b + co, cg + t, b)))
            shown.append(row)
        out.append(shown)
        history = (history + [packet])[-history_len:]
    return out
