"""Byte-exact rules over elementary streams: splitting at start codes, classification, edits, counters.

The rules are a fold over the units of one stream. ``StreamState`` is that fold, used alike by the batch form
(grouped by stream) and by the streaming form.
"""

from __future__ import annotations

from collections import Counter, deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from frameloom.plans.presets import FILTER_DEFAULTS

MASK = (1 << 64) - 1
#: A buffer without a start code is cut to its last bytes beyond this size.
LONGEST_TAIL = 1 << 20


def prefix(data: bytes, at: int = 0) -> int:
    """Length of the start code at a place, 0 if there is none."""
    if data[at : at + 4] == b"\0\0\0\1":
        return 4
    return 3 if data[at : at + 3] == b"\0\0\1" else 0


def next_code(data: bytes, at: int) -> int:
    """Place of the next start code, a leading zero of a long one included; -1 if there is none."""
    found = data.find(b"\0\0\1", at)
    return found - 1 if found > at and data[found - 1] == 0 else found


def split(buffer: bytes, final: bool = False) -> tuple[list[bytes], bytes]:
    """(whole units, what is left). What stands before the first code is dropped; the last unit is whole at the end."""
    start = next_code(buffer, 0)
    if start < 0:
        return [], b"" if final else buffer if len(buffer) <= LONGEST_TAIL else buffer[-3:]
    units = []
    while True:
        end = next_code(buffer, start + prefix(buffer, start))
        if end < 0:
            break
        units.append(buffer[start:end])
        start = end
    rest = buffer[start:]
    if final:
        return [u for u in [*units, rest] if len(u) > prefix(u)], b""
    return [u for u in units if len(u) > prefix(u)], rest


@dataclass
class Unit:
    role: str  # key, predicted, header, slice (of no predicted picture), extension, picture, other
    start: int = 0  # of the payload
    name: int = -1  # kind of header, or slice address
    picture: str = ""


def classify(codec: str, data: bytes, current: str = "") -> Unit:
    """What a unit is. ``current`` is the type of the latest MPEG-1/2 picture."""
    n = prefix(data)
    if not n or len(data) <= n:
        return Unit("other")
    code = data[n]
    if codec == "h264":
        kind = code & 31
        return Unit({1: "predicted", 5: "key", 7: "header", 8: "header"}.get(kind, "other"), n + 1, kind)
    if codec == "hevc":
        kind = code >> 1 & 63
        role = "predicted" if kind < 16 else "key" if kind < 24 else "header" if kind in (32, 33, 34) else "other"
        return Unit(role, n + 2, kind)
    if codec == "mpeg4":
        if code == 0xB6:
            if len(data) <= n + 1:
                return Unit("other")
            picture = "IPBS"[data[n + 1] >> 6]
            return Unit("key" if picture == "I" else "predicted", min(n + 8, len(data)), picture=picture)
        return Unit("header" if code in (0xB0, 0xB2, 0xB3, 0xB5) or 0x20 <= code <= 0x2F else "other", name=code)
    if code == 0:
        kind = data[n + 2] >> 3 & 7 if len(data) > n + 2 else 0
        return Unit("picture", picture={1: "I", 2: "P", 3: "B", 4: "D"}.get(kind, ""))
    if code <= 0xAF:
        return Unit("predicted" if current in ("P", "B", "D") else "slice", min(n + 2, len(data)), code)
    return Unit("extension" if code == 0xB5 else "header" if code in (0xB2, 0xB3, 0xB7, 0xB8) else "other", name=code)


def rewrite_type(codec: str, data: bytes, to: str) -> bytes:
    """A picture header with another frame type in its bits."""
    n = prefix(data)
    out = bytearray(data)
    if codec == "mpeg4":
        out[n + 1] = out[n + 1] & 0x3F | {"i": 0, "p": 1, "b": 2, "s": 3, "d": 3}[to] << 6
    else:
        out[n + 2] = out[n + 2] & 0xC7 | {"i": 1, "p": 2, "b": 3, "d": 4, "s": 4}[to] << 3
    return bytes(out)


def _lcg(state: int, a: int, c: int) -> int:
    return (state * a + c) & MASK


def damage(p: bytearray, seed: int, amount: int) -> bool:
    state = _lcg(seed, 1103515245, len(p))
    for _ in range(min(amount, len(p))):
        state = _lcg(state, 1664525, 1013904223)
        at, bit = state % len(p), 1 << (state & 7)
        p[at] = p[at] ^ bit or bit
    return True


def scramble(p: bytearray, seed: int, amount: int) -> bool:
    k = min(amount, len(p))
    if k > 1:
        turn = seed % (k - 1) + 1
        p[:k] = p[turn:k] + p[:turn]
        state = _lcg(seed, 2654435761, k)
        for i in range(k):
            state = _lcg(state, 22695477, 1)
            j = state % k
            p[i], p[j] = p[j], p[i]
    return True


def rotate(p: bytearray, seed: int, amount: int) -> bool:
    k = min(amount, len(p))
    if k < 2:
        return False
    at, turn = seed % (len(p) - k + 1), seed // 3 % (k - 1) + 1
    window = p[at : at + k]
    p[at : at + k] = window[-turn:] + window[:-turn]
    return True


def truncate(p: bytearray, seed: int, amount: int) -> bool:
    if amount == 0 or len(p) < 2:
        return False
    del p[max(1, len(p) - amount) :]
    return True


def splice(p: bytearray, other: bytes, seed: int, amount: int) -> bool:
    k = min(amount, len(p), len(other))
    if k == 0:
        return False
    to, at = (seed * 3 & MASK) % (len(p) - k + 1), (seed * 5 + 1 & MASK) % (len(other) - k + 1)
    p[to : to + k] = other[at : at + k]
    return True


def grow(p: bytearray, other: bytes, seed: int, amount: int) -> bool:
    k = min(amount, len(other))
    if k == 0:
        return False
    at, to = (seed * 7 + 3 & MASK) % (len(other) - k + 1), (seed * 11 & MASK) % (len(p) + 1)
    p[to:to] = other[at : at + k]
    return True


def xor(p: bytearray, other: bytes, seed: int, amount: int) -> bool:
    k = min(amount, len(p), len(other))
    for i in range(k):
        b, turn = other[i], i & 7
        p[i] = p[i] ^ ((b << turn | b >> (8 - turn)) & 255) or b | 1
    return k > 0


#: The order of edits: (setting, counter, function, which other payload, factor of the seed).
EDITS = (
    ("donor_xor", "donor_xored", xor, "donor", 1),
    ("xor", "xored", xor, "previous", 1),
    ("donor_splice", "donor_spliced", splice, "donor", 13),
    ("splice", "spliced", splice, "previous", 1),
    ("damage", "damaged", damage, "", 1),
    ("scramble", "scrambled", scramble, "", 1),
    ("rotate", "rotated", rotate, "", 1),
    ("grow", "grown", grow, "previous", 1),
    ("donor_grow", "donor_grown", grow, "donor", 17),
    ("truncate", "truncated", truncate, "", 1),
)


def due(n: int, ordinal: int) -> bool:
    return n != 0 and ordinal % n == 0


@dataclass
class StreamState:
    """The fold over one stream: settings, counters, what has been seen, the previous predicted unit, the donors."""

    config: dict
    counts: Counter = field(default_factory=Counter)
    headers: set = field(default_factory=set)
    current: str = ""
    skipping: bool = False
    previous: tuple[bytes, int] | None = None
    donors: deque = field(default_factory=deque)

    @classmethod
    def of(cls, **settings) -> StreamState:
        unknown = settings.keys() - FILTER_DEFAULTS.keys()
        if unknown:
            raise ValueError(f"no such setting: {', '.join(sorted(unknown))}; there are {', '.join(FILTER_DEFAULTS)}")
        return cls({**FILTER_DEFAULTS, **settings})

    def add_donor(self, data: bytes, unit: Unit) -> None:
        if unit.role == "predicted" and self.config["donor_bank_size"] and unit.start < len(data):
            self.donors.append((data, unit.start))
            while len(self.donors) > self.config["donor_bank_size"]:
                self.donors.popleft()
            self.counts["donors_stored"] += 1

    def push(self, data: bytes) -> list[bytes]:
        """The units that come out for one that goes in."""
        self.counts["units_in"] += 1
        self.counts["bytes_in"] += len(data)
        out = self._route(data, classify(self.config["codec"], data, self.current))
        self.counts["units_out"] += len(out)
        self.counts["bytes_out"] += sum(map(len, out))
        return out

    def _route(self, data: bytes, unit: Unit) -> list[bytes]:
        c = self.config
        if unit.picture:
            self.counts["types_seen"] += 1
            changed = due(c["rewrite_frame_type_every"], self.counts["types_seen"])
            if changed:
                data = rewrite_type(c["codec"], data, c["rewrite_frame_type_to"])
                self.counts["types_rewritten"] += 1
        if unit.role == "picture":
            self.current = unit.picture
            kept = unit.picture != "I" or self._key_passes()
            self.skipping = not kept
            return [data] if kept else []
        if self.skipping and unit.role in ("slice", "predicted", "extension"):
            return []
        if c["codec"] in ("mpeg1", "mpeg2") and unit.role in ("slice", "predicted"):
            self.counts["addresses_seen"] += 1
            if self._address_drops(unit.name):
                self.counts["addresses_dropped"] += 1
                return []
            if due(c["shift_slice_address_every"], self.counts["addresses_seen"]):
                n = prefix(data)
                data = data[:n] + bytes([(unit.name - 1 + c["shift_slice_address_by"]) % 175 + 1]) + data[n + 1 :]
                self.counts["addresses_shifted"] += 1
        if unit.role == "key":
            return [data] if self._key_passes() else []
        if unit.role == "header":
            self.counts["headers_seen"] += 1
            if unit.name in self.headers and c["drop_headers_after_first"]:
                self.counts["headers_dropped"] += 1
                return []
            self.headers.add(unit.name)
        return self._predicted(data, unit.start) if unit.role == "predicted" else [data]

    def _key_passes(self) -> bool:
        self.counts["keys_seen"] += 1
        later = self.counts["keys_seen"] - self.config["drop_idr_after"]
        passes = later <= 0 or due(self.config["recover_every"], later)
        self.counts["keys_passed" if passes else "keys_dropped"] += 1
        return passes

    def _address_drops(self, address: int) -> bool:
        n, mode = self.config["drop_mpeg_slice_address_every"], self.config["drop_mpeg_slice_address_mode"]
        in_scope = mode == "all" or (self.current == "I") == (mode == "key") and self.current != ""
        return n != 0 and in_scope and (address - 1) % n == self.config["drop_mpeg_slice_address_phase"] % n

    def _predicted(self, data: bytes, start: int) -> list[bytes]:
        c, counts = self.config, self.counts
        counts["predicted_seen"] += 1
        no = counts["predicted_seen"]
        if due(c["drop_slice_every"], no):
            counts["predicted_dropped"] += 1
            return []
        others = {"previous": self.previous, "donor": self.donors[(no * 1103515245 + len(self.donors) & MASK) % len(self.donors)] if self.donors else None}
        self.previous = (data, start)
        out = []
        if due(c["echo_slice_every"], no) and others["previous"]:
            out += [others["previous"][0]] * c["echo_count"]
            counts["echoed"] += c["echo_count"]
        for other, name in (("previous", "replace"), ("donor", "donor_replace")):
            if due(c[f"{name}_slice_every"], no) and others[other]:
                data, start = others[other]
                counts[f"{name}d"] += 1
                break
        payload = bytearray(data[start:])
        for setting, counter, edit, other, factor in EDITS:
            if not due(c[f"{setting}_slice_every"], no) or (other and not others[other]):
                continue
            if not payload and edit is not grow:
                counts[counter] += edit in (damage, scramble)
                continue
            rest = (bytes(others[other][0][others[other][1] :]),) if other else ()
            counts[counter] += bool(edit(payload, *rest, no * factor & MASK, c[f"{setting}_amount"]))
        copies = 1
        if due(c["repeat_slice_every"], no):
            copies += c["repeat_count"]
            counts["repeated"] += c["repeat_count"]
        return out + [data[:start] + bytes(payload)] * copies


def run_units(chunks: list[bytes], donor: bytes = b"", **settings) -> tuple[list[bytes], Counter]:
    """Chunks of one stream through the splitter and the rules, to the end."""
    state = StreamState.of(**settings)
    current = ""
    for unit in split(donor, final=True)[0]:
        found = classify(state.config["codec"], unit, current)
        current = found.picture if found.role == "picture" else current
        state.add_donor(unit, found)
    out, tail = [], b""
    for chunk in chunks:
        units, tail = split(tail + chunk)
        for u in units:
            out += state.push(u)
    for u in split(tail, final=True)[0]:
        out += state.push(u)
    return out, state.counts


def filter_streams(chunks: DataFrame, donor: bytes = b"", **settings) -> DataFrame:
    """Chunks (stream_id, chunk_no, bytes) to units (stream_id, seq, data), streams apart. The fold needs a stream's
    chunks in one task; streams are dealt over all tasks."""
    StreamState.of(**settings)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        units, _ = run_units([bytes(b) for b in rows.sort_values("chunk_no")["bytes"] if b is not None], donor, **settings)
        return pd.DataFrame({"stream_id": rows["stream_id"].iloc[0], "seq": range(1, len(units) + 1), "data": units})

    kind = chunks.schema["stream_id"].dataType.simpleString()
    return chunks.select("stream_id", "chunk_no", "bytes").groupBy("stream_id").applyInPandas(one, f"stream_id {kind}, seq long, data binary")


def stream_counters(chunks: DataFrame, donor: bytes = b"", **settings) -> DataFrame:
    """The counters (stream_id, counter, value) of the same run."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        _, counts = run_units([bytes(b) for b in rows.sort_values("chunk_no")["bytes"] if b is not None], donor, **settings)
        return pd.DataFrame({"stream_id": rows["stream_id"].iloc[0], "counter": sorted(counts), "value": [counts[k] for k in sorted(counts)]})

    kind = chunks.schema["stream_id"].dataType.simpleString()
    return chunks.select("stream_id", "chunk_no", "bytes").groupBy("stream_id").applyInPandas(one, f"stream_id {kind}, counter string, value long")
