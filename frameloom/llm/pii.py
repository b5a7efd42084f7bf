"""Personal data: fixed patterns, and a skip-chain conditional random field for the mentions that they miss.

Mentions that may be personal data (runs of digits and separators, addresses written out) are the nodes of a
document's graph. What the fixed patterns find is observed; of the other mentions each may have the labels that its
form allows (a card number passes Luhn, a phone number has 9 to 15 digits). Neighbours share a chain potential;
mentions of the same or similar digits or address, however far apart, share a skip potential. Loopy sum-product
messages make labels agree over the document, so a number that one place names plainly is found where it is written
in another form; nothing but the beliefs decides. Weights are trained by pseudo-likelihood on documents made with
labels.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)

#: Fixed values of the base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Candidates of the method: 7 digits or more with single or double separators; addresses with words or brackets for
#: signs. Labels of host names have at most 63 letters, names have 64 and hosts 126 parts (RFC 1035, RFC 5321).
_RUN = re.compile(r"\+?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9](?:[\x20().-]{0,2}[0-9])++")
_DOT = r"(?:\x20?[(\[{](?:dot|\.)[)\]}]\x20?|\x20dot\x20)"
_AT = re.compile(r"\s?[(\[{](?:at|@)[)\]}]\s?|\x20at\x20", re.I)
_HOST_PART = re.compile(rf"[A-Za-z0-9-]{{1,63}}+(?:(?:{_DOT}|\.)[A-Za-z0-9-]{{1,63}}+){{1,126}}", re.I)
_NAME_PART = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._+-]{{0,63}}(?:{_DOT}[A-Za-z0-9._+-]{{1,64}})*\Z", re.I)
_FOUR = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_DOT}|\x20\.\x20|\x20\.|\.\x20)[0-9]{{1,3}}){{3}}(?![0-9]|\.[0-9])", re.I)
_DOTS = re.compile(_DOT, re.I)
_CUE = re.compile(r"(tel|phone|call|mobile|fax|cell|whatsapp)|(card|visa|credit|amex|pay)|(\bip\b|host|server|addr)|(mail|contact|write)|(order|invoice|isbn|ref|no\.|id|serial|date|version)", re.I)
_NON_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns in code points: leftmost, not overlapping within a kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end(), "email"))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    for m in _DOTTED.finditer(text):
        parts, place = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                out.append((place, place + size, "ip"))
            place += size + 1
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NON_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NON_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass
class Mention:
    start: int
    end: int
    form: str  # digits, an address with its signs, or numbers with dots
    base: str | None
    shape: str  # run, spelt or dotted

    def allowed(self) -> np.ndarray:
        """Which of LABELS the mention may have: its own if observed, else those that its form fits."""
        if self.base:
            return np.array([k == self.base for k in LABELS])
        if self.shape == "spelt":
            return np.array([True, True, False, False, False])
        if self.shape == "dotted":
            return np.array([True, False, True, False, False])
        n = len(self.form)
        return np.array([True, False, False, 14 <= n <= 19 and luhn(self.form), 9 <= n <= 15])


def _spelt(text: str):
    """Addresses around the words or brackets that stand for their sign."""
    for m in _AT.finditer(text):
        host = _HOST_PART.match(text, m.end())
        name = _NAME_PART.search(text, max(0, m.start() - 200), m.start()) if host else None
        if name:
            yield Mention(name.start(), host.end(), f"{_DOTS.sub('.', name[0])}@{_DOTS.sub('.', host[0])}".lower(), None, "spelt")


def mentions(text: str, base) -> list[Mention]:
    """Base spans and candidates that touch none of them, in order; of candidates that overlap the first stays."""
    shape = {"email": "spelt", "ip": "dotted"}
    out = [Mention(s, e, text[s:e].lower() if k == "email" else _NON_DIGIT.sub("." if k == "ip" else "", text[s:e]), k, shape.get(k, "run")) for s, e, k in base]
    taken = sorted((s, e) for s, e, _ in base)
    found = list(_spelt(text))
    for m in _RUN.finditer(text):
        if m.end() - m.start() >= 7 and len(digits := _NON_DIGIT.sub("", m[0])) >= 7:
            found.append(Mention(m.start(), m.end(), digits, None, "run"))
    for m in _FOUR.finditer(text):
        parts = _NON_DIGIT.split(m[0])
        if all(int(p) <= 255 for p in parts):
            found.append(Mention(m.start(), m.end(), ".".join(parts), None, "dotted"))
    i = free = 0
    for f in sorted(found, key=lambda f: (f.start, f.shape)):
        while i < len(taken) and taken[i][1] <= f.start:
            i += 1
        if (i == len(taken) or taken[i][0] >= f.end) and f.start >= free:
            out.append(f)
            free = f.end
    return sorted(out, key=lambda f: (f.start, f.end))


def features(text: str, m: Mention) -> list[str]:
    raw = text[m.start : m.end]
    out = ["bias:" + m.shape]
    if m.shape == "spelt":
        out.append("sign:" + ("bracket" if re.search(r"[(\[{]", raw) else "word"))
        out.append("dots:" + ("plain" if not _DOTS.search(raw) else "spelt"))
        last = m.form.rsplit(".", 1)[-1]
        out.append("end:" + ("known" if last in _ENDS else "other"))
    elif m.shape == "dotted":
        out.append("dots:" + ("bracket" if re.search(r"[(\[{]", raw) else "word" if "dot" in raw.lower() else "spaced"))
    else:
        out += [f"digits:{min(len(m.form), 20)}", f"luhn:{len(m.form) >= 14 and luhn(m.form)}", f"plus:{raw[0] == '+'}"]
        out += [f"sep:{c}" for c in sorted({c for c in raw if not c.isdigit()})] or ["sep:none"]
        out.append("groups:" + "-".join(str(min(len(g), 5)) for g in _NON_DIGIT.split(raw)[:6] if g))
    for hit in _CUE.finditer(text[max(0, m.start - 24) : m.start]):
        out.append(f"cue:{hit.lastindex}:{m.shape}")
    return out


def skips(nodes: list[Mention]) -> list[tuple[int, int]]:
    """Links of each mention to the one before it and to the observed one before or after it that have the same form
    or the same last nine digits."""
    out, last, seen, open_ = set(), {}, {}, {}
    for i, m in enumerate(nodes):
        keys = [m.form]
        if m.shape == "run" and len(m.form) >= 9:
            keys.append("tail " + m.form[-9:])
        for key in keys:
            if key in last:
                out.add((last[key], i))
            if key in seen:
                out.add((seen[key], i))
            if m.base:
                out.update((j, i) for j in open_.pop(key, ()))
                seen[key] = i
            elif key not in seen:
                open_.setdefault(key, []).append(i)
            last[key] = i
    return sorted(out)


#: Ends of host names that most addresses have (fixed values).
_ENDS = frozenset(["com", "org", "net", "edu", "gov", "info", "io", "de", "uk", "fr", "es", "it", "eu", "ch", "at", "us"])
_NEVER = -1e6


class SkipChain:
    """Weights of (feature, label), and tables of chain and skip potentials over two labels."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.chain = np.zeros((5, 5))
        self.skip = np.zeros((5, 5))

    def unary(self, feats, masks) -> np.ndarray:
        zero = np.zeros(5)
        return np.array([sum((self.weights.get(f, zero) for f in fs), np.where(mask, 0.0, _NEVER)) for fs, mask in zip(feats, masks, strict=True)])

    def fit(self, docs, epochs: int = 20, rate: float = 0.2, decay: float = 1e-3, seed: int = 2) -> SkipChain:
        """Pseudo-likelihood: each label given its neighbours' labels. ``docs``: (features, masks, labels, skip links)."""
        rng = random.Random(seed)
        square: dict = {}
        for _ in range(epochs):
            rng.shuffle(docs)
            for feats, masks, ys, links in docs:
                near = [[] for _ in ys]
                for i in range(1, len(ys)):
                    near[i].append((self.chain, "chain", i - 1, True))
                    near[i - 1].append((self.chain, "chain", i, False))
                for i, j in links:
                    near[j].append((self.skip, "skip", i, True))
                    near[i].append((self.skip, "skip", j, False))
                for fs, mask, y, others, u in zip(feats, masks, ys, near, self.unary(feats, masks), strict=True):
                    if mask.sum() == 1:
                        continue
                    for table, _, o, after in others:
                        u = u + (table[ys[o]] if after else table[:, ys[o]])
                    g = -np.exp(u - np.logaddexp.reduce(u))
                    g[y] += 1
                    for f in fs:
                        w = self.weights.setdefault(f, np.zeros(5))
                        gf = g - decay * w
                        s = square.setdefault(f, np.full(5, 1e-2))
                        s += gf * gf
                        w += rate * gf / np.sqrt(s)
                    for table, name, o, after in others:
                        cells = table[ys[o]] if after else table[:, ys[o]]
                        gt = g - decay * cells
                        s = square.setdefault((name, after, ys[o]), np.full(5, 1e-2))
                        s += gt * gt
                        cells += rate * gt / np.sqrt(s)
        return self

    def marginals(self, feats, masks, links, settled: float = 1e-4, damp: float = 0.3) -> np.ndarray:
        """Beliefs by damped sum-product messages along chain and skip links, until none moves by over ``settled``.

        A message needs a round for each link on its way, so rounds are bounded by the number of mentions and 50.
        """
        u = self.unary(feats, masks)
        n = len(u)
        edges = [(i - 1, i, 0) for i in range(1, n)] + [(i, j, 1) for i, j in links]
        if edges:
            a, b, t = (np.array(x) for x in zip(*edges, strict=True))
            tables = np.stack([self.chain, self.skip])[t]
            source, target = np.concatenate([a, b]), np.concatenate([b, a])
            tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
            e = len(a)
            back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
            sent = np.zeros((2 * e, 5))
            for _ in range(n + 50):
                belief = u.copy()
                np.add.at(belief, target, sent)
                new = _logsum((belief[source] - sent[back])[:, :, None] + tables)
                new -= _logsum(new[:, :, None])
                new = damp * sent + (1 - damp) * new
                moved = np.abs(new - sent).max()
                sent = new
                if moved < settled:
                    break
            np.add.at(u, target, sent)
        return np.exp(u - np.logaddexp.reduce(u, axis=1, keepdims=True))


def _logsum(x: np.ndarray) -> np.ndarray:
    """log of the sum of exponentials over axis 1."""
    top = x.max(axis=1, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]


def labelled_documents(n: int = 400, seed: int = 5, texts: list | None = None):
    """Documents made with labelled mentions in plain and other forms, and with numbers and words that are nobody's.

    Gives (features, masks, labels, links) of each; ``texts``, if given, gets each (text, [(start, end, kind)]).
    """
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(("th", "re", "an", "on", "st", "ou")) for _ in range(rng.randint(1, 4)))
    filler = lambda: " ".join(word() for _ in range(rng.randint(2, 12)))
    out = []
    for _ in range(n):
        bits: list[tuple[str, str | None]] = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice((*KINDS, "none", "none", "none"))
            if kind == "phone":
                c, area, rest = rng.choice(("1", "33", "49", "34", "44")), digits(3), digits(7)
                plain = rng.choice((f"+{c} {area} {rest[:3]} {rest[3:]}", f"+{c}-{area}-{rest[:3]}-{rest[3:]}", f"+{c} ({area}) {rest[:3]}-{rest[3:]}"))
                other = rng.choice((f"({area}) {rest[:3]}-{rest[3:]}", f"{c}{area}{rest}", f"{area}.{rest[:3]}.{rest[3:]}", f"00{c} {area} {rest}", f"{c}-{area}-{rest[:3]}-{rest[3:]}", f"{area}-{rest[:3]}-{rest[3:]}"))
                forms = [(plain, kind), (other, kind)]
                if rng.random() < 0.3:
                    forms = [(rng.choice(("call ", "phone: ", "tel. ", "mobile ")) + other, kind)]
            elif kind == "card":
                number = digits(15)
                number += next(d for d in "0123456789" if luhn(number + d))
                fours = [number[i : i + 4] for i in range(0, 16, 4)]
                forms = [(rng.choice((number, " ".join(fours))), kind), (rng.choice((".".join(fours), "  ".join(fours))), kind)]
            elif kind == "email":
                name, host = ".".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.choice((1, 1, 2)))), "".join(rng.choice("mnopqr") for _ in range(5))
                end, at, dot = rng.choice(("com", "org", "net", "de", "example")), rng.choice((" [at] ", " (at) ", "(at)", " at ", " AT ")), rng.choice((".", " dot ", " [dot] ", "(dot)", "."))
                spelt = (name.replace(".", dot) + at + host + dot + end) if dot != "." or at.strip() != at.strip("()[]") or end != "example" else f"{name} at {host} dot {end}"
                forms = [(f"{name}@{host}.{end}", kind), (rng.choice(("", "", "mail ", "write to ")) + spelt, kind)]
            elif kind == "ip":
                p = [str(rng.randint(0, 255)) for _ in range(4)]
                forms = [(".".join(p), kind), (rng.choice(("", "server ", "host ", "")) + rng.choice(("[.]", " . ", "(dot)", " dot ", "[dot]", "(.)")).join(p), kind)]
            elif rng.random() < 0.4:  # words around "at" that are no address, numbers with points that are none
                forms = [(rng.choice((f"{word()} at {word()}.{word().capitalize()}", f"looked at {word()}.{word()}", f"version {rng.randint(0, 9)} . {rng.randint(0, 9)} . {rng.randint(0, 9)} . {rng.randint(0, 9)}", f"{rng.randint(1, 9)}. {rng.randint(1, 9)}. {rng.randint(1, 12)}. {rng.randint(1, 20)}")), None)]
            else:
                forms = [(rng.choice(("", "order ", "invoice ", "ref ", "id ")) + rng.choice((digits(7), digits(8), digits(10), digits(12), digits(16), f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(4)}-{digits(4)}", f"{digits(3)}-{digits(10)}")), None)]
                forms *= rng.choice((1, 1, 2))
            rng.shuffle(forms)
            bits += forms[: rng.randint(1, len(forms))] if kind != "none" else forms
        rng.shuffle(bits)
        text, marks = filler(), []
        for piece, kind in bits:
            at = len(text) + 1
            text += " " + piece + rng.choice((" ", ", ", "; ")) + filler()
            marks.append((at, at + len(piece), kind))
        nodes = mentions(text, base_spans(text))
        labels = []
        for m in nodes:
            own = next((k for s, e, k in marks if s <= m.start and m.end <= e), None)
            label = LABELS.index(m.base or own or "none")
            labels.append(label if m.allowed()[label] else 0)
        if texts is not None:
            texts.append((text, [(s, e, k) for s, e, k in marks if k]))
        if nodes:
            out.append(([features(text, m) for m in nodes], [m.allowed() for m in nodes], labels, skips(nodes)))
    return out


@lru_cache(maxsize=2)
def trained(documents: int = 400) -> SkipChain:
    return SkipChain().fit(labelled_documents(documents))


def all_spans(text: str, base, crf: SkipChain, least: float) -> list[tuple[int, int, str]]:
    """``base`` and the other mentions whose best label is a kind and has a belief of at least ``least``."""
    nodes = mentions(text, base)
    masks = [m.allowed() for m in nodes]
    if all(mask.sum() == 1 for mask in masks):
        return base
    belief = crf.marginals([features(text, m) for m in nodes], masks, skips(nodes))
    more = [(m.start, m.end, LABELS[k]) for m, p, k in zip(nodes, belief, belief.argmax(axis=1), strict=True) if m.base is None and k and p[k] >= least]
    return sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2]))) if more else base


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: SkipChain | None = None, training_documents: int = 400, least: float = 0.9) -> DataFrame:
    """A row for each row of ``docs``: id, n_email, n_ip, n_card, n_phone (of the fixed patterns),
    base_sha256 (of their spans), spans (these and the model's).

    A null text counts as empty and has no spans; rows are judged one by one, so equal texts get equal results and
    an empty table stays empty. ``training_documents`` bounds the labelled documents the model is trained on.
    """
    crf = model or trained(training_documents)

    def apply(batches):
        for b in batches:
            rows = []
            for text in b.column(text_col).to_pylist():
                base = base_spans(text or "")
                spans = all_spans(text or "", base, crf, least)
                kinds = [k for _, _, k in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(id_col, text_col).mapInArrow(apply, f"{id_col} {kind}, {counts}, base_sha256 string, spans string")
