"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A byte-pair vocabulary learnt from ordinary text spells words in few tokens and random strings in many. A run of
key characters with few characters for each token is reported, unless it is a known digest or an identifier: a
digest is known if it is in a given table or if the text names it as one, an identifier is a UUID, a number, or a name
whose parts the vocabulary spells in few tokens.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "random")

#: Fixed values of the base patterns.
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYS = ("passw", "secret", "token", "api")

_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Digests that texts hold without secrets: those of nothing.
KNOWN = frozenset(hashlib.new(name, b"").hexdigest() for name in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"))
#: Words that name what follows as a digest (fixed values).
_NAMED = re.compile(r"(?:md5|sha-?[0-9]{1,3}|blake2[bs]?|checksum|digest|commit|revision|etag|integrity)(?:sum|_hash|-hash)?[\"']?[\x20:=/_-]{0,4}[\"']?\Z", re.I)
_HASH_FORM = re.compile(r"(?:sha-?[0-9]{3}-)?(?:[0-9a-fA-F]{16,}|[A-Za-z0-9+/]{22,}={0,2})\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
#: No letters: numbers, at over two digits a token in any order.
_NUMBER = re.compile(r"[0-9+/_=-]+\Z")
#: The form of words in snake, kebab or path form, perhaps with numbers at their ends; random strings may have it too.
_NAME = re.compile(r"[+/_=-]*(?:[A-Za-z]*[0-9]*|[0-9]+)(?:[+/_=-]+(?:[A-Za-z]+[0-9]*|[0-9]+))*[+/_=-]*\Z")
#: Words and numbers of a name: capitals together, humps, digits.
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+"


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points; by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def is_name(run: str, encoding, spelt: float) -> bool:
    """Whether ``run`` has the form of a name and its parts, in lower case, have ``spelt`` characters a token or more."""
    if not _NAME.match(run):
        return False
    parts = [p.lower() for p in _PART.findall(run)]
    return sum(map(len, parts)) >= spelt * sum(len(encoding.encode_ordinary(p)) for p in parts)


def is_known_digest(text: str, at: int, run: str, known: frozenset[str]) -> bool:
    """Whether ``run``, at this place, is in ``known`` (lower case) or the text before it, or its own head, names it."""
    if run.lower() in known:
        return True
    return bool(_HASH_FORM.match(run)) and (run.lower().startswith("sha") and "-" in run[:8] or bool(_NAMED.search(text, max(0, at - 32), at)))


def random_strings(text: str, encoding, least: float, spelt: float = 2.25, known: frozenset[str] = KNOWN) -> list[tuple[int, int, str]]:
    """Runs of 16 and more key characters, of under ``least`` characters a token.

    Numbers, UUIDs, known digests and names are set aside. A name's parts are spelt in fewer tokens than the whole:
    the vocabulary has few words in capitals, and what joins them takes tokens of its own.
    """
    out = []
    for m in _RUN.finditer(text):
        run = m[0].strip("+/_=-")
        if len(run) < 16 or _NUMBER.match(run) or len(run) >= least * len(encoding.encode_ordinary(run)):
            continue
        if not (_UUID.match(run) or is_name(run, encoding, spelt) or is_known_digest(text, m.start(), run, known)):
            out.append((m.start(), m.end(), "random"))
    return out


def merged(base, found) -> list[tuple[int, int, str]]:
    """``base`` and those of ``found`` (in order, not overlapping) that touch none of ``base``."""
    if not found:
        return base
    union: list[list[int]] = []
    for s, e, _ in sorted(base):
        if union and s <= union[-1][1]:
            union[-1][1] = max(union[-1][1], e)
        else:
            union.append([s, e])
    free, i = [], 0
    for s, e, k in found:
        while i < len(union) and union[i][1] <= s:
            i += 1
        if i == len(union) or union[i][0] >= e:
            free.append((s, e, k))
    return sorted([*base, *free], key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, least: float = 2.0, known: frozenset[str] = KNOWN, most_bytes: int = 16 << 20) -> DataFrame:
    """A row for each row of ``docs``: id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    A null text counts as empty and has no spans; rows are judged one by one, so equal texts get equal results and
    an empty table stays empty. The driver reads ``vocabulary`` (a tiktoken rank file of at most ``most_bytes``) and
    broadcasts it. ``known`` are digests, in lower-case hex, that are no secrets.
    """
    if not Path(vocabulary).is_file():
        raise ValueError(f"vocabulary={vocabulary!r} is no file; name a tiktoken rank file")
    ranks = Path(vocabulary).read_bytes()
    if len(ranks) > most_bytes:
        raise ValueError(f"{vocabulary} has more than {most_bytes} bytes")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def apply(batches):
        encoding = _encoding(sent.value)
        for b in batches:
            rows = []
            for text in b.column(text_col).to_pylist():
                base = base_spans(text or "")
                spans = merged(base, random_strings(text or "", encoding, least, known=known))
                kinds = [k for _, _, k in spans]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])],
                [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(id_col, text_col).mapInArrow(apply, f"{id_col} {kind}, {counts}, base_sha256 string, spans string")
