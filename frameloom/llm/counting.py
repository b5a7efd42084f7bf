"""Corpus-wide counts of hashed keys, without a row for each key.

Documents are dealt into blocks of a few megabytes. A block is a run of sorted distinct hashes with counts, cut by
their leading bits into at most ``fan`` packed pieces. With up to ``fan`` blocks, one task for each piece number adds
up the counts of equal hashes and sends each block the totals in the order in which that block sent its keys.

With more blocks, the pieces of ``fan`` blocks that begin alike are merged into one run first, which remembers where
each key came from. The merged runs are as long as a block's, are cut by the next bits in the same way, and so on,
until at most ``fan`` runs begin alike; the totals then come back down the same steps. So a run gives at most ``fan``
rows at every level, the rows grow with the corpus times the (two or three) levels, and a task holds about a block's
keys at any size. A key that every text has is sent once for each block and then once for each merged run; pieces
are even because hashes are, and nothing is gathered in one place.

Two keys count as one if they agree in the bits of the first cut and the next ``8 * key_bytes`` bits; ``wide_enough``
gives a width at which that befalls at most one key in 2^17.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.batches import give_back
from frameloom.session import written


@dataclass
class Blocks:
    rows: DataFrame  # block and the columns asked for
    n: int
    total: int  # bytes of text
    fan_bits: int = 10

    @property
    def bits(self) -> int:
        """Bits of the first cut: as many pieces as blocks, at most 2 ** fan_bits."""
        return min(self.fan_bits, max(0, (self.n - 1).bit_length()))

    @property
    def wide_enough(self) -> int:
        """Bytes of a key at which at most one in 2 ** 17 agrees with another, were there one for each byte of text."""
        return min(8, max(1, -(-(self.total.bit_length() + 17 - self.bits) // 8)))


def into_blocks(docs: DataFrame, text_col: str, block_bytes: int, fan_bits: int = 10) -> Blocks:
    """``docs`` with ``block``, by a hash of all columns, so that blocks hold about ``block_bytes`` of text each."""
    total = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    n = max(1, -(-total // block_bytes))
    return Blocks(docs.withColumn("block", F.pmod(F.xxhash64(*docs.columns), F.lit(n))), n, total, fan_bits)


def cut(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places at which sorted keys go from one piece to the next."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def pack(keys: np.ndarray, bits: int, width: int) -> bytes:
    """The leading ``width`` bytes of sorted keys whose first ``bits`` bits are cut away: the first, then differences
    in as few bytes as the largest needs."""
    low = (keys << np.uint64(bits) if bits else keys) >> np.uint64(64 - 8 * width)
    steps = np.diff(low)
    size = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return low[:1].tobytes() + bytes([size]) + steps.view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack(data: bytes) -> np.ndarray:
    size = data[8]
    steps = np.zeros(((len(data) - 9) // size + 1, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8)
    steps[1:, :size] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, size)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def narrow(x: np.ndarray) -> bytes:
    for kind in (np.uint8, np.uint16, np.uint32):
        if not len(x) or x.max() <= np.iinfo(kind).max:
            return x.astype(kind).tobytes()
    return x.astype(np.uint64).tobytes()


def widen(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[len(data) // n]).astype(np.int64) if n else np.zeros(0, np.int64)


#: A piece: of which run, of which kind of key, which leading bits (a piece's number after that of the run's own, so
#: equal ones begin alike), the keys without those bits, the counts.
_PIECES = pa.schema([("run", pa.int64()), ("kind", pa.int32()), ("piece", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_PIECES_SQL = "run long, kind int, piece long, keys binary, counts binary"
_TOTALS = pa.schema([("run", pa.int64()), ("kind", pa.int32()), ("piece", pa.int64()), ("totals", pa.binary()), ("all", pa.int64()), ("distinct", pa.int64())])
_TOTALS_SQL = "run long, kind int, piece long, totals binary, all long, distinct long"


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys of the pieces, their counts, place of each piece's keys among them, where pieces end)."""
    keys = [unpack(x) for x in table.column("keys").to_pylist()]
    sizes = [len(x) for x in keys]
    counts = np.concatenate([widen(x, n) for x, n in zip(table.column("counts").to_pylist(), sizes, strict=True)])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(first) - 1
    place = np.empty(len(order), np.int64)
    place[order] = group
    return keys[first], np.add.reduceat(counts[order], np.flatnonzero(first)), place, np.concatenate([[0], np.cumsum(sizes)])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table(dict(zip(schema.names, zip(*rows, strict=True), strict=True)) if rows else {k: [] for k in schema.names}, schema=schema)


def _added(pieces: DataFrame, runs: int, fan_bits: int, key_bytes: tuple[int, ...], most: int | None) -> DataFrame:
    """Written (run, kind, piece, totals, all, distinct) for ``pieces`` of ``runs`` runs."""
    def add(table):
        unique, whole, place, at = _merged(table)
        back = (np.minimum(whole, most) if most else whole)[place]
        n = table.num_rows
        ids = [table.column(c).to_pylist() for c in ("run", "kind", "piece")]
        del unique, place
        give_back()
        return _table(list(zip(*ids, (narrow(back[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)), [int(whole.sum()), *[0] * (n - 1)], [int((whole > 0).sum()), *[0] * (n - 1)], strict=True)), _TOTALS)

    if runs <= 1 << fan_bits:
        return written(pieces.groupBy("kind", "piece").applyInArrow(add, _TOTALS_SQL))

    # merge the pieces of 2 ** fan_bits runs, and remember for each merged run what it was made of
    origin = pa.schema([*_PIECES, ("runs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("parts", pa.list_(pa.int64())), ("places", pa.binary())])
    origin_sql = _PIECES_SQL + ", runs array<long>, sizes array<long>, parts array<long>, places binary"

    def merge(key, table):
        up, kind, piece = (k.as_py() for k in key)
        unique, whole, place, at = _merged(table)
        left = unique << np.uint64(64 - 8 * key_bytes[kind])
        ends = cut(left, fan_bits)
        parts = [(j, a, b) for j, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
        own = [(up, kind, piece << fan_bits | j, pack(left[a:b], fan_bits, key_bytes[kind]), narrow(whole[a:b]), None, None, None, None) for j, a, b in parts]
        return _table([*own, (up, kind, piece, None, None, table.column("run").to_pylist(), np.diff(at).tolist(), [int(b - a) for _, a, b in parts], place.astype(np.uint32).tobytes())], origin)

    grouped = pieces.withColumn("up", F.shiftright("run", fan_bits)).groupBy("up", "kind", "piece")
    level = written(grouped.applyInArrow(merge, origin_sql))
    above = _added(level.filter("runs IS NULL").select(*_PIECES.names), -(-runs >> fan_bits), fan_bits, key_bytes, most)
    sums = above.groupBy("kind").agg(F.sum("all").alias("all"), F.sum("distinct").alias("distinct"))

    def split(key, made, got):
        _, kind, piece = (k.as_py() for k in key)
        row = {c: made.column(c)[0].as_py() for c in ("runs", "sizes", "parts", "places")}
        data = [t for _, t in sorted(zip(got.column("below").to_pylist(), got.column("totals").to_pylist(), strict=True))]
        whole = np.concatenate([widen(t, n) for t, n in zip(data, row["parts"], strict=True)])
        back = whole[np.frombuffer(row["places"], np.uint32)]
        at = np.concatenate([[0], np.cumsum(row["sizes"])])
        return _table([(r, kind, piece, narrow(back[a:b]), 0, 0) for r, a, b in zip(row["runs"], at[:-1], at[1:], strict=True)], _TOTALS)

    below = above.filter("run >= 0").select("run", "kind", F.shiftright("piece", fan_bits).alias("piece"), F.col("piece").alias("below"), "totals")
    at = ("run", "kind", "piece")
    down = level.filter("runs IS NOT NULL").select(*at, "runs", "sizes", "parts", "places").groupBy(*at).cogroup(below.groupBy(*at)).applyInArrow(split, _TOTALS_SQL)
    grand = sums.select(F.lit(-1).cast("long").alias("run"), "kind", F.lit(-1).cast("long").alias("piece"), F.lit(None).cast("binary").alias("totals"), "all", "distinct")
    return written(down.unionByName(grand))


def totals(blocks: Blocks, emit: Callable[[pa.Table], list[tuple[np.ndarray, np.ndarray]]], key_bytes: tuple[int, ...], most: int | None = None) -> DataFrame:
    """The written table (block, kind, piece, totals, all, distinct).

    ``emit`` gets a block's rows and returns for each kind of key its (sorted distinct keys, counts). ``totals`` are
    those of the block's keys of that kind (``key_bytes`` has a width for each) and piece, cut off at ``most`` if given. The sums of ``all`` and
    ``distinct`` over a kind are the sum of its counts and its number of keys with a count; rows that hold such sums
    alone have block -1.
    """
    bits, fan_bits = blocks.bits, blocks.fan_bits

    def send(key, table):
        out = []
        for kind, (keys, counts) in enumerate(emit(table)):
            at = cut(keys, bits)
            out += [(key[0].as_py(), kind, j, pack(keys[a:b], bits, key_bytes[kind]), narrow(counts[a:b])) for j, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
        give_back()
        return _table(out, _PIECES)

    packed = blocks.rows.groupBy("block").applyInArrow(send, _PIECES_SQL)
    return _added(packed, blocks.n, fan_bits, key_bytes, most).withColumnRenamed("run", "block")


def in_order(table: pa.Table, kind: int, keys: np.ndarray, bits: int) -> np.ndarray:
    """The totals of a block's sorted distinct keys, from its rows of ``totals``."""
    at = cut(keys, bits)
    out = np.zeros(len(keys), np.int64)
    for k, piece, data in zip(*(table.column(c).to_pylist() for c in ("kind", "piece", "totals")), strict=True):
        if k == kind:
            out[at[piece] : at[piece + 1]] = widen(data, int(at[piece + 1] - at[piece]))
    return out
