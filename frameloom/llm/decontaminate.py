"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces. Wherever the item occurs with at most k
edits, one piece occurs exactly, at its place give or take k. An Aho-Corasick automaton of all pieces reads each
text once; around each hit Myers' bit-parallel algorithm finds the least edit distance of the whole item.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normal(text: str) -> str:
    """Lower case, white space as single spaces, none at the ends."""
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``budget`` + 1 nearly equal pieces."""
    n = budget + 1
    at = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def least_distance(item: str, window: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """(least edit distance of ``item`` to any part of ``window``, where the first such part ends)."""
    m = len(item)
    if masks is None:
        masks = letter_masks(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(window, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
    return best, end


def letter_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Matcher:
    """Items [(id, text)] ready to be found with at most ``rate`` edits for each character."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, int(len(t) * rate), letter_masks(t)) for i, t in ((i, normal(t)) for i, t in items) if t]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, budget, _) in enumerate(self.items):
            for offset, piece in pieces(text, budget):
                where.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of each item found; its best place, the first of equals."""
        if not text or self.empty:
            return []
        text = normal(text)
        tried: set[tuple[int, int]] = set()
        best: dict[int, tuple[int, int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for k, offset in places:
                _, item, budget, masks = self.items[k]
                start = end - size + 1 - offset  # where the item would begin without edits
                # windows reach a budget further on both sides than needed, so neighbouring starts share one
                cell = start // (budget + 1)
                if (k, cell) in tried:
                    continue
                tried.add((k, cell))
                lo = max(0, cell * (budget + 1) - budget)
                distance, at = least_distance(item, text[lo : (cell + 1) * (budget + 1) + len(item) + budget], masks)
                if distance <= budget and (distance, lo + at) < best.get(k, (budget + 1, 0)):
                    best[k] = (distance, lo + at)
        return [(self.items[k][0], d, e) for k, (d, e) in sorted(best.items())]


def _blocks(items: DataFrame, id_col: str, text_col: str, most_chars: int):
    """The items in lists of at most ``most_chars`` characters (or one item), without all of them in memory."""
    held, size = [], 0
    for r in items.select(F.col(id_col), F.col(text_col)).filter(F.col(text_col).isNotNull()).toLocalIterator():
        if held and size + len(r[1]) > most_chars:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    if held:
        yield held


def matches(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rate: float = 0.08, block_chars: int = 4 << 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (id, item_id, distance, end_at) of documents and items they hold, with columns ``carry`` of ``docs``.

    Whole texts are compared in lower case with white space as single spaces; an item is found if its edit distance
    to some part of a text is at most ``rate`` of its length. Null and empty texts hold nothing, null and empty items
    are nowhere; repeated rows on either side give repeated pairs. Items are taken in blocks of ``block_chars``
    characters; each block is broadcast and read against all documents.
    """
    sc = docs.sparkSession.sparkContext
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    item_kind = items.schema[item_id_col].dataType.simpleString()
    schema = ", ".join([*(f"{c} {kind[c]}" for c in (id_col, *carry)), f"item_id {item_kind}", "distance int", "end_at int"])
    rows = docs.select(id_col, *carry, text_col)
    own = [id_col, *carry]

    def searched(block):
        sent = sc.broadcast(block)

        def apply(batches):
            matcher = Matcher(sent.value, rate)
            for b in batches:
                found = [(i, *hit) for i, text in enumerate(b.column(text_col).to_pylist()) for hit in matcher.find(text)]
                take = pa.array([f[0] for f in found], pa.int64())
                rest = list(zip(*found, strict=True))[1:] or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(take) for c in own), pa.array(rest[0], pa.int64() if item_kind == "bigint" else None), pa.array(rest[1], pa.int32()), pa.array(rest[2], pa.int32())],
                    [*own, "item_id", "distance", "end_at"],
                )

        return rows.mapInArrow(apply, schema)

    parts = [searched(block) for block in _blocks(items, item_id_col, item_text_col, block_chars)]
    return reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, whole, that hold no item. A row travels packed in one column, so no name can clash."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"), F.struct("*").alias("row"))
    hit = matches(rows.drop("row"), items, carry=("hash",), **kw).select("doc_id", "hash").distinct()
    on = F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("r.hash") == F.col("h.hash"))
    return rows.drop("text").alias("r").join(hit.alias("h"), on, "left_anti").select("row.*")
