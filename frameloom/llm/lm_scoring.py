"""Language-model scoring with a weighted backoff automaton of words.

Each history that training has seen is a state. An arc from state h reads a word w seen after h and weighs
log p(w | h), a Dirichlet-smoothed estimate (MacKay and Peto 1995): (c(hw) + mu p(w | h')) / (c(h) + mu), h' being
h without its first word. If the state has no arc for the word, its failure arc is taken, which weighs
log(mu / (c(h) + mu)) and leads to h'. The root has an arc for every word, unknown ones included. A text is read
once from left to right; the state carried along is the longest history that training has seen.

The counts come from all training texts by way of ``counting``: a block of texts gets the part of the automaton
that its texts can touch, as arrays, so no task or driver holds the whole. The texts of a block are read in step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from frameloom.llm import counting
from frameloom.llm.batches import END, flat, give_back, mix64, words


def grams(column, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(keys of the 1- to order-grams that end at each token, where they exist, tokens of each text).

    A text is its words and END; its first history is the END before it.
    """
    buf, offsets, _ = flat(column)
    own, sizes = words(buf, offsets)
    n = sizes + 1
    ends = np.cumsum(n)
    tokens = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint64)
    inside = np.ones(len(tokens), bool)
    inside[ends - 1] = False
    tokens[inside] = own
    place = np.arange(len(tokens)) - np.repeat(ends - n, n)
    keys, have = [mix64(tokens)], [np.ones(len(tokens), bool)]
    code = tokens.copy()
    for o in range(2, order + 1):
        before = np.concatenate([np.full(o - 1, END, np.uint64), tokens[: 1 - o]])[: len(tokens)]
        code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + before + np.uint64(o))
        keys.append(code)
        have.append(place + 1 >= o - 1)
    return keys, have, n


def _distinct(keys: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, how many of the counted are equal to each)."""
    unique, place = np.unique(keys, return_inverse=True)
    return unique, np.bincount(place[counted], minlength=len(unique)).astype(np.uint32)


class Automaton:
    """The part of the automaton that a block of texts can touch.

    States are numbered from the root (0), then by length of history. ``level``, ``fail`` and ``fail_weight`` are
    theirs; ``arc_weight`` and ``arc_next`` belong to the arcs. ``arc`` (order, tokens) has for each token the arc
    that reads it from a history of that many words, -1 where there is none.
    """

    def __init__(self, keys, have, count: Callable[[int, np.ndarray], np.ndarray], order: int, mu: tuple[float, ...], total: int, vocabulary: int):
        tokens = len(keys[0])
        start = mix64(np.array([END]))
        states, arcs = 1, 0
        level, fail, fail_weight = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1)]
        self.arc = np.full((order, tokens), -1, np.int64)
        weight, following = [], []
        self.known = np.zeros(tokens, bool)
        before = state_of = lower = None  # by token: probability by the shorter history, state of that history's gram
        for o in range(order):
            at = np.flatnonzero(have[o])
            unique, first, place = np.unique(keys[o][at], return_index=True, return_inverse=True)
            seen = count(o, unique)
            if o == 0:
                begin = int(np.searchsorted(unique, start[0]))  # every text ends with END, the history of the next
                p = (seen + 0.5) / (total + 0.5 * (vocabulary + 1))
                self.known[at] = seen[place] > 0
                arcs_here = np.ones(len(unique), bool)  # the root reads every word
            else:
                p = (seen + mu[o - 1] * before[at[first]]) / (lower[at[first]] + mu[o - 1])
                arcs_here = seen > 0
            number = np.where(arcs_here, np.cumsum(arcs_here) - 1 + arcs, -1)
            arcs += int(arcs_here.sum())
            self.arc[o, at] = number[place]
            weight.append(np.log10(p[arcs_here]))
            if o < order - 1:
                own = np.where(seen > 0, np.cumsum(seen > 0) - 1 + states, 0)
                states += int((seen > 0).sum())
                level.append(np.full(int((seen > 0).sum()), o + 1))
                fail.append((np.zeros(len(unique), np.int64) if o == 0 else state_of[at[first]])[seen > 0])
                fail_weight.append(np.log10(mu[o] / (seen[seen > 0] + mu[o])))
                target = own
                if o == 0:
                    self.start = int(own[begin])
            else:
                target = state_of[at[first]] if o else np.zeros(len(unique), np.int64)
            following.append(target[arcs_here])
            if o < order - 1:
                # what the next order needs at each token: p by this history, c(h) of the history one longer, the state
                before = p[place] if o == 0 else _put(before, at, p[place])
                state_of = own[place] if o == 0 else _put(state_of, at, own[place])
                lower = np.full(tokens, seen[begin] if o == 0 else 0, np.int64)
                lower[1:] = _put(np.zeros(tokens, np.int64), at, seen[place])[:-1]
        self.level, self.fail, self.fail_weight = np.concatenate(level), np.concatenate(fail), np.concatenate(fail_weight)
        self.arc_weight, self.arc_next = np.concatenate(weight), np.concatenate(following)

    def read(self, n: np.ndarray, segment: int) -> np.ndarray:
        """log10 probabilities of the texts of ``n`` tokens, read from left to right with the state carried along.

        All texts take a step at a time. A text of over ``segment`` tokens is read by several readers; as a state
        depends on the last words alone, a reader that begins at the root a history's length earlier is in the right
        state when its part begins.
        """
        order = len(self.arc)
        begin = np.cumsum(n) - n
        parts = -(-n // segment)
        owner = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        lo = begin[owner] + part * segment
        hi = np.minimum(lo + segment, (begin + n)[owner])
        at = np.where(part > 0, np.maximum(lo - (order - 1), begin[owner]), lo)
        way = np.argsort(at - hi, kind="stable")  # the longest first: those still reading are a prefix
        owner, lo, hi, at = owner[way], lo[way], hi[way], at[way]
        state = np.where(at == begin[owner], self.start, 0)
        log = np.zeros(len(owner))
        active = len(owner)
        steps = hi - at
        for step in range(int(steps[0]) if len(steps) else 0):
            while active and steps[active - 1] <= step:
                active -= 1
            t = at[:active] + step
            s = state[:active]
            level = self.level[s]
            gain = np.zeros(active)
            for o in range(order - 1, 0, -1):
                lost = np.flatnonzero((level == o) & (self.arc[o, t] < 0))
                if len(lost):
                    gain[lost] += self.fail_weight[s[lost]]
                    s[lost] = self.fail[s[lost]]
                    level[lost] -= 1
            arc = self.arc[level, t]
            gain += self.arc_weight[arc]
            state[:active] = self.arc_next[arc]
            log[:active] += np.where(t >= lo[:active], gain, 0.0)
        return np.bincount(owner, log, minlength=len(n))


def _put(old: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = old.copy()
    out[at] = new
    return out


def score(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train",
    order: int = 3, mu: tuple[float, ...] = (300.0, 1.0, 1.0), block_bytes: int = 8 << 20, fan_bits: int = 10, segment: int = 1024,
) -> DataFrame:
    """Scores of all ``docs`` under the model learnt from those whose ``train_col`` is true.

    Returns for each row: id, train_col, n_tokens, n_known, train_tokens, base_score and score (log10). ``mu`` has
    the weight of the shorter history for 2-grams, 3-grams and so on. A null or empty text is the END token alone; a
    null ``train_col`` counts as false. Repeated rows teach as often as they stand there. An empty table gives no
    rows; without training texts every token is unknown.
    """
    rows = docs.select(F.col(id_col), F.col(text_col), F.coalesce(F.col(train_col), F.lit(False)).alias(train_col))
    blocks = counting.into_blocks(rows, text_col, block_bytes, fan_bits)
    bits = blocks.bits

    def emit(table):
        keys, have, n = grams(table.column(text_col), order)
        learnt = np.repeat(np.asarray(table.column(train_col)), n)
        return [_distinct(k[h], learnt[h]) for k, h in zip(keys, have, strict=True)]

    counts = counting.totals(blocks, emit, key_bytes=(8, *[blocks.wide_enough] * (order - 1)))  # words are exact
    whole = counts.filter("kind = 0").agg(F.sum("all").alias("n"), F.sum("distinct").alias("v")).first()
    total, vocabulary = whole.n or 0, whole.v or 0

    def read(key, table, got):
        keys, have, n = grams(table.column(text_col), order)
        automaton = Automaton(keys, have, lambda o, unique: counting.in_order(got, o, unique, bits), order, mu, total, vocabulary)
        first = np.cumsum(n) - n
        base = automaton.arc_weight[automaton.arc[0]]
        done = pa.table(
            [
                table.column(id_col), table.column(train_col), n, np.add.reduceat(automaton.known.astype(np.int64), first),
                np.full(len(n), total, np.int64), np.add.reduceat(base, first), automaton.read(n, segment),
            ],
            schema=out,
        )
        del keys, have, automaton, base
        give_back()
        return done

    kind = rows.schema[id_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, `{train_col}` boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = pa.schema([(id_col, to_arrow_type(kind)), (train_col, pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return blocks.rows.groupBy("block").cogroup(counts.filter("block >= 0").drop("all", "distinct").groupBy("block")).applyInArrow(read, schema)
