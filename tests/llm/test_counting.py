"""Corpus-wide counts against a Counter, over one, two and three levels of merging, and how their rows grow."""

import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameloom.llm import counting
from frameloom.llm.batches import flat, mix64, words


def emitter():
    def emit(table):
        buf, offsets, _ = flat(table.column("text"))
        own, _ = words(buf, offsets)
        return [np.unique(mix64(own), return_counts=True)]

    return emit  # not by its name, as workers do not know this module


def table(spark, n):
    return spark.range(n).select(F.expr("array_join(transform(sequence(1, 40), i -> concat('w', pmod(hash(id, i), 3000))), ' ')").alias("text"))


@pytest.mark.parametrize("fan_bits", [1, 2, 4, 10])
def test_totals_at_any_number_of_levels(spark, fan_bits):
    docs = table(spark, 120)
    want = collections.Counter(w for r in docs.collect() for w in r.text.split())
    blocks = counting.into_blocks(docs, "text", 1500, fan_bits)
    assert blocks.n > 8
    totals = counting.totals(blocks, emitter(), key_bytes=(6,))
    sums = totals.agg(F.sum("all").alias("all"), F.sum("distinct").alias("distinct")).first()
    assert (sums["all"], sums["distinct"]) == (sum(want.values()), len(want))
    got = totals.filter("block >= 0").toArrow()
    for r in blocks.rows.groupBy("block").agg(F.collect_list("text").alias("texts")).collect():
        own = sorted((int(mix64(words(*flat(pa.array([w]))[:2])[0])[0]), w) for w in {w for t in r.texts for w in t.split()})
        keys = np.array([k for k, _ in own], np.uint64)
        mine = got.filter(np.asarray(got.column("block")) == r.block)
        assert counting.in_order(mine, 0, keys, blocks.bits).tolist() == [want[w] for _, w in own]


def test_rows_grow_with_the_corpus_and_not_with_its_square(spark, monkeypatch):
    written = []
    real = counting.written
    monkeypatch.setattr(counting, "written", lambda df: written.append(real(df)) or written[-1])
    rows = []
    for n in (450, 900, 1800):
        written.clear()
        blocks = counting.into_blocks(table(spark, n), "text", 1500, 3)
        counting.totals(blocks, emitter(), key_bytes=(6,)).count()
        rows.append(sum(t.count() for t in written) / blocks.n)
    assert blocks.n > 64 and rows[2] < 1.3 * rows[0], rows
