"""Connected components of links between keys: partitions are contracted on their own, then joins on written tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.session import written


class Deal:
    """How a table of a known number of rows is dealt for joins and groups.

    Few rows get few partitions, one for each ``rows_a_task``. Beyond ``most`` rows Spark's own shuffles, with their
    adaptive merging and skew handling, do it.
    """

    def __init__(self, rows: int, rows_a_task: int = 100_000, most: int = 500_000):
        self.n = max(1, -(-rows // rows_a_task)) if rows <= most else None

    def __call__(self, df: DataFrame, *keys: str) -> DataFrame:
        return df.repartition(self.n, *keys) if self.n else df

    def ordered(self, df: DataFrame, *keys: str) -> DataFrame:
        return (df.repartitionByRange(self.n, *keys) if self.n else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)


def lowest_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1, the smallest that the links (a, b) reach, itself included."""
    root = np.arange(n)
    while True:
        p, q = root[a], root[b]
        apart = p != q
        if not apart.any():
            return root
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]


#: Links (pairs of keys) that a task contracts in memory.
LINKS_A_TASK = 250_000


def _stars(batches):
    """Stars (a, b) of batches of links (a, b): of every ``LINKS_A_TASK`` links of a partition the components, each by
    its smallest key ``a`` and every key ``b`` in it."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ends = pa.chunked_array([*t.column("a").chunks, *t.column("b").chunks]).combine_chunks().dictionary_encode()
        keys, codes = ends.dictionary, np.asarray(ends.indices)
        order = np.asarray(pc.sort_indices(keys))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        root = lowest_reached(rank[codes[: t.num_rows]], rank[codes[t.num_rows :]], len(order))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(order[root])), keys.take(pa.array(order))], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, LINKS_A_TASK - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == LINKS_A_TASK:
                yield stars(held)
                held, n = [], 0
    if n:
        yield stars(held)


def components(links: DataFrame, n_links: int, deal: Deal) -> DataFrame:
    """``links`` (a, b), ``n_links`` of them, to (key, root): the smallest key that each key with a link can reach.

    Tasks contract ``LINKS_A_TASK`` links each to stars, without a shuffle. Links that fit one task are done with that.
    Otherwise rounds follow over the stars: every key takes the smallest label among its neighbours', then the label of
    that label, so chains shorten by halves. Rounds end when no label changes. Joins are plain ones, which a hot key
    can't hold up.
    """
    links = links.select("a", "b").filter("a <> b")
    tasks = max(1, -(-n_links // LINKS_A_TASK))
    links = links.coalesce(tasks).mapInArrow(_stars, links.schema)
    if tasks == 1:
        return written(links.select(F.col("b").alias("key"), F.col("a").alias("root")))
    links = written(links)
    both = written(deal(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b"), "a").distinct())
    label = written(deal(both, "a").groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("root")))
    while True:
        near = deal(both, "b").join(deal(label.select(F.col("key").alias("b"), "root"), "b"), "b")
        near = deal(near, "a").groupBy(F.col("a").alias("key")).agg(F.min("root").alias("near"))
        low = deal(label, "key").join(near, "key").select("key", "root", F.least("root", "near").alias("low"))
        jump = label.select(F.col("key").alias("low"), F.col("root").alias("far"))
        step = deal(low, "low").join(deal(jump, "low"), "low").select("key", F.least("low", "far").alias("root"), (F.least("low", "far") != F.col("root")).alias("moved"))
        step = written(step)
        label = step.select("key", "root")
        if step.filter("moved").isEmpty():
            return label


def merged(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (key, root) of all links so far: those of ``comps`` joined up by ``links`` (a, b), a written table.

    Links are first moved to the roots of their ends, so that the rounds see one key for each component.
    """
    n = links.count()
    if comps is None:
        return components(links, n, Deal(2 * n))
    deal = Deal(2 * n + comps.count())
    roots = lambda end: deal(comps.select(F.col("key").alias(end), F.col("root").alias(f"root_{end}")), end)
    ends = deal(deal(links, "a").join(roots("a"), "a", "left"), "b").join(roots("b"), "b", "left")
    up = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")), n, deal)
    moved = deal(comps, "root").join(deal(up.select(F.col("key").alias("root"), F.col("root").alias("to")), "root"), "root", "left").select("key", F.coalesce("to", "root").alias("root"))
    fresh = deal(up, "key").join(deal(comps.select("key"), "key"), "key", "left_anti")
    return written(moved.unionByName(fresh))
