"""N-gram Jaccard self-join with a count-vector R-tree, and near-duplicate classes from it.

1. Every text becomes the set of its distinct word n-grams. ``counting`` finds, for each, how many texts have it.
   A link at ``percent`` needs that share of a text's own n-grams in another text, so a text with too many n-grams
   of its own has no link; the others ("shared" texts) go on with the n-grams that another text has too.
2. Texts with equal sets are one class. The classes list their n-grams from rare to frequent; two linked classes
   have one in common among their first ``n - ceil(percent * n) + 1`` (the prefix). n-grams are hashed into groups;
   the counts by group are a class's point, and the sum of coordinate minima of two points bounds their overlap.
3. The index is an R-tree, first by prefix n-gram, then by size and counts: the entries are sorted so, runs of
   neighbours are leaves, runs of leaves are boxes, up to one root for each n-gram. It is sorted by ranges and packed
   partition by partition, so a frequent n-gram's tree is spread over as many tasks as its entries fill.
4. Along the edges of the tree (an entry, the one before it, the first of its run and of the tree) each class gets
   up to four first partners; pairs that the bound allows are verified on their sets, and links make components. The same
   again with one entry of each component, for n-grams whose classes are in several.
5. Last the trees that are still open are joined with themselves, from the roots down: pairs of boxes, a row each, are
   split into pairs of the boxes below them unless both lie in one component, their sizes are too far apart, or
   the summed minima of their upper corners are too small. Pairs of leaves give pairs of points by the same bound, so
   no link between components is missed. What survives is verified on the sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from frameloom.llm import counting
from frameloom.llm.batches import flat, give_back, mix64, words
from frameloom.llm.components import Deal, merged
from frameloom.session import written

GROUPS = 64
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def text_sets(column, n_words: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a shorter text is one n-gram of all its words."""
    buf, offsets, _ = flat(column)
    own, sizes = words(buf, offsets)
    code = np.zeros(max(0, len(own) - n_words + 1), np.uint64)
    for j in range(n_words if len(code) else 0):
        code = mix64(code * _M[0] + own[j : len(own) - n_words + 1 + j] + np.uint64(n_words))
    out, at = [], 0
    for n in sizes.tolist():
        if n >= n_words:
            out.append(np.unique(code[at : at + n - n_words + 1]))
        elif n:
            short = np.array([n], np.uint64)
            for x in own[at : at + n]:
                short = mix64(short * _M[1] + x)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _digest(s: np.ndarray) -> bytes:
    return b"".join(int(mix64(s * m).sum(dtype=np.uint64)).to_bytes(8, "big") for m in _M[1:])


def _point(s: np.ndarray) -> bytes:
    return np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.uint32).tobytes()


def _place(n: int, s: np.ndarray) -> int:
    """Where a class stands among others of an n-gram: by size, then by the counts of four groups."""
    counts = np.bincount((s & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)[:4]
    return min(n, (1 << 31) - 1) << 32 | int.from_bytes(bytes(np.minimum(counts, 255).astype(np.uint8)), "big")


def shared_texts(docs: DataFrame, id_col: str, text_col: str, n_words: int, percent: int, block_bytes: int, fan_bits: int) -> DataFrame:
    """For each row: its id, a hash of its text, the size of its set; for a shared text also digest, point, n-grams
    that other texts have (packed, ``shared``) and the prefix among them (``prefix``)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    blocks = counting.into_blocks(rows, "text", block_bytes, fan_bits)
    bits = blocks.bits

    def emit(table):
        sets = text_sets(table.column("text"), n_words)
        return [np.unique(np.concatenate(sets), return_counts=True)] if sets else []

    counts = counting.totals(blocks, emit, key_bytes=(blocks.wide_enough,), most=255)

    def read(key, table, got):
        sets = text_sets(table.column("text"), n_words)
        keys = np.unique(np.concatenate(sets))
        often = counting.in_order(got, 0, keys, bits)
        columns = {k: [] for k in ("n", "place", "digest", "point", "shared", "prefix")}
        for s in sets:
            n = len(s)
            df = often[np.searchsorted(keys, s)]
            common = df > 1
            k = int(common.sum())
            row = [n, None, None, None, None, None]
            if n and 100 * k >= percent * n:
                have = s[common]
                first = k - -(-percent * n // 100) + 1
                order = np.lexsort((have, df[common]))[:first]
                row = [n, _place(n, have), _digest(s), _point(have), have.tobytes(), have[order].view(np.int64)]
            for c, v in zip(columns.values(), row, strict=True):
                c.append(v)
        done = pa.table([table.column("doc_id"), table.column("text_hash"), *columns.values()], schema=out)
        del sets, keys, often, columns
        give_back()
        return done

    kind = rows.schema["doc_id"].dataType
    out = pa.schema([("doc_id", to_arrow_type(kind)), ("text_hash", pa.int64()), ("n", pa.int64()), ("place", pa.int64()), ("digest", pa.binary()), ("point", pa.binary()), ("shared", pa.binary()), ("prefix", pa.list_(pa.int64()))])
    schema = f"doc_id {kind.simpleString()}, text_hash long, n long, place long, digest binary, point binary, shared binary, prefix array<long>"
    return written(blocks.rows.groupBy("block").cogroup(counts.filter("block >= 0").drop("all", "distinct").groupBy("block")).applyInArrow(read, schema))


def may_link(p, n, q, m, percent: int):
    """Whether the summed coordinate minima allow 100 * overlap >= percent * union."""
    return (100 + percent) * np.minimum(p, q).sum(axis=1) >= percent * (n + m)


def _points(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, GROUPS).astype(np.int64)


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of digests that are links: first by their points, then by their sets."""
    def side(end):
        return classes.select(F.col("digest").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("n", "point", "shared")))

    def check(batches):
        for t in batches:
            if not t.num_rows:
                continue
            n, m = (np.asarray(t.column(c)) for c in ("n_a", "n_b"))
            keep = may_link(_points(t.column("point_a")), n, _points(t.column("point_b")), m, percent)
            a, b = t.column("shared_a"), t.column("shared_b")
            for i in np.flatnonzero(keep):
                both = np.concatenate([np.frombuffer(v[i].as_buffer(), np.uint64) for v in (a, b)])  # read where they lie
                both.sort(kind="stable")  # two sorted runs are merged
                same = int((both[1:] == both[:-1]).sum())
                keep[i] = (100 + percent) * same >= percent * (n[i] + m[i])
            yield t.select(["a", "b"]).filter(pa.array(keep))
            del a, b
            give_back()

    pairs = written(pairs)
    deal = Deal(pairs.count(), rows_a_task=5_000, most=500_000)  # a row holds two sets
    joined = deal(deal(pairs, "a").join(deal(side("a"), "a"), "a"), "b").join(deal(side("b"), "b"), "b")
    return written(joined.mapInArrow(check, "a binary, b binary"))


#: An entry of the tree: the n-gram, its place within the n-gram's tree (size, then counts), the class.
_ENTRY = ("token", "place", "digest")


def _runs(batches, fan: int, schema: list[str]):
    """Runs of at most ``fan`` neighbouring rows of one token as tables, across the batches of a partition."""
    held: list[pa.Table] = []
    token, size = None, 0

    def out():
        nonlocal size
        whole, size = pa.concat_tables(held), 0
        held.clear()
        return whole

    for batch in batches:
        t = pa.Table.from_batches([batch]).select(schema)
        tokens = np.asarray(t.column("token"))
        at = 0
        while at < len(tokens):
            if size and (tokens[at] != token or size == fan):
                yield out()
            token = tokens[at]
            end = at + int(np.searchsorted(tokens[at:], token, "right"))
            take = min(end - at, fan - size)
            held.append(t.slice(at, take))
            size, at = size + take, at + take
    if size:
        yield out()


def _in_batches(rows, schema: pa.Schema, most: int = 256):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _edges(entries: DataFrame, fan: int = 256) -> DataFrame:
    """Edges (a, b, before) of the trees of ``entries`` (token, place, digest): of every run of neighbours the first, each
    other one and the one before it, then the same of the first of the tree and the firsts of its runs."""

    def pack(most: int):
        def pack(batches):
            token, size, head, last = None, 0, None, None  # of the run that the batch before ended in, and its last entry
            for t in batches:
                n = t.num_rows
                if not n:
                    continue
                tokens = np.asarray(t.column("token"))
                at = np.arange(n)
                new = np.ones(n, bool)
                new[1:] = tokens[1:] != tokens[:-1]
                new[0] = tokens[0] != token
                begin = np.maximum.accumulate(np.where(new, at, -1))
                place = np.where(begin >= 0, at - begin, at + size)
                first = np.maximum.accumulate(np.where((place % most == 0) if most else place == 0, at, -1))
                heads = pa.concat_arrays([pa.array([head], pa.binary()), t.column("digest")]).take(pa.array(first + 1))
                before = pa.concat_arrays([pa.array([last], pa.binary()), t.column("digest")[:-1]])
                before = pc.if_else(pa.array(place > 0), before, t.column("digest"))
                yield pa.RecordBatch.from_arrays([*(t.column(c) for c in _ENTRY), heads, before], [*_ENTRY, "head", "before"])
                token, size, head, last = tokens[-1], int(place[-1]) + 1, heads[-1].as_py(), t.column("digest")[-1].as_py()

        return pack

    schema = "token long, place long, digest binary, head binary, before binary"
    deal = Deal(entries.count())
    runs = written(deal.ordered(entries.select(*_ENTRY), *_ENTRY).mapInArrow(pack(fan), schema))
    firsts = runs.filter("digest = head").select(*_ENTRY)
    firsts = deal(firsts, "token") if deal.n else firsts.repartition("token")
    firsts = firsts.sortWithinPartitions(*_ENTRY)
    both = runs.unionByName(firsts.mapInArrow(pack(0), schema)).filter("digest <> head")
    return both.select(F.col("head").alias("a"), F.col("before"), F.col("digest").alias("b"))


_BOX = "token long, box binary, high binary, least long, most long, low_comp binary, high_comp binary"
_LEAF = _BOX + ", ids array<binary>, sizes array<long>, comps array<binary>, points binary, prefixes array<array<long>>"


def _may_hold(high_a, high_b, least_a, least_b, most_a, most_b, percent: int) -> np.ndarray:
    """Whether two boxes may hold a link, by their sizes and by the summed minima of their upper corners."""
    bound = np.minimum(high_a, high_b).sum(axis=-1)
    smaller = np.maximum(least_a, -(-percent * least_b // 100))
    return (100 * most_a >= percent * least_b) & (100 * most_b >= percent * least_a) & ((100 + percent) * bound >= percent * (smaller + np.maximum(least_b, -(-percent * smaller // 100))))


class _Leaf:
    """The members of a leaf as arrays; their prefixes become sets when a pair asks for them."""

    def __init__(self, held: pa.StructScalar | dict):
        self.ids = held["ids"].values
        self.sizes = np.asarray(held["sizes"].values)
        self.comps = held["comps"].as_py()
        self.points = np.frombuffer(held["points"].as_buffer(), np.uint32).reshape(-1, GROUPS)
        self.prefixes = held["prefixes"].values
        self.sets: dict[int, frozenset] = {}

    def prefix(self, i: int) -> frozenset:
        if i not in self.sets:
            self.sets[i] = frozenset(np.asarray(self.prefixes[i].values).tolist())
        return self.sets[i]


def _pairs_of(a: _Leaf, b: _Leaf | None, token: int, percent: int):
    """Pairs of ids of two leaves (or of one, if ``b`` is None) that may link and whose least shared n-gram is ``token``."""
    other = b or a
    codes = {c: k for k, c in enumerate({*a.comps, *other.comps})}
    p, q = (np.array([codes[c] for c in leaf.comps]) for leaf in (a, other))
    low = np.minimum(a.points[:, None, :], other.points[None, :, :]).sum(axis=2, dtype=np.int64)
    fits = ((100 + percent) * low >= percent * (a.sizes[:, None] + other.sizes[None, :])) & (p[:, None] != q[None, :])
    if b is None:
        fits = np.triu(fits, 1)
    for i, j in np.argwhere(fits).tolist():
        if min(a.prefix(i) & other.prefix(j)) == token:
            yield a.ids[i], other.ids[j]


def _candidates(entries: DataFrame, percent: int, leaf: int = 32, fan: int = 16) -> DataFrame:
    """Pairs (a, b) of other components that the trees of ``entries`` (token, place, digest, n, comp, point, prefix) allow.

    A pair that shares several prefix n-grams comes out at the least of them alone.
    """
    members = ("ids", "sizes", "comps", "points", "prefixes")
    box = ("box", "high", "least", "most", "low_comp", "high_comp")

    def leaves(batches):
        def packed(runs: list[pa.Table]) -> pa.RecordBatch:
            whole = pa.concat_tables(runs).combine_chunks()
            ends = np.concatenate([[0], np.cumsum([r.num_rows for r in runs])])
            at = pa.array(ends, pa.int32())
            listed = lambda c: pa.ListArray.from_arrays(at, whole.column(c).combine_chunks() if isinstance(whole.column(c), pa.ChunkedArray) else whole.column(c))
            points, comps, sizes = _points(whole.column("point")).astype(np.uint32), whole.column("comp").to_pylist(), np.asarray(whole.column("n"))
            high = np.maximum.reduceat(points, ends[:-1])
            each = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            columns = [
                whole.column("token").take(at[:-1]), whole.column("digest").take(at[:-1]), pa.array([h.tobytes() for h in high], pa.binary()),
                pa.array(np.minimum.reduceat(sizes, ends[:-1])), pa.array(np.maximum.reduceat(sizes, ends[:-1])),
                pa.array([min(comps[i:j]) for i, j in each], pa.binary()), pa.array([max(comps[i:j]) for i, j in each], pa.binary()),
                listed("digest"), listed("n"), listed("comp"), pa.array([points[i:j].tobytes() for i, j in each], pa.binary()), listed("prefix"),
            ]
            return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=leaf_schema.names)

        held: list[pa.Table] = []
        for run in _runs(batches, leaf, ["token", "digest", "n", "comp", "point", "prefix"]):
            held.append(run)
            if len(held) == 256:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def boxes(batches):
        def rows():
            for run in _runs(batches, fan, ["token", *box]):
                high = _points(run.column("high")).max(axis=0).astype(np.uint32).tobytes()
                ids, least, most, low, top = (run.column(c).to_pylist() for c in ("box", "least", "most", "low_comp", "high_comp"))
                yield run.column("token")[0].as_py(), ids[0], high, min(least), max(most), min(low), max(top), ids

        return _in_batches(rows(), box_arrow)

    def found(pairs) -> pa.RecordBatch:
        pairs = list(pairs)
        return pa.RecordBatch.from_arrays([pa.array([f[k].as_py() for f in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

    def within(batches):
        for t in batches:
            mixed = [i for i in range(t.num_rows) if t.column("low_comp")[i] != t.column("high_comp")[i]]
            yield found(pair for i in mixed for pair in _pairs_of(_Leaf({c: t.column(c)[i] for c in members}), None, t.column("token")[i].as_py(), percent))

    def across(batches):
        for t in batches:
            ends = ((_Leaf(t.column("l")[i]), _Leaf(t.column("r")[i]), t.column("token")[i].as_py()) for i in range(t.num_rows))
            yield found(pair for left, right, token in ends for pair in _pairs_of(left, right, token, percent))

    def open_pairs(batches):
        for t in batches:
            if not t.num_rows:
                continue
            side = lambda c, e: np.asarray(t.column(f"{e}_{c}"))  # noqa: B023, E731
            keep = _may_hold(_points(t.column("l_high")), _points(t.column("r_high")), side("least", "l"), side("least", "r"), side("most", "l"), side("most", "r"), percent)
            yield t.select(["token", "l", "r"]).filter(pa.array(keep))

    spark = entries.sparkSession
    leaf_schema = spark.createDataFrame([], _LEAF).schema
    box_schema = spark.createDataFrame([], _BOX + ", below array<binary>").schema
    box_arrow = to_arrow_schema(box_schema)
    rows = entries.count()
    deal = Deal(rows)
    level = written(Deal(rows, rows_a_task=5_000).ordered(entries, *_ENTRY).mapInArrow(leaves, leaf_schema))
    inside = level.mapInArrow(within, "a binary, b binary")
    several = deal(level.select("token"), "token").groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token")
    bottom = written(deal(level, "token").join(several, "token"))
    if bottom.isEmpty():
        return inside
    # up: boxes of boxes until each tree has one root
    levels = [bottom.select("token", *box)]
    while True:
        order = ("token", "least", "box")
        if len(levels) == 1:  # a frequent n-gram's leaves are spread over tasks
            at = deal.ordered(levels[-1], *order)
        else:  # the far fewer boxes of an n-gram lie together, so each level is ``fan`` times as small and the levels end
            at = (deal(levels[-1], "token") if deal.n else levels[-1].repartition("token")).sortWithinPartitions(*order)
        up = written(at.mapInArrow(boxes, box_schema))
        levels.append(up)
        if deal(up.select("token"), "token").groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").isEmpty():
            break
    # down: pairs of boxes, a row each
    pairs = levels[-1].filter("low_comp <> high_comp").select("token", F.col("box").alias("l"), F.col("box").alias("r"))
    for above, here in zip(reversed(levels[1:]), reversed(levels[:-1]), strict=True):
        down = above.select("token", F.col("box").alias("up"), F.explode("below").alias("box"))
        at = Deal(pairs.count() * fan * fan)
        down = deal(down, "token", "box").join(deal(here.select("token", *box), "token", "box"), ["token", "box"])
        side = lambda e: at(down.select("token", F.col("up").alias(e), *(F.col(c).alias(f"{e}_{c}") for c in box)), "token", e)  # noqa: B023, E731
        split = at(at(pairs, "token", "l").join(side("l"), ["token", "l"]), "token", "r").join(side("r"), ["token", "r"])
        split = split.filter((F.col("l") != F.col("r")) | (F.col("l_box") <= F.col("r_box")))
        one = (F.col("l_low_comp") == F.col("l_high_comp")) & (F.col("r_low_comp") == F.col("r_high_comp")) & (F.col("l_low_comp") == F.col("r_low_comp"))
        split = split.filter(~one).select("token", F.col("l_box").alias("l"), F.col("r_box").alias("r"), *(f"{e}_{c}" for e in "lr" for c in ("high", "least", "most")))
        pairs = written(split.mapInArrow(open_pairs, "token long, l binary, r binary"))
    held = bottom.select("token", "box", F.struct(*members).alias("held"))
    ends = pairs.filter("l <> r")
    at = Deal(pairs.count(), rows_a_task=500, most=100_000)  # a row holds two leaves
    for e in "lr":
        ends = at(ends, "token", e).join(at(held.select("token", F.col("box").alias(e), F.col("held").alias(f"{e}_held")), "token", e), ["token", e])
    ends = ends.select("token", F.col("l_held").alias("l"), F.col("r_held").alias("r"))
    return inside.unionByName(ends.mapInArrow(across, "a binary, b binary"))


def _open(posts: DataFrame, comps: DataFrame) -> DataFrame:
    """The entries (token, place, digest, comp) of n-grams whose classes are in more than one component."""
    deal = Deal(posts.count())
    rooted = deal(posts, "digest").join(deal(comps.withColumnRenamed("key", "digest"), "digest"), "digest", "left").select(*_ENTRY, F.coalesce("root", "digest").alias("comp"))
    rooted = written(rooted)
    split = deal(rooted, "token").groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token")
    return deal(rooted, "token").join(split, "token")


def near_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, percent: int = 80, block_bytes: int = 4 << 20, fan_bits: int = 10) -> DataFrame:
    """A row for each row of ``docs``: doc_id, text_hash, n_shingles, digest, component_id.

    Words are runs without white space, A-Z lower-cased. Two texts link when 100 * intersection >= percent * union
    of their sets of distinct ``n_words``-word shingles; ``component_id`` is the smallest id that links reach, the
    own one included. A text without words (or null) has an empty set and links with nothing. Repeated ids and rows
    keep their rows; a null id is passed over in the minimum and is null only if all ids of its component are.
    ``digest`` is null for texts that too few others share n-grams with. An empty table gives no rows.
    """
    texts = shared_texts(docs, id_col, text_col, n_words, percent, block_bytes, fan_bits)
    mine = texts.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "digest")
    classes = texts.filter("digest IS NOT NULL").groupBy("digest").agg(*(F.first(c).alias(c) for c in ("n", "place", "point", "shared", "prefix")))
    classes = written(classes)
    posts = written(classes.select(F.explode("prefix").alias("token"), "place", "digest"))
    deal = Deal(posts.count())

    def partnered(entries):
        some = F.array_distinct(F.array(F.min("a"), F.max("a"), F.min("before"), F.max("before")))
        pairs = deal(_edges(entries), "b").groupBy("b").agg(some.alias("a"))
        return _close(pairs.select(F.explode("a").alias("a"), "b"), classes, percent)

    comps = merged(None, partnered(posts))
    one_each = deal(_open(posts, comps), "token").groupBy("token", "comp").agg(F.min(F.struct("place", "digest")).alias("e")).select("token", "e.*")
    comps = merged(comps, partnered(written(one_each)))
    left = written(deal(_open(posts, comps), "digest").join(deal(classes.select("digest", "n", "point", "prefix"), "digest"), "digest"))
    comps = merged(comps, _close(_candidates(left, percent), classes, percent))
    root = mine.filter("digest IS NOT NULL").join(comps.withColumnRenamed("key", "digest"), "digest", "left").select("doc_id", "digest", F.coalesce("root", "digest").alias("root"))
    lowest = written(root.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    of_class = root.groupBy("digest").agg(F.first("root").alias("root")).join(lowest, "root").select("digest", "component_id")
    alone = mine.filter("digest IS NULL").withColumn("component_id", F.col("doc_id"))
    return mine.filter("digest IS NOT NULL").join(of_class, "digest").select(*alone.columns).unionByName(alone)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs``, whole, with one row left of each component: the smallest id, then the smallest text hash.

    Rows equal in id and text are one text; of such rows, one stays if they stand for their component, as for any
    set of copies. Rows without a link stay. A row travels packed in one column, so no name can clash.
    """
    rows = written(near_classes(docs, id_col=id_col, text_col=text_col, **kw).filter("digest IS NOT NULL").select("doc_id", "text_hash", "digest", "component_id"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    by = F.coalesce(F.col("component_id").cast("string"), F.hex("digest"))
    group = rows.groupBy(by.alias("g")).agg(F.min(row).alias("stays"), F.count("*").alias("n")).filter("n > 1")
    judged = written(rows.withColumn("g", by).join(group, "g").groupBy("doc_id", "text_hash").agg(F.max(row == F.col("stays")).alias("stays"), F.count("*").alias("same")))
    here = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.struct("*").alias("row")).alias("h")
    on = F.col("h.doc_id").eqNullSafe(F.col("j.doc_id")) & (F.col("h.text_hash") == F.col("j.text_hash"))
    kept = here.join(judged.filter(~F.col("stays") | (F.col("same") > 1)).alias("j"), on, "left_anti").select("row.*")
    again = judged.filter(F.col("stays") & (F.col("same") > 1))
    if again.isEmpty():
        return kept
    return kept.unionByName(here.join(again.alias("j"), on, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("row.*"))
