import random

import numpy as np

from frameloom.llm import components, ngram_jaccard


def test_levels_end_when_boxes_are_spread(spark, monkeypatch):
    """A frequent n-gram whose boxes lie in many range partitions still gets one root, and no pair is lost."""
    monkeypatch.setattr(components.Deal, "ordered", lambda self, df, *keys: df.repartitionByRange(12, *keys).sortWithinPartitions(*keys))
    rng = random.Random(9)
    sets = []
    for i in range(640):
        if i % 8:
            sets.append(np.unique(np.array([7, *(rng.randrange(1 << 60) for _ in range(rng.randrange(12, 30)))], np.uint64)))
        else:  # one more n-gram than the set before
            sets.append(np.unique(np.append(sets[-1] if sets else [7], np.array([rng.randrange(1 << 60)], np.uint64)).astype(np.uint64)))
    rows = [(7, ngram_jaccard._place(len(s), s), i.to_bytes(4, "big"), len(s), i.to_bytes(4, "big"), ngram_jaccard._point(s), [7]) for i, s in enumerate(sets)]
    entries = spark.createDataFrame(rows, "token long, place long, digest binary, n long, comp binary, point binary, prefix array<long>")
    got = {frozenset((bytes(r.a), bytes(r.b))) for r in ngram_jaccard._candidates(entries, 80).collect()}
    for i, a in enumerate(sets):
        for j in range(i):
            same = len(np.intersect1d(a, sets[j]))
            if 100 * same >= 80 * (len(a) + len(sets[j]) - same):
                assert frozenset((i.to_bytes(4, "big"), j.to_bytes(4, "big"))) in got
