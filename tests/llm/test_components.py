import random

import numpy as np
import pytest

from frameloom.llm import components
from frameloom.llm.components import Deal


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {k: find(k) for k in root}


def random_links(rng):
    links = [(i, i + 1) for i in range(1000, 1060)]  # a chain, from its end
    links = links[::-1] + [(2000, 2000 + i) for i in range(1, 80)]  # a hub
    links += [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    return links + links[:40] + [(7, 7)]


def test_lowest_reached():
    rng = random.Random(3)
    for _ in range(50):
        n = rng.randrange(1, 40)
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(30))]
        a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
        want = brute(links)
        assert components.lowest_reached(a, b, n).tolist() == [want.get(i, i) for i in range(n)]


@pytest.mark.parametrize("a_task", [250_000, 64])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, a_task):
    monkeypatch.setattr(components, "LINKS_A_TASK", a_task)
    links = random_links(random.Random(5))
    df = spark.createDataFrame([(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in links], "a binary, b binary")
    got = components.components(df, len(links), Deal(2 * len(links))).collect()
    number = lambda x: int.from_bytes(x, "big")
    assert len({bytes(r.key) for r in got}) == len(got)
    assert {number(r.key): number(r.root) for r in got} == brute(links)


def test_no_links(spark):
    assert components.components(spark.createDataFrame([], "a binary, b binary"), 0, Deal(0)).collect() == []
