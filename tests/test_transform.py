"""The cosine transform on arrays: one evaluation a block, and the same results for odd arrays."""

import re

import numpy as np

from frameloom.functions.tables import cosine
from frameloom.operators import transform

BASIS = np.array([[cosine(u, x) for x in range(8)] for u in range(8)])


def loops_around(plan: str, name: str) -> int:
    """The largest number of lambda functions that stand around an attribute in the text of a plan."""
    most, opened = 0, []
    for token in re.findall(r"lambdafunction\(|\(|\)|\b\w+#\d+", plan):
        if token == ")":
            opened.pop()
        elif token.endswith("("):
            opened.append(token != "(")
        elif token.startswith(f"{name}#"):
            most = max(most, sum(opened))
    return most


def test_chained_transforms_evaluate_each_other_once(spark):
    rows = spark.range(3).selectExpr("id", "transform(sequence(0, 63), k -> cast((id * 37 + k * k) % 255 - 128 as int)) AS s")
    rows = rows.localCheckpoint()
    once = transform.forward(rows)
    for chained in (once, transform.inverse(once), transform.forward(transform.inverse(once))):
        plan = chained._jdf.queryExecution().optimizedPlan().toString()
        assert "lambdafunction(" in plan and loops_around(plan, "s") == 0


def test_forward_and_inverse_against_numpy(spark):
    given = [(n, np.random.default_rng(n).integers(-128, 128, 64).tolist()) for n in range(50)]
    rows = spark.createDataFrame(given, "id int, s array<int>")
    there = {r.id: r.f for r in transform.forward(rows).collect()}
    back = {r.id: r.s for r in transform.inverse(transform.forward(rows)).collect()}
    for n, s in given:
        assert np.allclose(np.reshape(there[n], (8, 8)), BASIS @ np.reshape(s, (8, 8)) @ BASIS.T, atol=1e-9)
        assert np.allclose(back[n], s, atol=1e-9)


def test_odd_arrays(spark):
    """What lacks or is null makes null what depends on it; what comes after 64 values is not read."""
    full = list(range(64))
    rows = spark.createDataFrame([(0, full), (1, full + [9] * 64), (2, full[:20]), (3, [None] + full[1:]), (4, []), (5, None)], "id int, s array<int>")
    f = {r.id: r.f for r in transform.forward(rows).collect()}
    assert f[1] == f[0] and None not in f[0]
    assert all(f[n] == [None] * 64 for n in (2, 3, 4, 5))
