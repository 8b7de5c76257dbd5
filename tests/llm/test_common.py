import random

import numpy as np
import pytest

from gneiss.llm.common import components, local_forest, look_up, pack, release, staged, unpack


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(99, k) for k in range(30)], [(k, (7 * k + 3) % 60) for k in range(60)], [(2, 1), (1, 2), (2, 1)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["root"] for r in components(df).collect()} == roots([e for e in edges if e[0] != e[1]])


def test_local_forest():
    rng = random.Random(1)
    for _ in range(50):
        edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(40))]
        low = local_forest(30, np.array([e[0] for e in edges], int), np.array([e[1] for e in edges], int))
        assert low.tolist() == [roots([*edges, (k, k)])[k] for k in range(30)]


def test_pack():
    for arrays in ([np.arange(5, dtype=np.uint64)], [np.zeros(0, np.int64), np.array([1, 2], np.uint32), np.array([-1], np.int64)]):
        for a, b in zip(arrays, unpack(pack(*arrays)), strict=True):
            assert a.dtype == b.dtype and a.tolist() == b.tolist()


def test_look_up(spark):
    rows = spark.createDataFrame([(k, 0 if k < 300 else k) for k in range(400)] + [(401, None)], "id long, key long")
    table = spark.createDataFrame([(0, "hot"), (350, "one"), (999, "none")], "key long, v string")
    out = look_up(rows, "key", table, "id").collect()
    assert len(out) == 401 and sum(r["v"] == "hot" for r in out) == 300 and sum(r["v"] == "one" for r in out) == 1


def test_release(spark):
    df = staged(spark.range(3), "test")
    assert df.count() == 3
    release(spark)
    spark.catalog.clearCache()
    try:
        left = df.count()
    except Exception:
        left = 0
    assert left == 0
