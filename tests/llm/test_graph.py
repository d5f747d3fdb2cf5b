"""Components of edge tables against union-find, and the joining of components of components."""

import random

import pytest

from veilcount.llm import neardup
from veilcount.llm._graph import components
from veilcount.llm._scratch import Scratch

DRAW = random.Random(1)
CASES = {
    "path": [(i, i + 1) for i in range(40)],
    "random": [(DRAW.randrange(200), DRAW.randrange(200)) for _ in range(110)],
    "stars": [(1, 2), (1, 3), (5, 9)],
    "loops": [(3, 3)],
    "negative": [(-5, 2), (2, 7), (7, -9), (10, 11), (7, 2)],
    "none": [],
}


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def rows(df):
    found = [(r["node"], r["comp"]) for r in df.collect()]
    assert len(found) == len(dict(found))
    return dict(found)


@pytest.mark.parametrize("case", CASES)
def test_components(spark, case):
    assert rows(components(spark.createDataFrame(CASES[case], "a bigint, b bigint"), Scratch(spark))) == union_find(CASES[case])


def test_later_links_join_components(spark):
    edges = CASES["random"]
    old, new = edges[:60], edges[60:]
    known = union_find(old)
    over = [(known.get(a, a), known.get(b, b)) for a, b in new]
    scratch = Scratch(spark)
    first = components(spark.createDataFrame(old, "a bigint, b bigint"), scratch)
    second = components(spark.createDataFrame(over, "a bigint, b bigint"), scratch)
    assert rows(neardup._joined(first, second)) == union_find(edges)
