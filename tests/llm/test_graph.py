"""Connected components, both ways, against a plain union-find."""

from __future__ import annotations

import random

import pytest

from trackloom.llm.common import Scratch
from trackloom.llm.graph import components


def plain(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, one_task):
    r = random.Random(2)
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1001 + i) for i in range(50)]
    loose = [(r.randint(-500, -1), r.randint(-500, -1)) for _ in range(300)]
    links = chain + star + loose + [(7, 7), (3, 2), (2, 3)]
    r.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long")
    got = {x.node: x.component for x in components(df, Scratch(spark), one_task).collect()}
    assert got == plain(links)
    assert components(df.limit(0), Scratch(spark), one_task).count() == 0
