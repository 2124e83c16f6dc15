"""Greedy graph choices against the sequential forms."""

import random

import pytest

from tickloom.operators import graph as G


def sequential(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    cover, taken, colours = {}, {}, {}
    left = {frozenset((a, b)) for a in near for b in near[a]}
    for v in sorted(near, key=lambda v: (-len(near[v]), v)):
        cover[v] = int(bool(left))
        left -= {frozenset((v, b)) for b in near[v]}
        colours[v] = next(c for c in range(1, len(near) + 1) if c not in {colours.get(b) for b in near[v]})
    for v in sorted(near, key=lambda v: (len(near[v]), v)):
        taken[v] = int(not any(taken.get(b) for b in near[v]))
    return cover, taken, colours


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 25), r.randint(0, 25)) for _ in range(45)] + [(40, 41), (41, 40), (50, 50)]
    df = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, w double")
    cover, taken, colours = sequential(edges)
    assert dict(map(tuple, G.greedy_cover(df).collect())) == cover
    assert dict(map(tuple, G.greedy_independent_set(df).collect())) == taken
    assert dict(map(tuple, G.greedy_colours(df).collect())) == colours


def test_greedy_without_edges(spark):
    none = spark.createDataFrame([], "src long, dst long, w double")
    assert G.greedy_cover(none).count() == G.greedy_colours(none).count() == 0
