"""Components against union-find, at once and merged from two parts, with and without broadcasts."""

import random

import pytest

from almanac.llm import components
from almanac.llm.common import cut


def union_find(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("most", [400_000, 10])
def test_components_and_merging(spark, monkeypatch, most):
    monkeypatch.setattr(components, "BROADCAST_ROWS", most)
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(500, 540)]
    edges = [e for e in edges if e[0] != e[1]]
    table = lambda rows: cut(spark.createDataFrame(rows, "a long, b long"))
    whole = components.connected_components(table(edges + [(None, 1), (7, 7)])).collect()
    assert len(whole) == len(set(whole)) and dict(map(tuple, whole)) == union_find(edges)
    parts = rng.sample(edges, len(edges))
    found = cut(components.connected_components(table(parts[:60])))
    merged = components.merged_components(found, table(parts[60:])).collect()
    assert len(merged) == len(set(merged)) and dict(map(tuple, merged)) == union_find(edges)


def test_no_edges(spark):
    none = cut(spark.createDataFrame([], "a long, b long"))
    assert components.connected_components(none).count() == 0
    assert components.merged_components(cut(components.connected_components(none)), none).count() == 0
