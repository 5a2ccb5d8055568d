"""Small graphs, and what is left of large ones, are finished without further rounds."""

import random

import numpy as np
import pytest

from lumenflow.llm import common, graph


def plain(edges):
    low = {n: n for e in edges for n in e}
    while any(low[a] != low[b] for a, b in edges):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    return low


def path_and_pairs(rng):
    nodes = rng.sample(range(-(10**12), 10**12), 400)
    return [*zip(nodes[:200], nodes[1:200], strict=False), *((rng.choice(nodes[200:]), rng.choice(nodes[200:])) for _ in range(120))]


def test_a_small_graph_takes_two_tables(spark):
    """A path took a round, with two tables and three jobs, for each halving of it."""
    edges = [(a, b) for a, b in path_and_pairs(random.Random(1)) if a != b]
    before = common.scratch_tables()
    got = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5))
    assert {r.node: r.component for r in got.collect()} == plain(edges)
    assert len(common.scratch_tables()) - len(before) <= 2


@pytest.mark.parametrize("left", [0, 7, 60])
def test_rounds_before_the_last_task(spark, monkeypatch, left):
    """Folded bit by bit, contracted round by round and finished in one task, components are the same."""
    monkeypatch.setattr(graph, "FOLDED", left)
    edges = [(a, b) for a, b in path_and_pairs(random.Random(2)) if a != b]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(40)
    assert {r.node: r.component for r in graph.components(frame).collect()} == plain(edges)


def test_forests():
    rng = random.Random(3)
    for n in (1, 5, 40, 400):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
        node, low = graph.forest(*np.array(edges, np.int64).T)
        assert dict(zip(node.tolist(), low.tolist(), strict=True)) == plain(edges)
    nodes = np.array(rng.sample(range(10**6), 100_000))
    assert (graph.forest(nodes[:-1], nodes[1:])[1] == nodes.min()).all()
