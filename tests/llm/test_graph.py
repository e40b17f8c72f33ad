import random

import numpy as np
import pytest

from tagwell.llm import graph


@pytest.mark.parametrize("at_once", [graph.LINKS_AT_ONCE, 50])
def test_components_in_one_task_and_in_many(spark, monkeypatch, at_once):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 60)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(-5, 9000), (7, 7)]
    rng.shuffle(links)
    root = {}
    top = lambda x: x if root.setdefault(x, x) == x else top(root[x])
    for a, b in links:
        low, high = sorted((top(a), top(b)))
        root[high] = low
    monkeypatch.setattr(graph, "LINKS_AT_ONCE", at_once)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}


def test_one_task_hangs_a_chain():
    node, label = graph.hung(np.arange(1, 5000), np.arange(4999))
    assert node.tolist() == list(range(5000)) and not label.any()
