"""components says so if its rounds are used up."""

import numpy as np
import pytest

from lectern.llm.graph import components


def test_rounds_used_up(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    with pytest.raises(RuntimeError, match="converge"):
        components(edges, most_rounds=1)
    assert {r.label for r in components(edges).collect()} == {0}


def test_hubs_are_dealt_without_loss(spark):
    rng = np.random.default_rng(7)
    pairs = [(0, i) for i in range(1, 60)] + [(i, 200) for i in range(70, 120)] + [(int(a), int(b)) for a, b in rng.integers(120, 200, (60, 2))] + [(300, 300)]
    up = list(range(301))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    edges = spark.createDataFrame(pairs, "u long, v long")
    for hub in (None, 5):
        got = {r.node: r.label for r in components(edges, hub=hub).collect()}
        assert got == {i: root(i) for a, b in pairs if a != b for i in (a, b)}
