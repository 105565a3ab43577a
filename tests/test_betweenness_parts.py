"""The driver never holds the adjacency of betweenness, and repeated edges do not count twice."""

import numpy as np
import pytest

from arcwise.graph import Graph
from arcwise.operators import learn, walk


def test_the_driver_fetches_parts(spark, monkeypatch):
    pairs = np.unique(np.random.default_rng(2).integers(0, 200, (4000, 2)), axis=0)
    rows = [(int(a), int(b), 1.0) for a, b in pairs]
    once, twice = (Graph(spark.createDataFrame(r, "src long, dst long, w double"), spark.range(200)) for r in (rows, rows + rows))
    fetched, fetch = [], type(once.edges).toArrow

    def counted(df):
        table = fetch(df)
        fetched.append(table.nbytes)
        return table

    monkeypatch.setattr(type(once.edges), "toArrow", counted)
    monkeypatch.setattr(walk, "PART_ROWS", 500)
    monkeypatch.setattr(learn, "SHARED_EDGES", 5000)
    a, b = ({r.id: r.betweenness for r in learn.betweenness(g, g.nodes.where("id % 10 = 0"), 3).collect()} for g in (once, twice))
    assert max(fetched) < 10_000  # the edges have 16 bytes each
    assert a.keys() == b.keys() and np.allclose([a[i] for i in a], [b[i] for i in a]) and max(a.values()) > 0
    monkeypatch.setattr(learn, "SHARED_EDGES", 100)
    with pytest.raises(ValueError, match="at most 100 edges"):
        learn.betweenness(twice, twice.nodes, 3)
