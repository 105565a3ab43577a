"""Distances by shared searches equal those by joins."""

import numpy as np

from arcwise.graph import Graph
from arcwise.operators import iterate


def test_shared_searches_equal_joins(spark):
    rng = np.random.default_rng(4)
    edges = spark.createDataFrame([(int(a) * 2, int(b) * 2, 1.0) for a, b in rng.integers(0, 400, (700, 2))], "src long, dst long, w double")
    graph, sources = Graph(edges, spark.range(0, 820, 2)), spark.range(0, 820, 2).where("id % 4 = 0 or id < 300")
    assert sources.count() > iterate.TOGETHER
    for directed in (True, False):
        a = sorted(map(tuple, iterate.distances(graph, sources, directed).select("source", "node", "d").collect()))
        b = sorted(map(tuple, iterate.distances(graph, sources, directed, shared_rows=0).select("source", "node", "d").collect()))
        assert a == b
        c = sorted(map(tuple, iterate.distance_counts(graph, sources, directed).collect()))
        counts = {}
        for s, _, d in b:
            counts[s, d] = counts.get((s, d), 0) + 1
        assert c == sorted((*k, n) for k, n in counts.items())
