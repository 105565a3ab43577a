"""Frames that walks share come to the driver and the workers in parts."""

import numpy as np

from arcwise.graph import Graph
from arcwise.operators import reduce, walk


def test_parts_hold_the_frame_and_are_mapped(spark):
    rng = np.random.default_rng(1)
    rows = [(int(a) * 3, int(b) * 3, float(i)) for i, (a, b) in enumerate(rng.integers(0, 50, (400, 2))) if a != 7]
    names = np.arange(0, 150, 3)
    frame = spark.createDataFrame(rows, "n_in long, n_out long, p double").repartition(3)
    size, parts = walk.shared_frame(frame, spark.sparkContext.broadcast(names), len(names), len(rows), part_rows=60)
    assert len(parts) > 5 and size * len(parts) >= len(names)
    got = []
    for k, b in enumerate(parts):
        first, to, p = walk.mapped_part(b, size)
        assert not first.flags.owndata and len(to) == len(p) == first[-1]
        got += [(int(names[k * size + i]), int(names[to[j]]), float(p[j])) for i in range(size) for j in range(first[i], first[i + 1])]
    assert sorted(got) == sorted(rows)
    assert [len(x) for x in walk.mapped_part(spark.sparkContext.broadcast(walk.packed_part(np.array([0, 0, 100_000]), np.zeros(100_000, "i4"), np.ones(100_000))), 2)] == [3, 100_000, 100_000]


def test_the_driver_never_holds_a_frame(spark, monkeypatch):
    rng = np.random.default_rng(2)
    edges = spark.createDataFrame([(int(a), int(b), 1.0 + i % 3) for i, (a, b) in enumerate(rng.integers(0, 200, (4000, 2)))], "src long, dst long, w double")
    graph, fetched, fetch = Graph(edges, spark.range(200)), [], type(edges).toArrow

    def counted(df):
        table = fetch(df)
        fetched.append(table.nbytes)
        return table

    monkeypatch.setattr(type(edges), "toArrow", counted)
    monkeypatch.setattr(walk, "PART_ROWS", 500, raising=False)
    sources = spark.range(0, 200, 20).select("id")
    a, b = (sorted(map(tuple, walk.walk_table(graph, sources, [("O", [0.2, 0.3, 0.5]), ("U", [0.1, 0.4, 0.5])], reduce.TOTAL_VARIATION, k).collect())) for k in (walk.SHARED_ROWS, 0))
    assert np.allclose(a, b) and len(a) == 10
    assert max(fetched) < 20_000  # a frame has 48,000 bytes or more
