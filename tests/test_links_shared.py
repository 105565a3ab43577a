"""Shared searches take links as they are, without sums or weights, and follow them from either end."""

import numpy as np

from arcwise.graph import Graph
from arcwise.operators import iterate, walk
from arcwise.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_links_are_written_without_an_aggregate(spark, monkeypatch):
    plans, cut = [], iterate.cut
    monkeypatch.setattr(iterate, "cut", lambda df, name="round": (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), cut(df, name))[1])
    g = T.part_graph(spark, SF)
    sources = g.nodes.where("id % 20 = 0").select("id")
    iterate.distance_counts(g, sources, True)
    assert [("Aggregate" in p) for n, p in plans if n == "near"] == [False]


def test_repeats_unknown_ends_and_nothing_at_all(spark):
    rows = [(1, 2), (1, 2), (2, 1), (2, 90), (90, 3_000_000_000), (5, 5), (None, 1), (1, None)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "src long, dst long, w double")
    g = Graph(edges, spark.range(1, 8))
    for directed in (True, False):
        got = sorted(map(tuple, iterate.distances(g, spark.range(1, 8), directed).where("source < 3 or source = 7").select("source", "node", "d").collect()))
        assert got == [(1, 1, 0), (1, 2, 1), (1, 90, 2), (1, 3_000_000_000, 3), (2, 1, 1), (2, 2, 0), (2, 90, 1), (2, 3_000_000_000, 2), (7, 7, 0)]
    none = Graph(edges.where("false"), spark.range(0))
    assert iterate.distances(none, spark.range(0)).count() == 0


def test_bare_parts_hold_each_link_once_by_both_ends(spark):
    links = np.random.default_rng(3).integers(0, 40, (600, 2))
    frame = spark.createDataFrame([(int(a), int(b)) for a, b in links], "n_in long, n_out long").repartition(3)
    named = spark.sparkContext.broadcast(np.arange(40))
    expected = {"out": {tuple(x) for x in links.tolist()}, "in": {(b, a) for a, b in links.tolist()}}
    expected["near"] = expected["out"] | expected["in"]
    for ways in (["out", "in"], ["near"]):
        for way, (size, parts) in zip(ways, walk.shared_frames(frame, named, 40, 600, ways, 100), strict=True):
            assert len(parts) > 5
            got = []
            for k, part in enumerate(parts):
                first, to, p = walk.mapped_part(part, size, False)
                assert p is None
                got += [(k * size + i, int(to[j])) for i in range(size) for j in range(first[i], first[i + 1])]
            assert got == sorted(expected[way])


def _frame(a, b, n, size):
    order = np.lexsort((b, a))
    a, b = a[order], b[order].astype("i4")
    parts = []
    for low in range(0, n, size):
        mine = (a >= low) & (a < low + size)
        parts.append((np.concatenate([[0], np.cumsum(np.bincount(a[mine] - low, minlength=size))]), b[mine], None))
    return size, parts


def test_both_ends_bring_the_same_bits(monkeypatch):
    monkeypatch.setattr(iterate, "FOLLOWED", 7)
    rng, n = np.random.default_rng(5), 60
    pairs = np.unique(rng.integers(0, n - 5, (170, 2)), axis=0)
    out, into = _frame(pairs[:, 0], pairs[:, 1], n, 13), _frame(pairs[:, 1], pairs[:, 0], n, 13)
    for many in (1, 8, 40):
        front = np.sort(rng.choice(n, many, replace=False))
        now = np.zeros((n, 2), "u8")
        now[front] = rng.integers(0, 1 << 60, (many, 2), dtype="u8")
        expected = np.zeros((n, 2), "u8")
        for a, b in pairs:
            expected[b] |= now[a]
        for forward in (0, 1 << 40):
            monkeypatch.setattr(iterate, "FORWARD", forward)
            at, bits = iterate._spread(out, into, front, np.arange(n), now)
            assert (np.diff(at) > 0).all()
            full = np.zeros((n, 2), "u8")
            full[at] = bits
            assert (full == expected).all()
        ahead, new = set(front.tolist()), set(front.tolist())
        while new:
            new = {b for a, b in pairs.tolist() if a in new} - ahead
            ahead |= new
        seen = np.zeros(n, bool)
        assert iterate._within(out, front, seen).tolist() == sorted(ahead) and not seen.any()


def test_counts_by_bit():
    bits = np.random.default_rng(6).integers(0, 1 << 63, (9001, 4), dtype="u8")
    assert (iterate._counted(bits) == np.unpackbits(bits.view("u1"), axis=1, bitorder="little").sum(0)).all()


def test_bits_that_are_set():
    bits = np.random.default_rng(7).integers(0, 1 << 63, (999, 4), dtype="u8")
    bits[::3] = 0
    expected = np.nonzero(np.unpackbits(bits.view("u1"), axis=1, bitorder="little"))
    for got, wanted in zip(iterate._set_bits(bits), expected, strict=True):
        assert (got == wanted).all()


def test_harmonic_closeness_follows_the_direction(spark):
    pairs = np.unique(np.random.default_rng(8).integers(0, 30, (70, 2)), axis=0)
    repeated = [(int(a) * 5, int(b) * 5, 1.0) for a, b in pairs for _ in range(1 + (a + b) % 2)]
    g = Graph(spark.createDataFrame(repeated, "src long, dst long, w double"), spark.range(0, 165, 5))
    expected = {}
    for s in range(33):
        near, new, d, total = {s}, {s}, 0, 0.0
        while new:
            total, d = total + (len(new) / d if d else 0), d + 1
            new = {int(b) for a, b in pairs if a in new} - near
            near |= new
        expected[5 * s] = total / 32
    got = {r.id: r.closeness for r in iterate.harmonic_closeness(g, g.nodes.select("id"), 33).collect()}
    assert got.keys() == expected.keys() and np.allclose([got[i] for i in expected], list(expected.values()))
