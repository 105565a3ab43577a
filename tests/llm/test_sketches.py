"""Pairs of long hashed lines are sifted by sketches as long as the lines, before their words are moved."""

import random

from arcwise.llm import line_dedup as L


def _table(spark, lines):
    rows = [(i, 0, i, -i, sorted(x)) for i, x in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id long, line_no int, h1 long, h2 long, line array<long>")


def _lines():
    """For sizes on both sides of a doubling: a line, near copies of other sizes, and a line that shares a third of it."""
    drawn = random.Random(5)
    new = lambda k: [drawn.getrandbits(64) - (1 << 63) for _ in range(k)]
    out = []
    for n in (3, 60, 70, 600, 1000, 1030, 3000):
        line = new(n)
        out += [line, line[: n - n // 12] + new(n // 12), line + new(n // 5), line[: n - n // 6], line[: n // 3] + new(n - n // 3)]
    return out


def _similar(x, y):
    x, y = set(x), set(y)
    return 5 * len(x & y) >= 4 * len(x | y)


def test_no_similar_pair_is_lost_and_long_unlike_ones_go(spark):
    lines = _lines()
    told = L.words_of(spark.createDataFrame([(i, 0) for i in range(len(lines))], "doc_id long, line_no int"), _table(spark, lines))
    every = [((i, 0), (j, 0)) for i in range(len(lines)) for j in range(i + 1, len(lines))]
    pairs = spark.createDataFrame(every, "a struct<doc_id: long, line_no: int>, b struct<doc_id: long, line_no: int>")
    left = {(r.a.doc_id, r.b.doc_id) for r in L.sketches_near(pairs, told, L.SIMILARITY).collect()}
    near = {(i, j) for (i, _), (j, _) in every if _similar(lines[i], lines[j])}
    assert near <= left
    assert len(near) >= 21
    assert not {(i, j) for i, j in left - near if min(len(lines[i]), len(lines[j])) > 500}


def test_words_of_unlike_lines_are_not_moved(spark, monkeypatch):
    sifted, keep = [], L.keep

    def kept(df, name):
        out = keep(df, name)
        if name == "line-sifted":
            sifted.append(out.count())
        return out

    monkeypatch.setattr(L, "keep", kept)
    lines = _lines()[20:25]
    rows = spark.createDataFrame([(i, 0, sorted(x)) for i, x in enumerate(lines)], "doc_id long, line_no int, line array<long>")
    every = [((0, 0), (j, 0)) for j in range(1, 5)]
    told = L.words_of(rows.select("doc_id", "line_no"), _table(spark, lines))
    pairs = spark.createDataFrame(every, "a struct<doc_id: long, line_no: int>, b struct<doc_id: long, line_no: int>")
    got = {r.doc_id for r in L.verified(pairs, told, L.SIMILARITY).collect()}
    assert got == {j for j in range(1, 5) if _similar(lines[0], lines[j])}
    assert 4 not in got and sifted == [3]
