"""Bounds of the line join: unlike lines that share prefix words go no further, similar ones of other lengths do."""

import random

from arcwise.llm import line_dedup as L


def test_unlike_long_lines_do_not_meet_and_similar_ones_do(spark, monkeypatch):
    r = random.Random(5)
    common = [f"acommonlongword{i:03d}" for i in range(30)]
    rows = [(i, 0, " ".join(common + [f"w{i}x{k}" for k in range(170)])) for i in range(40)]
    for i, (n, changed) in enumerate([(7, 0), (8, 1), (15, 1), (31, 3), (60, 5), (127, 14), (200, 20)]):
        words = [f"p{i}q{k}" + "z" * r.randrange(9) for k in range(n)]
        rows += [(100 + 2 * i, 0, " ".join(words)), (101 + 2 * i, 0, " ".join(words[: n - changed] + [f"new{k}" for k in range(max(1, n // 9) if changed else 1)]))]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, line string")
    sets = {d: set(x.split()) for d, _, x in rows}
    near = {d for d, x in sets.items() if any(e < d and 5 * len(x & y) >= 4 * len(x | y) for e, y in sets.items())}
    pairs, verified = [], L.verified
    monkeypatch.setattr(L, "verified", lambda p, *more: [pairs.append((x.a.doc_id, x.b.doc_id)) for x in p.collect()] and None or verified(p, *more))
    assert {x.doc_id for x in L.later_lines(lines).collect()} == near and len(near) >= 5
    assert near <= {b for _, b in pairs} and all(a >= 100 for a, _ in pairs)


def test_words_put_last_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "HOT", 3)
    base = "some very longestwordofall common line of words here today"
    rows = [(i, 0, f"{base} {i}" if i % 2 else f"longestwordofall a{i} b{i} c{i} d{i} e{i}") for i in range(12)]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, line string")
    assert {x.doc_id for x in L.later_lines(lines).collect()} == {3, 5, 7, 9, 11}
