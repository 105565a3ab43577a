"""Near copies of documents in the pipeline against brute force."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def near_rows():
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(12):
        text = [r.choice(words) for _ in range(r.randint(80, 200))]
        for copy in range(5):
            now = list(text)
            for k in range(copy):
                now[r.randrange(len(now))] = r.choice(words)
            rows.append((base * 10 + copy, " ".join(now)))
    rows += [(200, "Short one"), (201, "short ONE"), (202, "short two"), (203, ""), (204, None), (205, " \n"), (None, rows[0][1])]
    return rows


def test_near_copies_of_the_stage_equal_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*x, "en", "s", 0) for x in rows], SCHEMA).repartition(3)
    named = [(i, shingles(t)) for i, t in rows if i is not None]
    gone = {i for i, s in named if any(j < i and alike(s, q) for j, q in named)}
    got = corpus_pipeline.simhash_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = [x.doc_id for x in got.collect()]
    assert sorted(x for x in kept if x is not None) == sorted({i for i, _ in named} - gone) and kept.count(None) == 1
    assert len(gone) > 30 and {201, 204, 205} <= gone and 202 not in gone
