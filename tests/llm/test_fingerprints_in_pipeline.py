"""The near-copy stage of the pipeline goes through SimHash fingerprints."""

import random

import pytest

from arcwise.llm import shingle_dedup, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_linked_fingerprints_are_verified_and_the_join_finds_the_rest(spark, monkeypatch):
    r = random.Random(3)
    text = [f"w{r.randrange(500)}" for _ in range(3000)]
    close, far = list(text), list(text)
    close[1500] = "changed"
    far[::60] = ["x"] * len(far[::60])
    rows = [(3, " ".join(text)), (5, " ".join(close)), (6, " ".join(far)), (8, "some other text of no one else")]
    docs = spark.createDataFrame([(*x, "en", "s", 0) for x in rows], SCHEMA)
    pairs, tiles = [], []
    linked, link = shingle_dedup.linked_to_first, simhash.link_fingerprints
    monkeypatch.setattr(shingle_dedup, "linked_to_first", lambda firsts: [pairs.append((x.a.doc_id, x.b.doc_id)) for x in linked(firsts).collect()] and linked(firsts))
    monkeypatch.setattr(simhash, "link_fingerprints", lambda *a: tiles.append(1) or link(*a))
    kept = sorted(x.doc_id for x in corpus_pipeline.simhash_dedup(spark, docs, "").collect())
    assert (3, 5) in pairs and tiles
    assert kept == [3, 8]
