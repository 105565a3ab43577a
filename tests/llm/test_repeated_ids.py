"""Rows of the pipeline's near-copy stage that share an id."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_distinct_texts_of_one_id_stay(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(1, one, "en", "s1", 0), (7, two, "en", "s2", 0), (7, three, "en", "s1", 0), (7, three, "en", "s0", 0), (7, one, "en", "s0", 0), (7, two.upper(), "en", "s0", 0), (9, three, "en", "s0", 0)]
    for parts in (1, 4):
        got = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(parts), "").collect()
        kept = sorted((x.doc_id, x.text.lower(), x.source) for x in got)
        assert [x[:2] for x in kept] == [(1, one), (7, two), (7, three)]
        assert kept[0][2] == "s1" and kept[2][2] == "s0"
