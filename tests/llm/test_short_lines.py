"""Lines of few words in the pipeline against brute force."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_short_lines_of_the_stage_equal_brute_force(spark):
    rows = [(1, "Read more\n\n未経験でも大丈夫です\na b c d"), (2, "Read more\n\n未経験でも大丈夫です\nnew"), (3, "more Read\n \na b c d e\nb a\na"), (4, "a\n a\nnew words\nb a a"), (5, None)]
    seen, expected = [], {}
    for i, text in rows:
        kept = []
        for line in [] if text is None else text.split("\n"):
            w = set(line.split())
            if not w or not any(5 * len(w & v) >= 4 * len(w | v) for v in seen):
                kept.append(line)
            if w:
                seen.append(w)
        expected[i] = None if text is None else "\n".join(kept)
    docs = spark.createDataFrame([(*x, "en", "s", 0) for x in rows], SCHEMA)
    got = {x.doc_id: x for x in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert {i: x.text for i, x in got.items()} == expected
    assert expected[2] == "\nnew" and got[2].n_chars == 4
