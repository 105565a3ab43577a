"""Language identification, mixing and the pipeline."""

import random
import re

import numpy as np
import pytest

from arcwise.llm import langid, mixing

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORDS = {"en": "the of and ing tion that with his was are", "de": "der die und ung nicht ein ist mit das auch", "fr": "le la et que des une dans pour est pas"}


def language_rows(n=240):
    r = random.Random(3)
    return [(i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(5, 60))), lang, f"s{i % 4}", 0) for i in range(n) for lang in [list(WORDS)[i % 3]]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_languages_of_held_out_texts(spark):
    rows = language_rows()
    docs = spark.createDataFrame([*rows, (900, None, "en", "s0", 0), (901, "12 !!", "en", "s0", 0), (None, "der die und", None, None, None), (1, "the of and", "en", "s0", 0)], SCHEMA)
    model = langid.fit_centroids(langid.labelled_rows(docs), sample=50)
    got = langid.predict_languages(docs, model).collect()
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([truth[x.doc_id] == x.lang_pred for x in got if x.doc_id in truth]) > 0.98
    assert {(x.lang_pred, x.score, x.rejected) for x in got if x.doc_id in (900, 901)} == {("und", 0.0, True)}
    assert all(0 <= x.score <= 1 for x in got) and len(got) == 244
    assert langid.keep_known(docs, model).count() >= 240
    empty = docs.limit(0)
    assert langid.predict_languages(empty, langid.fit_centroids(langid.labelled_rows(empty))).count() == 0


def test_sources_and_ids_do_not_move_predictions(spark):
    docs = spark.createDataFrame(language_rows(120), SCHEMA)
    model = langid.fit_centroids(langid.labelled_rows(docs), sample=50)
    a = {x.doc_id: x.score for x in langid.predict_languages(docs, model).collect()}
    b = {x.doc_id - 5000: x.score for x in langid.predict_languages(docs.selectExpr("doc_id + 5000 as doc_id", "text", "'zz' as lang", "null as source"), model).collect()}
    assert all(abs(a[k] - b[k]) < 1e-5 for k in a)


@pytest.mark.parametrize("seed", range(3))
def test_targets_on_the_cluster_equal_the_plain_rule(spark, seed):
    r = random.Random(seed)
    names = [f"s{i:02d}" for i in range(r.randint(1, 9))] + [None]
    sizes = [r.choice([0, 3, 50, 1000, 20]) for _ in names]
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(names))]
    expected = mixing.capped_targets(sizes, weights, 1.5 * sum(sizes), 2.0)
    df = spark.createDataFrame([(n, 1, s) for n, s in zip(names, sizes, strict=True)], "source string, n long, source_size long")
    got = {x.source: x.target for x in mixing.source_targets(df, mixing.WEIGHTS, 1.5, 2.0).collect()}
    assert np.allclose([got[n] for n in names], expected)


def test_mix_meets_targets(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 60))), None if i % 11 == 0 else f"s{i % 4}") for i in range(600)]
    rows += [(700, None, "s1"), (701, "one\x0btwo three", "s2"), (5, "a b", "s1"), (None, "a b c", "zz")]
    docs = spark.createDataFrame([(*x, 1.5) for x in rows], "doc_id long, text string, source string, rate double")
    got = mixing.mix_sources(docs, bucket_rows=100).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = {}
    for x in got:
        assert x["size"] == size(x.text) and 0 <= x.taken <= 2 * x["size"] and x.taken == x.copies * x["size"]
        t = by.setdefault(x.source, [0, x.target, x.source_size, 0])
        t[0] += x.taken
        t[3] += x["size"]
    for taken, target, source_size, total in by.values():
        assert source_size == total and abs(taken - target) <= max(2, 0.01 * target)
    slim = mixing.mix_sources(docs, texts=False)
    again = {(x.doc_id, x["size"]): x.taken for x in mixing.mix_sources(docs, texts=False).collect()}
    assert {(x.doc_id, x["size"]): x.taken for x in slim.collect()} == again
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(8)
    rows = language_rows(90)
    rows += [(100 + i, rows[i][1], rows[i][2], "s1", 0) for i in range(10)]
    rows += [(200, None, None, None, None), (201, "", "en", "s0", 0), (202, "12 34", "en", "s0", 0), (203, " ".join(r.choice(WORDS["en"].split()) for _ in range(4000)), "en", "s0", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({x.doc_id for x in now.select("doc_id").collect()})
    assert not seen[0] & {200, 201, 202} and len(seen[0]) >= 98
    assert seen[1] == seen[0] and seen[2] < seen[1] and seen[3] <= seen[2]
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in final} == seen[3]
    assert all(0 < x.length <= 2048 for x in final)
    (tmp_path / "none").mkdir()
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
