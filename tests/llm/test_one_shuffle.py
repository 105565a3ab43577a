"""Prefix rows of hashed lines lie on disk once: one shuffle that both sides of their join read, no table."""

from arcwise.llm import line_dedup as L


def test_hashed_lines_meet_over_one_shuffle(spark, monkeypatch):
    plans, keep = [], L.keep

    def kept(df, name):
        if name == "line-meeting" and not plans:
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
            assert not [x for x in spark.catalog.listTables() if x.name.endswith("_prefixes")]
        return keep(df, name)

    monkeypatch.setattr(L, "keep", kept)
    rows = [(i, 0, [1000 * (i // 2) + k for k in range(20)] + [-i - 1]) for i in range(40)]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, line array<long>")
    assert {x.doc_id for x in L.later_lines(lines).collect()} == set(range(1, 40, 2))
    assert "ReusedExchange" in plans[0] and plans[0].count("REPARTITION_BY_NUM") <= 2
