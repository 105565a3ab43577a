"""Links of vectors do not depend on how many vectors there are."""

import numpy as np

from arcwise.llm import lattice


def test_links_do_not_depend_on_the_size_of_the_table(spark, monkeypatch):
    rng = np.random.default_rng(5)
    a, b = lattice.unit_rows(rng.standard_normal((3000, 64))), rng.standard_normal((3000, 64))
    b = lattice.unit_rows(b - (a * b).sum(1, keepdims=True) * a)
    x = np.concatenate([a, 0.9005 * a + np.sqrt(1 - 0.9005**2) * b])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = lattice.unit_rows(x)
    exact = (unit @ unit.T >= 0.9).sum(1) - 1
    links = []
    for many in (2_000_000, 0):  # from this many vectors on, cells were once others
        monkeypatch.setattr(lattice, "TWO_BLOCKS", many, raising=False)
        links.append(lattice.near_vectors(rows).toPandas().sort_values("vec_id")["n_links"].to_numpy())
    assert (links[0] == links[1]).all()
    assert (links[0] <= exact).all() and links[0].sum() >= 0.999 * exact.sum()
