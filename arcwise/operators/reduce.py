"""Reductions of reachability (series, source, node, r) to source vectors.

Only non-zero entries are stored, so every reduction takes the number of
nodes n and accounts for the zeros left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["series", "source"]


@dataclass(frozen=True)
class Reduction:
    """A reduction of whole sources, which a walk may take before any pair leaves its task.

    of() gets the masses of one source that are not zero (side by side if two
    walks are compared) and gives rows of fields, a DDL list; by() gives the
    same from a table of all pairs, with the keys in front.
    """

    fields: str
    of: Callable[..., Sequence[tuple]]
    by: Callable[[DataFrame], DataFrame]


def entropy(r: DataFrame) -> DataFrame:
    return r.groupBy(KEYS).agg((-F.sum(F.col("r") * F.log2(F.col("r") + 1e-10))).alias("entropy"))


def coverage(r: DataFrame, n: int) -> DataFrame:
    return r.groupBy(KEYS).agg(F.sum(F.when(F.col("r") >= 1.0 / n, 1).otherwise(0)).alias("coverage"))


def gini(r: DataFrame, n: int) -> DataFrame:
    """(n + 1 - 2 sum(cumulative) / total) / n over all n values, zeros first."""
    w = Window.partitionBy(KEYS).orderBy("r", "node")
    # The i-th smallest of the stored values counts in as many sums as values follow it, itself included.
    ranked = r.withColumn("after", F.count(F.lit(1)).over(Window.partitionBy(KEYS)) - F.row_number().over(w) + 1)
    return ranked.groupBy(KEYS).agg(((n + 1 - 2 * F.sum(F.col("r") * F.col("after")) / F.sum("r")) / n).alias("gini"))


def total_variation_of(both: DataFrame) -> DataFrame:
    """(source, tv) of two reachabilities side by side, (source, node, r0, r1)."""
    return both.groupBy("source").agg((F.sum(F.abs(F.col("r0") - F.col("r1"))) / 2).alias("tv"))


def hellinger_of(both: DataFrame) -> DataFrame:
    """(source, hellinger) of two reachabilities side by side, (source, node, r0, r1)."""
    return both.groupBy("source").agg(F.sqrt(F.greatest(F.lit(0.0), 1 - F.sum(F.sqrt(F.col("r0") * F.col("r1"))))).alias("hellinger"))


def total_variation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Half the summed difference of two reachabilities, by series and source."""
    signed = a.select(*KEYS, "node", "r").unionAll(b.select(*KEYS, "node", -F.col("r")))
    return signed.groupBy(*KEYS, "node").agg(F.sum("r").alias("d")).groupBy(KEYS).agg((F.sum(F.abs("d")) / 2).alias("tv"))


def hellinger(a: DataFrame, b: DataFrame) -> DataFrame:
    """sqrt(1 - sum sqrt(p q)); the sum is kept from passing one."""
    both = a.select(*KEYS, "node", "r").join(b.select(*KEYS, "node", F.col("r").alias("q")), [*KEYS, "node"])
    s = F.sum(F.sqrt(F.col("r") * F.col("q")))
    return both.groupBy(KEYS).agg(F.sqrt(F.greatest(F.lit(0.0), 1 - s)).alias("hellinger"))


def characteristic(r: DataFrame, n: int, dim: int = 8, largest: float = 100.0) -> DataFrame:
    """(series, source, j, re, im): the empirical characteristic function at largest * j / (dim / 2)."""
    points = dim // 2
    ts = F.array(*[F.lit(largest * j / points) for j in range(1, points + 1)])
    long = r.select(*KEYS, "r", F.posexplode(ts).alias("j", "t"))
    re = (n - F.count(F.lit(1)) + F.sum(F.cos(F.col("t") * F.col("r")))) / n
    return long.groupBy(*KEYS, (F.col("j") + 1).alias("j")).agg(re.alias("re"), (F.sum(F.sin(F.col("t") * F.col("r"))) / n).alias("im"))


def central_moments(r: DataFrame, n: int, largest: int = 4) -> DataFrame:
    """mean and m2..m_largest over all n nodes."""
    mean = F.sum("r").over(Window.partitionBy(KEYS)) / n
    cols = [(F.sum(F.pow(F.col("r") - F.col("mean"), F.lit(m))) + (n - F.count(F.lit(1))) * F.pow(-F.first("mean"), F.lit(m))) / n for m in range(2, largest + 1)]
    return r.withColumn("mean", mean).groupBy(KEYS).agg(F.first("mean").alias("mean"), *[c.alias(f"m{m}") for m, c in enumerate(cols, 2)])


def sorted_values(r: DataFrame, dim: int) -> DataFrame:
    """(series, source, pos, r): own mass at 0, then the dim - 1 largest others; missing ones are zero."""
    w = Window.partitionBy(KEYS).orderBy(F.col("own").desc(), F.col("r").desc(), "node")
    rows = r.withColumn("own", F.col("source") == F.col("node"))
    own = F.max("own").over(Window.partitionBy(KEYS)).cast("int")
    ranked = rows.withColumn("pos", F.row_number().over(w) - own).where(F.col("pos") < dim)
    grid = r.select(KEYS).distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(dim - 1))))
    return grid.join(ranked.select(*KEYS, "pos", "r"), [*KEYS, "pos"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))


def _entropy(r: np.ndarray) -> float:
    return float(-(r * np.log2(r + 1e-10)).sum())


def _gini(r: np.ndarray, n: int) -> float:
    r = np.sort(r)
    return float((n + 1 - 2 * (r * np.arange(len(r), 0, -1)).sum() / r.sum()) / n)


def _moments(r: np.ndarray, n: int, largest: int) -> tuple[float, ...]:
    mean = r.sum() / n
    return (float(mean), *(float((((r - mean) ** m).sum() + (n - len(r)) * (-mean) ** m) / n) for m in range(2, largest + 1)))


def _characteristic(r: np.ndarray, n: int, dim: int, largest: float) -> list[tuple]:
    ts = [(j, largest * j / (dim // 2)) for j in range(1, dim // 2 + 1)]
    return [(j, float((n - len(r) + np.cos(t * r).sum()) / n), float(np.sin(t * r).sum() / n)) for j, t in ts]


def entropy_reduction() -> Reduction:
    return Reduction("entropy double", lambda r: [(_entropy(r),)], entropy)


def coverage_reduction(n: int) -> Reduction:
    return Reduction("coverage long", lambda r: [(int((r >= 1.0 / n).sum()),)], lambda r: coverage(r, n))


def gini_reduction(n: int) -> Reduction:
    return Reduction("gini double", lambda r: [(_gini(r, n),)], lambda r: gini(r, n))


def dispersal_reduction(n: int) -> Reduction:
    """entropy and coverage at once."""

    def by(r: DataFrame) -> DataFrame:
        return r.groupBy(KEYS).agg((-F.sum(F.col("r") * F.log2(F.col("r") + 1e-10))).alias("entropy"), F.sum(F.when(F.col("r") >= 1.0 / n, 1).otherwise(0)).alias("coverage"))

    return Reduction("entropy double, coverage long", lambda r: [(_entropy(r), int((r >= 1.0 / n).sum()))], by)


def characteristic_reduction(n: int, dim: int = 8, largest: float = 100.0) -> Reduction:
    return Reduction("j long, re double, im double", lambda r: _characteristic(r, n, dim, largest), lambda r: characteristic(r, n, dim, largest))


def moments_reduction(n: int, largest: int = 4) -> Reduction:
    fields = ", ".join(f"{c} double" for c in ("mean", *(f"m{m}" for m in range(2, largest + 1))))
    return Reduction(fields, lambda r: [_moments(r, n, largest)], lambda r: central_moments(r, n, largest))


#: Distances of two reachabilities side by side.
TOTAL_VARIATION = Reduction("tv double", lambda a, b: [(float(np.abs(a - b).sum() / 2),)], total_variation_of)
HELLINGER = Reduction("hellinger double", lambda a, b: [(float(np.sqrt(max(0.0, 1 - np.sqrt(a * b).sum()))),)], hellinger_of)
