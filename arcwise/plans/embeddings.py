"""Embedding pipelines by name: walk series, reductions and assembly, with outcomes instead of crashes."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coeffs import Coefficients
from ..graph import Graph, symmetrize, unweighted
from ..operators import reduce, structure
from ..operators.linalg import project, singular_values
from ..operators.walk import propagate_features, reachability


@dataclass(frozen=True)
class WalkSpec:
    """Orientations joined by `::`, coefficient families, order and size of an embedding."""

    orientations: str = "OU::IU"
    coefficients: tuple[Coefficients, ...] = (Coefficients("poisson", {"tau": 1.0}),)
    order: int = 5
    dimensions: int = 16
    reduction: str = "ecf"

    @property
    def digest(self) -> str:
        return hashlib.sha224(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def _vector(rows: DataFrame, position: str, value: str) -> DataFrame:
    return rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(position, value))).alias("v")).select("id", F.col(f"v.{value}").alias("emb"))


def structural(graph: Graph, spec: WalkSpec, sources: DataFrame | None = None) -> DataFrame:
    """(id, emb): reductions of each source's reachability, orientation-major, then series."""
    sources = graph.nodes.select("id") if sources is None else sources
    n = graph.nodes.count()
    parts = spec.orientations.split("::")
    size = max(spec.dimensions // (len(parts) * len(spec.coefficients)), 2)
    rows = None
    for at, orientation in enumerate(parts):
        r = reachability(graph, sources, orientation, [c.values(spec.order) for c in spec.coefficients])
        if spec.reduction == "ecf":
            e = reduce.characteristic(r, n, size)
            one = e.select("series", "source", F.posexplode(F.array("re", "im")).alias("k", "x"), "j").withColumn("pos", F.col("j") * 2 + F.col("k"))
        elif spec.reduction == "sorted":
            one = reduce.sorted_values(r, size).select("series", "source", "pos", F.col("r").alias("x"))
        elif spec.reduction == "moments":
            m = reduce.central_moments(r, n)
            one = m.select("series", "source", F.posexplode(F.array("mean", "m2", "m3", "m4")).alias("pos", "x"))
        else:
            raise ValueError(f"reduction {spec.reduction!r}")
        one = one.select(F.col("source").alias("id"), F.struct(F.lit(at).alias("o"), "series", "pos").alias("at"), "x")
        rows = one if rows is None else rows.unionAll(one)
    return _vector(rows, "at", "x")


def attributed(graph: Graph, columns: list[str], spec: WalkSpec) -> DataFrame:
    """(id, emb): walked features of each orientation and series, compressed and joined end to end."""
    parts = [(o, c) for o in spec.orientations.split("::") for c in spec.coefficients]
    size = max(spec.dimensions // len(parts), 1)
    rows = None
    for at, (orientation, c) in enumerate(parts):
        x = propagate_features(graph, graph.nodes, columns, orientation, c.values(spec.order)).select("id", F.array(*columns).alias("emb"))
        small = project(x, min(size, len(columns))).select("id", F.lit(at).alias("at"), "emb")
        rows = small if rows is None else rows.unionAll(small)
    joined = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "emb"))).alias("v"))
    return joined.select("id", F.flatten(F.col("v.emb")).alias("emb"))


def degree_features(graph: Graph, clustering: bool = True) -> DataFrame:
    """(id, emb): degrees, weight sums and, if asked, clustering coefficients."""
    d = structure.degrees(graph)
    if clustering:
        d = d.join(structure.clustering(graph), "id")
    names = [c for c in d.columns if c != "id"]
    return d.select("id", F.array(*[F.col(c).cast("double") for c in names]).alias("emb"))


#: Named recipes: graph -> (id, emb).
RECIPES: dict[str, Callable[[Graph, int], DataFrame]] = {
    "degree": lambda g, dim: degree_features(g, False),
    "degree_lcc": lambda g, dim: degree_features(g, True),
    "walk_ecf": lambda g, dim: structural(g, WalkSpec(dimensions=dim)),
    "walk_ecf_undirected": lambda g, dim: structural(g, WalkSpec("U", dimensions=dim)),
    "walk_sorted": lambda g, dim: structural(g, WalkSpec(dimensions=dim, reduction="sorted")),
    "walk_moments": lambda g, dim: structural(g, WalkSpec(dimensions=dim, reduction="moments")),
}


def cast_graph(graph: Graph, directed: bool | None = None, weighted: bool | None = None) -> Graph:
    """The graph as a method takes it: undirected edges both ways, weights all one."""
    if weighted is False:
        graph = graph.with_edges(unweighted(graph.edges))
    if directed is False and graph.directed:
        graph = Graph(symmetrize(graph.edges, "mean"), graph.nodes, False)
    return graph


@dataclass
class Outcome:
    name: str
    outcome: str
    seconds: float
    vectors: DataFrame | None = None
    error: str | None = None
    metadata: dict = field(default_factory=dict)


def validate(vectors: DataFrame, nodes: int) -> str:
    """completed, or what is wrong: empty, missing_rows, zero_dim, not_finite."""
    row = vectors.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("emb")).alias("d"), F.max(F.exists("emb", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).alias("bad")).first()
    if not row["n"]:
        return "empty"
    if row["n"] != nodes:
        return "missing_rows"
    return "zero_dim" if row["d"] == 0 else "not_finite" if row["bad"] else "completed"


def embed(graph: Graph, name: str, dimensions: int = 16) -> Outcome:
    """Run a recipe; failures are outcomes."""
    began = time.perf_counter()
    try:
        vectors = RECIPES[name](graph, dimensions)
        outcome, error = validate(vectors, graph.nodes.count()), None
    except KeyError:
        raise
    except Exception as e:  # an algorithm's failure is a result of the comparison
        vectors, outcome, error = None, "failed", repr(e)[:500]
    return Outcome(name, outcome, time.perf_counter() - began, vectors, error)


class Strikes:
    """Leaves out algorithms after so many failures."""

    def __init__(self, allowed: int = 2):
        self.allowed, self.seen = allowed, {}

    def runs(self, name: str) -> bool:
        return self.seen.get(name, 0) < self.allowed

    def note(self, outcome: Outcome) -> None:
        if outcome.outcome != "completed":
            self.seen[outcome.name] = self.seen.get(outcome.name, 0) + 1


def compare(graph: Graph, names: list[str], dimensions: int = 16, strikes: Strikes | None = None) -> list[Outcome]:
    strikes, out = strikes or Strikes(), []
    for name in names:
        if strikes.runs(name):
            out.append(embed(graph, name, dimensions))
            strikes.note(out[-1])
    return out


__all__ = ["RECIPES", "Outcome", "Strikes", "WalkSpec", "attributed", "cast_graph", "compare", "degree_features", "embed", "singular_values", "structural", "validate"]
