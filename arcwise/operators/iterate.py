"""Fixpoints: distances, components, PageRank, hubs, spectral radius, Katz."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, drop_loops, flip, sum_repeats
from ..plans.tables import cut, discard
from .number import numbered
from .walk import SHARED_ROWS, _opened, reachability, shared_frames


def neighbours(edges: DataFrame, directed: bool = False) -> DataFrame:
    pairs = drop_loops(edges).select("src", "dst")
    return (pairs if directed else pairs.unionAll(flip(pairs))).distinct()


#: Longs of one row of the breadth-first search; a block has 64 times as many sources.
LANES = 16


def distances(graph: Graph, sources: DataFrame, directed: bool = False, then: Callable[[DataFrame], DataFrame] | None = None, shared_rows: int = SHARED_ROWS) -> DataFrame:
    """(source, node, d): breadth-first distances from sources(id); unreachable nodes are absent.

    If the adjacency has shared_rows rows at most and nothing is reduced,
    tasks search over a shared one, and no pair is shuffled. Otherwise
    sources are numbered and searched 1,024 at a time by the bits of LANES
    longs, so an edge is followed once for a block of sources at each depth.
    A row is a node that a block has reached; each depth is written to the
    shared folder. Blocks share the rounds, which go on until no bit is new.
    then() may reduce the new pairs (source, node, d) of each depth.
    """
    found = shared_distances(graph, sources, directed, False, shared_rows) if then is None and shared_rows else None
    if found is not None:
        return found
    then = then or (lambda new: new)
    near = cut(neighbours(graph.edges, directed).select(F.col("src").alias("n_in"), "dst", F.lit(0).alias("stay")).unionAll(graph.nodes.select("id", "id", F.lit(1))), "near")
    places = cut(numbered(sources.select(F.col("id").alias("source")).distinct(), ["source"], "k").select("source", F.expr(f"k div {64 * LANES}").alias("block"), F.pmod("k", F.lit(64 * LANES)).alias("bit")), "places")
    lanes = range(LANES)
    bit = lambda i: F.when(F.expr(f"bit div 64 = {i}"), F.expr("shiftleft(1L, cast(bit % 64 as int))")).otherwise(F.lit(0).cast("long"))
    at = places.select(F.col("source").alias("node"), "block", *[bit(i).alias(f"f{i}") for i in lanes]).groupBy("node", "block").agg(*[F.bit_or(f"f{i}").alias(f"f{i}") for i in lanes])
    # f: bits that came in the last round; s: bits seen before it.
    state = cut(at.select("*", *[F.lit(0).cast("long").alias(f"s{i}") for i in lanes]), "front")
    found = then(places.select("source", F.col("source").alias("node"), F.lit(0).alias("d")))
    d = 0
    while True:
        d += 1
        moved = state.join(near, state.node == near.n_in)
        f = [F.bit_or(F.when(F.col("stay") == 0, F.col(f"f{i}")).otherwise(0)).alias(f"f{i}") for i in lanes]
        s = [F.bit_or(F.when(F.col("stay") == 1, F.col(f"f{i}").bitwiseOR(F.col(f"s{i}"))).otherwise(0)).alias(f"s{i}") for i in lanes]
        met = moved.groupBy(F.col("dst").alias("node"), "block").agg(*f, *s)
        old, state = state, cut(met.select("node", "block", *[F.expr(f"f{i} & ~s{i}").alias(f"f{i}") for i in lanes], *[f"s{i}" for i in lanes]), "front")
        discard(old)
        front = state.where(" or ".join(f"f{i} <> 0" for i in lanes))
        if front.isEmpty():
            break
        lane = front.select("node", "block", F.posexplode(F.array(*[f"f{i}" for i in lanes])).alias("i", "f")).where("f <> 0")
        bits = lane.select("node", "block", F.explode(F.expr("transform(filter(sequence(0, 63), k -> (shiftright(f, k) & 1) = 1), k -> 64 * i + k)")).alias("bit"))
        new = bits.join(places, ["block", "bit"]).select("source", "node", F.lit(d).alias("d"))
        found = found.unionAll(cut(then(new), "depth"))
    return found


#: Sources that a task searches from at once, in shared searches; a power of two.
TOGETHER = 256


#: Links that a shared search follows at once.
FOLLOWED = 1 << 20
#: A link that is followed forward costs so many looked at from its end, as what it brings is sorted.
FORWARD = 4


def _links(frame: tuple[int, list[tuple]], at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """FOLLOWED links or so at once of the sorted places at: the places, where the links of each begin, what they lead to. Places without links are left out."""
    size, parts = frame
    ends = np.searchsorted(at, np.arange(len(parts) + 1) * size).tolist()
    for k, (i, j) in enumerate(itertools.pairwise(ends)):
        first, to, _ = parts[k]
        here = at[i:j] - k * size
        begin = first[here]
        many = first[here + 1] - begin
        here, begin, many = (x[many > 0] for x in (here, begin, many))
        upto = np.cumsum(many)
        cuts = np.unique(np.searchsorted(upto, np.arange(FOLLOWED, (upto[-1] if len(upto) else 0) + FOLLOWED, FOLLOWED)) + 1)
        for u, v in itertools.pairwise([0, *np.minimum(cuts, len(here)).tolist()]):
            if u < v:
                b, m = begin[u:v], many[u:v]
                starts = np.cumsum(m) - m
                total = int(starts[-1] + m[-1])
                if int(b[-1] + m[-1] - b[0]) == total:
                    some = to[b[0] : b[0] + total]
                else:
                    rows = np.repeat(b - starts, m)
                    rows += np.arange(total)
                    some = to[rows]
                yield here[u:v] + k * size, starts, some


def _degrees_at(frame: tuple[int, list[tuple]], at: np.ndarray) -> np.ndarray:
    """The number of links of the sorted places at."""
    size, parts = frame
    ends = np.searchsorted(at, np.arange(len(parts) + 1) * size).tolist()
    return np.concatenate([parts[k][0][at[i:j] - k * size + 1] - parts[k][0][at[i:j] - k * size] for k, (i, j) in enumerate(itertools.pairwise(ends))])


def _within(frame: tuple[int, list[tuple]], at: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The sorted places that can be reached from at; seen is all False, before and after."""
    found, new = [], at
    seen[at] = True
    while len(new):
        found.append(new)
        ahead = []
        for _, _, to in _links(frame, new):
            to = to[~seen[to]]
            seen[to] = True
            ahead.append(to)
        new = np.unique(np.concatenate(ahead)) if ahead else new[:0]
    found = np.sort(np.concatenate(found))
    seen[found] = False
    return found


def _spread(out, into, front: np.ndarray, left: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places that links from the front lead to, of those left at least, and the bits now at its places that come there; the cheaper of the links from the front and those into the places left are followed."""
    if FORWARD * _degrees_at(out, front).sum() >= _degrees_at(into, left).sum():
        got = [(at, np.bitwise_or.reduceat(now[to], starts)) for at, starts, to in _links(into, left)]
    else:
        got = []
        for at, starts, to in _links(out, front):
            order = np.argsort(to, kind="stable")
            to, row = to[order], np.repeat(at, np.diff(starts, append=len(to)))[order]
            first = np.flatnonzero(np.diff(to, prepend=-1))
            got.append((to[first], np.bitwise_or.reduceat(now[row], first)))
        if len(got) > 1:  # a place may be met by several
            at, bits = np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got])
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            got = [(at[order][first], np.bitwise_or.reduceat(bits[order], first))]
    if not got:
        return front[:0], now[:0]
    return np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got])


def _set_bits(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each bit that is set, by rows."""
    set_ = np.flatnonzero(np.unpackbits(bits.view("u1"), axis=1, bitorder="little").view(bool))
    width = 64 * bits.shape[1]
    return set_ >> width.bit_length() - 1, set_ & width - 1


def _counted(bits: np.ndarray) -> np.ndarray:
    """How many rows have each bit. 255 rows are summed at once in lanes of a byte."""
    total = np.zeros(64 * bits.shape[1], "i8")
    for i in range(0, len(bits), 255 * 16):
        lanes = np.unpackbits(bits[i : i + 255 * 16].view("u1"), axis=1, bitorder="little").view("u8")
        for j in range(0, len(lanes), 255):
            total += lanes[j : j + 255].sum(0, dtype="u8").view("u1")
    return total


def shared_distances(graph: Graph, sources: DataFrame, directed: bool, counted: bool, shared_rows: int = SHARED_ROWS) -> DataFrame | None:
    """(source, node, d), or counts (source, d, c), by tasks that search from TOGETHER sources over a shared adjacency; None if it has more rows than may be shared.

    Links may repeat and are shared as they are; those of a place are stated
    once where they are packed.
    """
    spark = sources.sparkSession
    near = cut(drop_loops(graph.links if graph.links is not None else graph.edges).select(F.col("src").alias("n_in"), F.col("dst").alias("n_out")), "near")
    rows = near.count()
    if 2 * rows > shared_rows:
        discard(near)
        return None
    ids = near.select(F.explode(F.array("n_in", "n_out")).alias("id")).unionAll(graph.nodes.select("id")).unionAll(sources.select("id")).where("id is not null")
    names = np.sort(ids.select(F.col("id").cast("long").alias("id")).distinct().toArrow()["id"].to_numpy())  # at most the nodes
    named = spark.sparkContext.broadcast(names)
    ways = ["out", "in"] if directed else ["near"]
    shared = named, dict(zip(ways, shared_frames(near, named, len(names), rows, ways), strict=True))
    discard(near)
    some = numbered(sources.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct(), ["id"], "k").groupBy(F.expr(f"k div {TOGETHER}").alias("block")).agg(F.collect_list("id").alias("ids"))  # TOGETHER at most
    fields = ["source", "d", "c"] if counted else ["source", "node", "d"]

    def run(batches):
        names, frames = _opened(shared, False)
        out, into = frames[ways[0]], frames[ways[-1]]
        seen, now = (np.zeros((len(names), TOGETHER // 64), "u8") for _ in range(2))
        marks = np.zeros(len(names), bool)
        for ids in (np.array(x, "i8") for batch in batches for x in batch.column(0).to_pylist()):
            k = np.arange(len(ids))
            at, inverse = np.unique(np.searchsorted(names, ids), return_inverse=True)
            bits = np.zeros((len(at), seen.shape[1]), "u8")
            bits[inverse, k // 64] = np.uint64(1) << (k % 64).astype("u8")
            every = np.bitwise_or.reduce(bits)
            within = _within(out, at, marks)
            left, d = within, 0
            while len(at):
                seen[at] |= bits
                now[at] = bits
                for i in range(0, 1 if counted else len(at), 1 << 12):
                    if counted:
                        c = _counted(bits)
                        who = np.flatnonzero(c)
                        columns = ids[who], np.full(len(who), d, "i4"), c[who]
                    else:
                        place, who = _set_bits(bits[i : i + 4096])
                        columns = ids[who], names[at[i + place]], np.full(len(who), d, "i4")
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=fields)
                left = left[(seen[left] != every).any(1)]
                to, bits = _spread(out, into, at, left, now)
                now[at] = 0
                bits = bits & ~seen[to]
                new = bits.any(1)
                at, bits, d = to[new], bits[new], d + 1
            seen[within] = 0  # cleared where this block wrote

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return some.select("ids").repartition(4 * tasks).mapInArrow(run, "source long, d int, c long" if counted else "source long, node long, d int")


def distance_counts(graph: Graph, sources: DataFrame, directed: bool = False, shared_rows: int = SHARED_ROWS) -> DataFrame:
    """(source, d, c): how many nodes lie at each distance."""
    found = shared_distances(graph, sources, directed, True, shared_rows)
    return found if found is not None else distances(graph, sources, directed, then=lambda new: new.groupBy("source", "d").agg(F.count(F.lit(1)).alias("c")), shared_rows=0)


def average_path_length(graph: Graph, sources: DataFrame) -> DataFrame:
    """mean and standard error by source of the distances that exist; a node's distance to itself counts as 0."""
    counts = distance_counts(graph, sources)
    per = counts.groupBy("source").agg(F.sum(F.col("d") * F.col("c")).alias("s"), F.sum("c").alias("c")).withColumn("a", F.col("s") / F.col("c"))
    return per.agg((F.sum("s") / F.sum("c")).alias("mean"), (F.stddev_pop("a") / F.sqrt(F.count(F.lit(1)))).alias("error"))


def harmonic_closeness(graph: Graph, sources: DataFrame, n: int, directed: bool = True) -> DataFrame:
    """(id, closeness): sum of 1/d over reached nodes, over n - 1."""
    counts = distance_counts(graph, sources, directed)
    return counts.groupBy(F.col("source").alias("id")).agg((F.sum(F.when(F.col("d") > 0, F.col("c") / F.col("d")).otherwise(0.0)) / (n - 1)).alias("closeness"))


def weak_components(graph: Graph) -> DataFrame:
    """(id, component): smallest id reachable regardless of direction, by label spreading with pointer jumps."""
    near = cut(neighbours(graph.edges))
    label = cut(graph.nodes.select("id", F.col("id").alias("c")))
    while True:
        low = near.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("m"))
        new = label.join(low, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("was"))
        jump = new.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        new = cut(new.join(jump, "c").select("id", F.least("c", "cc").alias("c"), "was"))
        label = new.select("id", "c")
        if new.where("c <> was").isEmpty():
            break
    return label.select("id", F.col("c").alias("component"))


def strong_components(graph: Graph) -> DataFrame:
    """(id, component): smallest id of each strongly connected component.

    Colouring: the smallest id that reaches a node is its colour; the nodes
    of a colour that reach back to it are a component and leave. Nodes
    without in- or out-edges are trimmed as components of their own.
    """
    edges = cut(neighbours(graph.edges, True))
    nodes = cut(graph.nodes.select("id"))
    done = None
    while True:
        if nodes.isEmpty():
            break
        colour = cut(nodes.withColumn("c", F.col("id")))
        while True:  # forward: smallest colour over in-edges
            low = edges.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            new = cut(colour.join(low, "id", "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("was")))
            colour = new.select("id", "c")
            if new.where("c <> was").isEmpty():
                break
        inside = cut(
            edges.join(colour.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").where("a = b").select("src", "dst")
        )
        found = front = cut(colour.where("id = c").select("id", F.col("c").alias("component")))
        while True:  # backward inside the colour
            new = front.join(inside, front.id == inside.dst).select(F.col("src").alias("id"), "component").distinct()
            front = cut(new.join(found, "id", "left_anti"))
            if front.isEmpty():
                break
            found = cut(found.unionAll(front))
        done = found if done is None else done.unionAll(found)
        nodes = cut(nodes.join(found, "id", "left_anti"))
        edges = cut(edges.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti"))
    return done if done is not None else nodes.withColumn("component", F.col("id"))


def pagerank(graph: Graph, n: int, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank): weight-proportional steps; mass of nodes without out-edges spreads evenly."""
    e = sum_repeats(graph.edges)
    total = e.groupBy("src").agg(F.sum("w").alias("t"))
    p = cut(e.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("p")))
    ends = cut(graph.nodes.select("id").join(total.select(F.col("src").alias("id"), F.lit(True).alias("out")), "id", "left").select("id", F.coalesce("out", F.lit(False)).alias("out")))
    rank = ends.select("id", "out", F.lit(1.0 / n).alias("r"))
    for k in range(iterations):
        lost = rank.agg(F.coalesce(F.sum(F.when(~F.col("out"), F.col("r"))), F.lit(0.0)).alias("lost"))
        got = rank.join(p, rank.id == p.src).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("p")).alias("g"))
        new = ends.join(got, "id", "left").crossJoin(F.broadcast(lost))  # one row
        rank = new.select("id", "out", ((1 - damping) / n + damping * (F.coalesce("g", F.lit(0.0)) + F.col("lost") / n)).alias("r"))
        if k % 3 == 2:
            rank = cut(rank)
    return rank.select("id", F.col("r").alias("rank"))


def hits(graph: Graph, iterations: int = 8) -> DataFrame:
    """(id, hub, authority), each summing to one, after alternating steps."""
    e = cut(sum_repeats(graph.edges))
    hub = graph.nodes.select("id", F.lit(1.0).alias("hub"))
    auth = None

    def normal(df: DataFrame, c: str) -> DataFrame:
        total = df.agg(F.sum(c).alias("_t"))
        return df.crossJoin(F.broadcast(total)).select("id", (F.col(c) / F.col("_t")).alias(c))  # one row

    for _ in range(iterations):
        auth = cut(normal(hub.join(e, hub.id == e.src).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("hub") * F.col("w")).alias("authority")), "authority"))
        hub = cut(normal(auth.join(e, auth.id == e.dst).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("authority") * F.col("w")).alias("hub")), "hub"))
    return graph.nodes.select("id").join(hub, "id", "left").join(auth, "id", "left").na.fill(0.0)


def spectral_radius(graph: Graph, iterations: int = 10) -> DataFrame:
    """One row rho: the ratio of norms of the last two power iterates of the adjacency, from all ones."""
    e = cut(sum_repeats(graph.edges))
    x = graph.nodes.select("id", F.lit(1.0).alias("x"))
    for _ in range(iterations):
        y = e.join(x, e.dst == x.id).groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("x"))
        norm = y.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("rho"))
        y = cut(y.crossJoin(F.broadcast(norm)))  # one row
        x = y.select("id", (F.col("x") / F.col("rho")).alias("x"))
    return y.select("rho").limit(1)


def katz(graph: Graph, sources: DataFrame, beta: float, terms: int = 4) -> DataFrame:
    """(source, node, katz): sum of beta^l times weighted walks of l = 1..terms steps."""
    r = reachability(graph, sources, "A", [[0.0, *(beta**k for k in range(1, terms + 1))]])
    return r.select("source", "node", F.col("r").alias("katz"))
