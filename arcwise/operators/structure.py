"""Degrees, directed triangles, clustering, egonets, homophily, compatibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, drop_loops, flip, sum_repeats
from ..plans.tables import cut, discard


def degrees(graph: Graph) -> DataFrame:
    """id, out_deg, in_deg, w_out, w_in of every node; repeats count once."""
    e = sum_repeats(graph.edges)
    ends = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.col("w").alias("wo"), F.lit(0.0).alias("wi")).unionAll(
        e.select("dst", F.lit(0), F.lit(1), F.lit(0.0), "w")
    )
    d = ends.groupBy("id").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg"), F.sum("wo").alias("w_out"), F.sum("wi").alias("w_in"))
    return graph.nodes.select("id").join(d, "id", "left").na.fill(0)


def degree_stats(graph: Graph) -> DataFrame:
    d = degrees(graph)
    cols = []
    for c in ("out_deg", "in_deg"):
        cols += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.percentile(c, 0.5).alias(f"{c}_median")]
    return d.agg(*cols)


def log_density(graph: Graph) -> DataFrame:
    m = graph.edges.agg(F.count(F.lit(1)).alias("m"))
    return m.crossJoin(graph.nodes.agg(F.count(F.lit(1)).alias("n"))).select((F.log10("m") - 2 * F.log10("n")).alias("log_density"))


def triplets(graph: Graph) -> DataFrame:
    """id, out_t, in_t, cycle_t, mid_t: ordered pairs of edges at each node that may close."""
    e = sum_repeats(drop_loops(graph.edges))
    back = e.join(flip(e).select("src", "dst"), ["src", "dst"], "left_semi").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("rec"))
    d = degrees(graph.with_edges(e)).join(back, "id", "left").na.fill(0)
    o, i = F.col("out_deg"), F.col("in_deg")
    return d.select("id", (o * (o - 1)).alias("out_t"), (i * (i - 1)).alias("in_t"), (o * i - F.col("rec")).alias("cycle_t"), (o * i - F.col("rec")).alias("mid_t"))


#: For each kind: whether the first and the closing edge leave v (True) or enter it.
KINDS = {"out": (True, True), "cycle": (True, False), "mid": (False, True), "in": (False, False)}


def pair_table(graph: Graph) -> DataFrame:
    """(x, y, xy, yx): each linked pair once, the end of lower degree (then id) first, with both directions' weights or null.

    Loops are left out and repeats summed. Written once, as all that follows
    reads it several times.
    """
    e = sum_repeats(drop_loops(graph.edges))
    low, up = F.col("src") < F.col("dst"), F.col("src") > F.col("dst")
    pairs = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(F.when(low, F.col("w"))).alias("ab"), F.max(F.when(up, F.col("w"))).alias("ba"))
    pairs = cut(pairs, "pairs")
    deg = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    both = pairs.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    first = F.struct("da", "a") < F.struct("db", "b")
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    out = cut(both.select(pick("a", "b").alias("x"), pick("b", "a").alias("y"), pick("ab", "ba").alias("xy"), pick("ba", "ab").alias("yx"), pick("db", "da").alias("dy")), "oriented")
    discard(pairs)
    return out


def closed_triples(pairs: DataFrame) -> DataFrame:
    """(x, y, z, xy, yx, xz, zx, yz, zy): every triangle of pair_table once, with the weights of its directed edges or null.

    Each node lists its neighbours of higher degree, so a list has at most
    sqrt(2m) entries whatever the hubs. The rest of x's list goes to y, where
    it meets y's list: a wedge is one number in an array, never a row.
    """
    lists = pairs.groupBy("x").agg(F.sort_array(F.collect_list(F.struct("dy", "y", "xy", "yx"))).alias("l"))
    rest = lists.where(F.size("l") > 1).select("x", F.transform("l", lambda p: p["y"]).alias("ys"), F.posexplode("l").alias("at", "p"))
    rest = rest.where(F.col("at") + 1 < F.size("ys")).select("x", F.col("p.y").alias("y"), F.col("p.xy").alias("xy"), F.col("p.yx").alias("yx"), F.expr("slice(ys, at + 2, size(ys))").alias("zs"))
    own = pairs.groupBy(F.col("x").alias("y")).agg(F.collect_list("y").alias("ys"))
    met = rest.join(own, "y").select("x", "y", "xy", "yx", F.explode(F.array_intersect("zs", "ys")).alias("z"))
    xz = pairs.select("x", F.col("y").alias("z"), F.col("xy").alias("xz"), F.col("yx").alias("zx"))
    yz = pairs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("xy").alias("yz"), F.col("yx").alias("zy"))
    return met.join(xz, ["x", "z"]).join(yz, ["y", "z"])


def triangle_sums(graph: Graph, weighted: bool = False) -> DataFrame:
    """(id, out, cycle, mid, in, n_out, n_cycle, n_mid, n_in): triangles of the four kinds at each node that closes any, from one pass.

    Sums are counts, or with weighted the cube roots of the weights' products,
    weights divided by the largest one first.
    """
    pairs = pair_table(graph)
    if weighted:
        top = pairs.agg(F.greatest(F.max("xy"), F.max("yx")).alias("top"))
        pairs = pairs.crossJoin(F.broadcast(top)).select("x", "y", "dy", (F.col("xy") / F.col("top")).alias("xy"), (F.col("yx") / F.col("top")).alias("yx"))  # one row
    found = closed_triples(pairs)

    def term(*edges: str):
        there = F.lit(True)
        for e in edges:
            there = there & F.col(e).isNotNull()
        n = F.when(there, 1).otherwise(0)
        if not weighted:
            return n, n
        size = F.cbrt(F.col(edges[0]) * F.col(edges[1]) * F.col(edges[2]))
        return n, F.when(there, size).otherwise(0.0)

    ends = []
    for v, a, b in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y")):
        sums = []
        for kind, (first, last) in KINDS.items():
            one = term(f"{v}{a}" if first else f"{a}{v}", f"{a}{b}", f"{v}{b}" if last else f"{b}{v}")
            two = term(f"{v}{b}" if first else f"{b}{v}", f"{b}{a}", f"{v}{a}" if last else f"{a}{v}")
            sums += [(one[1] + two[1]).alias(kind), (one[0] + two[0]).alias(f"n_{kind}")]
        ends.append(F.struct(F.col(v).alias("id"), *sums))
    names = [c for k in KINDS for c in (k, f"n_{k}")]
    return found.select(F.explode(F.array(*ends)).alias("e")).select("e.*").groupBy("id").agg(*[F.sum(c).alias(c) for c in names])


def triangles(graph: Graph, kind: str, weighted: bool = False) -> DataFrame:
    """(id, tri): edges a -> b between neighbours a, b of v, of one kind; nodes without any are absent."""
    return triangle_sums(graph, weighted).where(F.col(f"n_{kind}") > 0).select("id", F.col(kind).alias("tri"))


def triangle_total(graph: Graph) -> DataFrame:
    """One row total: triangles of all four kinds over all nodes."""
    t = triangle_sums(graph)
    return t.agg(F.coalesce(F.sum(sum((F.col(k) for k in KINDS), F.lit(0))), F.lit(0)).alias("total"))


def clustering(graph: Graph, weighted: bool = False) -> DataFrame:
    """id, out_lcc, in_lcc, cycle_lcc, mid_lcc: triangles over triplets, at least 1e-6."""
    out = triplets(graph).join(triangle_sums(graph, weighted), "id", "left")
    ratio = [(F.coalesce(F.col(k).cast("double"), F.lit(0.0)) / F.greatest(F.col(f"{k}_t").cast("double"), F.lit(1e-6))).alias(f"{k}_lcc") for k in ("out", "in", "cycle", "mid")]
    return out.select("id", *ratio)


def _undirected_triangles(pairs: DataFrame) -> DataFrame:
    """(id, tri): triangles at each node regardless of direction."""
    return closed_triples(pairs).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("tri"))


def _undirected_degrees(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))


def undirected_clustering(graph: Graph) -> DataFrame:
    """id, lcc on the symmetric graph: the mean of the four kinds, which are equal there."""
    pairs = pair_table(graph)
    t = graph.nodes.select("id").join(_undirected_degrees(pairs), "id", "left").join(_undirected_triangles(pairs), "id", "left").na.fill(0)
    return t.select("id", (2 * F.col("tri") / F.greatest((F.col("d") * (F.col("d") - 1)).cast("double"), F.lit(1e-6))).alias("lcc"))


def global_clustering(graph: Graph) -> DataFrame:
    """Closed over all triplets of the undirected graph."""
    pairs = pair_table(graph)
    closed = _undirected_triangles(pairs).agg(F.sum("tri").alias("c"))
    d = graph.nodes.select("id").join(_undirected_degrees(pairs), "id")
    return closed.crossJoin(d.agg(F.sum(F.col("d") * (F.col("d") - 1)).alias("t"))).select((2 * F.coalesce("c", F.lit(0)) / F.col("t")).alias("clustering"))


def egonets(graph: Graph) -> DataFrame:
    """id, n_edges, n_src, n_dst and their weight sums: edges inside, leaving and entering {v} and its neighbours.

    Edges inside are the node's own and, for each of its triangles, those
    opposite. The members' out-edges are those inside and those leaving,
    their in-edges those inside and those entering, so degrees give the rest
    and no edge list is built for an ego.
    """
    pairs = pair_table(graph)
    one = lambda c: F.when(F.col(c).isNotNull(), 1).otherwise(0)
    w = lambda c: F.coalesce(c, F.lit(0.0))
    # Both ends of each pair: the node, the other end, and what leaves and enters the node by the pair.
    sides = F.array(
        F.struct(F.col("x").alias("id"), F.col("y").alias("m"), one("xy").alias("o"), one("yx").alias("i"), w("xy").alias("wo"), w("yx").alias("wi")),
        F.struct(F.col("y").alias("id"), F.col("x").alias("m"), one("yx").alias("o"), one("xy").alias("i"), w("yx").alias("wo"), w("xy").alias("wi")),
    )
    sided = pairs.select(F.explode(sides).alias("s")).select("s.*")
    deg = cut(sided.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("o", "i", "wo", "wi")]), "degrees")
    member = sided.select("id", "m").join(deg.withColumnRenamed("id", "m"), "m").groupBy("id").agg(*[F.sum(c).alias(f"m_{c}") for c in ("o", "i", "wo", "wi")])
    across = [F.struct(F.col(v).alias("id"), (one(f"{a}{b}") + one(f"{b}{a}")).alias("n"), (w(f"{a}{b}") + w(f"{b}{a}")).alias("w")) for v, a, b in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))]
    opposite = closed_triples(pairs).select(F.explode(F.array(*across)).alias("s")).select("s.*").groupBy("id").agg(F.sum("n").alias("n_opp"), F.sum("w").alias("w_opp"))
    t = graph.nodes.select("id").join(deg, "id", "left").join(member, "id", "left").join(opposite, "id", "left").na.fill(0)
    n_in, w_in = F.col("o") + F.col("i") + F.col("n_opp"), F.col("wo") + F.col("wi") + F.col("w_opp")
    return t.select(
        "id", n_in.alias("n_edges"), (F.col("o") + F.col("m_o") - n_in).alias("n_src"), (F.col("i") + F.col("m_i") - n_in).alias("n_dst"),
        w_in.alias("w_edges"), (F.col("wo") + F.col("m_wo") - w_in).alias("w_src"), (F.col("wi") + F.col("m_wi") - w_in).alias("w_dst"),
    )


def node_homophily(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row h: the weight share of same-label edges by source, averaged over sources with weight."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("_a")), labels.select(F.col("id").alias("dst"), F.col("label").alias("_b"))
    per = edges.join(a, "src").join(b, "dst").groupBy("src").agg(F.sum("w").alias("t"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("w")).otherwise(0.0)).alias("s"))
    return per.where("t <> 0").agg(F.avg(F.col("s") / F.col("t")).alias("h"))


def two_step(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse product: paths over an edge of a, then one of b."""
    x, y = a.select("src", F.col("dst").alias("_m"), F.col("w").alias("_w")), b.select(F.col("src").alias("_m"), "dst", "w")
    return x.join(y, "_m").groupBy("src", "dst").agg(F.sum(F.col("_w") * F.col("w")).alias("w"))


def homophily_suite(graph: Graph) -> DataFrame:
    """One row of one-step and two-step homophilies, directed and undirected, and what direction gains.

    A product's share needs only how much weight reaches each class, so the
    second step is replaced by class sums of each node: o(m, class) over its
    out-edges, i(m, class) over its in-edges. No product is formed; all
    shuffles are of edges or of (node, class) sums. The undirected graph is
    the sum of both directions, so its values are sums too.
    """
    e, y = cut(sum_repeats(graph.edges), "edges"), graph.nodes.select("id", "label")
    lab = y.select("id", "label", F.lit(True).alias("known"))
    # Each directed edge seen from both of its ends: me, the other end, and the weight that leaves (o) or enters (i) me.
    far = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("m"), F.col("w").alias("o"), F.lit(0.0).alias("i")), F.struct(F.col("dst").alias("id"), F.col("src").alias("m"), F.lit(0.0).alias("o"), F.col("w").alias("i")))
    seen = e.select(F.explode(far).alias("s")).select("s.*")
    classes = cut(seen.join(y.withColumnRenamed("id", "m"), "m").groupBy("id", "label").agg(F.sum("o").alias("c_o"), F.sum("i").alias("c_i")), "classes")
    totals = classes.groupBy("id").agg(F.sum("c_o").alias("t_o"), F.sum("c_i").alias("t_i"))
    # One step: the share of a node's own class among its class sums.
    own = lab.join(totals, "id").join(classes, ["id", "label"], "left").na.fill(0.0, ["c_o", "c_i"])
    share = lambda s, t: F.avg(F.when(t != 0, s / t))
    c = F.col
    one = own.agg(share(c("c_o") + c("c_i"), c("t_o") + c("t_i")).alias("h_u"), share(c("c_o"), c("t_o")).alias("h_d"), share(c("c_i"), c("t_i")).alias("h_d_t"))
    # Two steps: to the middle node m, then by its sums of my class and of all classes.
    there = seen.join(lab, "id").select("id", F.col("label"), "m", "o", "i")
    total = there.join(totals.withColumnRenamed("id", "m"), "m")
    met = total.join(classes.withColumnRenamed("id", "m"), ["m", "label"], "left").na.fill(0.0, ["c_o", "c_i"])
    steps = {"aa": ("o", "o"), "a_a_t": ("o", "i"), "a_t_a": ("i", "o"), "a_t_a_t": ("i", "i")}
    sums = [F.sum(c(a) * c(f"{k}_{b}")).alias(f"{k}_{n}") for n, (a, b) in steps.items() for k in ("c", "t")]
    per = met.groupBy("id").agg(*sums)
    all_of = lambda k: sum((c(f"{k}_{n}") for n in steps), F.lit(0.0))
    two = per.agg(share(all_of("c"), all_of("t")).alias("h_u2"), *[share(c(f"c_{n}"), c(f"t_{n}")).alias(f"h_d_{n}") for n in steps])
    wide = one.crossJoin(two).select("h_u", "h_u2", "h_d", "h_d_t", "h_d_aa", "h_d_a_a_t", "h_d_a_t_a", "h_d_a_t_a_t")  # one row each
    wide = wide.withColumn("h_u_eff", F.greatest("h_u", "h_u2")).withColumn("h_d_eff", F.greatest("h_d", "h_d_t", "h_d_aa", "h_d_a_a_t", "h_d_a_t_a", "h_d_a_t_a_t"))
    return wide.withColumn("h_eff_gain", F.col("h_d_eff") / F.col("h_u_eff"))


def compatibility(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(y_src, y_dst, share): class to class weight, each source class summing to one."""
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("y_src")), labels.select(F.col("id").alias("dst"), F.col("label").alias("y_dst"))
    w = edges.join(a, "src").join(b, "dst").groupBy("y_src", "y_dst").agg(F.sum("w").alias("w"))
    total = w.groupBy("y_src").agg(F.sum("w").alias("t"))
    return w.join(total, "y_src").select("y_src", "y_dst", (F.col("w") / F.col("t")).alias("share"))


def one_hop_homophily(graph: Graph) -> DataFrame:
    """(id, h1): share of distinct neighbours with the node's label; 0 without neighbours."""
    pairs = drop_loops(graph.edges).select("src", "dst")
    near = pairs.unionAll(flip(pairs)).distinct()
    y = graph.nodes.select("id", "label")
    a, b = y.select(F.col("id").alias("src"), F.col("label").alias("_a")), y.select(F.col("id").alias("dst"), F.col("label").alias("_b"))
    h = near.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("id")).agg(F.avg(F.when(F.col("_a") == F.col("_b"), 1.0).otherwise(0.0)).alias("h1"))
    return y.select("id").join(h, "id", "left").na.fill(0.0)


def two_hop_homophily(graph: Graph) -> DataFrame:
    """(id, h2): share over the distinct nodes exactly two hops away; NaN if a neighbour has degree one; 0 without any."""
    pairs = drop_loops(graph.edges).select("src", "dst")
    near = pairs.unionAll(flip(pairs)).distinct()
    deg = near.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("d"))
    thin = near.join(deg, "dst").groupBy(F.col("src").alias("id")).agg(F.min("d").alias("d"))
    far = near.select("src", F.col("dst").alias("m")).join(near.select(F.col("src").alias("m"), "dst"), "m").where("src <> dst").select("src", "dst").distinct()
    far = far.join(near, ["src", "dst"], "left_anti")
    y = graph.nodes.select("id", "label")
    a, b = y.select(F.col("id").alias("src"), F.col("label").alias("_a")), y.select(F.col("id").alias("dst"), F.col("label").alias("_b"))
    h = far.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("id")).agg(F.avg(F.when(F.col("_a") == F.col("_b"), 1.0).otherwise(0.0)).alias("h"))
    out = y.select("id").join(h, "id", "left").join(thin, "id", "left")
    return out.select("id", F.when(F.col("d") == 1, F.lit(float("nan"))).otherwise(F.coalesce("h", F.lit(0.0))).alias("h2"))


def standardize(features: DataFrame, columns: list[str], ddof: int) -> DataFrame:
    """Columns less their mean over their deviation; a deviation near nothing counts as one."""
    sd = F.stddev_samp if ddof else F.stddev_pop
    stats = features.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[sd(c).alias(f"{c}_s") for c in columns])
    z = [((F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") < 1e-7, 1.0).otherwise(F.col(f"{c}_s"))).alias(c) for c in columns]
    return features.crossJoin(F.broadcast(stats)).select("id", *z)  # one row of statistics
