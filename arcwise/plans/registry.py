"""Named queries over the star-schema tables and their DuckDB statements.

Doubles are rounded to six decimals in both engines; coefficients enter both
as the same literals; sources are chosen by rule; ties end in ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import graph as G
from ..functions.coeffs import Coefficients
from ..operators import reduce, sample, structure, walk
from ..sources import tables as T
from .oracle import GRAPHS, with_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, integers to bigint; minus zero becomes zero."""
    kinds = dict(df.dtypes)
    cols = [(F.round(F.col(c), 6) + 0.0).alias(c) if kinds[c] in ("double", "float") else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "smallint", "tinyint") else F.col(c) for c in df.columns]
    return df.select(cols)


def part(s: SparkSession, d: str) -> G.Graph:
    return T.part_graph(s, d)


def chosen(nodes: DataFrame) -> DataFrame:
    """The stated query set of searches from nodes: ids divisible by 20, against the whole graph."""
    return nodes.where("id % 20 = 0").select("id")


# ---- edges -----------------------------------------------------------------


@query("edges_part", with_graph("part", "select src, dst, round(w, 6) as w from e"))
def _(s, d):
    return rounded(part(s, d).edges)


@query("edges_nation", with_graph("nation", "select src, dst, round(w, 6) as w from e"))
def _(s, d):
    return rounded(T.nation_graph(s, d).edges)


@query("canonical_mean", with_graph("part", "select least(src,dst) as src, greatest(src,dst) as dst, round(avg(w),6) as w from e group by 1,2"))
def _(s, d):
    return rounded(G.canonical_mean(part(s, d).edges))


for _how, _sql in (("sum", "sum(w)"), ("max", "max(w)"), ("mean", "avg(w)")):

    @query(f"symmetrize_{_how}", with_graph("part", f"select src, dst, round({_sql},6) as w from (select src,dst,w from e union all select dst,src,w from e) group by 1,2"))
    def _(s, d, how=_how):
        return rounded(G.symmetrize(part(s, d).edges, how))


@query("signed_split", with_graph("part", "select src, dst, w-25 as w, case when w-25<0 then 'negative' else 'positive' end as sign from e"))
def _(s, d):
    neg, pos = G.split_signed(part(s, d).edges.withColumn("w", F.col("w") - 25))
    return rounded(neg.withColumn("sign", F.lit("negative")).unionByName(pos.withColumn("sign", F.lit("positive"))))


@query("flow_canonical", with_graph("part", "select least(src,dst) as src, greatest(src,dst) as dst, round(sum(case when src>dst then -w else w end),6)+0.0 as flow, cast(count(*) as bigint) as cnt, round(avg(w),6) as w from e group by 1,2"))
def _(s, d):
    return rounded(G.canonical_flow(part(s, d).edges.withColumn("flow", F.col("w")).withColumn("cnt", F.lit(1))))


@query("graph_union", f"with {GRAPHS['part']}, {GRAPHS['supp'].replace(' e as', ' e2 as').replace('e_raw', 'e_raw2').replace(' n as', ' n2 as').replace(', n as', ', n2 as').replace(', e as', ', e2 as')}, o as (select max(id)+1 as k from n) select src,dst,round(w,6) as w from e union all select src+k, dst+k, round(w,6) from e2, o")
def _(s, d):
    a, b = part(s, d), T.supplier_graph(s, d)
    k = a.nodes.agg(F.max("id") + 1).first()[0]
    return rounded(G.disjoint_union(a, b, k).edges)


@query("permute_nodes", with_graph("part", "select a.k as src, b.k as dst, round(w,6) as w from e join p a on e.src=a.id join p b on e.dst=b.id", "p as (select id, cast(row_number() over (order by (id*7919+id*104729+13*31337)%1000003, id)-1 as bigint) as k from n)"))
def _(s, d):
    g = part(s, d)
    return rounded(G.relabel(g, G.permutation(g.nodes)).edges)


@query("induced_subgraph", with_graph("part", "select src,dst,round(w,6) as w from e where src in (select id from n where p_size<=25) and dst in (select id from n where p_size<=25)"))
def _(s, d):
    g = part(s, d)
    return rounded(G.induced(g, g.nodes.where("p_size <= 25")).edges)


@query("edge_difference", with_graph("part", "select src,dst,round(w,6) as w from e where (src,dst) not in (select dst,src from e)"))
def _(s, d):
    e = part(s, d).edges
    return rounded(G.edge_difference(e, G.flip(e)))


@query("edge_intersection", with_graph("part", "select src,dst,round(w,6) as w from e where (src,dst) in (select dst,src from e)"))
def _(s, d):
    e = part(s, d).edges
    return rounded(G.edge_intersection(e, G.flip(e)))


@query("bidirected_loops", with_graph("part", "select src,dst,1.0::double as w from (select src,dst from e union select dst,src from e union select id,id from n)"))
def _(s, d):
    return G.bidirected_with_loops(part(s, d))


@query("adjacency_lists", with_graph("part", "select src, string_agg(cast(dst as varchar), ' ' order by dst) as neighbours from e group by src"))
def _(s, d):
    return part(s, d).edges.groupBy("src").agg(F.array_join(F.transform(F.sort_array(F.collect_list("dst")), lambda x: x.cast("string")), " ").alias("neighbours"))


# ---- degrees ---------------------------------------------------------------

DEG = "deg as (select n.id, coalesce(o,0) as out_deg, coalesce(i,0) as in_deg, coalesce(wo,0.0) as w_out, coalesce(wi,0.0) as w_in from n left join (select src, count(*) as o, sum(w) as wo from e group by 1) a on n.id=a.src left join (select dst, count(*) as i, sum(w) as wi from e group by 1) b on n.id=b.dst)"


@query("degrees", with_graph("part", "select id, cast(out_deg as bigint) as out_deg, cast(in_deg as bigint) as in_deg from deg", DEG))
def _(s, d):
    return structure.degrees(part(s, d)).select("id", "out_deg", "in_deg")


@query("weighted_degrees", with_graph("part", "select id, round(w_out,6) as w_out, round(w_in,6) as w_in from deg", DEG))
def _(s, d):
    return rounded(structure.degrees(part(s, d)).select("id", "w_out", "w_in"))


@query("degree_stats", with_graph("part", "select " + ", ".join(f"round(avg({c}),6) as {c}_mean, round(stddev_pop({c}),6) as {c}_std, round(quantile_cont(cast({c} as double),0.5),6) as {c}_median" for c in ("out_deg", "in_deg")) + " from deg", DEG))
def _(s, d):
    return rounded(structure.degree_stats(part(s, d)))


@query("density", with_graph("part", "select round(log10((select count(*) from e)) - 2*log10((select count(*) from n)),6) as log_density"))
def _(s, d):
    return rounded(structure.log_density(part(s, d)))


@query("branch_factor", with_graph("part", "select round(avg(out_deg),6) as branch from deg", DEG))
def _(s, d):
    return rounded(structure.degrees(part(s, d)).agg(F.avg("out_deg").alias("branch")))


# ---- walk operators --------------------------------------------------------

OUT, INTO = "od as (select src as v, sum(w) as t from {e} group by 1)", "idg as (select dst as v, sum(w) as t from {e} group by 1)"
EU = "eu as (select src,dst,sum(w) as w from (select src,dst,w from e union all select dst,src,w from e) group by 1,2)"


def frame_sql(symbol: str, name: str = "p") -> str:
    """CTEs that end in name(n_in, n_out, p)."""
    e, pre = "e", ""
    base = symbol
    if symbol in "UCS":
        e, pre, base = f"eu_{name}", EU.replace("eu as", f"eu_{name} as") + ", ", {"U": "O", "C": "B", "S": "X"}[symbol]
    ends = "dst as n_in, src as n_out" if base in "BIT" else "src as n_in, dst as n_out"
    od, idg = OUT.format(e=e).replace("od as", f"od_{name} as"), INTO.format(e=e).replace("idg as", f"id_{name} as")
    if base in "AT":
        return f"{name} as (select {ends}, w as p from e)"
    if base in "OB":
        return f"{pre}{od}, {name} as (select {ends}, w/t as p from {e} join od_{name} on src=v union all select id,id,1.0 from n where id not in (select v from od_{name}))"
    if base in "FI":
        return f"{pre}{idg}, {name} as (select {ends}, w/t as p from {e} join id_{name} on dst=v union all select id,id,1.0 from n where id not in (select v from id_{name}))"
    return f"{pre}{od}, {idg}, {name} as (select {ends}, w/sqrt(od_{name}.t*id_{name}.t) as p from {e} join od_{name} on src=od_{name}.v join id_{name} on dst=id_{name}.v union all select id,id,1.0 from n where id not in (select v from od_{name}) and id not in (select v from id_{name}))"


for _name, _symbol in {"norm_out": "O", "norm_in": "I", "norm_forward": "F", "norm_backward": "B", "norm_sym": "X", "norm_undirected": "U", "norm_undirected_t": "C", "norm_undirected_sym": "S", "norm_raw": "A", "norm_raw_t": "T"}.items():
    _g = "cs" if _symbol in "XOF" else "part"

    @query(_name, with_graph(_g, "select n_in, n_out, round(p,9) as p from p", frame_sql(_symbol)))
    def _(s, d, symbol=_symbol, g=_g):
        frame = walk.operator_frame(T.customer_supplier_graph(s, d) if g == "cs" else part(s, d), symbol)
        return frame.select("n_in", "n_out", F.round("p", 9).alias("p"))  # many shares end in a five at the seventh place


@query("walk_step", with_graph("part", "select n_in as source, n_out as node, round(sum(p),6) as r from p where n_in % 20 = 0 group by 1,2", frame_sql("O")))
def _(s, d):
    g = part(s, d)
    return rounded(walk.step(walk.start(chosen(g.nodes)), walk.operator_frame(g, "O")))


def reach_sql(orientation: str, coefficients: list[float], name: str = "r", sources: str = "id % 20 = 0") -> str:
    """CTEs that end in name(source, node, r)."""
    seq = walk.pad_sequence(orientation, len(coefficients) - 1)
    ctes = [frame_sql(c, f"p_{name}_{c}") for c in dict.fromkeys(seq)]
    ctes.append(f"{name}_0 as (select id as source, id as node, 1.0::double as r from n where {sources})")
    for k, c in enumerate(seq, 1):
        ctes.append(f"{name}_{k} as (select source, n_out as node, sum(r*p) as r from {name}_{k - 1} join p_{name}_{c} on node=n_in group by 1,2)")
    union = " union all ".join(f"select source,node,r*{c!r}::double as r from {name}_{k}" for k, c in enumerate(coefficients) if c)
    ctes.append(f"{name} as (select source,node,sum(r) as r from ({union}) group by 1,2)")
    return ", ".join(ctes)


POISSON = Coefficients("poisson", {"tau": 2.0}).values(3)
FAMILIES = {
    "reach_poisson": POISSON,
    "reach_geometric": Coefficients("geometric", {"tau": 2.0}).values(3),
    "reach_uniform": Coefficients("uniform", {"tau": 1.0}, 1).values(3),
    "reach_binom": Coefficients("binom", {"tau": 2.0}).values(3),
    "reach_nbinom": Coefficients("nbinom", {"tau": 2.0, "r": 3.0}).values(3),
}


def reach(s: SparkSession, d: str, orientation: str = "O", coefficients: list[float] = POISSON, then=None) -> DataFrame:
    g = part(s, d)
    return walk.reachability(g, chosen(g.nodes), orientation, [coefficients], then=then)


for _name, _c in FAMILIES.items():

    @query(_name, with_graph("part", "select source,node,round(r,6) as r from r", reach_sql("O", _c)))
    def _(s, d, c=_c):
        return rounded(reach(s, d, "O", c).drop("series"))


@query("reach_switch_oui", with_graph("part", "select source,node,round(r,6) as r from r", reach_sql("OUI", POISSON)))
def _(s, d):
    return rounded(reach(s, d, "OUI").drop("series"))


@query("reach_series", with_graph("part", "select 0::bigint as series, source,node,round(r,6) as r from r union all select 1, source,node,round(r,6) from q", reach_sql("OI", POISSON) + ", " + reach_sql("OI", FAMILIES["reach_geometric"], "q")))
def _(s, d):
    g = part(s, d)
    return rounded(walk.reachability(g, chosen(g.nodes), "OI", [POISSON, FAMILIES["reach_geometric"]]))


def features_sql(c: list[float]) -> str:
    ctes = [frame_sql("O", "p"), "x_0 as (select id, p_size::double as p_size, p_retailprice as p_retailprice from n)"]
    ctes += [f"x_{k} as (select n_out as id, sum(p_size*p) as p_size, sum(p_retailprice*p) as p_retailprice from x_{k - 1} join p on id=n_in group by 1)" for k in (1, 2, 3)]
    union = " union all ".join(f"select id, p_size*{v!r}::double as p_size, p_retailprice*{v!r}::double as p_retailprice from x_{k}" for k, v in enumerate(c))
    return ", ".join([*ctes, f"z as (select id, sum(p_size) as p_size, sum(p_retailprice) as p_retailprice from ({union}) group by 1)"])


@query("reach_times_x", with_graph("part", "select id, round(p_size,6) as p_size, round(p_retailprice,4) as p_retailprice from z", features_sql(POISSON)))
def _(s, d):
    g = part(s, d)
    out = walk.propagate_features(g, g.nodes, ["p_size", "p_retailprice"], "O", POISSON)
    return out.select("id", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 4).alias("p_retailprice"))


@query("filter_threshold", with_graph("part", "select source,node,round(r,6) as r from r where r >= 1.0/sqrt(((select count(*) from n)+1.0)*((select count(*) from e)+1.0))", reach_sql("O", POISSON)))
def _(s, d):
    g = part(s, d)
    theta = walk.default_theta(g.nodes.count(), g.edges.count())
    return rounded(reach(s, d, then=lambda r: walk.threshold_filter(r, theta)).drop("series"))


@query("filter_log", with_graph("part", "select source,node,round(ln(greatest(r,1.0/c))+ln(c),6) as r from r, (select count(*)::double as c from n) where ln(greatest(r,1.0/c))+ln(c) <> 0", reach_sql("O", POISSON)))
def _(s, d):
    n = part(s, d).nodes.count()
    return rounded(reach(s, d, then=lambda r: walk.log_filter(r, n)).drop("series"))


# ---- reductions ------------------------------------------------------------

N = "(select count(*) from n)"


def reduced(name: str, sql: str, f):
    @query(name, with_graph("part", sql, reach_sql("O", POISSON)))
    def _(s, d):
        n = part(s, d).nodes.count()
        return rounded(reach(s, d, then=f(n)).drop("series"))


def distanced(name: str, sql: str, f):
    @query(name, with_graph("part", sql, reach_sql("O", POISSON) + ", " + reach_sql("U", POISSON, "q")))
    def _(s, d):
        g = part(s, d)
        return rounded(walk.compared(g, chosen(g.nodes), "O", "U", POISSON, f))


reduced("entropy", "select source, round(-sum(r*log2(r+1e-10)),6) as entropy from r group by 1", lambda n: reduce.entropy_reduction())
reduced("coverage", f"select source, cast(count(*) filter (where r >= 1.0/{N}) as bigint) as coverage from r group by 1", reduce.coverage_reduction)
reduced("gini", f"select source, round(({N}+1-2*sum(r*(c-k+1))/sum(r))/{N},6) as gini from (select source, r, row_number() over (partition by source order by r, node) as k, count(*) over (partition by source) as c from r) group by 1", reduce.gini_reduction)
distanced("tv_distance", "select coalesce(a.source,b.source) as source, round(sum(abs(coalesce(a.r,0)-coalesce(b.r,0)))/2,6) as tv from r a full join q b on a.source=b.source and a.node=b.node group by 1", reduce.TOTAL_VARIATION)
distanced("hellinger", "select a.source as source, round(sqrt(greatest(0.0,1-sum(sqrt(a.r*b.r)))),6) as hellinger from r a join q b on a.source=b.source and a.node=b.node group by 1", reduce.HELLINGER)
reduced("ecf", f"select source, j::bigint as j, round(({N}-count(*)+sum(cos(100.0*j/4*r)))/{N},6) as re, round(sum(sin(100.0*j/4*r))/{N},6) as im from r, range(1,5) t(j) group by 1,2", reduce.characteristic_reduction)
reduced("central_moments", f"select source, round(any_value(mu),6) as mean, " + ", ".join(f"round((sum(pow(r-mu,{m}))+({N}-count(*))*pow(-any_value(mu),{m}))/{N},6)+0.0 as m{m}" for m in (2, 3, 4)) + f" from (select source, r, sum(r) over (partition by source)/{N} as mu from r) group by 1", reduce.moments_reduction)
reduced("sorted_values", "select g.source, g.pos::bigint as pos, round(coalesce(k.r,0),6) as r from (select distinct source, pos from r, range(0,6) t(pos)) g left join (select source, r, row_number() over (partition by source order by (source=node)::int desc, r desc, node) - max((source=node)::int) over (partition by source) as pos from r) k on g.source=k.source and g.pos=k.pos", lambda n: lambda r: reduce.sorted_values(r, 6))


@query("dispersal", with_graph("part", f"select source, round(-sum(r*log2(r+1e-10)),6) as entropy, cast(count(*) filter (where r >= 1.0/{N}) as bigint) as coverage from r group by 1", reach_sql("OU", POISSON)))
def dispersal(s, d):
    n = part(s, d).nodes.count()
    return rounded(reach(s, d, "OU", then=reduce.dispersal_reduction(n)).drop("series"))


# ---- structure -------------------------------------------------------------

TRIPLETS = DEG + ", rec as (select a.src as id, count(*) as k from e a join e b on a.src=b.dst and a.dst=b.src group by 1), tp as (select d.id, out_deg*(out_deg-1) as out_t, in_deg*(in_deg-1) as in_t, out_deg*in_deg-coalesce(k,0) as cycle_t, out_deg*in_deg-coalesce(k,0) as mid_t from deg d left join rec on d.id=rec.id)"


@query("triplets", with_graph("part", "select id, " + ", ".join(f"cast({k}_t as bigint) as {k}_t" for k in ("out", "in", "cycle", "mid")) + " from tp", TRIPLETS))
def _(s, d):
    return rounded(structure.triplets(part(s, d)))


ENDS = {"out": ("x.src", "x.dst", "z.src", "z.dst"), "cycle": ("x.src", "x.dst", "z.dst", "z.src"), "mid": ("x.dst", "x.src", "z.src", "z.dst"), "in": ("x.dst", "x.src", "z.dst", "z.src")}


def tri_sql(kind: str, e: str = "e", value: str = "count(*)") -> str:
    v, a, v2, b = ENDS[kind]
    return f"select {v} as id, {value} as tri from {e} x join {e} y on y.src={a} join {e} z on {v2}={v} and {b}=y.dst where y.dst<>{v} group by 1"


for _k in ENDS:

    @query(f"triangles_{_k}", with_graph("part", f"select id, cast(tri as bigint) as tri from ({tri_sql(_k)})"))
    def _(s, d, k=_k):
        return structure.triangles(part(s, d), k)


LCC = ", ".join(f"round(coalesce({k}.tri,0)/greatest({k}_t::double,1e-6),6) as {k}_lcc" for k in ("out", "in", "cycle", "mid"))
LCC_JOIN = " ".join(f'left join ({{{k}}}) {k if k != "in" else chr(34) + "in" + chr(34)} on tp.id={k if k != "in" else chr(34) + "in" + chr(34)}.id' for k in ("out", "in", "cycle", "mid"))
LCC = LCC.replace("(in.tri", '("in".tri')


@query("lcc_directed", with_graph("part", f"select tp.id, {LCC} from tp " + LCC_JOIN.format(**{"out": tri_sql("out"), "in": tri_sql("in"), "cycle": tri_sql("cycle"), "mid": tri_sql("mid")}), TRIPLETS))
def _(s, d):
    return rounded(structure.clustering(part(s, d)))


@query("lcc_weighted", with_graph("part", f"select tp.id, {LCC} from tp " + LCC_JOIN.format(**{k: tri_sql(k, "en", "sum(cbrt(x.w*y.w*z.w))") for k in ENDS}), TRIPLETS + ", en as (select src,dst,w/(select max(w) from e) as w from e)"))
def _(s, d):
    return rounded(structure.clustering(part(s, d), True))


UND = "u as (select src,dst,avg(w) as w from (select src,dst,w from e union all select dst,src,w from e) group by 1,2), ud as (select n.id, coalesce(c,0) as dg from n left join (select src, count(*) as c from u group by 1) t on n.id=t.src)"


@query("lcc_undirected", with_graph("part", f"select ud.id, round(coalesce(tri,0)/greatest((dg*(dg-1))::double,1e-6),6) as lcc from ud left join ({tri_sql('out', 'u')}) t on ud.id=t.id", UND))
def _(s, d):
    return rounded(structure.undirected_clustering(part(s, d)))


@query("global_clustering", with_graph("part", f"select round((select sum(tri) from ({tri_sql('out', 'u')}))/(select sum(dg*(dg-1)) from ud),6) as clustering", UND))
def _(s, d):
    return rounded(structure.global_clustering(part(s, d)))


EGO = "ego as (select id, id as m from n union select src,dst from e union select dst,src from e), tch as (select g.id, e.src, e.dst, any_value(w) as w, max((m=e.src)::int) as s, max((m=e.dst)::int) as d from ego g join e on m=e.src or m=e.dst group by 1,2,3), eg as (select id, " + ", ".join(f"count(*) filter (where {c}) as n_{k}, coalesce(sum(w) filter (where {c}),0.0) as w_{k}" for k, c in {"edges": "s=1 and d=1", "src": "s=1 and d=0", "dst": "s=0 and d=1"}.items()) + " from tch group by 1)"
EGO = EGO.replace("from ego g join e on m=e.src or m=e.dst group", "from (select g.id, g.m, src, dst, w from ego g join e on m=src union all select g.id, g.m, src, dst, w from ego g join e on m=dst) g2 join lateral (select 1) on true group").replace("g.id, e.src, e.dst, any_value(w) as w, max((m=e.src)::int) as s, max((m=e.dst)::int) as d", "id, src, dst, any_value(w) as w, max((m=src)::int) as s, max((m=dst)::int) as d").replace(" g2 join lateral (select 1) on true", " g2")


@query("egonet_edges", with_graph("part", "select n.id, " + ", ".join(f"cast(coalesce(n_{k},0) as bigint) as n_{k}" for k in ("edges", "src", "dst")) + " from n left join eg on n.id=eg.id", EGO))
def _(s, d):
    return structure.egonets(part(s, d)).select("id", "n_edges", "n_src", "n_dst")


@query("egonet_weighted", with_graph("part", "select n.id, " + ", ".join(f"round(coalesce(w_{k},0.0),6) as w_{k}" for k in ("edges", "src", "dst")) + " from n left join eg on n.id=eg.id", EGO))
def _(s, d):
    return rounded(structure.egonets(part(s, d)).select("id", "w_edges", "w_src", "w_dst"))


def hom_sql(e: str) -> str:
    return f"(select avg(s/t) from (select src, sum(w) as t, sum(case when a.label=b.label then w else 0 end) as s from {e} join n a on src=a.id join n b on dst=b.id group by 1) where t<>0)"


TWO = lambda a, b: f"(select x.src as src, y.dst as dst, sum(x.w*y.w) as w from {a} x join {b} y on x.dst=y.src group by 1,2)"


@query("homophily_undirected", with_graph("nation", f"select round({hom_sql('eu')},6) as h", EU))
def _(s, d):
    g = T.nation_graph(s, d)
    return rounded(structure.node_homophily(G.symmetrize(g.edges, "sum"), g.nodes))


_SUITE = {"h_u": "eu", "h_u2": TWO("eu", "eu"), "h_d": "e", "h_d_t": "t", "h_d_aa": TWO("e", "e"), "h_d_a_a_t": TWO("e", "t"), "h_d_a_t_a": TWO("t", "e"), "h_d_a_t_a_t": TWO("t", "t")}


@query(
    "homophily_suite",
    with_graph(
        "part",
        "select " + ", ".join(f"round({k},6) as {k}" for k in _SUITE) + ", round(greatest(h_u,h_u2),6) as h_u_eff, round(greatest(h_d,h_d_t,h_d_aa,h_d_a_a_t,h_d_a_t_a,h_d_a_t_a_t),6) as h_d_eff, round(greatest(h_d,h_d_t,h_d_aa,h_d_a_a_t,h_d_a_t_a,h_d_a_t_a_t)/greatest(h_u,h_u2),6) as h_eff_gain from suite",
        EU + ", t as (select dst as src, src as dst, w from e), suite as (select " + ", ".join(f"{hom_sql(v)} as {k}" for k, v in _SUITE.items()) + ")",
    ),
)
def _(s, d):
    return rounded(structure.homophily_suite(part(s, d)))


@query("compatibility_matrix", with_graph("nation", "select y_src, y_dst, round(w/sum(w) over (partition by y_src),6) as share from (select a.label::bigint as y_src, b.label::bigint as y_dst, sum(w) as w from e join n a on src=a.id join n b on dst=b.id group by 1,2)"))
def _(s, d):
    g = T.nation_graph(s, d)
    return rounded(structure.compatibility(g.edges, g.nodes))


NEAR = "nb as (select src,dst from e union select dst,src from e)"


@query("onehop_homophily", with_graph("part", "select n.id, round(coalesce(h,0.0),6) as h1 from n left join (select src, avg((a.label=b.label)::int) as h from nb join n a on src=a.id join n b on dst=b.id group by 1) t on n.id=src", NEAR))
def _(s, d):
    return rounded(structure.one_hop_homophily(part(s, d)))


@query("twohop_homophily", with_graph("user", "select n.id, case when mind=1 then 'NaN'::double else round(coalesce(h,0.0),6) end as h2 from n left join (select src, avg((a.label=b.label)::int) as h from far join n a on src=a.id join n b on dst=b.id group by 1) t on n.id=t.src left join (select nb.src, min(c) as mind from nb join (select src, count(*) as c from nb group by 1) q on nb.dst=q.src group by 1) m on n.id=m.src", NEAR + ", far as (select distinct x.src as src, y.dst as dst from nb x join nb y on x.dst=y.src where x.src<>y.dst and (x.src,y.dst) not in (select src,dst from nb))"))
def _(s, d):
    g = T.user_graph(s, d)
    g = G.Graph(g.edges, g.nodes.withColumn("label", F.col("id") % 3))
    return structure.two_hop_homophily(g).withColumn("h2", F.round("h2", 6))


for _n, _f, _dd in (("standardize_sample", "stddev_samp", 1), ("standardize_pop", "stddev_pop", 0)):

    @query(_n, with_graph("part", "select id, " + ", ".join(f"round(({c}-avg({c}) over ())/{_f}({c}) over (),6)+0.0 as {c}" for c in ("p_size", "p_retailprice")) + " from n"))
    def _(s, d, dd=_dd):
        return rounded(structure.standardize(part(s, d).nodes, ["p_size", "p_retailprice"], dd))


@query("edf_cdf", with_graph("part", "select v, round(sum(c) over (order by v rows unbounded preceding)/sum(c) over (),6) as cdf from (select w as v, count(*) as c from e group by 1)"))
def _(s, d):
    return rounded(sample.empirical_cdf(part(s, d).edges, "w"))


@query("triangle_total", with_graph("part", "select cast(sum(tri) as bigint) as total from (" + " union all ".join(tri_sql(k) for k in ENDS) + ")"))
def _(s, d):
    return structure.triangle_total(part(s, d))


from . import registry_more  # noqa: E402  the rest registers itself here

registry_more.register(query)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy and coverage of switch-walk reachability."""
    return dispersal(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
