"""Queries of evaluation, sampling, fixpoints, layers and learned parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import graph as G
from ..operators import evaluate, iterate, layers, learn, linalg, sample, walk
from ..sources import tables as T
from .oracle import with_graph

DIST = "sqrt(list_sum([(x - y) * (x - y) for x, y in list_zip(a, b)]))"


def register(query) -> None:
    from .registry import DEG, EU, POISSON, chosen, part, reach, reach_sql, rounded

    def vectors(s, d):
        return T.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("emb"), "label")

    emb = "v as (select vec_id as id, embedding::double[] as x, label from embeddings)"
    gap = "sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1]-z[2])*(z[1]-z[2]))))"
    near_sql = f"nn as (select a.id, b.id as other, row_number() over (partition by a.id order by {gap}, b.id) as rank, {gap} as dist from v a join v b on a.id<>b.id where a.id % 20 = 0 qualify rank <= 10)"

    @query("knn_embeddings", f"with {emb}, {near_sql} select id, other, round(dist,6) as dist, cast(rank as bigint) as rank from nn where rank <= 5")
    def _(s, d):
        v = vectors(s, d)
        return rounded(evaluate.nearest(v.where("id % 20 = 0"), v, 5))

    @query("alignment_topk", f"with {emb}, {near_sql} select " + ", ".join(f"round(avg(case when rank <= {k} then 1.0 else 0.0 end),6) as k_at_{k}" for k in (1, 5, 10)) + " from (select id, (id*7+3)%500 as other from v where id%20=0) t left join nn using (id, other)")
    def _(s, d):
        v = vectors(s, d)
        truth = v.where("id % 20 = 0").select("id", ((F.col("id") * 7 + 3) % 500).alias("other"))
        return rounded(evaluate.alignment_scores(evaluate.nearest(v.where("id % 20 = 0"), v, 10), truth))

    @query("knn_vote", f"with {emb}, {near_sql} select id, label::bigint as label from (select nn.id, v.label, row_number() over (partition by nn.id order by count(*) desc, v.label) as k from nn join v on v.id=nn.other where rank<=5 group by nn.id, v.label) where k=1")
    def _(s, d):
        from pyspark.sql import Window

        v = vectors(s, d)
        votes = evaluate.nearest(v.where("id % 20 = 0"), v, 5).join(v.select(F.col("id").alias("other"), "label"), "other").groupBy("id", "label").count()
        w = Window.partitionBy("id").orderBy(F.col("count").desc(), "label")
        return rounded(votes.withColumn("k", F.row_number().over(w)).where("k = 1").select("id", "label"))

    pairs = "pr as (select p_size%5 as label, (p_partkey*7)%5 as pred from part)"

    @query("confusion_f1", f"with {pairs}, y as (select label as k from pr union select pred from pr), f as (select k, 2.0*count(*) filter (where label=k and pred=k)/(count(*) filter (where label=k)+count(*) filter (where pred=k)) as f1 from y, pr group by k) select round((select avg((label=pred)::int) from pr),6) as accuracy, round((select avg(f1) from f),6) as macro_f1, round((select avg((label=pred)::int) from pr),6) as micro_f1")
    def _(s, d):
        p = T.table(s, d, "part").select((F.col("p_size") % 5).cast("long").alias("label"), (F.col("p_partkey") * 7 % 5).alias("pred"))
        return rounded(evaluate.multiclass_scores(p))

    @query("binary_scores", "with b as (select quality as y, toxic as p from labels) select round(avg((y=p)::int),6) as accuracy, round(count(*) filter (where y=1 and p=1)*1.0/count(*) filter (where p=1),6) as precision, round(count(*) filter (where y=1 and p=1)*1.0/count(*) filter (where y=1),6) as recall, round(2.0*count(*) filter (where y=1 and p=1)/(2*count(*) filter (where y=1 and p=1)+count(*) filter (where y=0 and p=1)+count(*) filter (where y=1 and p=0)),6) as f1 from b")
    def _(s, d):
        return rounded(evaluate.binary_scores(T.table(s, d, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("pred"))))

    @query("binary_auc", "with s as (select quality as y, doc_id*37%101 as sc from labels), r as (select y, avg(k) over (partition by sc) as k from (select y, sc, row_number() over (order by sc) as k from s)) select round((sum(k) filter (where y=1) - sum(y)*(sum(y)+1)/2.0)/(sum(y)*(count(*)-sum(y))),6) as auc from r")
    def _(s, d):
        return rounded(evaluate.auc(T.table(s, d, "labels").select(F.col("quality").alias("label"), (F.col("doc_id") * 37 % 101).alias("score"))))

    @query("ndcg", with_graph("part", "select round((select sum(in_deg/log2(k+1.0)) from (select in_deg, row_number() over (order by out_deg desc, id) as k from deg) where k<=50)/(select sum(in_deg/log2(k+1.0)) from (select in_deg, row_number() over (order by in_deg desc, id) as k from deg) where k<=50),6) as ndcg", DEG))
    def _(s, d):
        from ..operators.structure import degrees

        g = degrees(part(s, d))
        return rounded(evaluate.ndcg(g.select("id", F.col("out_deg").cast("double").alias("score"), F.col("in_deg").cast("double").alias("rel")), 50))

    @query("spearman", with_graph("part", "select round(corr(a,b),6) as rho from (select avg(x) over (partition by out_deg) as a, avg(y) over (partition by in_deg) as b from (select out_deg, in_deg, row_number() over (order by out_deg) as x, row_number() over (order by in_deg) as y from deg))", DEG))
    def _(s, d):
        from ..operators.structure import degrees

        return rounded(evaluate.spearman(degrees(part(s, d)), "out_deg", "in_deg"))

    @query("graph_reconstruction", with_graph("part", "select round(sum(h)*1.0/sum(c),6) as micro, round(avg(h*1.0/c),6) as macro from (select source, count(*) as c, sum((exists (select 1 from e where src=source and dst=node))::int) as h from (select *, row_number() over (partition by source order by r desc, node) as k from (select source,node,round(r,9) as r from r) where source<>node) where k<=5 group by 1)", reach_sql("O", POISSON)))
    def _(s, d):
        edges = part(s, d).edges
        return rounded(evaluate.precision_of(reach(s, d, then=lambda r: evaluate.reconstruction_counts(r.withColumn("r", F.round("r", 9)), edges, 5))))

    dot = "list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1]*z[2]))"

    @query("link_scores", f"with {emb} select a.id as src, b.id as dst, round(1/(1+exp(-{dot})),6) as score from v a join v b on b.id=a.id+1")
    def _(s, d):
        v = vectors(s, d)
        p = v.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
        return rounded(evaluate.link_scores(p, v, v))

    @query("edge_combiners", f"with {emb} select src, dst, (j-1)::bigint as j, round((p+q)/2,6) as average, round(p*q,6)+0.0 as hadamard, round(abs(p-q),6) as l1, round((p-q)*(p-q),6) as l2 from (select a.id as src, b.id as dst, j, a.x[j] as p, b.x[j] as q from v a join v b on b.id=a.id+1, range(1,65) t(j))")
    def _(s, d):
        v = vectors(s, d)
        return rounded(evaluate.combine_edges(v.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), v)).withColumn("average", F.round("average", 6) + 0.0)

    h = lambda a, b, seed: f"(({a})*7919+({b})*104729+{seed * 31337})%1000003"
    noise = f"rk as (select id, row_number() over (order by id)-1 as k from n), dr as (select {h('i', '1', 7)}%(select count(*) from n) as a, ({h('i', '2', 8)}*31+i)%(select count(*) from n) as b from range(0,2000) t(i)), cand as (select distinct x.id as src, y.id as dst from dr join rk x on a=x.k join rk y on b=y.k where x.id<>y.id)"

    @query("noise_add", with_graph("part", f"select src, dst, 1.0::double as w from cand where (src,dst) not in (select src,dst from e) order by {h('src', 'dst', 7)}, src, dst limit 1000", noise))
    def _(s, d):
        return sample.add_noise(part(s, d), 1000)

    @query("noise_remove", with_graph("part", f"select src, dst, round(w,6) as w from (select *, row_number() over (order by {h('src', 'dst', 7)}, src, dst) as k from e) where k > 4000"))
    def _(s, d):
        return rounded(sample.remove_edges(part(s, d), 4000))

    @query("drop_edges", with_graph("part", f"select src, dst, round(w,6) as w from e where {h('src', 'dst', 11)} >= 200000"))
    def _(s, d):
        return rounded(sample.drop_edges(part(s, d).edges, 200000 / 1_000_003))

    @query("kfold_split", with_graph("part", f"select id, label, cast((row_number() over (partition by label order by {h('id', 'id', 3)}, id)-1)%5 as bigint) as fold from n"))
    def _(s, d):
        return rounded(sample.kfold(part(s, d).nodes.select("id", "label"), 5, strata="label"))

    walk_sql = f"nx as (select src, list(dst order by dst) as nb from e group by 1), w0 as (select id as walk_id, [id] as walk from n)" + "".join(f", w{k} as (select walk_id, case when nb is not null and len(walk)={k} then list_append(walk, nb[{h('walk_id', 'walk[-1]', 5 + k)}%len(nb)+1]) else walk end as walk from w{k - 1} left join nx on src=walk[-1])" for k in range(1, 6))

    @query("walk_windows", with_graph("part", "select walk_id, start::bigint as start, array_to_string(walk[start+1:start+3], ' ') as nodes from w5, range(0,4) t(start) where start+3 <= len(walk)", walk_sql))
    def _(s, d):
        g = part(s, d)
        w = sample.context_windows(sample.random_walks(g, g.nodes.select(F.col("id").alias("walk_id"), "id"), 5), 3)
        return w.select("walk_id", F.col("start").cast("long"), F.array_join(F.col("window").cast("array<string>"), " ").alias("nodes"))

    # ---- fixpoints

    near_edges = "nb as materialized (select src,dst from e union select dst,src from e)"
    rounds = 12  # depths that the statements follow; the search itself goes on until nothing is new

    def bfs(edges: str) -> str:
        """CTEs that end in ds(source, node, d)."""
        ctes = ["f0 as materialized (select id as source, id as node, 0 as d from n where id%20=0)", "s0 as materialized (select * from f0)"]
        for k in range(1, rounds + 1):
            ctes.append(f"f{k} as materialized (select distinct source, dst as node, {k} as d from f{k - 1} join {edges} on node=src where (source, dst) not in (select source, node from s{k - 1}))")
            ctes.append(f"s{k} as materialized (select * from s{k - 1} union all select * from f{k})")
        return ", ".join([*ctes, f"ds as (select * from s{rounds})"])

    @query("bfs_distance", with_graph("part", "select source, node, d::bigint as d from ds", near_edges + ", " + bfs("nb")))
    def _(s, d):
        g = part(s, d)
        return rounded(iterate.distances(g, chosen(g.nodes)))

    @query("avg_path_length", with_graph("part", "select round(sum(s)*1.0/sum(c),6) as mean, round(stddev_pop(a)/sqrt(count(*)),6) as error from (select source, avg(d) as a, sum(d) as s, count(*) as c from ds group by 1)", near_edges + ", " + bfs("nb")))
    def _(s, d):
        g = part(s, d)
        return rounded(iterate.average_path_length(g, chosen(g.nodes)))

    @query("harmonic_closeness", with_graph("part", "select source as id, round(sum(case when d>0 then 1.0/d else 0 end)/((select count(*) from n)-1),6) as closeness from ds group by 1", bfs("e")))
    def _(s, d):
        g = part(s, d)
        return rounded(iterate.harmonic_closeness(g, chosen(g.nodes), g.nodes.count()))

    lowest = "l0 as (select id, id as c from n)" + "".join(f", l{k} as materialized (select id, min(c) as c from (select id, c from l{k - 1} union all select dst, c from l{k - 1} join nb on id=src) group by 1)" for k in range(1, rounds + 1))

    @query("weak_components", with_graph("part", f"select id, c as component from l{rounds}", near_edges + ", " + lowest))
    def _(s, d):
        return iterate.weak_components(part(s, d))

    reached = "rc as (select id as a, id as b from n union select a, dst from rc join e on b=src)"

    @query("strong_components", with_graph("user", "select x.a as id, min(x.b) as component from rc x join rc y on x.a=y.b and x.b=y.a group by 1", reached).replace("with ", "with recursive ", 1))
    def _(s, d):
        return iterate.strong_components(T.user_graph(s, d))

    rank = "tt as (select src, sum(w) as t from e group by 1), pp as (select e.src, dst, w/t as p from e join tt on e.src=tt.src), nn as (select count(*)::double as k from n), r0 as (select id, 1.0/k as r from n, nn)" + "".join(f", r{i} as (select n.id, (1-0.85)/k + 0.85*(coalesce(g,0)+(select coalesce(sum(r),0) from r{i - 1} where id not in (select src from tt))/k) as r from n cross join nn left join (select dst, sum(r*p) as g from r{i - 1} join pp on id=src group by 1) q on n.id=q.dst)" for i in range(1, 11))

    @query("pagerank", with_graph("part", "select id, round(r*1000,6) as rank from r10", rank))
    def _(s, d):
        g = part(s, d)
        return rounded(iterate.pagerank(g, g.nodes.count()).withColumn("rank", F.col("rank") * 1000))

    hub = "h0 as (select id, 1.0::double as h from n)" + "".join(f", ra{i} as materialized (select dst as id, sum(h*w) as a from h{i - 1} join e on id=src group by 1), a{i} as materialized (select id, a/(select sum(a) from ra{i}) as a from ra{i}), rh{i} as materialized (select src as id, sum(a*w) as h from a{i} join e on id=dst group by 1), h{i} as materialized (select id, h/(select sum(h) from rh{i}) as h from rh{i})" for i in range(1, 9))

    @query("hits", with_graph("cs", "select n.id, round(coalesce(h,0)*1000,6) as hub, round(coalesce(a,0)*1000,6) as authority from n left join h8 on n.id=h8.id left join a8 on n.id=a8.id", hub))
    def _(s, d):
        return rounded(iterate.hits(T.customer_supplier_graph(s, d)).select("id", (F.col("hub") * 1000).alias("hub"), (F.col("authority") * 1000).alias("authority")))

    power = "x0 as (select id, 1.0::double as x from n)" + "".join(f", y{i} as materialized (select src as id, sum(w*x) as x from e join x{i - 1} on dst=id group by 1), x{i} as materialized (select id, x/(select sqrt(sum(x*x)) from y{i}) as x from y{i})" for i in range(1, 11))

    @query("spectral_radius", with_graph("supp", "select round(sqrt(sum(x*x)),6) as rho from y10", power))
    def _(s, d):
        return rounded(iterate.spectral_radius(T.supplier_graph(s, d)))

    katz = "k0 as (select id as source, id as node, 1.0::double as r from n where id%20=0)" + "".join(f", k{i} as (select source, dst as node, sum(r*w)*0.001 as r from k{i - 1} join e on node=src group by 1,2)" for i in range(1, 5))

    @query("katz_truncated", with_graph("part", "select source, node, round(sum(r),6) as katz from (" + " union all ".join(f"select * from k{i}" for i in range(1, 5)) + ") group by 1,2", katz))
    def _(s, d):
        g = part(s, d)
        return rounded(iterate.katz(g, chosen(g.nodes), 0.001))

    # ---- layers

    @query("sage_mean_layer", with_graph("part", "select n.id, round(greatest(0.0, 0.5*p_size+0.5*coalesce(m,0)),6) as p_size from n left join (select dst, avg(p_size) as m from e join n on src=id group by 1) t on n.id=t.dst"))
    def _(s, d):
        return rounded(layers.sage_mean(part(s, d), ["p_size"]))

    loops = "bl as (select src,dst from e union select dst,src from e union select id,id from n), bd as (select src as v, count(*) as c from bl group by 1)"

    @query("gcn_layer", with_graph("part", "select dst as id, round(sum(p_size/sqrt(a.c*b.c)),6) as p_size from bl join bd a on src=a.v join bd b on dst=b.v join n on src=id group by 1", loops))
    def _(s, d):
        return rounded(layers.gcn(part(s, d), ["p_size"]))

    @query("gat_attention", with_graph("part", "select id, round(sum(exp(s-top)*xs)/sum(exp(s-top)),6) as h from (select dst as id, xs, s, max(s) over (partition by dst) as top from (select dst, a.p_size::double as xs, case when 0.3*a.p_size+0.2*b.p_size>0 then 0.3*a.p_size+0.2*b.p_size else 0.2*(0.3*a.p_size+0.2*b.p_size) end as s from e join n a on src=a.id join n b on dst=b.id)) group by 1"))
    def _(s, d):
        return rounded(layers.gat(part(s, d), "p_size"))

    @query("direction_mix", with_graph("part", "select n.id, round(0.5*coalesce(f,0)+0.5*coalesce(b,0),6) as p_size from n left join (select dst as id, avg(p_size) as f from e join n on src=id group by 1) x on n.id=x.id left join (select src as id, avg(p_size) as b from e join n on dst=id group by 1) y on n.id=y.id"))
    def _(s, d):
        return rounded(layers.direction_mix(part(s, d), ["p_size"]))

    # ---- numeric and learned parts: no statement, their tests hold them to numpy

    @query("filter_betainc")
    def _(s, d):
        g = part(s, d)
        return rounded(walk.reachability(g, g.nodes.select("id"), "O", [POISSON], each=linalg.betainc(0.5, 2.0)).drop("series"))

    @query("betweenness")
    def _(s, d):
        g = part(s, d)
        return rounded(learn.betweenness(g, g.nodes.select("id")))

    @query("gram_pca")
    def _(s, d):
        return linalg.project(vectors(s, d), 8)

    @query("svd_singular_values")
    def _(s, d):
        return s.createDataFrame([(k, v) for k, v in enumerate(linalg.singular_values(vectors(s, d), 8))], "k int, value double")

    @query("rsvd_embedding")
    def _(s, d):
        g = T.supplier_graph(s, d)
        return s.createDataFrame(list(enumerate(linalg.walk_singular_values(g, "O", POISSON, 6))), "k int, value double")

    @query("walk_embedding")
    def _(s, d):
        return linalg.walk_embedding(part(s, d), "OU", POISSON, 8)

    @query("kmeans_auto_k")
    def _(s, d):
        return learn.kmeans_auto(vectors(s, d))

    @query("logreg_cv")
    def _(s, d):
        return learn.cross_validated(vectors(s, d))

    @query("sgns_walks")
    def _(s, d):
        g = T.user_graph(s, d)
        w = sample.context_windows(sample.random_walks(g, g.nodes.select(F.col("id").alias("walk_id"), "id"), 10), 4)
        return learn.skip_gram(w, g.nodes)
