"""DuckDB text of the derived graphs: CTEs e(src, dst, w) and n(id, ...)."""

from __future__ import annotations


def _chain(raw: str) -> str:
    return f"e_raw as ({raw}), e as (select src, dst, sum(q) as w from e_raw where dst is not null and src <> dst group by src, dst)"


_ORDER = "partition by l_orderkey order by l_linenumber, l_suppkey, l_extendedprice, l_partkey"

GRAPHS = {
    "part": _chain(f"select l_partkey as src, lead(l_partkey) over ({_ORDER}) as dst, cast(l_quantity as double) as q from lineitem")
    + ", n as (select p_partkey as id, p_size, p_retailprice, p_brand as label from part)",
    "supp": _chain(f"select l_suppkey as src, lead(l_suppkey) over ({_ORDER}) as dst, cast(l_quantity as double) as q from lineitem") + ", n as (select s_suppkey as id, s_nationkey as label from supplier)",
    "user": _chain("select user_id as src, lead(user_id) over (partition by event_type order by ts, event_id) as dst, 1.0::double as q from events") + ", n as (select distinct user_id as id, user_id % 3 as label from events)",
    "nation": """e as (select cast(s_nationkey as bigint) as src, cast(c_nationkey as bigint) as dst, cast(sum(cast(round(l_extendedprice*100) as bigint)) as bigint)/100.0 as w
        from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey join supplier on l_suppkey=s_suppkey where s_nationkey<>c_nationkey group by 1,2),
        n as (select cast(n_nationkey as bigint) as id, n_regionkey as label from nation)""",
    "cs": """e as (select o_custkey as src, l_suppkey+1000000 as dst, sum(l_quantity) as w from lineitem join orders on l_orderkey=o_orderkey group by 1,2),
        n as (select c_custkey as id from customer union all select s_suppkey+1000000 from supplier)""",
}


def with_graph(name: str, select: str, more: str = "") -> str:
    return f"with {GRAPHS[name]}{', ' + more if more else ''} {select}"
