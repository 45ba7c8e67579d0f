"""Registered queries over the test tables, and the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspark.functions import rational as R
from arcspark.functions.geometry import Segment, line_of, on_segment, slope
from arcspark.functions.semiring import MAX_CAPACITY_PATH, MOST_RELIABLE_PATH
from arcspark.graph import Graph
from arcspark.operators import flow, knapsack, paths, sampling, traverse, trees, views
from arcspark.operators.components import component_labels
from arcspark.operators.segments import intersections
from arcspark.sources import builders, datasets, dot
from arcspark.sources.datasets import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_HANDOFF = """rk as (select user_id, lead(user_id) over (order by ts, event_id) as dst, 1 + event_id % 9 as w from events),
h as (select user_id as src, dst, w::bigint as w from rk where dst is not null),
a as (select row_number() over (order by src, dst, w) - 1 as arc_id, src, dst, w from h),
v as (select distinct user_id as id from events where user_id in (select src from h) or user_id in (select dst from h))"""
_PAIRS = f"""{_HANDOFF}, sp as (select distinct src, dst from h), sv as (select distinct user_id as id from events)"""
_CHAIN = """c as (select event_id as src, lead(event_id) over (partition by user_id order by ts, event_id) as dst from events)"""
_TRADE = """t as (select c_nationkey::bigint as src, s_nationkey::bigint as dst, count(*) as w from customer join orders on c_custkey = o_custkey
join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey group by 1, 2)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL that gives the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _least_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").agg(F.min("user_id").cast("long").alias("id"))


# access and construction


@query(f"with {_HANDOFF} select arc_id, src, dst from a")
def arcs_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.handoff(spark, sf_dir).arcs_entries()


@query(f"with {_HANDOFF} select id, (select count(*) from a where src = id) as out_degree from v")
def out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.handoff(spark, sf_dir).out_degree()


@query(f"with {_HANDOFF} select id, (select count(*) from a where dst = id) as in_degree from v")
def in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.handoff(spark, sf_dir).in_degree()


@query(f"with {_HANDOFF} select src as id, dst as neighbor from a")
def out_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.handoff(spark, sf_dir).out_neighbors()


@query(f"with {_HANDOFF} select dst as id, src as neighbor from a")
def in_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.handoff(spark, sf_dir).in_neighbors()


@query(f"with {_HANDOFF} select arc_id, src, dst, w from a where src = (select min(user_id) from events)")
def out_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.handoff(spark, sf_dir).out_arcs(_least_user(spark, sf_dir))


@query(f"with {_HANDOFF} select (select count(*) from v) as n_vertices, (select count(*) from a) as n_arcs")
def graph_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.handoff(spark, sf_dir)
    return g.vertices.agg(F.count("*").alias("n_vertices")).join(F.broadcast(g.arcs.agg(F.count("*").alias("n_arcs"))))


@query(f"with {_HANDOFF} select arc_id as edge_id, least(src, dst) as u, greatest(src, dst) as v from a")
def edge_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.undirect(datasets.handoff(spark, sf_dir)).edge_endpoints()


@query(f"with {_HANDOFF} select src as id, arc_id as edge_id, dst as other from a union all select dst, arc_id, src from a")
def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.undirect(datasets.handoff(spark, sf_dir)).incidence()


@query(f"with {_HANDOFF}, i as (select src as id from a union all select dst from a) select id, count(*) as degree from i group by id")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.undirect(datasets.handoff(spark, sf_dir)).degree()


@query(f"""with {_HANDOFF}, o as (select id, row_number() over (order by id desc) - 1 as n from v)
select row_number() over (order by s.n, a.arc_id) - 1 as arc_id, s.n as src, d.n as dst, a.arc_id as old_arc_id, a.w as w
from a join o s on a.src = s.id join o d on a.dst = d.id""")
def compact_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.compacted(datasets.handoff(spark, sf_dir), F.desc("id")).arcs


@query("""with n as (select unnest(range((select count(*) from nation))) as i) select row_number() over (order by a.i, b.i) - 1 as arc_id, a.i as src, b.i as dst from n a, n b where a.i <> b.i""")
def complete_digraph_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete graph over as many vertices as there are nations."""
    return builders.complete_digraph(spark, read(spark, sf_dir, "nation").count()).arcs


@query("""with n as (select unnest(range((select count(*) from supplier))) as i), p as (select a.i as src, b.i as dst from n a, n b where a.i <> b.i)
select row_number() over (order by src, dst) - 1 as arc_id, src, dst from p
where ('0x' || substr(md5(src::varchar || ',' || dst::varchar), 1, 8))::bigint < 429496730""")
def erdos_renyi_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random graph over as many vertices as there are suppliers."""
    return builders.erdos_renyi_md5(spark, read(spark, sf_dir, "supplier").count(), 429496730).arcs


@query("""with u as (select distinct user_id as id from events) select id, id % 7 as grp, 0 as mark from u""")
def vertex_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.whole_handoff(spark, sf_dir).with_vertex_map("grp", F.col("id") % 7).with_vertex_map("mark", 0)
    return g.vertices


@query(f"""with {_TRADE} select 2 as section, row_number() over (order by src, dst) - 1 as pos,
'  ' || src || ' -> ' || dst || ' [label="w=\\"' || w || '\\""];' as line from t
union all select 1, n_nationkey, '  ' || n_nationkey || ';' from nation union all select 0, 0, 'digraph {{' union all select 3, 0, '}}'""")
def dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.trade(spark, sf_dir).with_arc_map("label", F.concat(F.lit('w="'), F.col("w").cast("string"), F.lit('"')))
    return dot.dot_lines(Graph(g.vertices, g.arcs.drop("w")))


# updates


@query(f"with {_PAIRS} select id, 0 as fresh from sv union all select id + 1000000, 1 from sv where id % 10 = 0")
def add_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.whole_handoff(spark, sf_dir).with_vertex_map("fresh", 0)
    new = g.vertices.where("id % 10 = 0").select((F.col("id") + 1000000).alias("id"), F.lit(1).alias("fresh"))
    return g.add_vertices(new).vertices


@query(f"with {_HANDOFF} select arc_id, src, dst, w from a where src % 3 <> 0 and dst % 3 <> 0")
def remove_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.handoff(spark, sf_dir)
    return g.remove_vertices(g.vertices.where("id % 3 = 0")).arcs


@query(f"""with {_HANDOFF}, n as (select dst as src, src as dst, w + 100 as w from a where arc_id % 5 = 0), m as (select max(arc_id) + 1 as f from a)
select arc_id, src, dst, w from a union all select f + row_number() over (order by src, dst, w) - 1, src, dst, w from n, m""")
def add_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.handoff(spark, sf_dir)
    new = g.arcs.where("arc_id % 5 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("w") + 100).alias("w"))
    return g.add_arcs(new).arcs.select("arc_id", "src", "dst", "w")


@query(f"with {_HANDOFF} select arc_id, src, dst, w from a where arc_id % 4 <> 1")
def remove_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.handoff(spark, sf_dir)
    return g.remove_arcs(g.arcs.where("arc_id % 4 = 1")).arcs


@query(f"with {_HANDOFF} select arc_id, src, case when arc_id % 6 = 0 then src else dst end as dst, w from a")
def repoint_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.handoff(spark, sf_dir)
    changes = g.arcs.where("arc_id % 6 = 0").select("arc_id", F.lit(None).cast("long").alias("src"), F.col("src").alias("dst"))
    return g.repoint(changes).arcs


@query(f"with {_HANDOFF} select k as id, k in (select id from v) as valid from (select unnest(range(0, 300)) as k)")
def valid_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.handoff(spark, sf_dir).has_vertices(spark.range(300))


# views


@query(f"with {_HANDOFF} select arc_id, dst as src, src as dst, w from a")
def reverse_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (datasets.handoff(spark, sf_dir) | views.reverse).arcs


@query(f"with {_HANDOFF} select arc_id, src, dst, w from a where w > 3 and src % 2 = 0 and dst % 2 = 0")
def subgraph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (datasets.handoff(spark, sf_dir) | views.subgraph("id % 2 = 0", "w > 3")).arcs


@query(f"with {_HANDOFF} select arc_id, dst as src, src as dst, w from a where src % 5 < 2 and dst % 5 < 2")
def induced_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.handoff(spark, sf_dir)
    return (g | views.induced_subgraph(g.vertices.where("id % 5 < 2")) | views.reverse).arcs


@query(f"with {_HANDOFF} select id from v where id >= 10 and id < 60 and id % 4 <> 2")
def filter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.handoff(spark, sf_dir)
    off = g | views.set_flags(g.vertices.where("id % 4 = 2"), False)
    return views.enabled_keys(off.vertices, 10, 60)


# traversals


@query(f"""with recursive {_HANDOFF}, s as (select min(user_id) as id from events),
b(id, dist) using key (id) as (select id, 0::bigint from s union select a.dst, min(b.dist + 1) from b join a on a.src = b.id
left join recurring.b k on k.id = a.dst group by a.dst having min(b.dist + 1) < coalesce(min(k.dist), 1000000000000)) select id, dist from b""")
def bfs_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.breadth_first_search(datasets.handoff(spark, sf_dir), _least_user(spark, sf_dir)).select("id", "dist")


@query(f"""with recursive {_HANDOFF}, r(id) as (select min(user_id) from events union select h.dst from r join h on h.src = r.id)
select distinct user_id as id, user_id in (select id from r) as reached from events""")
def bfs_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.whole_handoff(spark, sf_dir)
    return traverse.reached(g, traverse.breadth_first_search(g, _least_user(spark, sf_dir)))


@query("""with e as (select r_regionkey::bigint as region, null::bigint as nation, null::bigint as customer from region
union all select n_regionkey, n_nationkey, null from nation
union all select n_regionkey, n_nationkey, c_custkey from customer join nation on c_nationkey = n_nationkey),
p as (select coalesce(customer + 1000000, nation + 1000, region) as id, row_number() over (order by region, nation nulls first, customer nulls first) - 1 as pos,
(case when nation is null then 0 when customer is null then 1 else 2 end)::bigint as depth from e) select id, pos, depth from p""")
def dfs_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.hierarchy(spark, sf_dir)
    roots = read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("id"))
    return traverse.depth_first_search(g, roots).select("id", "pos", "depth")


@query("select event_id as id, row_number() over (partition by user_id order by ts, event_id) - 1 as rank from events")
def topo_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.topological_sort(datasets.chain(spark, sf_dir)).select("id", "rank")


@query("select max(n) - 1 as critical_length from (select count(*) as n from events group by user_id)")
def critical_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.topological_sort(datasets.chain(spark, sf_dir)).agg(F.max("rank").alias("critical_length"))


@query(f"""with recursive {_PAIRS}, r(id, tree) as (select id, id from sv where id % 10 = 0 union select sp.dst, r.tree from r join sp on sp.src = r.id)
select id, min(tree) as tree from r group by id""")
def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.whole_handoff(spark, sf_dir)
    return traverse.traversal_forest(g, g.vertices.where("id % 10 = 0"))


@query(f"""with recursive {_PAIRS}, r(s, id) as (select id, id from sv union select r.s, sp.dst from r join sp on sp.src = r.id)
select a.s as id, min(a.id) as component from r a join r b on a.s = b.id and a.id = b.s group by a.s""")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.strongly_connected_components(datasets.whole_handoff(spark, sf_dir))


@query("select event_id as id, min(event_id) over (partition by user_id) as component from events")
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.weakly_connected_components(datasets.chain(spark, sf_dir))


@query("select event_id as id, min(event_id) over (partition by user_id) as component from events where user_id in (select user_id from events group by user_id having count(*) > 1)")
def union_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_labels(datasets.chain(spark, sf_dir).arcs)


# paths

_SSSP = """b(id, dist) using key (id) as ({seed} union select e.dst, {best}({plus}) from b join {arcs} e on e.src = b.id
left join recurring.b k on k.id = e.dst group by e.dst having {best}({plus}) {better} coalesce({best}(k.dist), {worst})) select id, dist from b"""


@query(f"with recursive {_HANDOFF}, " + _SSSP.format(seed="select min(user_id), 0::bigint from events", best="min", plus="b.dist + e.w", arcs="a", better="<", worst="1000000000000"))
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.shortest_paths(datasets.handoff(spark, sf_dir), "w", _least_user(spark, sf_dir))


@query(f"with recursive {_TRADE}, " + _SSSP.format(seed="select 0::bigint, 9223372036854775807", best="max", plus="least(b.dist, e.w)", arcs="t", better=">", worst="-1"))
def widest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.shortest_paths(datasets.trade(spark, sf_dir), "w", spark.range(1), MAX_CAPACITY_PATH)


@query(f"""with recursive {_TRADE}, e2 as (select src, dst, 1 / (1 << (w % 4)::bigint) as p from t), """ + _SSSP.format(seed="select 0::bigint, 1.0::double", best="max", plus="b.dist * e.p", arcs="e2", better=">", worst="-1"))
def reliable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.trade(spark, sf_dir).with_arc_map("p", F.pow(F.lit(0.5), F.col("w") % 4))
    return paths.shortest_paths(g, "p", spark.range(1), MOST_RELIABLE_PATH)


@query(f"""with {_CHAIN}, u as (select min(user_id) as u from events), o as (select event_id, row_number() over (order by ts, event_id) as k from events, u where user_id = u),
arcs as (select src, dst, row_number() over (order by src, dst) - 1 as arc_id from c where dst is not null)
select l.event_id as target, o.k - 1 as pos, arc_id from o join arcs on arcs.src = o.event_id, (select event_id from o where k = 11) l where o.k < 11""")
def path_of_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").join(F.broadcast(_least_user(spark, sf_dir).withColumnRenamed("id", "user_id")), "user_id")
    first = events.agg(F.min(F.struct("ts", "event_id")).alias("a")).select(F.col("a.event_id").alias("id"))
    g = datasets.chain(spark, sf_dir).with_arc_map("one", F.lit(1).cast("long"))
    found = paths.shortest_paths(g, "one", first, store_paths=True, max_dist=10)
    return paths.path_to(found, found.where("dist = 10").select("id"))


@query(f"with recursive {_HANDOFF}, " + _SSSP.format(seed="select min(user_id), 0::bigint from events", best="min", plus="b.dist + e.w", arcs="a", better="<", worst="1000000000000").replace("select id, dist from b", "select dist from b where id = (select max(user_id) from events)"))
def source_target_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = read(spark, sf_dir, "events").agg(F.max("user_id").cast("long").alias("id"))
    return paths.bidirectional_shortest_path(datasets.handoff(spark, sf_dir), "w", _least_user(spark, sf_dir), last)[0]


@query(f"""with recursive {_HANDOFF}, ks as (select id from v where id % 40 = 0),
b(id, kernel, dist) using key (id, kernel) as (select id, id, 0::bigint from ks union select a.dst, b.kernel, min(b.dist + a.w) from b join a on a.src = b.id
left join recurring.b k on k.id = a.dst and k.kernel = b.kernel group by a.dst, b.kernel having min(b.dist + a.w) < coalesce(min(k.dist), 1000000000000))
select id, dist, kernel from (select *, row_number() over (partition by id order by dist, kernel) as n from b) where n = 1""")
def voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.handoff(spark, sf_dir)
    return paths.network_voronoi(g, "w", g.vertices.where("id % 40 = 0"))


@query(f"""with recursive {_TRADE}, l(id, b, r) as (select 0::bigint, 0::bigint, 0::bigint union select t.dst, l.b + t.w % 7, l.r + t.w % 5 from l join t on t.src = l.id where l.b + t.w % 7 <= 144 and l.r + t.w % 5 <= 96)
select id, b as blue, r as red from (select *, min(r) over (partition by id order by b, r rows between unbounded preceding and 1 preceding) as least from l) where least is null or least > r""")
def pareto_fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fronts over all trade arcs; a label that none beats needs at most 24 arcs, which bounds the labels that SQL lists."""
    g = datasets.trade(spark, sf_dir).with_arc_map("b", F.col("w") % 7).with_arc_map("r", F.col("w") % 5)
    return paths.pareto_paths(g, "b", "r", spark.range(1))


@query("""with l as (select distinct l_orderkey % 50 as id, l_linenumber::bigint as blue, l_suppkey % 20 as red from lineitem)
select distinct x.id, x.blue, x.red, exists (select 1 from l y where y.id = x.id and y.blue <= x.blue and y.red <= x.red and (y.blue <> x.blue or y.red <> x.red)) as dominated from l x""")
def dominated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    labels = lines.select((F.col("l_orderkey") % 50).alias("id"), F.col("l_linenumber").cast("long").alias("blue"), (F.col("l_suppkey") % 20).alias("red")).distinct()
    return paths.is_dominated(labels, labels)


@query(f"""with recursive {_TRADE}, d(id, dist, colour, done) using key (id) as (select * from (values (0::bigint, 0::bigint, 0, false), (12, 0, 1, false)) union
select * from (select c.id, c.dist, c.colour, true from (select * from recurring.d where not done order by dist, colour, id limit 1) c, (select count(*) from d)
union all select x.id, x.o[1], x.o[2]::int, false from (select t.dst as id, min([c.dist + case when c.colour = 0 then t.w else t.w - t.w % 3 end, c.colour]) as o
from (select * from recurring.d where not done order by dist, colour, id limit 1) c join t on t.src = c.id where t.dst <> c.id group by t.dst) x left join recurring.d k on k.id = x.id
where k.id is null or (not k.done and x.o < [k.dist, k.colour::bigint])))
select id, dist from d where colour = 0""")
def competing(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.trade(spark, sf_dir).with_arc_map("r", F.col("w") - F.col("w") % 3)
    return paths.competing_searches(g, "w", "r", spark.range(1), spark.range(12, 13))


# trees and flows


@query(f"""with recursive {_TRADE}, e as (select row_number() over (order by src, dst, w) - 1 as edge_id, src, dst, w from t),
k as (select *, row_number() over (order by w, edge_id) as n from e where src <> dst), u as (select src, dst, n from k union all select dst, src, n from k),
m(s, id, n) using key (s, id) as (select n_nationkey::bigint, n_nationkey::bigint, 0::bigint from nation union select m.s, u.dst, min(greatest(m.n, u.n)) from m join u on u.src = m.id
left join recurring.m q on q.s = m.s and q.id = u.dst group by m.s, u.dst having min(greatest(m.n, u.n)) < coalesce(min(q.n), 1000000000000))
select edge_id, k.src, k.dst, w as cost from k join m on m.s = k.src and m.id = k.dst where m.n = k.n""")
def spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.spanning_forest(views.undirect(datasets.trade(spark, sf_dir)), "w")


def _flow_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = builders.numbered(datasets.trade_arcs(spark, sf_dir).where("src <> dst"), "arc_id", "src", "dst")
    return named.select(F.lit(1).alias("problem_id"), "arc_id", "src", "dst", F.col("w").alias("capacity"))


def _terminals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 0, 9)], "problem_id int, s long, t long")


@query()
def max_flow_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = flow.max_flow(_flow_arcs(spark, sf_dir), _terminals(spark))
    return flow.flow_value(flows, _terminals(spark)).select("problem_id", F.col("value").cast("long").alias("value"))


@query()
def min_cut_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = flow.max_flow(_flow_arcs(spark, sf_dir), _terminals(spark))
    cut = flow.minimum_cut(flows, "target").groupBy("problem_id").agg(F.sum("capacity").alias("value"))
    asked = _terminals(spark).select("problem_id")
    return asked.join(cut, "problem_id", "left").select("problem_id", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


# knapsacks and draws

_ITEMS = """it as (select p_brand as problem_id, p_partkey as item_id, floor(p_retailprice)::bigint as value, p_size::bigint as cost,
row_number() over (partition by p_brand order by p_partkey) as k from part), n as (select problem_id, max(k) as n from it group by 1)"""


@query(f"""with recursive {_ITEMS}, d(problem_id, k, c, v) as (select problem_id, 0::bigint, 0::bigint, 0::bigint from n union all
select problem_id, k, c, max(v)::bigint from (select d.problem_id, d.k + 1 as k, d.c + o.c as c, d.v + o.v as v from d join it on it.problem_id = d.problem_id and it.k = d.k + 1,
lateral (select it.cost as c, it.value as v union all select 0, 0) o where d.c + o.c <= 60) group by 1, 2, 3)
select d.problem_id, max(v) as value from d join n on n.problem_id = d.problem_id and d.k = n.n group by d.problem_id having max(v) > 0""")
def knapsack_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = datasets.knapsack_items(spark, sf_dir)
    budgets = items.select("problem_id").distinct().withColumn("budget", F.lit(60).cast("long"))
    return knapsack.knapsack(items, budgets).groupBy("problem_id").agg(F.sum("value").alias("value"))


@query(f"""with recursive {_ITEMS}, d(problem_id, c, v) using key (problem_id, c) as (select distinct problem_id, 0::bigint, 0::bigint from it union
select d.problem_id, d.c + it.cost, max(d.v + it.value)::bigint from d join it on it.problem_id = d.problem_id and d.c + it.cost <= 60
left join recurring.d k on k.problem_id = d.problem_id and k.c = d.c + it.cost group by d.problem_id, d.c + it.cost having max(d.v + it.value) > coalesce(max(k.v), -1))
select problem_id, max(v) as value from d group by problem_id having max(v) > 0""")
def unbounded_knapsack_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = datasets.knapsack_items(spark, sf_dir)
    budgets = items.select("problem_id").distinct().withColumn("budget", F.lit(60).cast("long"))
    taken = knapsack.knapsack(items, budgets, repeat=True)
    return taken.groupBy("problem_id").agg(F.sum(F.col("value") * F.col("count")).alias("value"))


@query("""with w as (select p_partkey, p_retailprice as weight, floor(p_retailprice * pow(2, 52 - floor(log2((select max(p_retailprice) from part)))))::hugeint as w from part),
i as (select *, sum(w) over (order by p_partkey, weight rows unbounded preceding) - w as place from w where w > 0), t as (select sum(w)::hugeint as total from i),
d as (select draw, ((('0x' || md5(draw || ':7')[1:15])::bigint::hugeint * total) >> 60) as place from range(10000) r(draw), t)
select draw, p_partkey, weight from d asof join i on d.place >= i.place""")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("weight"))
    return sampling.weighted_sample(items, 10_000, seed=7)


# geometry and numbers

_SEGMENTS = """s as (select o_orderkey as seg_id, (o_orderkey * 7919) % 4001 as x1, (o_orderkey * 104729 + o_custkey * 31) % 4001 as y1,
(o_orderkey * 7919) % 4001 + o_orderkey % 41 - 20 as x2, (o_orderkey * 104729 + o_custkey * 31) % 4001 + o_custkey % 37 - 18 as y2 from orders),
p as (select a.seg_id as i, b.seg_id as j, a.x1, a.y1, a.x2, a.y2, b.x1 as u1, b.y1 as v1, b.x2 as u2, b.y2 as v2,
(a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) as det from s a join s b on a.seg_id < b.seg_id
and greatest(a.x1, a.x2) >= least(b.x1, b.x2) and greatest(b.x1, b.x2) >= least(a.x1, a.x2) and greatest(a.y1, a.y2) >= least(b.y1, b.y2) and greatest(b.y1, b.y2) >= least(a.y1, a.y2))"""


@query(f"""with {_SEGMENTS}, q as (select *, (u1 - x1) * (v2 - v1) - (v1 - y1) * (u2 - u1) as tn, (u1 - x1) * (y2 - y1) - (v1 - y1) * (x2 - x1) as un from p where det <> 0),
g as (select i, j, x1 * det + tn * (x2 - x1) as xn, y1 * det + tn * (y2 - y1) as yn, det from q where case when det > 0 then tn >= 0 and tn <= det and un >= 0 and un <= det else tn <= 0 and tn >= det and un <= 0 and un >= det end),
one as (select i, j, xn * sign(det) // gcd(xn, det) as xa, abs(det) // gcd(xn, det) as xb, yn * sign(det) // gcd(yn, det) as ya, abs(det) // gcd(yn, det) as yb from g),
col as (select i, j, greatest(least(row(x1, y1), row(x2, y2)), least(row(u1, v1), row(u2, v2))) as lo, least(greatest(row(x1, y1), row(x2, y2)), greatest(row(u1, v1), row(u2, v2))) as hi from p
where det = 0 and (x2 - x1) * (v1 - y1) = (y2 - y1) * (u1 - x1) and (u2 - u1) * (v1 - y1) = (v2 - v1) * (u1 - x1)),
pts as (select i, j, xa::bigint as xa, xb::bigint as xb, ya::bigint as ya, yb::bigint as yb from one
union all select i, j, lo[1], 1, lo[2], 1 from col where lo <= hi union all select i, j, hi[1], 1, hi[2], 1 from col where lo <= hi),
e as (select distinct xa, xb, ya, yb, unnest([i, j]) as seg_id from pts)
select xa as x_num, xb as x_den, ya as y_num, yb as y_den, string_agg(seg_id::varchar, ',' order by seg_id) as segments from e group by 1, 2, 3, 4""")
def segment_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = intersections(datasets.segments(spark, sf_dir))
    names = {f"{c}_{p}": F.col(f"{c}.{p}").cast("long") for c in "xy" for p in ("num", "den")}
    return met.select(*(v.alias(k) for k, v in names.items()), F.array_join(F.col("segments").cast("array<string>"), ",").alias("segments"))


@query(f"""with {_SEGMENTS} select seg_id, y2 - y1 as a, x1 - x2 as b, (y2 - y1) * x1 + (x1 - x2) * y1 as c,
case when x1 = x2 then 1 else (y2 - y1) * sign(x2 - x1) // gcd(y2 - y1, x2 - x1) end::bigint as slope_num,
case when x1 = x2 then 0 else abs(x2 - x1) // gcd(y2 - y1, x2 - x1) end::bigint as slope_den,
(x1 + x2) % 2 = 0 and (y1 + y2) % 2 = 0 as has_middle from s""")
def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Segment.of()
    rows = datasets.segments(spark, sf_dir).withColumns({"line": line_of(s), "slope": slope(s)})
    mid = ((F.col("x1") + F.col("x2")) % 2 == 0) & ((F.col("y1") + F.col("y2")) % 2 == 0)
    half = on_segment(F.floor((F.col("x1") + F.col("x2")) / 2), F.floor((F.col("y1") + F.col("y2")) / 2), s)
    return rows.select(
        "seg_id", *(F.col(f"line.{c}").cast("long").alias(c) for c in "abc"),
        F.col("slope.num").cast("long").alias("slope_num"), F.col("slope.den").cast("long").alias("slope_den"), (mid & half).alias("has_middle"),
    )


@query("""with r as (select distinct l_quantity::bigint as a, l_linenumber::bigint as b, l_suppkey % 7 + 1 as c from lineitem),
x as (select a, b, c, a * c + b * b as n, b * c as d, a * b as mn, b * c as md, cmp from (select *, sign(a * c - b * b)::int as cmp from r))
select a, b, c, n // gcd(n, d) as sum_num, d // gcd(n, d) as sum_den, mn // gcd(mn, md) as mul_num, md // gcd(mn, md) as mul_den, cmp from x""")
def rational_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_quantity").cast("long").alias("a"), F.col("l_linenumber").cast("long").alias("b"), (F.col("l_suppkey") % 7 + 1).alias("c")).distinct()
    rows = rows.withColumns({"p": R.rational(F.col("a"), F.col("b")), "q": R.rational(F.col("b"), F.col("c"))})
    rows = rows.withColumns({"s": R.add(F.col("p"), F.col("q")), "m": R.multiply(F.col("p"), R.rational(F.col("b") * F.col("b"), F.col("b") * F.col("c")))})
    return rows.select(
        "a", "b", "c", F.col("s.num").cast("long").alias("sum_num"), F.col("s.den").cast("long").alias("sum_den"),
        F.col("m.num").cast("long").alias("mul_num"), F.col("m.den").cast("long").alias("mul_den"), R.compare(F.col("p"), F.col("q")).alias("cmp"),
    )
