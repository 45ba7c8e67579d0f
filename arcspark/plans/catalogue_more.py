"""More registered queries: predecessors, certificates of flows and paths, maps, orders and number checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspark.functions import rational as R
from arcspark.graph import Graph
from arcspark.operators import flow, paths, planar, queues, traverse, trees, views
from arcspark.plans.scratch import materialise, told
from arcspark.plans.catalogue import _CHAIN, _HANDOFF, _TRADE, _flow_arcs, _least_user, _terminals, query
from arcspark.sources import builders, datasets, dot
from arcspark.sources.datasets import read

_HOPS = """{name}(id, dist) using key (id) as ({seed} union select e.dst, min({name}.dist + 1) from {name} join {arcs} e on e.src = {name}.id
left join recurring.{name} k on k.id = e.dst group by e.dst having min({name}.dist + 1) < coalesce(min(k.dist), 1000000000000))"""
_LENGTHS = """b(id, dist) using key (id) as (select min(user_id), 0::bigint from events union select e.dst, min(b.dist + e.w) from b join a e on e.src = b.id
left join recurring.b k on k.id = e.dst group by e.dst having min(b.dist + e.w) < coalesce(min(k.dist), 1000000000000))"""


@query(f"with {_HANDOFF} select arc_id, src, dst from a")
def endpoint_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.handoff(spark, sf_dir)
    return g.arc_sources().join(g.arc_targets(), "arc_id")


@query(f"with {_HANDOFF} select arc_id, src, dst, w from a where dst = (select max(user_id) from events)")
def in_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = read(spark, sf_dir, "events").agg(F.max("user_id").cast("long").alias("id"))
    return datasets.handoff(spark, sf_dir).in_arcs(last)


@query(f"with {_HANDOFF} select event_id as arc_id, event_id in (select arc_id from a) as valid from events")
def valid_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.handoff(spark, sf_dir).has_arcs(read(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("arc_id")))


@query(f"with {_HANDOFF} select arc_id as edge_id, least(src, dst) as u, greatest(src, dst) as v, w * 2 as cost, (select count(*) from a) as n_edges from a")
def edge_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = views.undirect(datasets.handoff(spark, sf_dir)).with_edge_map("cost", F.col("w") * 2)
    ends = g.edge_endpoints().join(g.edges.select("edge_id", "cost"), "edge_id")
    return ends.withColumn("n_edges", F.lit(g.num_edges()))


@query(f"with {_HANDOFF} select arc_id, case when arc_id % 6 = 0 then dst else src end as src, dst, w from a")
def repoint_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.handoff(spark, sf_dir)
    return g.repoint(g.arcs.where("arc_id % 6 = 0").select("arc_id", F.col("dst").alias("src"), F.lit(None).cast("long").alias("dst"))).arcs


@query("""select row_number() over (order by n_regionkey, n_nationkey) - 1 as arc_id, n_regionkey::bigint as src, n_nationkey::bigint as dst from nation""")
def static_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    arcs = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"))
    return builders.indexed(builders.static_graph(25, arcs)).arcs.select("arc_id", "src", "dst")


@query("select count(*) as n_vertices, 0::bigint as n_arcs from nation")
def empty_graph_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The empty graph once it is given a vertex for each nation."""
    g = builders.empty_graph(spark).add_vertices(datasets.nations(spark, sf_dir))
    return g.vertices.agg(F.count("*").alias("n_vertices")).join(F.broadcast(g.arcs.agg(F.count("*").alias("n_arcs"))))


@query(f"""with recursive {_HANDOFF}, {_HOPS.format(name="b", seed="select min(user_id), 0::bigint from events", arcs="a")},
p as (select e.dst as id, min(e.arc_id) as arc from a e join b x on x.id = e.src join b y on y.id = e.dst where x.dist + 1 = y.dist group by e.dst)
select b.id, b.dist, p.arc as pred_arc, e.src as pred_vertex from b left join p on p.id = b.id left join a e on e.arc_id = p.arc""")
def bfs_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.breadth_first_search(datasets.handoff(spark, sf_dir), _least_user(spark, sf_dir))


@query(f"""with recursive {_HANDOFF}, {_LENGTHS}, tight as (select e.arc_id, e.src, e.dst from a e join b x on x.id = e.src join b y on y.id = e.dst where x.dist + e.w = y.dist),
{_HOPS.format(name="h2", seed="select min(user_id), 0::bigint from events", arcs="tight")},
p as (select e.dst as id, min(e.arc_id) as arc from tight e join h2 x on x.id = e.src join h2 y on y.id = e.dst where x.dist + 1 = y.dist group by e.dst)
select b.id, b.dist, p.arc as pred_arc, e.src as pred_vertex from b left join p on p.id = b.id left join a e on e.arc_id = p.arc""")
def shortest_path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.shortest_paths(datasets.handoff(spark, sf_dir), "w", _least_user(spark, sf_dir), store_paths=True)


@query(f"with recursive {_HANDOFF}, {_LENGTHS} select row_number() over (order by dist, id) - 1 as pos, id, dist from b")
def settled_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reached vertices in the order in which a heap of (distance, id) gives them."""
    found = paths.shortest_paths(datasets.handoff(spark, sf_dir), "w", _least_user(spark, sf_dir))
    return builders.numbered(found, "pos", "dist", "id").select("pos", "id", "dist")


@query("""select p_brand, p_partkey, pos from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice, p_partkey) - 1 as pos from part) where pos < 5""")
def heap_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five least of each brand, as a heap of (price, key) gives them."""
    parts = read(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("priority"))
    return queues.first(parts, 5, "p_brand").select("p_brand", F.col("id").alias("p_partkey"), "pos")


@query(f"""with recursive {_HANDOFF}, {_LENGTHS} select dist as total, true as starts, true as ends, true as joined from b where id = (select max(user_id) from events)""")
def source_target_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-sided search's path: its length, where it starts and ends, and whether its arcs join up."""
    g = datasets.handoff(spark, sf_dir)
    ends = read(spark, sf_dir, "events").agg(F.min("user_id").cast("long").alias("s"), F.max("user_id").cast("long").alias("t"))
    _, arcs = paths.bidirectional_shortest_path(g, "w", ends.select(F.col("s").alias("id")), ends.select(F.col("t").alias("id")))
    each = arcs.join(g.arcs, "arc_id").select("pos", "src", "dst", "w")
    after = each.select((F.col("pos") - 1).alias("pos"), F.col("src").alias("next"))
    both = each.join(after, "pos", "left").join(F.broadcast(ends))
    n = F.max("pos")
    return both.agg(
        F.sum("w").alias("total"), F.max(F.when(F.col("pos") == 0, F.col("src") == F.col("s"))).alias("starts"),
        F.max_by(F.col("dst") == F.col("t"), "pos").alias("ends"),
        ((F.count("*") == n + 1) & (F.sum(F.when(F.col("next") == F.col("dst"), 0).otherwise(1)) == 1)).alias("joined"),
    )


@query("""select event_id as component, row_number() over (order by later, event_id) - 1 as component_id
from (select event_id, count(*) over (partition by user_id order by ts desc, event_id desc) as later from events)""")
def component_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.chain(spark, sf_dir)
    return traverse.component_order(g, traverse.strongly_connected_components(g))


@query(f"""with {_CHAIN} select true as acyclic, (select count(*) from c where dst is not null) as n_arcs""")
def chain_is_acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = datasets.chain(spark, sf_dir)
    return g.arcs.agg(F.count("*").alias("n_arcs")).withColumn("acyclic", F.lit(traverse.is_acyclic(g)))


@query(f"""with {_TRADE}, e as (select row_number() over (order by src, dst) - 1 as arc_id, src, dst, w from t where src <> dst)
select arc_id, src, dst, true as within, true as conserved, true as is_cut_value from e""")
def flow_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A maximum flow proved arc by arc: within its capacity, conserved at its ends, and worth as much as either cut."""
    ends = _terminals(spark)
    return certified(flow.max_flow(_flow_arcs(spark, sf_dir), ends), ends)


def certified(flows: DataFrame, ends: DataFrame) -> DataFrame:
    """Of one problem, by arc: the flow is within the capacity, conserved at both ends of the arc, and worth as much as either cut."""
    flows = materialise(flows, "flows")
    some = flows.where("flow <> 0")
    moved = some.select(F.col("src").alias("id"), (-F.col("flow")).alias("f")).unionByName(some.select(F.col("dst").alias("id"), F.col("flow").alias("f")))
    loose = moved.groupBy("id").agg(F.sum("f").alias("f")).where("f <> 0").join(ends, F.col("id").isin(F.col("s"), F.col("t")), "left_anti").select("id")
    loose = materialise(loose, "loose")
    value = flow.flow_value(flows, ends).select("value")
    cuts = [flow.minimum_cut(flows, side).agg(F.sum("capacity").alias(side)) for side in ("source", "target")]
    worth = value.join(F.broadcast(cuts[0])).join(F.broadcast(cuts[1])).select(((F.col("value") == F.col("source")) & (F.col("value") == F.col("target"))).alias("is_cut_value"))
    at = flows
    for end in ("src", "dst"):
        at = at.join(told(loose.select(F.col("id").alias(end), F.lit(True).alias(f"loose_{end}"))), end, "left")
    return at.join(F.broadcast(worth)).select(
        "arc_id", "src", "dst", F.col("flow").between(0, F.col("capacity")).alias("within"),
        (F.col("loose_src").isNull() & F.col("loose_dst").isNull()).alias("conserved"), "is_cut_value",
    )


@query(f"""with recursive {_TRADE}, e as (select row_number() over (order by src, dst, w) - 1 as edge_id, src, dst, w from t),
k as (select *, row_number() over (order by w, edge_id) as n from e where src <> dst), u as (select src, dst, n from k union all select dst, src, n from k),
m(s, id, n) using key (s, id) as (select n_nationkey::bigint, n_nationkey::bigint, 0::bigint from nation union select m.s, u.dst, min(greatest(m.n, u.n)) from m join u on u.src = m.id
left join recurring.m q on q.s = m.s and q.id = u.dst group by m.s, u.dst having min(greatest(m.n, u.n)) < coalesce(min(q.n), 1000000000000))
select edge_id, k.src, k.dst, w as cost from k join m on m.s = k.src and m.id = k.dst where m.n = k.n and k.src in (select id from m where s = 0)""")
def tree_from_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.spanning_tree(views.undirect(datasets.trade(spark, sf_dir)), "w", 0)


@query("""with r as (select distinct l_quantity::bigint as a, l_linenumber::bigint as b, l_suppkey % 7 + 1 as c from lineitem),
x as (select a, b, c, a * c - b * b as n, b * c as d, a * c as qn, b * b as qd from r)
select a, b, c, n // gcd(n, d) as sub_num, d // gcd(n, d) as sub_den, qn // gcd(qn, qd) as div_num, qd // gcd(qn, qd) as div_den, -a // gcd(a, b) as neg_num, b // gcd(a, b) as neg_den,
(a * b * c)::bigint as within, a::hugeint * 1000000000000 * b * 1000000 > 9223372036854775807 as over from x""")
def rational_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_quantity").cast("long").alias("a"), F.col("l_linenumber").cast("long").alias("b"), (F.col("l_suppkey") % 7 + 1).cast("long").alias("c")).distinct()
    p, q = R.rational(F.col("a"), F.col("b")), R.rational(F.col("b"), F.col("c"))
    rows = rows.withColumns({"sub": R.subtract(p, q), "div": R.divide(p, q), "neg": R.negate(p)})
    parts = [F.col(f"{k}.{x}").cast("long").alias(f"{k}_{x}") for k in ("sub", "div", "neg") for x in ("num", "den")]
    return rows.select(
        "a", "b", "c", *parts, R.bounded(F.col("a") * F.col("b") * F.col("c"), 0, 1 << 20).alias("within"),
        R.overflows(F.col("a") * 1_000_000_000_000, F.col("b") * 1_000_000, "*").alias("over"),
    )


def _strip(spark: SparkSession, sf_dir: str) -> Graph:
    """A planar map: a row of squares, one for each order, between faces 0 above and below; arc 2k and 2k + 1 are twins."""
    n = read(spark, sf_dir, "orders").count()
    posts = spark.range(n + 1).select(F.col("id"))
    kinds = F.posexplode(F.array(F.lit("post"), F.lit("top"), F.lit("floor"))).alias("k", "kind")
    edges = posts.select(F.col("id").alias("i"), kinds).where((F.col("kind") == "post") | (F.col("i") < n))
    i, square = F.col("i"), F.col("i") + 1
    low, high = 2 * i, 2 * i + 1
    src = F.when(F.col("kind") == "post", low).when(F.col("kind") == "top", high).otherwise(low)
    dst = F.when(F.col("kind") == "post", high).when(F.col("kind") == "top", high + 2).otherwise(low + 2)
    right = F.when(F.col("kind") == "post", F.when(i < n, square).otherwise(0)).when(F.col("kind") == "top", square).otherwise(F.lit(0))
    left = F.when(F.col("kind") == "post", i).when(F.col("kind") == "top", F.lit(0)).otherwise(square)
    name = 2 * (3 * i + F.col("k"))
    rows = edges.select(name.alias("arc_id"), src.alias("src"), dst.alias("dst"), left.alias("face"), (name + 1).alias("twin")).unionByName(
        edges.select((name + 1).alias("arc_id"), dst.alias("src"), src.alias("dst"), right.alias("face"), name.alias("twin"))
    )
    vertices = posts.select(F.explode(F.array(F.struct((2 * F.col("id")).alias("id"), F.col("id").alias("x"), F.lit(0).alias("y")), F.struct((2 * F.col("id") + 1).alias("id"), F.col("id").alias("x"), F.lit(1).alias("y")))).alias("v")).select("v.*")
    return Graph(vertices, rows)


@query("""with n as (select count(*) as n from orders), f as (select unnest(range(0, (select n + 1 from n))) as face)
select face, case when face = 0 then 2 * n + 2 else 4 end::bigint as n_arcs, case when face = 0 then 2 * n + 2 else 4 end::bigint as out_degree,
case when face = 0 then 2 * n + 2 else 4 end::bigint as in_degree from f, n""")
def planar_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of a strip of squares with the arcs that bound them, and the degrees of the dual."""
    g = _strip(spark, sf_dir)
    d = planar.dual(g)
    return planar.faces(g).join(d.out_degree().withColumnRenamed("id", "face"), "face").join(d.in_degree().withColumnRenamed("id", "face"), "face")


@query("""with n as (select count(*)::bigint as n from orders), i as (select unnest(range(0, (select n + 1 from n)))::bigint as i),
b as (select 6 * i as arc_id, i as face, i as x1, 0 as y1, i as x2, 1 as y2 from i union all select 6 * i + 1, i + 1, i, 1, i, 0 from i, n where i < n
union all select 6 * i + 3, i + 1, i + 1, 1, i, 1 from i, n where i < n union all select 6 * i + 4, i + 1, i, 0, i + 1, 0 from i, n where i < n)
select arc_id, face, x1, y1::bigint as y1, x2, y2::bigint as y2 from b where face > 0""")
def planar_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arcs that bound the squares of the strip, with their coordinates."""
    g = _strip(spark, sf_dir)
    bounds = Graph(g.vertices, planar.bounding_arcs(g, planar.faces(g).where("face > 0")))
    return planar.arc_coordinates(bounds, "face").select("arc_id", *(F.col(c).cast("long").alias(c) for c in ("face", "x1", "y1", "x2", "y2")))


@query("""select n_nationkey::bigint as pos, '  ' || n_nationkey || ' [label="' || n_name || '", pos="' || n_nationkey || ',' || n_regionkey || '!", color="red"];' as line from nation""")
def dot_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    place = F.concat(F.col("n_nationkey").cast("string"), F.lit(","), F.col("n_regionkey").cast("string"), F.lit("!"))
    vertices = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.lit("red").alias("color"), F.col("n_name").alias("label"), place.alias("pos"))
    lines = dot.dot_lines(Graph(vertices, builders.empty_graph(spark).arcs))
    return lines.where("section = 1").select("pos", "line")
