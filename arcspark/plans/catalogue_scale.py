"""Queries of what a task, a round a hop or a table in the driver can't hold: chosen items, early ends, large flows, ..."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcspark.operators import flow, knapsack, paths, queues, traverse, trees, views
from arcspark.operators.components import component_labels, count_components, merge_edges
from arcspark.plans.catalogue import _CHAIN, _HANDOFF, _ITEMS, ORACLE_SQL, _least_user, query
from arcspark.plans.catalogue_more import _LENGTHS, certified
from arcspark.sources import datasets
from arcspark.sources.datasets import read


def _budgets(items: DataFrame, budget: int) -> DataFrame:
    return items.select("problem_id").distinct().withColumn("budget", F.lit(budget).cast("long"))


@query(f"""with recursive {_ITEMS}, d(problem_id, k, c, v, s) as (select problem_id, 0::bigint, 0::bigint, 0::bigint, []::bigint[] from n union all
select problem_id, k, c, max(v)::bigint, arg_max(s, 2 * v + (case when taken then 0 else 1 end)) from (select d.problem_id, d.k + 1 as k, d.c + o.c as c, d.v + o.v as v, taken,
case when taken then list_append(d.s, it.item_id) else d.s end as s from d join it on it.problem_id = d.problem_id and it.k = d.k + 1,
lateral (select it.cost as c, it.value as v, true as taken union all select 0, 0, false) o where d.c + o.c <= 60) group by 1, 2, 3)
select problem_id, unnest(s) as item_id, 1::bigint as count from (select d.problem_id, s, row_number() over (partition by d.problem_id order by v desc, c) as best from d join n on n.problem_id = d.problem_id and d.k = n.n) where best = 1""")
def knapsack_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each brand that are worth most in 60 units of size."""
    items = datasets.knapsack_items(spark, sf_dir)
    return knapsack.knapsack(items, _budgets(items, 60)).select("problem_id", "item_id", "count")


@query(f"""with recursive {_ITEMS}, d(problem_id, k, c, v, s) as (select problem_id, 0::bigint, 0::bigint, 0::bigint, []::struct(i bigint, j bigint)[] from n union all
select problem_id, k, c, max(v)::bigint, arg_max(s, 100 * v - j) from (select d.problem_id, d.k + 1 as k, d.c + j * it.cost as c, d.v + j * it.value as v, j,
case when j > 0 then list_append(d.s, {{'i': it.item_id, 'j': j}}) else d.s end as s from d join it on it.problem_id = d.problem_id and it.k = d.k + 1,
lateral (select unnest(range(0, 60 // it.cost + 1)) as j) o where d.c + j * it.cost <= 60) group by 1, 2, 3)
select problem_id, x.i as item_id, x.j as count from (select problem_id, unnest(s) as x from (select d.problem_id, s, row_number() over (partition by d.problem_id order by v desc, c) as best from d join n on n.problem_id = d.problem_id and d.k = n.n) where best = 1)""")
def unbounded_knapsack_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``knapsack_selection``, with parts taken any number of times."""
    items = datasets.knapsack_items(spark, sf_dir)
    return knapsack.knapsack(items, _budgets(items, 60), repeat=True).select("problem_id", "item_id", "count")


# searches that end early


@query(f"with recursive {_HANDOFF}, {_LENGTHS} select id, dist from b order by dist, id limit 100")
def nearest_hundred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred users that a search from the first one settles."""
    return paths.shortest_paths(datasets.handoff(spark, sf_dir), "w", _least_user(spark, sf_dir), limit=100, delta=1)


@query(f"with recursive {_HANDOFF}, {_LENGTHS} select id, dist from b where dist <= (select min(dist) from b where id = (select max(user_id) from events))")
def until_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users no farther from the first one than the last one is, the search ending there."""
    last = read(spark, sf_dir, "events").agg(F.max("user_id").cast("long").alias("id"))
    return paths.shortest_paths(datasets.handoff(spark, sf_dir), "w", _least_user(spark, sf_dir), targets=last, delta=1)


# chains


@query(f"""with {_CHAIN}, arcs as (select src, row_number() over (order by src, dst) - 1 as arc_id from c where dst is not null),
o as (select event_id, last_value(event_id) over w as target, row_number() over w - 1 as pos from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following))
select target, pos, arc_id from o join arcs on arcs.src = o.event_id""")
def critical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest path to the last event of each user."""
    g = datasets.chain(spark, sf_dir)
    last = g.vertices.select("id").join(g.arcs.select(F.col("src").alias("id")), "id", "left_anti")
    return traverse.critical_path(traverse.topological_sort(g), last)


# flows beyond a task


@query(f"""with {_HANDOFF} select arc_id, src, dst, true as within, true as conserved, true as is_cut_value from a where src <> dst""")
def large_flow_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A maximum flow over all handoffs from the first user to the last, by rounds, proved arc by arc as ``flow_certificate`` is."""
    arcs = datasets.handoff(spark, sf_dir).arcs.where("src <> dst").select(F.lit(1).alias("problem_id"), "arc_id", "src", "dst", F.col("w").alias("capacity"))
    ends = read(spark, sf_dir, "events").agg(F.min("user_id").cast("long").alias("s"), F.max("user_id").cast("long").alias("t")).select(F.lit(1).alias("problem_id"), "s", "t")
    return certified(flow.max_flow(arcs, ends, max_arcs=0), ends)


# components under insertions


@query(f"""with recursive {_HANDOFF}, e as (select src as u, dst as v from a union select dst, src from a),
r(id, c) using key (id) as (select id, id from v union select e.v, min(r.c) from r join e on e.u = r.id left join recurring.r k on k.id = e.v group by e.v having min(r.c) < min(k.c))
select id, c as component from r""")
def merged_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak components of the handoffs, their arcs arriving in three batches."""
    arcs = datasets.handoff(spark, sf_dir).arcs
    labels = component_labels(arcs.where("arc_id % 3 = 0"))
    for k in (1, 2):
        labels = merge_edges(labels, arcs.where(F.col("arc_id") % 3 == k))
    return labels


@query("select count(distinct user_id) as n_weak, count(*) as n_strong from events")
def component_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many weak and strong components the chains of the users' events have."""
    g = datasets.chain(spark, sf_dir)
    n = [count_components(f(g)) for f in (traverse.weakly_connected_components, traverse.strongly_connected_components)]
    return spark.createDataFrame([tuple(n)], "n_weak long, n_strong long")


# orders and queues


@query(f"select *, row_number() over (order by cost, edge_id) - 1 as pos from ({ORACLE_SQL['spanning_forest']})")
def forest_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the least spanning forest, the cheapest first."""
    return trees.spanning_forest(views.undirect(datasets.trade(spark, sf_dir)), "w", ordered=True)


@query("""with lines as (select l_partkey, min(l_quantity)::bigint as least, max(l_quantity)::bigint as most from lineitem group by 1),
q as (select p_brand, p_partkey, case when l_partkey is null then p_size else greatest(least(p_size, least), least(most, 20)) end::bigint as priority from part left join lines on l_partkey = p_partkey)
select p_brand, pos - 5 as pos, p_partkey, priority from (select *, row_number() over (partition by p_brand order by priority, p_partkey) - 1 as pos from q) where pos between 5 and 9""")
def heap_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand by size, promoted to the least quantity sold and demoted to the greatest (20 at most): the five after the first five have gone."""
    parts = read(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("priority"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_quantity").cast("long").alias("least"), F.max("l_quantity").cast("long").alias("most"))
    up, down = lines.select("id", F.col("least").alias("priority")), lines.select("id", F.least("most", F.lit(20)).alias("priority"))
    queue = queues.updated(queues.updated(parts, up, "promote"), down, "demote")
    return queues.first(queues.popped(queue, 5, "p_brand"), 5, "p_brand").select("p_brand", "pos", F.col("id").alias("p_partkey"), "priority")
