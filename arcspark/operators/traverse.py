"""Traversals: breadth first, depth first, topological order, forests, strong and weak components.

Breadth-first search, forests and components are rounds of joins. Depth-first search is
sequential by nature and runs as one task per search, but for forests. Topological order (once chains are
contracted) and strong components are sequential within a weak component, so small weak components
each run as one task, side by side, and large ones by rounds of joins.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcspark.graph import Graph, UndirectedGraph
from arcspark.operators.chains import chain_places, list_sums
from arcspark.operators.components import component_labels
from arcspark.plans.fixpoint import Accumulated, per_group, rounds
from arcspark.plans import scratch
from arcspark.plans.scratch import discard, materialise, told
from arcspark.sources.builders import numbered

#: Arcs of a weak component that a sequential kernel takes.
TASK_ARCS = 500_000
#: Rows of a bin of weak components that a task takes together, about.
BIN_ROWS = 50_000
#: Hops that a breadth-first search makes by rounds before small components go on in tasks.
ROUND_HOPS = 24


def breadth_first_search(graph: Graph, sources: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``id, dist, pred_arc, pred_vertex`` of the vertices reached from ``sources`` (id).

    The predecessor is the least arc id from the hop before; sources have none. What is still going on
    after ``ROUND_HOPS`` rounds is finished by one task for each weak component of at most TASK_ARCS
    arcs, so that long chains need no round for each hop; larger components go on by rounds. While few vertices
    are seen, arcs to them go before the shuffle.
    """
    none = F.lit(None).cast("long")
    seeds = sources.select("id").distinct().join(graph.vertices.select("id"), "id", "left_semi")
    frontier = materialise(seeds.select("id", F.lit(0).cast("long").alias("dist"), none.alias("pred_arc"), none.alias("pred_vertex")), "bfs")
    seen, arcs = Accumulated(frontier), graph.arcs.select("arc_id", "src", "dst")
    n = n_seen = frontier.count()
    for hop in rounds(max_hops):
        reached = told(frontier.select(F.col("id").alias("src")), n).join(arcs, "src").withColumnRenamed("dst", "id")
        before, few = seen.table().select("id"), n_seen <= scratch.TOLD_ROWS
        if few:
            reached = reached.join(told(before, n_seen), "id", "left_anti")
        best = reached.groupBy("id").agg(F.min(F.struct("arc_id", "src")).alias("p"))
        if not few:
            best = best.join(before, "id", "left_anti")
        frontier = materialise(best.select("id", F.lit(hop).cast("long").alias("dist"), F.col("p.arc_id").alias("pred_arc"), F.col("p.src").alias("pred_vertex")), "bfs")
        n = frontier.count()
        if not n:
            break
        seen.add(frontier)
        n_seen += n
        if hop == ROUND_HOPS:
            members, _ = _by_size(graph, TASK_ARCS)
            mine = materialise(members.join(frontier.join(members, "id").select("component").distinct(), "component", "left_semi").select("id", "component"), "small")
            if not mine.isEmpty():
                ended = materialise(_finished(graph, mine, frontier, seen.table(), max_hops), "bfs")
                frontier = materialise(frontier.join(mine.select("id"), "id", "left_anti"), "bfs")
                seen.add(ended)
                n, n_seen = frontier.count(), n_seen + ended.count()
                if not n:
                    break
    return seen.table()


def _finished(graph: Graph, members: DataFrame, frontier: DataFrame, seen: DataFrame, max_hops: int | None) -> DataFrame:
    """What the search finds beyond ``frontier`` in these weak components, one task for each."""
    left = members.join(seen.select("id"), "id", "left_anti").unionByName(members.join(frontier.select("id"), "id", "left_semi"))
    left = materialise(left, "left")
    inside = graph.arcs.select("arc_id", "src", "dst").join(left.select(F.col("id").alias("src"), "component"), "src").join(left.select(F.col("id").alias("dst")), "dst", "left_semi")
    none = F.lit(None).cast("long")
    starts = frontier.join(members, "id").select("component", none.alias("arc_id"), F.col("id").alias("src"), F.col("dist").alias("dst"))
    most = -1 if max_hops is None else max_hops

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.arc_id.isna()
        dist = {int(u): int(d) for u, d in pdf.loc[first, ["src", "dst"]].itertuples(index=False)}
        out: dict[int, list[tuple[int, int]]] = {}
        for arc, u, v in pdf.loc[~first, ["arc_id", "src", "dst"]].astype("int64").itertuples(index=False):
            out.setdefault(u, []).append((arc, v))
        level, rows = list(dist), []
        while level and (most < 0 or dist[level[0]] < most):
            offers: dict[int, tuple[int, int]] = {}
            for u in level:
                for arc, v in out.get(u, ()):
                    if v not in dist and (v not in offers or (arc, u) < offers[v]):
                        offers[v] = (arc, u)
            hop = dist[level[0]] + 1
            rows += [(v, hop, arc, u) for v, (arc, u) in offers.items()]
            dist.update(dict.fromkeys(offers, hop))
            level = list(offers)
        return pd.DataFrame(rows, columns=["id", "dist", "pred_arc", "pred_vertex"]).astype("int64")

    rows = inside.select("component", "arc_id", "src", "dst").unionByName(starts)
    return per_group(rows, "component", search, "id long, dist long, pred_arc long, pred_vertex long")


def reached(graph: Graph, found: DataFrame) -> DataFrame:
    """``id, reached`` for every vertex, from the result of a search."""
    hit = found.select("id", F.lit(True).alias("reached")).distinct()
    return graph.vertices.select("id").join(hit, "id", "left").select("id", F.coalesce("reached", F.lit(False)).alias("reached"))


def depth_first_search(graph: Graph, sources: DataFrame, most_arcs: int = TASK_ARCS * 10) -> DataFrame:
    """``id, pos, depth, pred_arc, pred_vertex`` in preorder; arcs are tried in order of arc id, sources of id.

    Where no vertex has two arcs in and no source has any, what is reached is a forest, and its preorder is that
    of an Euler tour whose places are found by doubling, in no single task. Other graphs are searched by one
    task, of at most ``most_arcs`` arcs.
    """
    s = sources.select("id").distinct().join(graph.vertices.select("id"), "id", "left_semi")
    ins = graph.arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    if ins.where("n > 1").isEmpty() and ins.join(s, "id", "left_semi").isEmpty():
        return _preorder(graph, s)
    none = F.lit(None).cast("long")
    rows = graph.arcs.select(F.lit(0).alias("g"), "arc_id", "src", "dst").unionByName(
        s.select(F.lit(0).alias("g"), none.alias("arc_id"), F.col("id").alias("src"), none.alias("dst"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        start = sorted(pdf.loc[pdf.arc_id.isna(), "src"].astype("int64"))
        out: dict[int, list[tuple[int, int]]] = {}
        for arc, u, v in pdf.loc[pdf.arc_id.notna(), ["arc_id", "src", "dst"]].astype("int64").sort_values("arc_id").itertuples(index=False):
            out.setdefault(u, []).append((arc, v))
        seen: set[int] = set()
        found = []
        for s in start:
            stack = [iter([(None, s)])]
            path: list[int | None] = [None]
            while stack:
                arc, v = next(stack[-1], (None, None))
                if v is None:
                    stack.pop()
                    path.pop()
                elif v not in seen:
                    seen.add(v)
                    found.append((v, len(found), len(stack) - 1, arc, path[-1]))
                    stack.append(iter(out.get(v, ())))
                    path.append(v)
        return pd.DataFrame(found, columns=["id", "pos", "depth", "pred_arc", "pred_vertex"]).astype({"pred_arc": "Int64", "pred_vertex": "Int64"})

    return per_group(rows, "g", run, "id long, pos long, depth long, pred_arc long, pred_vertex long", most_arcs)


def _preorder(graph: Graph, roots: DataFrame) -> DataFrame:
    """Preorder of the trees below ``roots``: an Euler tour enters each vertex (2 * id) and leaves it (2 * id + 1)."""
    arcs = materialise(graph.arcs.select("arc_id", "src", "dst"), "arcs")
    roots = numbered(roots, "n", "id")
    brothers = W.partitionBy("src").orderBy("arc_id")
    kids = arcs.select("src", F.col("dst").alias("id"), F.lead("dst").over(brothers).alias("brother"), F.row_number().over(brothers).alias("n"))
    kids = materialise(kids, "children")
    heirs = roots.select("id", (F.col("n") - 1).alias("n")).where("n >= 0").select("n", F.col("id").alias("brother"))
    tops = roots.join(heirs, "n", "left").select(F.lit(None).cast("long").alias("src"), "id", "brother")
    every = kids.select("src", "id", "brother").unionByName(tops)
    first = kids.where("n = 1").select(F.col("src").alias("id"), F.col("id").alias("child"))
    one, enter, leave = F.lit(1).cast("long"), lambda c: 2 * F.col(c), lambda c: 2 * F.col(c) + 1
    entered = every.join(first, "id", "left").select(enter("id").alias("id"), F.coalesce(enter("child"), leave("id")).alias("next"), one.alias("entered"), one.alias("deeper"))
    left = every.select(leave("id").alias("id"), F.coalesce(enter("brother"), leave("src")).alias("next"), F.lit(0).cast("long").alias("entered"), (-one).alias("deeper"))
    sums = list_sums(materialise(entered.unionByName(left), "tour"), ["entered", "deeper"])
    end = roots.agg(F.max(F.struct("n", "id")).alias("x")).select((2 * F.col("x.id") + 1).alias("last"))
    met = materialise(sums.where("id % 2 = 0").join(F.broadcast(end), "last").select((F.col("id") / 2).cast("long").alias("id"), "entered", "deeper"), "preorder")
    n = met.agg(F.count("*").alias("n"))
    tree = met.join(arcs.select(F.col("dst").alias("id"), F.col("arc_id").alias("pred_arc"), F.col("src").alias("pred_vertex")), "id", "left").join(F.broadcast(n))
    return tree.select("id", (F.col("n") - F.col("entered")).alias("pos"), (-F.col("deeper")).alias("depth"), "pred_arc", "pred_vertex")


def connected_components(graph: UndirectedGraph) -> DataFrame:
    """``id, component`` for every vertex; a component is named by its least vertex."""
    found = component_labels(graph.edges, "src", "dst")
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def weakly_connected_components(graph: Graph) -> DataFrame:
    return connected_components(UndirectedGraph(graph))


def _by_size(graph: Graph, task_arcs: int) -> tuple[DataFrame, DataFrame]:
    """``id, component`` of vertices in weak components with at most ``task_arcs`` arcs, and of the rest."""
    weak = materialise(weakly_connected_components(graph), "weak")
    sizes = graph.arcs.select(F.col("src").alias("id")).join(weak, "id").groupBy("component").count()
    large = materialise(sizes.where(F.col("count") > task_arcs).select("component"), "large")
    if large.isEmpty():
        return weak.select("id", "component"), weak.limit(0).select("id", "component")
    return weak.join(large, "component", "left_anti").select("id", "component"), weak.join(large, "component", "left_semi").select("id", "component")


def _in_bins(rows: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` for weak components (``component``) of at most TASK_ARCS arcs, small ones in bins of some BIN_ROWS rows: many calls for a few rows each would cost more than the work.

    For kernels that take any union of components. Bins have no share in the result.
    """
    rows = materialise(rows, "parts")
    bins = max(1, rows.count() // BIN_ROWS)
    return per_group(rows.withColumn("bin", F.pmod(F.xxhash64("component"), F.lit(bins))), "bin", run, schema)


def _parts(graph: Graph, members: DataFrame) -> DataFrame:
    """Rows (component, arc_id, src, dst) of the members' arcs, and (component, null, id, null) of the members."""
    none = F.lit(None).cast("long")
    arcs = graph.arcs.join(members.select(F.col("id").alias("src"), "component"), "src").select("component", "arc_id", "src", "dst")
    return arcs.unionByName(members.select("component", none.alias("arc_id"), F.col("id").alias("src"), none.alias("dst")))


def topological_sort(graph: Graph, task_arcs: int = TASK_ARCS) -> DataFrame:
    """``id, rank, pred_arc, pred_vertex`` of the vertices on or behind no cycle.

    ``rank`` is the number of arcs on the longest path to the vertex; (rank, id) is a
    topological order; the predecessor is the least arc from rank - 1. Chains are contracted to arcs of
    their length first, so a chain of any length costs no round for each of its arcs and no task.
    """
    return _with_predecessors(graph, topological_ranks(graph, task_arcs))


def topological_ranks(graph: Graph, task_arcs: int = TASK_ARCS) -> DataFrame:
    """``id, rank`` alone, as ``topological_sort`` gives them; written."""
    places, turning = chain_places(graph)
    places = materialise(places, "places")
    gone = places.select("id").unionByName(turning)
    ends = graph.vertices.select("id").join(gone, "id", "left_anti")
    arcs = graph.arcs.select("src", "dst").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    behind = arcs.join(places.select(F.col("id").alias("src"), "head", "place"), "src", "left")
    length = F.coalesce("place", F.lit(0).cast("long")) + 1
    short = behind.groupBy(F.coalesce("head", "src").alias("src"), "dst").agg(F.max(length).alias("length"))
    short = Graph(materialise(ends, "ends"), materialise(short.withColumn("arc_id", F.lit(0).cast("long")), "contracted"))
    ranks = materialise(_longest(short, task_arcs), "ranks")
    along = places.join(ranks.withColumnRenamed("id", "head"), "head").select("id", (F.col("rank") + F.col("place")).alias("rank"))
    return materialise(ranks.unionByName(along), "ranks")


def _with_predecessors(graph: Graph, ranks: DataFrame) -> DataFrame:
    before, after = (ranks.select(F.col("id").alias(end), F.col("rank").alias(r)) for end, r in (("src", "r"), ("dst", "q")))
    tight = graph.arcs.select("arc_id", "src", "dst").join(before, "src").join(after, "dst").where("r + 1 = q")
    best = tight.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct("arc_id", "src")).alias("p"))
    return ranks.join(best, "id", "left").select("id", "rank", F.col("p.arc_id").alias("pred_arc"), F.col("p.src").alias("pred_vertex"))


def _longest(graph: Graph, task_arcs: int) -> DataFrame:
    """``id, rank``: the longest path to each vertex by the arcs' ``length``; a task for each small weak component, rounds for the rest."""
    small, large = _by_size(graph, task_arcs)

    def kahn(pdf: pd.DataFrame) -> pd.DataFrame:
        waiting = dict.fromkeys(pdf.loc[pdf.length.isna(), "src"].astype("int64").tolist(), 0)
        out: dict[int, list[tuple[int, int]]] = {}
        for u, v, n in pdf.loc[pdf.length.notna(), ["src", "dst", "length"]].astype("int64").itertuples(index=False):
            out.setdefault(u, []).append((v, n))
            waiting[v] += 1
        free, rank = [v for v, n in waiting.items() if not n], dict.fromkeys(waiting, 0)
        for u in free:  # grows on the way
            for v, n in out.get(u, ()):
                rank[v] = max(rank[v], rank[u] + n)
                waiting[v] -= 1
                if not waiting[v]:
                    free.append(v)
        return pd.DataFrame([(v, rank[v]) for v in free], columns=["id", "rank"]).astype("int64")

    none = F.lit(None).cast("long")
    arcs = graph.arcs.join(small.select(F.col("id").alias("src"), "component"), "src").select("component", "src", "dst", "length")
    parts = arcs.unionByName(small.select("component", F.col("id").alias("src"), none.alias("dst"), none.alias("length")))
    done = _in_bins(parts, kahn, "id long, rank long")
    return done if large.isEmpty() else done.unionByName(_peeled(graph, large))


def _peeled(graph: Graph, members: DataFrame) -> DataFrame:
    """``id, rank`` by rounds: those without remaining in-arcs leave, and offer their rank and the arc's length to those they lead to."""
    left = materialise(members.select("id", F.lit(0).cast("long").alias("rank")), "left")
    inside = materialise(graph.arcs.select("src", "dst", "length").join(left.select(F.col("id").alias("src")), "src", "left_semi"), "inside")
    parts: Accumulated | None = None
    for _ in rounds():
        free = materialise(left.join(inside.select(F.col("dst").alias("id")), "id", "left_anti"), "level")
        if free.isEmpty():
            break
        if parts is None:
            parts = Accumulated(free)
        else:
            parts.add(free)
        going = inside.join(free.select(F.col("id").alias("src"), "rank"), "src")
        offers = going.groupBy(F.col("dst").alias("id")).agg(F.max(F.col("rank") + F.col("length")).alias("offer"))
        rest = left.join(free.select("id"), "id", "left_anti").join(offers, "id", "left").select("id", F.greatest("rank", F.coalesce("offer", "rank")).alias("rank"))
        older = left, inside
        left, inside = materialise(rest, "left"), materialise(inside.join(free.select(F.col("id").alias("src")), "src", "left_anti"), "inside")
        discard(*older)
    return members.limit(0).select("id", F.lit(0).cast("long").alias("rank")) if parts is None else parts.table()


def critical_path(order: DataFrame, targets: DataFrame) -> DataFrame:
    """``target, pos, arc_id``: a longest path to each target (id) that has a rank, its arcs from pos 0 on; ``order`` as ``topological_sort`` gives it."""
    from arcspark.operators.paths import path_to

    return path_to(order, targets.join(order.select("id"), "id", "left_semi"))


def is_acyclic(graph: Graph, order: DataFrame | None = None) -> bool:
    """Whether the whole graph came out in topological order."""
    order = topological_sort(graph) if order is None else order
    return graph.vertices.select("id").join(order.select("id"), "id", "left_anti").isEmpty()


def traversal_forest(graph: Graph, sources: DataFrame) -> DataFrame:
    """``id, tree``: for each reached vertex the first source, in order of ``pos`` (or id), that reaches it.

    The trees are those of searches from each not yet reached source in this order: a vertex
    belongs to the first source that reaches it at all.
    """
    order = F.col("pos").cast("long") if "pos" in sources.columns else F.col("id")
    seeds = sources.groupBy("id").agg(F.min(order).alias("label"))
    labels = materialise(seeds.select("id", F.struct("label", F.col("id").alias("root")).alias("tree")), "forest")
    frontier, arcs = labels, graph.arcs.select("src", "dst")
    for _ in rounds():
        offered = frontier.select(F.col("id").alias("src"), "tree").join(arcs, "src").groupBy(F.col("dst").alias("id")).agg(F.min("tree").alias("new"))
        better = offered.join(labels, "id", "left").where(F.col("tree").isNull() | (F.col("new") < F.col("tree")))
        before, frontier = frontier, materialise(better.select("id", F.col("new").alias("tree")), "forest")
        if frontier.isEmpty():
            break
        older, labels = labels, materialise(labels.join(frontier.select("id"), "id", "left_anti").unionByName(frontier), "forest")
        discard(before, older)
    return labels.select("id", F.col("tree.root").alias("tree"))


def strongly_connected_components(graph: Graph, task_arcs: int = TASK_ARCS) -> DataFrame:
    """``id, component``: each vertex with the least vertex of its strong component."""
    small, large = _by_size(graph, task_arcs)

    def tarjan(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list[int]] = {}
        for u, v in pdf.loc[pdf.arc_id.notna(), ["src", "dst"]].astype("int64").itertuples(index=False):
            out.setdefault(u, []).append(v)
        index: dict[int, int] = {}
        low: dict[int, int] = {}
        held: list[int] = []
        on: set[int] = set()
        rows = []
        for root in sorted(int(v) for v in pdf.loc[pdf.arc_id.isna(), "src"]):
            if root in index:
                continue
            work = [(root, iter(out.get(root, ())))]
            index[root] = low[root] = len(index)
            held.append(root)
            on.add(root)
            while work:
                u, rest = work[-1]
                for v in rest:
                    if v not in index:
                        index[v] = low[v] = len(index)
                        held.append(v)
                        on.add(v)
                        work.append((v, iter(out.get(v, ()))))
                        break
                    if v in on:
                        low[u] = min(low[u], index[v])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[u])
                    if low[u] == index[u]:
                        group = []
                        while True:
                            v = held.pop()
                            on.discard(v)
                            group.append(v)
                            if v == u:
                                break
                        rows += [(v, min(group)) for v in group]
        return pd.DataFrame(rows, columns=["id", "component"])

    done = _in_bins(_parts(graph, small), tarjan, "id long, component long")
    if large.isEmpty():
        return done
    return done.unionByName(_coloured(graph, large))


def _least_reaching(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, label``: the least label that reaches each vertex along ``arcs`` (src, dst)."""
    labels = materialise(labels, "colour")
    frontier = labels
    for _ in rounds():
        offered = frontier.select(F.col("id").alias("src"), "label").join(arcs, "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("new"))
        before, frontier = frontier, materialise(offered.join(labels, "id").where("new < label").select("id", F.col("new").alias("label")), "colour")
        if frontier.isEmpty():
            break
        older, labels = labels, materialise(labels.join(frontier.select("id"), "id", "left_anti").unionByName(frontier), "colour")
        discard(before, older)
    return labels


def _coloured(graph: Graph, members: DataFrame) -> DataFrame:
    """Strong components by trimming, then by forward and backward searches from many pivots at once.

    Vertices on or behind no cycle, or before none, are components of their own; topological orders of the graph and its
    reverse find them all. Of the rest, v is with its colour c, the least vertex that reaches it, iff v reaches c within the colour.
    """
    left, parts = materialise(members.select("id"), "left"), None
    for ends in (("src", "dst"), ("dst", "src")):
        arcs = graph.arcs.select("arc_id", *(F.col(a).alias(b) for a, b in zip(ends, ("src", "dst"), strict=True)))
        inside = arcs.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi")
        inside = materialise(inside, "inside")
        alone = topological_ranks(Graph(left, inside))
        part = materialise(alone.select("id", F.col("id").alias("component")), "strong")
        if parts is None:
            parts = Accumulated(part)
        else:
            parts.add(part)
        older, left = left, materialise(left.join(part.select("id"), "id", "left_anti"), "left")
        discard(older, inside)
    for _ in rounds():
        if left.isEmpty():
            break
        ends = left.select(F.col("id").alias("src"))
        inside = graph.arcs.select("src", "dst").join(ends, "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
        inside = materialise(inside, "inside")
        colours = _least_reaching(inside, left.select("id", F.col("id").alias("label")))
        same = inside.join(colours.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(colours.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        back = materialise(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "back")
        found = breadth_first_search(Graph(left, back.withColumn("arc_id", F.lit(0))), colours.where("id = label").select("id"))
        part = materialise(found.select("id").join(colours, "id").select("id", F.col("label").alias("component")), "strong")
        parts.add(part)
        older, left = left, materialise(left.join(part.select("id"), "id", "left_anti"), "left")
        discard(older, inside, back)
    return parts.table()


def component_order(graph: Graph, strong: DataFrame) -> DataFrame:
    """``component, component_id``: dense ids with id(src) >= id(dst) on every arc (reverse topological order)."""
    c = materialise(strong, "strong")
    arcs = graph.arcs.join(c.select(F.col("id").alias("src"), F.col("component").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("component").alias("b")), "dst")
    condensed = arcs.where("a <> b").select(F.col("b").alias("src"), F.col("a").alias("dst")).distinct()
    order = topological_sort(Graph(c.select(F.col("component").alias("id")).distinct(), condensed.withColumn("arc_id", F.monotonically_increasing_id())))
    return numbered(order.select(F.col("id").alias("component"), "rank"), "component_id", "rank", "component").drop("rank")
