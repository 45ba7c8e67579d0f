"""Maximum flow and minimum cut: one exact solver task per problem, and rounds of joins for problems beyond a task."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcspark.graph import Graph, GraphError
from arcspark.operators.traverse import breadth_first_search
from arcspark.plans.fixpoint import per_group, rounds
from arcspark.plans.scratch import discard, materialise, told
from arcspark.sources.builders import numbered

MAX_ARCS = 2_000_000


class _Residual:
    """Residual network by adjacency of arc slots: slot 2k is arc k, slot 2k + 1 its reverse."""

    def __init__(self, arcs: list[tuple[int, int, int | float]]) -> None:
        self.to, self.left, self.at = [], [], {}
        for u, v, capacity in arcs:
            for a, b, c in ((u, v, capacity), (v, u, capacity - capacity)):
                self.at.setdefault(a, []).append(len(self.to))
                self.to.append(b)
                self.left.append(c)

    def levels(self, s: int) -> dict[int, int]:
        """Hops from s over slots with room."""
        level, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for e in self.at.get(u, ()):
                if self.left[e] > 0 and self.to[e] not in level:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        return level

    def reaching(self, t: int) -> set[int]:
        """Vertices from which t can be reached over slots with room."""
        seen, queue = {t}, deque([t])
        while queue:
            v = queue.popleft()
            for e in self.at.get(v, ()):
                if self.left[e ^ 1] > 0 and self.to[e] not in seen:
                    seen.add(self.to[e])
                    queue.append(self.to[e])
        return seen

    def block(self, s: int, t: int) -> bool:
        """Push a blocking flow along levels; False when t is out of reach."""
        level = self.levels(s)
        if t not in level:
            return False
        tried = {u: 0 for u in level}
        path: list[int] = []
        u = s
        while True:
            if u == t:
                room = min(self.left[e] for e in path)
                for k, e in enumerate(path):
                    self.left[e] -= room
                    self.left[e ^ 1] += room
                first = next(k for k, e in enumerate(path) if not self.left[e] > 0)
                u = self.to[path[first] ^ 1]
                del path[first:]
                continue
            slots = self.at.get(u, ())
            while tried[u] < len(slots):
                e = slots[tried[u]]
                if self.left[e] > 0 and level.get(self.to[e]) == level[u] + 1:
                    path.append(e)
                    u = self.to[e]
                    break
                tried[u] += 1
            else:
                if u == s:
                    return True
                e = path.pop()
                u = self.to[e ^ 1]
                tried[u] += 1


def max_flow(arcs: DataFrame, terminals: DataFrame, capacity: str = "capacity", max_arcs: int = MAX_ARCS) -> DataFrame:
    """``problem_id, arc_id, src, dst, capacity, flow, source_cut, target_cut`` for every arc.

    ``arcs``: problem_id, arc_id, src, dst and capacities; ``terminals``: problem_id, s, t.
    Flows are those of blocking flows along shortest augmenting paths, arcs in order of id, and of ``_by_rounds``
    for problems of more than ``max_arcs`` arcs, so they are the same on every run. ``source_cut`` marks the arcs that leave the set reachable
    from s in the residual network, ``target_cut`` those that enter the set that reaches t; both
    are minimum cuts. GraphError: negative or null capacities, or s = t.
    """
    c = F.col(capacity)
    if not arcs.where(c.isNull() | (c < 0)).isEmpty():
        raise GraphError("capacities must be 0 or more")
    if not terminals.where("s is null or t is null or s = t").isEmpty():
        raise GraphError("a problem needs two different terminals")
    kinds = dict(arcs.dtypes)
    kind = kinds[capacity]
    rows = arcs.select("problem_id", "arc_id", "src", "dst", c.alias("capacity")).join(terminals.select("problem_id", "s", "t"), "problem_id")
    large = materialise(rows.groupBy("problem_id").count().where(F.col("count") > max_arcs).select("problem_id"), "large")
    none_large = large.isEmpty()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("arc_id").reset_index(drop=True)
        s, t = int(pdf.s.iloc[0]), int(pdf.t.iloc[0])
        net = _Residual(list(zip(pdf.src.tolist(), pdf.dst.tolist(), pdf.capacity.tolist(), strict=True)))
        while net.block(s, t):
            pass
        near, far = set(net.levels(s)), net.reaching(t)
        pdf["flow"] = [net.left[2 * k + 1] for k in range(len(pdf))]
        pdf["source_cut"] = [u in near and v not in near for u, v in zip(pdf.src, pdf.dst, strict=True)]
        pdf["target_cut"] = [u not in far and v in far for u, v in zip(pdf.src, pdf.dst, strict=True)]
        return pdf[["problem_id", "arc_id", "src", "dst", "capacity", "flow", "source_cut", "target_cut"]]

    schema = f"problem_id {kinds['problem_id']}, arc_id long, src long, dst long, capacity {kind}, flow {kind}, source_cut boolean, target_cut boolean"
    if none_large:
        return per_group(rows, "problem_id", solve, schema, max_arcs)
    done = per_group(rows.join(large, "problem_id", "left_anti"), "problem_id", solve, schema, max_arcs)
    return done.unionByName(_by_rounds(rows.join(large, "problem_id", "left_semi"), kind))


def _with_room(arcs: DataFrame, sent: DataFrame) -> DataFrame:
    """``arc_id, src, dst``: arcs along which more can be sent, and the other way those from which some can be taken back; ``arc_id`` is the key."""
    full = told(sent.where("flow >= capacity").select("key"))
    ahead = arcs.select("key", "src", "dst").join(full, "key", "left_anti")
    return ahead.unionByName(sent.select("key", F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("key", "arc_id")


def _reached(vertices: DataFrame, residual: DataFrame, start: DataFrame, towards: bool) -> DataFrame:
    """``id, dist``: hops from ``start`` over arcs with room, or to it."""
    ends = (F.col("dst").alias("src"), F.col("src").alias("dst")) if towards else ("src", "dst")
    return breadth_first_search(Graph(vertices, residual.select("arc_id", *ends)), start).select("id", "dist")


def _by_rounds(rows: DataFrame, kind: str) -> DataFrame:
    """Large problems, all at once, by push and relabel in rounds of joins.

    Every arc from a source is filled; a vertex that gets more than it gives sends the excess on, over arcs
    with room to vertices one hop nearer to its target (or back to the source, where the target is out of reach), in
    order of arc id. When no excess can move, hops are found anew by searches in the residual network. A round
    sends each vertex's excess one hop further, all vertices at a time. Real capacities count in units of 1e-10.
    Arcs are written once; a round writes those that carry flow only, and reads the others without a shuffle while few vertices have excess.
    """
    exact = "decimal(38,10)" if kind in ("double", "float") else "decimal(38,0)" if kind in ("bigint", "int", "smallint", "tinyint") else kind
    pairs = materialise(rows.select("problem_id", "s", "t").distinct(), "pairs")
    ends = rows.select("problem_id", F.col("src").alias("v")).unionByName(rows.select("problem_id", F.col("dst").alias("v")))
    ends = ends.unionByName(pairs.select("problem_id", F.explode(F.array("s", "t")).alias("v"))).distinct()
    names = materialise(numbered(ends, "id", "problem_id", "v"), "names")
    n = names.count()
    at = lambda end: told(names.select("problem_id", F.col("v").alias(end), F.col("id").alias(f"{end}_id")), n)
    known = rows.select("problem_id", "arc_id", "src", "dst", F.col("capacity").cast(exact).alias("capacity"))
    for end in ("src", "dst"):
        known = known.join(at(end), ["problem_id", end])
    known = materialise(known.withColumn("key", F.monotonically_increasing_id()), "problem")
    sources, targets = (materialise(pairs.join(at(x), ["problem_id", x]).select(F.col(f"{x}_id").alias("id")).distinct(), "terminals") for x in "st")
    vertices, terminals = names.select("id"), told(sources.unionByName(targets), 2 * sources.count())
    arcs = known.where("src_id <> dst_id and capacity > 0").select("key", "arc_id", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "capacity")

    sent = materialise(arcs.join(told(sources.withColumnRenamed("id", "src")), "src", "left_semi").select(*arcs.columns, F.col("capacity").alias("flow")), "flow")
    excess = sent.groupBy(F.col("dst").alias("id")).agg(F.sum("flow").cast(exact).alias("excess")).join(terminals, "id", "left_anti")
    excess = materialise(excess, "excess")
    labels = None
    for _ in rounds():
        n_excess = excess.count()
        if not n_excess:
            break
        moved = None
        if labels is not None:
            moved = _pushed(arcs, sent, excess, labels, (n_excess, n), exact)
        if moved is None:
            if labels is not None:
                discard(labels)
            residual = _with_room(arcs, sent)
            near = materialise(_reached(vertices, residual, targets, True), "near")
            # what can't reach a target has its way home among its like
            apart = residual.join(told(near.select(F.col("id").alias("src"))), "src", "left_anti")
            home = _reached(vertices, apart, sources, True).join(told(near.select("id")), "id", "left_anti").select("id", (F.col("dist") + n).alias("hops"))
            nearer = near.join(told(sources), "id", "left_anti").select("id", F.col("dist").alias("hops"))
            labels = materialise(nearer.unionByName(home).unionByName(near.join(told(sources), "id", "left_semi").select("id", F.lit(n).cast("long").alias("hops"))), "hops")
            moved = _pushed(arcs, sent, excess, labels, (n_excess, n), exact)
            if moved is None:
                raise GraphError("excess that can't move")
        ahead = F.col("way") == 1
        more = moved.select(
            "key", "arc_id", F.when(ahead, F.col("u")).otherwise(F.col("v")).alias("src"), F.when(ahead, F.col("v")).otherwise(F.col("u")).alias("dst"),
            "capacity", (F.col("way") * F.col("amount")).cast(exact).alias("flow"),
        )
        gains = moved.select(F.col("v").alias("id"), F.col("amount").alias("x")).unionByName(moved.select(F.col("u").alias("id"), (-F.col("amount")).cast(exact).alias("x")))
        gains = gains.unionByName(excess.select("id", F.col("excess").alias("x"))).groupBy("id").agg(F.sum("x").cast(exact).alias("excess"))
        older = sent, excess, moved
        sums = sent.unionByName(more).groupBy(*arcs.columns).agg(F.sum("flow").cast(exact).alias("flow"))
        sent = materialise(sums.where("flow > 0"), "flow")
        excess = materialise(gains.where("excess > 0").join(terminals, "id", "left_anti"), "excess")
        discard(*older)

    residual = _with_room(arcs, sent)
    near = _reached(vertices, residual, sources, False).select("id", F.lit(True).alias("near"))
    far = _reached(vertices, residual, targets, True).select("id", F.lit(True).alias("far"))
    sides = materialise(vertices.join(near, "id", "left").join(far, "id", "left").select("id", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("far", F.lit(False)).alias("far")), "sides")
    cut = known.join(told(sent.select("key", "flow")), "key", "left")
    for end in ("src", "dst"):
        cut = cut.join(told(sides.select(F.col("id").alias(f"{end}_id"), F.col("near").alias(f"{end}_near"), F.col("far").alias(f"{end}_far")), n), f"{end}_id")
    return cut.select(
        "problem_id", "arc_id", "src", "dst", F.col("capacity").cast(kind).alias("capacity"), F.coalesce("flow", F.lit(0).cast(exact)).cast(kind).alias("flow"),
        (F.col("src_near") & ~F.col("dst_near")).alias("source_cut"), (~F.col("src_far") & F.col("dst_far")).alias("target_cut"),
    )


def _pushed(arcs: DataFrame, sent: DataFrame, excess: DataFrame, labels: DataFrame, sizes: tuple[int, int], exact: str) -> DataFrame | None:
    """``key, arc_id, way, u, v, capacity, amount``: the excess of each vertex over its arcs (way 1) and back along flows to it (way -1).

    They lead to vertices one hop nearer, in order of arc id. None if no excess can move. ``sizes``: rows of excess and, at most, of labels.
    """
    n, n_labels = sizes
    mine = told(labels.join(told(excess, n), "id").select(F.col("id").alias("u"), "excess", F.col("hops").alias("high")), n)
    ahead = mine.join(arcs.withColumnsRenamed({"src": "u", "dst": "v"}), "u").join(told(sent.select("key", "flow")), "key", "left")
    ahead = ahead.withColumns({"way": F.lit(1), "room": (F.col("capacity") - F.coalesce("flow", F.lit(0).cast(exact))).cast(exact)}).drop("flow")
    back = mine.join(sent.withColumnsRenamed({"dst": "u", "src": "v"}), "u").withColumn("way", F.lit(-1)).withColumnRenamed("flow", "room")
    fit = ahead.unionByName(back).where("room > 0").join(told(labels.select(F.col("id").alias("v"), F.col("hops").alias("low")), n_labels), "v").where("high = low + 1")
    order = W.partitionBy("u").orderBy("arc_id", "way", "key").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("room").over(order), F.lit(0))
    amount = F.least(F.col("room"), F.col("excess") - F.col("before")).cast(exact)
    moved = fit.withColumn("before", before).where("before < excess").select("key", "arc_id", "way", "u", "v", "capacity", amount.alias("amount"))
    moved = materialise(moved, "moved")
    if moved.isEmpty():
        discard(moved)
        return None
    return moved


def flow_value(flows: DataFrame, terminals: DataFrame) -> DataFrame:
    """``problem_id, value``: what leaves s less what returns to it; 0 without arcs at s."""
    at = terminals.select("problem_id", "s")
    net = F.when(F.col("src") == F.col("s"), F.col("flow")).otherwise(0) - F.when(F.col("dst") == F.col("s"), F.col("flow")).otherwise(0)
    sums = flows.join(at, "problem_id").groupBy("problem_id").agg(F.sum(net).alias("value"))
    return at.select("problem_id").join(sums, "problem_id", "left").select("problem_id", F.coalesce("value", F.lit(0)).alias("value"))


def minimum_cut(flows: DataFrame, side: str = "source") -> DataFrame:
    """``problem_id, arc_id, src, dst, capacity`` of the cut nearest the source, or the target."""
    if side not in ("source", "target"):
        raise GraphError("side is source or target")
    return flows.where(f"{side}_cut").select("problem_id", "arc_id", "src", "dst", "capacity")
