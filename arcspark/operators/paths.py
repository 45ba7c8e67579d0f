"""Shortest paths over semirings, and their relatives, by rounds of relaxation.

A round extends only labels that improved, picks the best offer for each vertex (map-side
first), keeps it where it beats the vertex's label, and writes these improvements only. For values that ``plus`` never
improves and whose order it keeps, the fixpoint is that of settling vertices in order. Lengths that add up
are settled in buckets, which gives bounds for ending a search early.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcspark.functions.semiring import SHORTEST_PATH, Semiring
from arcspark.graph import Graph, GraphError
from arcspark.operators.traverse import breadth_first_search
from arcspark.plans.fixpoint import COMPACT_EVERY, Accumulated, per_group, rounds
from arcspark.plans.scratch import discard, materialise
from arcspark.sources.builders import numbered

#: The width of a bucket, in means of the arcs' lengths.
DELTA_MEANS = 4


def _checked(graph: Graph, weight: str | Column, semiring: Semiring = SHORTEST_PATH) -> DataFrame:
    """``arc_id, src, dst, w``; raises GraphError for null, NaN or values outside the semiring's domain."""
    value = F.col(weight) if isinstance(weight, str) else weight
    arcs = graph.arcs.select("arc_id", "src", "dst", value.alias("w"))
    bad = F.col("w").isNull()
    if dict(arcs.dtypes)["w"] in ("double", "float"):
        bad = bad | F.isnan("w")
    low, high = semiring.domain
    if low is not None:
        bad = bad | (F.col("w") < low)
    if high is not None:
        bad = bad | (F.col("w") > high)
    if not arcs.where(bad).isEmpty():
        raise GraphError(f"arc values must be within {semiring.domain} for {semiring.name}")
    return arcs


def _seeds(graph: Graph, sources: DataFrame, semiring: Semiring) -> DataFrame:
    """``id, dist``: the best offset of each source that is a vertex."""
    offset = F.col("offset") if "offset" in sources.columns else semiring.zero()
    at = sources.select("id", offset.alias("dist")).groupBy("id").agg(semiring.choose(F.col("dist")).alias("dist"))
    return at.join(graph.vertices.select("id"), "id", "left_semi")


class Labels:
    """The best label of each vertex, from written tables of improvements; many of them are merged into one."""

    def __init__(self, first: DataFrame, semiring: Semiring) -> None:
        self.parts, self.semiring = [first], semiring

    def add(self, part: DataFrame) -> None:
        """A round writes what improved; the rest stays as it is written."""
        if len(self.parts) >= COMPACT_EVERY:
            merged = materialise(self.table(), "labels")
            discard(*self.parts[:-1])  # the last is what the next round goes on from
            self.parts = [merged]
        self.parts.append(part)

    def table(self) -> DataFrame:
        """``id, dist``"""
        if len(self.parts) == 1:
            return self.parts[0]
        every = self.parts[0]
        for part in self.parts[1:]:
            every = every.unionByName(part)
        return every.groupBy("id").agg(self.semiring.choose(F.col("dist")).alias("dist"))


class Search:
    """Labels settled bucket by bucket (delta-stepping).

    A bucket holds the labels of lengths from the least open one up to ``delta`` more. Arcs of at most ``delta``
    are relaxed within it until nothing improves; longer ones then once, as they lead to later buckets only.
    When a bucket ends, all labels below ``bound`` are settled. Without ``length`` (of a label; for
    values that don't add up) there is one bucket of everything.
    """

    def __init__(self, arcs: DataFrame, seeds: DataFrame, semiring: Semiring, within: Column | None = None, length: Callable[[Column], Column] | None = None, delta: float | None = None) -> None:
        self.semiring, self.within, self.length, self.delta = semiring, within, length, delta
        self.labels, self.bound, self.light, self.heavy = Labels(materialise(seeds, "labels"), semiring), None, arcs, None
        if length is not None:
            told = arcs.agg(F.avg("w"), F.max("w")).first()
            self.delta = delta if delta is not None else DELTA_MEANS * float(told[0] or 1) or 1.0
            if told[1] is not None and told[1] > self.delta:
                self.light, self.heavy = arcs.where(F.col("w") <= F.lit(self.delta)), arcs.where(F.col("w") > F.lit(self.delta))

    def _relax(self, frontier: DataFrame, arcs: DataFrame) -> DataFrame | None:
        """One round: what improved, written; None if nothing did."""
        offers = frontier.select(F.col("id").alias("src"), "dist").join(arcs, "src").select(F.col("dst").alias("id"), self.semiring.plus(F.col("dist"), F.col("w")).alias("new"))
        if self.within is not None:
            offers = offers.where(self.within)
        best = offers.groupBy("id").agg(self.semiring.choose(F.col("new")).alias("new"))
        won = best.join(self.labels.table(), "id", "left").where(F.col("dist").isNull() | self.semiring.better(F.col("new"), F.col("dist")))
        part = materialise(won.select("id", F.col("new").alias("dist")), "labels")
        if part.isEmpty():
            discard(part)
            return None
        self.labels.add(part)
        return part

    def advance(self) -> bool:
        """Settle the next bucket; False if no label is open."""
        frontier, inside = self.labels.table(), None
        if self.length is not None:
            at = self.length(F.col("dist"))
            least = (frontier if self.bound is None else frontier.where(at >= F.lit(self.bound))).agg(F.min(at)).first()[0]
            if least is None:
                return False
            self.bound = float(least) + self.delta
            inside = (at >= F.lit(least)) & (at < F.lit(self.bound))
            frontier = frontier.where(inside)
        for _ in rounds():
            part = self._relax(frontier, self.light)
            if part is None:
                break
            frontier = part if inside is None else part.where(inside)
        if self.heavy is not None:
            self._relax(self.labels.table().where(inside), self.heavy)
        return inside is not None

    def run(self) -> DataFrame:
        for _ in rounds():
            if not self.advance():
                break
        return self.labels.table()


def _itself(label: Column) -> Column:
    return label


def _tight(arcs: DataFrame, labels: DataFrame, semiring: Semiring) -> DataFrame:
    """Arcs on which the target's label is the source's extended."""
    ends = arcs.join(labels.select(F.col("id").alias("src"), F.col("dist").alias("a")), "src").join(labels.select(F.col("id").alias("dst"), F.col("dist").alias("b")), "dst")
    return ends.where(semiring.plus(F.col("a"), F.col("w")) == F.col("b")).select("arc_id", "src", "dst")


def shortest_paths(
    graph: Graph, weight: str | Column, sources: DataFrame, semiring: Semiring = SHORTEST_PATH,
    store_paths: bool = False, max_dist: float | None = None, targets: DataFrame | None = None, limit: int | None = None, delta: float | None = None,
) -> DataFrame:
    """``id, dist`` (and ``pred_arc, pred_vertex``) of the vertices reached from ``sources`` (id[, offset]).

    Of equally good predecessors the search over tight arcs takes the fewest hops from a
    source, then the least arc id, so paths end also where arcs of value zero form cycles.

    Three early ends, of which the last two need lengths that add up: ``max_dist`` stops at this value
    (inclusive); ``targets`` (id) ends the search once all of them are settled, and gives the vertices no farther
    than the farthest of them (all vertices, if one isn't reached); ``limit`` gives the first so many vertices in
    the order in which they are settled, by (dist, id). ``delta`` is the width of a bucket.
    """
    adds = semiring is SHORTEST_PATH
    if (targets is not None or limit is not None) and not adds:
        raise GraphError("an early end needs lengths that add up")
    arcs = materialise(_checked(graph, weight, semiring), "arcs")
    seeds = materialise(_seeds(graph, sources, semiring), "seeds")
    within = None
    if max_dist is not None:
        within = F.col("new") <= max_dist if semiring.best == "min" else F.col("new") >= max_dist
    search = Search(arcs, seeds, semiring, within, _itself if adds else None, delta)
    if targets is None and limit is None:
        labels = search.run()
    else:
        labels = _until(search, targets, limit)
    if not store_paths:
        return labels
    labels = materialise(labels, "labels")
    roots = seeds.join(labels, ["id", "dist"], "left_semi").select("id")
    tree = breadth_first_search(Graph(labels.select("id"), materialise(_tight(arcs, labels, semiring), "tight")), roots)
    return labels.join(tree.select("id", "pred_arc", "pred_vertex"), "id", "left")


def _until(search: Search, targets: DataFrame | None, limit: int | None) -> DataFrame:
    """The settled labels that were asked for, with no bucket more than they take."""
    wanted = None if targets is None else materialise(targets.select("id").distinct(), "targets")
    asked = 0 if wanted is None else wanted.count()
    farthest = None
    for _ in rounds():
        if limit is not None and limit <= 0 or not search.advance():
            break
        settled = search.labels.table().where(F.col("dist") < F.lit(search.bound))
        if limit is not None and settled.count() >= limit:
            break
        if wanted is not None:
            met = settled.join(wanted, "id", "left_semi").agg(F.count("*"), F.max("dist")).first()
            if met[0] == asked:
                farthest = met[1]
                break
    found = search.labels.table()
    if search.bound is not None:
        found = found.where(F.col("dist") < F.lit(search.bound))
    if farthest is not None:
        found = found.where(F.col("dist") <= F.lit(farthest))
    if asked == 0 and wanted is not None:
        found = found.limit(0)
    return found if limit is None else numbered(found, "pos", "dist", "id").where(F.col("pos") < max(limit, 0)).select("id", "dist")


def path_to(found: DataFrame, targets: DataFrame) -> DataFrame:
    """``target, pos, arc_id``: the arcs of the path to each target (id), pos from 0 at the source.

    Jumps over 1, 2, 4, ... predecessors are joined from each other; adding to the places found
    so far those one jump further, longest jump first, gives the whole path in a number of
    rounds that grows as the logarithm of its length.
    """
    step = found.select("id", "pred_arc", F.col("pred_vertex").alias("back")).where("pred_arc is not null")
    jumps = [materialise(step.select("id", "back"), "jumps")]
    while not jumps[-1].isEmpty():
        last = jumps[-1]
        jumps.append(materialise(last.join(last.select(F.col("id").alias("back"), F.col("back").alias("_further")), "back").select("id", F.col("_further").alias("back")), "jumps"))
    places = targets.select(F.col("id").alias("target"), F.col("id").alias("at"), F.lit(0).cast("long").alias("behind")).distinct()
    for k in range(len(jumps) - 2, -1, -1):
        further = places.join(jumps[k], places["at"] == jumps[k]["id"]).select("target", F.col("back").alias("at"), (F.col("behind") + (1 << k)).alias("behind"))
        places = materialise(places.unionByName(further), "places")
    arcs = places.join(step.select(F.col("id").alias("at"), "pred_arc"), "at")
    length = F.count("*").over(W.partitionBy("target"))
    return arcs.select("target", (length - 1 - F.col("behind")).alias("pos"), F.col("pred_arc").alias("arc_id"))


def bidirectional_shortest_path(
    graph: Graph, weight: str | Column, sources: DataFrame, targets: DataFrame, delta: float | None = None, settled: list[int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """One source-to-target distance by two searches: a row (dist), null if none, and the path's (pos, arc_id).

    The side that is settled less far goes on, bucket by bucket, and only keeps labels below the best meeting found so
    far. A path that isn't met yet is at least as long as both sides' bounds together, so the search ends when these
    reach the best meeting. A vertex that is both a source and a target is a path of no arcs. ``settled``
    is given the number of labels of each side.
    """
    arcs = materialise(_checked(graph, weight), "arcs")
    back = arcs.select("arc_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    seeds = [materialise(_seeds(graph, ends, SHORTEST_PATH), "seeds") for ends in (sources, targets)]
    sides = [Search(one, at, SHORTEST_PATH, None, _itself, delta) for one, at in zip((arcs, back), seeds, strict=True)]
    best = None
    for k in rounds():
        both = [side.labels.table() for side in sides]
        met = both[0].join(both[1].select("id", F.col("dist").alias("other")), "id").agg(F.min(F.col("dist") + F.col("other"))).first()[0]
        if met is not None and (best is None or met < best):
            best = met
            for side in sides:
                side.within = F.col("new") < F.lit(best)
        bounds = [side.bound or 0.0 for side in sides]
        if best is not None and sum(bounds) >= best or not sides[bounds[1] < bounds[0]].advance():
            break  # a side with nothing open has met all that it can
    labels = [materialise(side.labels.table(), "labels") for side in sides]
    if settled is not None:
        settled += [x.count() for x in labels]
    dist = graph.spark.createDataFrame([(best,)], "dist long" if best is None or isinstance(best, int) else "dist double")
    middle = labels[0].join(labels[1].select("id", F.col("dist").alias("other")), "id").where(F.col("dist") + F.col("other") == (best if best is not None else -1))
    at = materialise(middle.orderBy("id").limit(1).select("id"), "middle")
    halves = []
    for side in range(2):
        tight = Graph(graph.vertices, _tight((arcs, back)[side], labels[side], SHORTEST_PATH))
        roots = seeds[side].join(labels[side], ["id", "dist"], "left_semi").select("id")
        halves.append(path_to(breadth_first_search(tight, roots), at))
    first = halves[0].select("pos", "arc_id")
    n = first.agg(F.count("*").alias("n"))
    m = halves[1].agg(F.count("*").alias("m"))
    second = halves[1].join(F.broadcast(n)).join(F.broadcast(m)).select((F.col("n") + F.col("m") - 1 - F.col("pos")).alias("pos"), "arc_id")
    return dist, first.unionByName(second)


def network_voronoi(graph: Graph, weight: str | Column, kernels: DataFrame) -> DataFrame:
    """``id, dist, kernel``: the nearest kernel (id) of each reached vertex, the least of equally near ones."""
    arcs = materialise(_checked(graph, weight), "arcs")
    pair = Semiring(
        "nearest", lambda: F.lit(0), lambda a, w: F.struct((a["dist"] + w).alias("dist"), a["kernel"].alias("kernel")), "min"
    )
    zero = F.lit(0).cast(dict(arcs.dtypes)["w"])
    seeds = kernels.select("id").distinct().join(graph.vertices.select("id"), "id", "left_semi")
    first = seeds.select("id", F.struct(zero.alias("dist"), F.col("id").alias("kernel")).alias("dist"))
    found = Search(arcs, first, pair, None, lambda label: label["dist"]).run()
    return found.select("id", F.col("dist.dist").alias("dist"), F.col("dist.kernel").alias("kernel"))


def pareto_paths(graph: Graph, blue: str, red: str, sources: DataFrame, max_labels: int = 100_000) -> DataFrame:
    """``id, blue, red``: the labels of every vertex that no other label is as good as in both.

    ``sources``: id[, blue, red]. Raises GraphError where a vertex has over ``max_labels``.
    """
    _checked(graph, blue), _checked(graph, red)
    arcs = materialise(graph.arcs.select("src", "dst", F.col(blue).alias("b"), F.col(red).alias("r")), "arcs")
    zero = F.lit(0).cast("long")
    seeds = sources.select("id", *(F.col(c).alias(c) if c in sources.columns else zero.alias(c) for c in ("blue", "red")))

    def pruned(labels: DataFrame) -> DataFrame:
        ordered = W.partitionBy("id").orderBy("blue", "red")
        before = F.min("red").over(ordered.rowsBetween(W.unboundedPreceding, -1))
        return labels.withColumn("_m", before).where("_m is null or _m > red").drop("_m")

    kept = materialise(pruned(seeds.join(graph.vertices.select("id"), "id", "left_semi").distinct()), "front")
    fresh = kept
    for _ in rounds():
        offers = fresh.select(F.col("id").alias("src"), "blue", "red").join(arcs, "src").select(F.col("dst").alias("id"), (F.col("blue") + F.col("b")).alias("blue"), (F.col("red") + F.col("r")).alias("red"))
        offers = materialise(pruned(offers.distinct()), "offers")  # an offered label that another one beats goes before it meets a front
        met = materialise(kept.join(offers.select("id").distinct(), "id", "left_semi"), "met")
        now = materialise(pruned(met.unionByName(offers).distinct()), "front")
        after = materialise(now.join(met, ["id", "blue", "red"], "left_anti"), "fresh")
        if after.isEmpty():
            break
        if (now.groupBy("id").count().agg(F.max("count")).first()[0] or 0) > max_labels:
            raise GraphError(f"a vertex has over {max_labels} labels")
        changed = after.select("id").distinct()
        older, kept = kept, materialise(kept.join(changed, "id", "left_anti").unionByName(now.join(changed, "id", "left_semi")), "front")
        discard(offers, met, now, older, *(() if fresh is older else (fresh,)))
        fresh = after
    return kept


def is_dominated(fronts: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` (id, blue, red) with ``dominated``: some kept label is as good in both and different."""
    kept = fronts.select(F.col("id").alias("_id"), F.col("blue").alias("_b"), F.col("red").alias("_r"))
    mine = labels.select("id", "blue", "red").distinct()
    on = (F.col("id") == F.col("_id")) & (F.col("_b") <= F.col("blue")) & (F.col("_r") <= F.col("red")) & ((F.col("_b") != F.col("blue")) | (F.col("_r") != F.col("red")))
    hit = mine.join(kept, on, "left_semi").withColumn("dominated", F.lit(True))
    return labels.join(hit, ["id", "blue", "red"], "left").withColumn("dominated", F.coalesce("dominated", F.lit(False)))


def competing_searches(
    graph: Graph, blue: str, red: str, blue_sources: DataFrame, red_sources: DataFrame, task_arcs: int = 2_000_000
) -> DataFrame:
    """``id, dist`` of the vertices that the blue search reaches before the red one; blue wins ties.

    A vertex's claim extends with its own colour's lengths, so a better entry may lead to worse
    ones and labels can't be merged by a minimum: claims are settled in order. Up to
    ``task_arcs`` arcs a heap in one task does it; beyond, a round for each (distance, colour).
    """
    _checked(graph, blue), _checked(graph, red)
    zero = F.lit(0).cast("long")
    seeds = None
    for colour, rows in enumerate((blue_sources, red_sources)):
        offset = F.col("offset").cast("long") if "offset" in rows.columns else zero
        part = rows.select("id", offset.alias("dist"), F.lit(colour).alias("colour"))
        seeds = part if seeds is None else seeds.unionByName(part)
    seeds = seeds.join(graph.vertices.select("id"), "id", "left_semi").groupBy("id").agg(F.min(F.struct("dist", "colour")).alias("c"))
    arcs = graph.arcs.select("src", "dst", F.col(blue).cast("long").alias("b"), F.col(red).cast("long").alias("r"))
    if arcs.limit(task_arcs + 1).count() > task_arcs:
        return _settled_in_rounds(arcs, seeds)
    rows = arcs.select(F.lit(0).alias("g"), "src", "dst", "b", "r").unionByName(
        seeds.select(F.lit(0).alias("g"), F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.col("c.dist").alias("b"), F.col("c.colour").cast("long").alias("r"))
    )

    def race(pdf: pd.DataFrame) -> pd.DataFrame:
        heap = [(int(x.b), int(x.r), int(x.src)) for x in pdf[pdf.dst.isna()].itertuples()]
        out: dict[int, list[tuple[int, int, int]]] = {}
        for x in pdf[pdf.dst.notna()].itertuples():
            out.setdefault(int(x.src), []).append((int(x.dst), int(x.b), int(x.r)))
        heapq.heapify(heap)
        settled: dict[int, tuple[int, int]] = {}
        while heap:
            dist, colour, u = heapq.heappop(heap)
            if u in settled:
                continue
            settled[u] = (dist, colour)
            for v, *lengths in out.get(u, ()):
                if v not in settled:
                    heapq.heappush(heap, (dist + lengths[colour], colour, v))
        return pd.DataFrame([(u, d) for u, (d, c) in settled.items() if not c], columns=["id", "dist"]).astype("int64")

    return per_group(rows, "g", race, "id long, dist long", 2 * task_arcs)


def _settled_in_rounds(arcs: DataFrame, seeds: DataFrame) -> DataFrame:
    arcs = materialise(arcs, "arcs")
    open_ = materialise(seeds.select("id", F.col("c.dist").alias("dist"), F.col("c.colour").alias("colour")), "open")
    done = None
    for _ in rounds():
        first = open_.agg(F.min(F.struct("dist", "colour")).alias("c"), F.min("colour").alias("any")).first()
        if first.c is None or first.any != 0:
            break
        now = materialise(open_.where((F.col("dist") == first.c.dist) & (F.col("colour") == first.c.colour)), "now")
        if done is None:
            done = Accumulated(now)
        else:
            done.add(now)
        length = F.col("b") if first.c.colour == 0 else F.col("r")
        offers = now.select(F.col("id").alias("src"), "dist", "colour").join(arcs, "src").select(F.col("dst").alias("id"), (F.col("dist") + length).alias("dist"), "colour")
        both = open_.unionByName(offers).join(done.table().select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("dist", "colour")).alias("c"))
        older, open_ = open_, materialise(both.select("id", "c.dist", "c.colour"), "open")
        discard(older)
    empty = seeds.limit(0).select("id", F.lit(0).cast("long").alias("dist"))
    return empty if done is None else done.table().where("colour = 0").select("id", "dist")
