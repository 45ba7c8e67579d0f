"""Components under insertions, trimmed strong components and Pareto fronts, against plain algorithms."""

from graphs import graph, ids, rows

from arcspark.operators import paths, traverse
from arcspark.operators.components import component_labels, merge_edges


def test_batches_of_edges(spark, rng):
    """After each batch the labels are those of all edges so far."""
    def table(edges):
        return spark.createDataFrame(edges, "src long, dst long")

    n, seen = 70, [(1, 2), (5, 5)]
    labels = component_labels(table(seen))
    for size in (6, 40):
        batch = [(rng.randrange(-5, n), rng.randrange(n)) for _ in range(size)] + [(None, 3), (8, 8)]
        seen += batch
        labels = merge_edges(labels, table(batch))
        whole = dict(rows(component_labels(table(seen))))
        assert dict(rows(labels, "id", "component")) == whole | {v: v for v in {8} - whole.keys()}
    assert rows(merge_edges(labels, table(seen).limit(0)), "id", "component") == rows(labels, "id", "component")


def test_trimming_leaves_the_cycles(spark, rng, monkeypatch):
    """A large acyclic part around two cycles takes no more rounds of searches than the cycles do."""
    before = [(i, i + rng.randrange(1, 4)) for i in range(60)]
    cycles = [(70 + i, 70 + (i + 1) % 8) for i in range(8)] + [(80 + i, 80 + (i + 1) % 3) for i in range(3)]
    arcs = before + cycles + [(10, 70), (73, 80), (82, 90)] + [(90 + i, 91 + i) for i in range(15)]
    g = graph(spark, 110, " ".join(f"{u}-{v}" for u, v in arcs))
    called, least = [], traverse._least_reaching

    def counted(inside, labels):
        called.append(labels.count())
        return least(inside, labels)

    monkeypatch.setattr(traverse, "_least_reaching", counted)
    found = dict(rows(traverse.strongly_connected_components(g, task_arcs=0)))
    assert found == {v: 70 if 70 <= v < 78 else 80 if 80 <= v < 83 else v for v in range(110)}
    assert found[77] == 70 and found[82] == 80 and found[100] == 100
    assert len(called) <= 2 and max(called) == 11


def test_fronts_by_brute_force(spark, rng):
    n, arcs = 12, []
    arcs = [(rng.randrange(12), rng.randrange(12), rng.randrange(6), rng.randrange(6)) for _ in range(45)]
    g = graph(spark, n, " ".join(f"{u}-{v}:{b},{r}" for u, v, b, r in arcs), ("b", "r"))
    fronts, todo = {0: {(0, 0)}, 1: {(3, 0), (0, 2)}}, [0, 1]
    while todo:
        u = todo.pop()
        for s, v, b, r in arcs:
            if s == u:
                every = fronts.get(v, set()) | {(x + b, y + r) for x, y in fronts[u]}
                kept = {p for p in every if not any(q != p and q[0] <= p[0] and q[1] <= p[1] for q in every)}
                if kept != fronts.get(v):
                    fronts[v] = kept
                    todo.append(v)
    seeds = spark.createDataFrame([(0, 0, 0), (1, 3, 0), (1, 0, 2), (1, 4, 1)], "id long, blue long, red long")
    assert rows(paths.pareto_paths(g, "b", "r", seeds)) == sorted((v, *p) for v, at in fronts.items() for p in at)
    assert rows(paths.pareto_paths(g, "b", "r", ids(spark, 0).limit(0))) == []
