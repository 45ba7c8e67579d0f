"""Hashes of pairs worked out side by side, and the random graph that is listed from their bits."""

from hashlib import md5

import pytest

from arcspark.functions import md5 as M
from arcspark.sources import builders


def bits(u, v):
    return int(md5(f"{u},{v}".encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("sources, targets", [((0, 7), (0, 10)), ((5, 6), (10, 100)), ((98, 100), (1000, 1030)), ((123_456, 123_459), (100_000, 100_040)), ((10**18, 10**18 + 2), (10**18 + 5, 10**18 + 9))])
def test_first_bits(sources, targets):
    assert M.first_bits(sources, targets).tolist() == [[bits(u, v) for v in range(*targets)] for u in range(*sources)]


def test_runs_have_one_number_of_digits():
    assert M.runs(0, 12, 4) == [(0, 4), (4, 8), (8, 10), (10, 12)] and M.runs(7, 8) == [(7, 8)] and M.runs(0, 0) == []
    with pytest.raises(ValueError):
        M.first_bits((0, 1), (9, 11))


@pytest.mark.parametrize("run, sources, at_once", [(1 << 14, 256, 32), (50, 7, 3)])
def test_arcs_are_listed_from_bits(spark, monkeypatch, run, sources, at_once):
    """A row is written for a source and a run of targets, none for an arc, and arcs keep their ranks."""
    n, most = 130, 1 << 30
    monkeypatch.setattr(M, "RUN", run)
    monkeypatch.setattr(builders, "SOURCES", sources)
    monkeypatch.setattr(builders, "AT_ONCE", at_once)
    write, written = builders.materialise, []
    monkeypatch.setattr(builders, "materialise", lambda df, name: written.append(write(df, name)) or written[-1])
    found = builders.erdos_renyi_md5(spark, n, most).arcs
    want = [(u, v) for u in range(n) for v in range(n) if u != v and bits(u, v) < most]
    assert sorted(tuple(r) for r in found.collect()) == [(k, u, v) for k, (u, v) in enumerate(want)]
    assert written[0].count() == n * len(M.runs(0, n, run)) and found.dtypes == [("arc_id", "bigint"), ("src", "bigint"), ("dst", "bigint")]


def test_few_vertices(spark):
    for n in (0, 1, 2):
        assert builders.erdos_renyi_md5(spark, n, 1 << 32).arcs.count() == n * (n - 1)
