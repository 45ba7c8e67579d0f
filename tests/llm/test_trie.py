import hashlib
import re
import zlib

import pytest

from arcspark.llm import trie
from arcspark.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, label int, depth string, part int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Nodes by their whole sequences, in plain Python."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role, sha(f"{len(role)}:{role}{text}"), (role, text)))
    convs = {c: [t[3] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 * (1 if c >= 0 else -1))
        whole[c] = tuple(convs.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = {}
    for s in sorted(nodes, key=len, reverse=True):
        children = [k for k in out if len(k) == len(s) + 1 and k[:-1] == s]
        words = len(WORD.findall(s[-1][1])) if s else 0
        ends = sha(",".join(map(str, sorted(c for c in nodes[s] if len(whole[c]) == len(s)))))
        leaves = sum(out[k][5] for k in children) or 1
        saved = (len(nodes[s]) - 1) * words + sum(out[k][6] for k in children)
        out[s] = (min(nodes[s]), len(s), min(nodes[s[:-1]]) if s else None, len(nodes[s]), len(children), leaves, saved, ends)
    return sorted(out.values(), key=lambda r: r[:2])


def got(df, **options):
    return sorted((tuple(r) for r in trie.prefix_trie(df, **options).collect()), key=lambda r: r[:2])


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)


def some(rng, convs, turns, words=3):
    out = []
    for c in convs:
        out += [(c, t, rng.choice(["user", "assistant", "", None]), " ".join(rng.choice("ab") for _ in range(rng.randint(0, words)))) for t in range(rng.randint(1, turns))]
    rng.shuffle(out)
    return out


def test_equals_brute_force(spark, rng, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 3)
    rows = some(rng, range(-70, 170), 6, 1)
    want = brute(rows)
    df = conversations(spark, rows)
    assert got(df) == want
    assert got(df.repartition(30)) == want


def test_odd_rows(spark, rng):
    rows = some(rng, [0, 1, 2, 5, 19, 21, 41, 60, 61], 4)
    rows += [(None, 0, "user", "no conversation"), (20, None, None, None), (20, None, "user", "null turn"), (20, 3, "user", "x"), (20, 3, "user", "y"), (20, 3, "a", "z")]
    rows += [(22, 0, "user", "same row")] * 3 + [(80, 5, "user", "word " * 60_000), (81, 1, "user", "\x0b\x0c    é")]
    df = conversations(spark, rows)
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


def test_long_and_hot(spark, rng):
    """One conversation that fills several partitions, and many that are alike."""
    rows = [(3, t, "user", f"turn {t % 5}") for t in range(700)] + [(7, t, "user", f"turn {t % 5}") for t in range(500)] + [(7, 500, "user", "elsewhere")]
    rows += [(100 + i, t, "user", f"hello {t}") for i in range(90) for t in range(3)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert got(conversations(spark, rows)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_runs_compose(rng):
    turns = [(rng.getrandbits(60), rng.getrandbits(60)) for _ in range(50)]

    def run(some, state=(0, 0, 0)):
        for t in some:
            state = trie._chained(state, t)
        return state

    for cut in (0, 1, 20, 50):
        assert trie._joined(run(turns[:cut]), run(turns[cut:])) == run(turns)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = op13_prefix_trie(spark, sf_dir)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in found.dtypes[:-1]} == {"bigint"}
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[:2]) == brute(rows)


@pytest.mark.parametrize("group, heads", [(5, 2), (20, 1)])
def test_other_groups(spark, rng, group, heads):
    """Heads that are never shared: the trie of the conversations as they stand."""
    rows = some(rng, range(40), 4, 1)
    nodes = got(conversations(spark, rows), group=group, heads=heads)
    root = nodes[0]
    assert root[:4] == (0, 0, None, len({r[0] for r in rows}))
    assert root[5] == sum(n[4] == 0 for n in nodes)
    assert sum(n[4] for n in nodes) == len(nodes) - 1
