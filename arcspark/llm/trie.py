"""Operator 13: the prefix trie of conversations, from mergeable partial tries.

Conversations are rebuilt (a group's first turns, then their own), and each distinct sequence of their
first d turns is a node. A node's key is its depth and a polynomial hash of the sequence (twice modulo
2^61 - 1, over SHA-256 of role and text), and no text is moved:

1. *Keys.* Turns are ordered by a range partition, so a conversation of any length is dealt to as
   many tasks as it fills. Each hashes its runs on its own; one row a partition is collected and
   carried into the next one, as hashes of parts compose. A shared head replaced by another
   changes all later keys by a multiple of one difference, so rebuilt turns are keyed without ordering them again.
2. *Partial tries.* Each task combines the nodes it meets (smallest and number of members), and these node
   tables are merged by node key in two levels, so a node of all conversations sends few rows to its last merge.
3. *Paths.* Nodes with the same smallest member c lie on one path, which ends where c ends: a node is
   (c, depth) from here on. What a path sums up to reaches every node above it as c is a member of each.
4. *Rollup.* Sums along a path are suffix sums over depth, again by range partition and carries; the
   totals of the paths that leave it are added to the nodes they pass, one row for each turn. No
   rounds are needed, however deep the trie is.
5. *End lists.* Sorted runs of at most ``RUN`` ids are joined to text in the tasks that hold them; the runs of
   a node are hashed one after the other.

Defined cases: rows with a null ``conv_id`` belong to no conversation; null role or text is empty; null turns
come first; turns of one number are ordered by role and then by the SHA-256 of role and text, so rows
that repeat count as turns of their own; a group without its first conversation has no shared head; a
conversation left without turns is a member of the root; an empty table gives no nodes; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcspark.llm.common import arrow_map, crc32_of, partitions_for, small_batches
from arcspark.plans.scratch import materialise

PRIME, BASES = (1 << 61) - 1, (0x0B4E0EF37BC32127, 0x0318AF2D5A9C0E41)
RUN, MERGES = 50_000, 32
#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"

State = tuple[int, ...]


def _chained(state: State, turn: State) -> State:
    """Number of turns and hashes, after one more turn."""
    return state[0] + 1, *((h * b + d) % PRIME for h, b, d in zip(state[1:], BASES, turn, strict=True))


def _joined(before: State, state: State) -> State:
    """Of two runs one after the other."""
    return before[0] + state[0], *((a * pow(b, state[0], PRIME) + h) % PRIME for a, h, b in zip(before[1:], state[1:], BASES, strict=True))


def _added(before: State, state: State) -> State:
    return (before[0] + state[0],)


def scanned(df: DataFrame, key: str, order: list[Column | str], inputs: list[str], states: list[str], step: Callable, join: Callable) -> DataFrame:
    """``df`` with ``states``: its state after each row of a key's rows in order, begun anew for each key.

    Each partition of a range partition runs on its own from zeros; the state at its end is carried
    into the next one by ``join``, so a key may fill any number of partitions.
    """
    small_batches(df.sparkSession)
    names = df.columns
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *(f"{s} long" for s in states), "part int, opening boolean, closing boolean"])
    zero = (0,) * len(states)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, state, opening, held = TaskContext.get().partitionId(), None, zero, True, None

        def out(batch: pa.RecordBatch, found: list[State], heads: list[bool], closing: bool) -> pa.RecordBatch:
            n = batch.num_rows
            ends = [False] * (n - 1) + [closing]
            columns = [pa.array([s[i] for s in found], pa.int64()) for i in range(len(states))]
            return pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array([part] * n, pa.int32()), pa.array(heads), pa.array(ends)], names=[*batch.schema.names, *states, "part", "opening", "closing"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                yield out(*held, False)
            found, heads = [], []
            for k, *turn in zip(*(batch.column(c).to_pylist() for c in (key, *inputs)), strict=True):
                if k != now:
                    opening, now, state = now is None, k, zero
                state = step(state, turn)
                found.append(state)
                heads.append(opening)
            held = batch, found, heads
        if held:
            yield out(*held, True)

    n = partitions_for(df.sparkSession)
    written = materialise(df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).mapInArrow(local, schema), "runs")
    carried, last, state = {}, None, zero
    for row in written.filter("closing").select("part", key, "opening", *states).orderBy("part").collect():  # one row a partition
        own = tuple(row[s] for s in states)
        carried[row.part] = (last, state)
        state = join(state, own) if row.opening and row[key] == last else own
        last = row[key]

    def carry(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, parts, heads = (batch.column(c).to_pylist() for c in (key, "part", "opening"))
        found = list(zip(*(batch.column(s).to_pylist() for s in states), strict=True))
        for i, (k, p, h) in enumerate(zip(keys, parts, heads, strict=True)):
            if h and carried[p][0] == k:
                found[i] = join(carried[p][1], found[i])
        columns = [pa.array([s[i] for s in found], pa.int64()) for i in range(len(states))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], names=[*names, *states])

    return arrow_map(written, carry, ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *(f"{s} long" for s in states)]))


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, nth, h1, h2, words``: each turn's place from 1 on, and the key of the turns up to it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    number = lambda at: F.conv(F.substring(sha, at, 15), 16, 10).cast("long")
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), number(1).alias("d1"), number(16).alias("d2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.spark_partition_id().alias("copy"),
    )  # ``copy`` deals out rows that are alike
    keyed = scanned(rows, "conv_id", ["turn", "role", "d1", "d2", "copy"], ["d1", "d2"], ["nth", "h1", "h2"], _chained, _joined)
    return keyed.select("conv_id", "nth", "h1", "h2", "words")


def _heads(turns: DataFrame, group: int, heads: int) -> DataFrame:
    """One row a conversation: its own turns, how many it takes from its group's first one, their keys, and the change of its own turns' keys."""
    at = lambda c, i: F.max(F.when(F.col("nth") == i, F.col(c)))
    first = {c: F.array(F.lit(0).cast("long"), *(at(c, i) for i in range(1, heads))) for c in ("h1", "h2", "words")}
    convs = turns.groupBy("conv_id").agg(F.max("nth").alias("n"), *(v.alias(c) for c, v in first.items()))
    convs = convs.withColumn("asked", crc32_of(F.col("conv_id").cast("string")) % heads)
    base = convs.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), *(F.col(c).alias(f"base_{c}") for c in first))
    both = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(base, "base", "left")
    taken = F.least("asked", F.coalesce("base_n", F.lit(0).cast("long")))
    given = F.least("asked", "n")
    none = F.lit(0).cast("long")
    changes = [F.pmod(F.coalesce(F.get(f"base_{h}", taken.cast("int")), none) - F.get(h, given.cast("int")), F.lit(PRIME)).alias(f"change{i}") for i, h in enumerate(("h1", "h2"))]
    shared = [F.slice(F.coalesce(f"base_{c}", F.array(none)), F.lit(1), taken.cast("int") + 1).alias(c) for c in first]
    return both.select("conv_id", "asked", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("asked"), none)).alias("length"), *changes, *shared)


def _rekeyed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Keys of own turns behind another head: the difference of the heads, times the base to the power of turns since."""
    since = batch.column("since").to_pylist()
    out = []
    for i, base in enumerate(BASES):
        keys, changes = batch.column(f"h{i + 1}").to_pylist(), batch.column(f"change{i}").to_pylist()
        out.append(pa.array([(h + c * pow(base, s, PRIME)) % PRIME if c else h for h, c, s in zip(keys, changes, since, strict=True)], pa.int64()))
    return pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("depth"), *out, batch.column("words"), batch.column("last")], names=["conv_id", "depth", "h1", "h2", "words", "last"])


def rebuilt(conversations: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations (``conv_id, length``), and ``conv_id, depth, h1, h2, words, last`` for each turn of them."""
    turns = turns_of(conversations)
    convs = materialise(_heads(turns, group, heads), "heads")
    own = turns.join(convs.select("conv_id", "asked", "taken", "length", "change0", "change1"), "conv_id").filter("nth > asked")
    own = own.withColumn("since", F.col("nth") - F.col("asked")).withColumn("depth", F.col("taken") + F.col("since"))
    own = arrow_map(own.withColumn("last", F.expr("depth = length")), _rekeyed, "conv_id long, depth long, h1 long, h2 long, words long, last boolean")
    zipped = F.explode(F.arrays_zip("h1", "h2", "words", F.sequence(F.lit(0).cast("long"), "taken").alias("depth")))
    shared = convs.select("conv_id", "length", zipped.alias("x")).select("conv_id", "x.depth", "x.h1", "x.h2", "x.words", F.expr("x.depth = length").alias("last")).filter("depth > 0")
    return convs.select("conv_id", "length"), materialise(own.unionByName(shared), "rebuilt")


def merged(rows: DataFrame) -> DataFrame:
    """Partial tries merged by node key: its smallest member and number of members."""
    node = ["depth", "h1", "h2"]
    some = rows.groupBy(*node, F.pmod(F.xxhash64("conv_id"), F.lit(MERGES)).alias("at")).agg(F.min("conv_id").alias("label"), F.count("*").alias("n_convs"))
    return some.groupBy(*node).agg(F.min("label").alias("label"), F.sum("n_convs").alias("n_convs"))


def end_lists(ends: DataFrame) -> DataFrame:
    """``label, depth, ends_sha256`` from ``label, depth, conv_id``: merged end lists, hashed."""
    small_batches(ends.sparkSession)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def out() -> pa.RecordBatch:
            columns = [pa.array([x], pa.int64()) for x in (*node, ids[0])]
            return pa.RecordBatch.from_arrays([*columns, pa.array([",".join(map(str, ids))])], names=["label", "depth", "first", "ids"])

        for batch in batches:
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and (key != node or len(ids) == RUN):
                    yield out()
                    ids = []
                node = key
                ids.append(conv)
        if ids:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        done: list[tuple] = []
        names = ["label", "depth", "ends_sha256"]
        for batch in batches:
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == node:
                    sha.update(b"," + ids.encode())
                    continue
                if node:
                    done.append((*node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=names)
                done = []
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, sha.hexdigest())], names=names)

    order = ["label", "depth", "conv_id"]
    parts = ends.select(*order).repartitionByRange(partitions_for(ends.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(runs, "label long, depth long, first long, ids string")
    lists = parts.repartition(partitions_for(ends.sparkSession), "label", "depth").sortWithinPartitions("label", "depth", "first")
    return lists.mapInArrow(hashed, "label long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations."""
    convs, rows = rebuilt(conversations, group, heads)
    least, n_convs = convs.agg(F.min("conv_id"), F.count("*")).first()
    zero = F.lit(0).cast("long")
    met = rows.join(merged(rows), ["depth", "h1", "h2"]).select("conv_id", "depth", "label", "n_convs", "words", "last")
    root = convs.select("conv_id", zero.alias("depth"), F.lit(least).cast("long").alias("label"), F.lit(n_convs).cast("long").alias("n_convs"), zero.alias("words"), F.expr("length = 0").alias("last"))
    members = materialise(met.unionByName(root), "members")

    own = F.col("label") == F.col("conv_id")
    saved = (F.col("n_convs") - 1) * F.col("words")
    paths = members.groupBy("conv_id").agg(
        F.min(F.when(own, F.col("depth"))).alias("top"), F.max("depth").alias("end"), F.sum(F.when(own, saved)).alias("total"),
        F.max(F.when(~own, F.struct("depth", "label"))).alias("above"),
    ).filter("top is not null")
    paths = materialise(paths.select("conv_id", "top", "end", "total", F.col("above.label").alias("above")), "paths")
    hung = paths.filter("top > 0").groupBy(F.col("above").alias("label"), (F.col("top") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    hung = materialise(hung, "hung")
    childless = paths.join(hung.select(F.col("label").alias("conv_id"), F.col("depth").alias("end"), "hung"), ["conv_id", "end"], "left")
    paths = childless.withColumn("leaf", F.col("hung").isNull().cast("long")).drop("hung")

    nodes = members.filter(own).join(paths.drop("total"), "conv_id").select("conv_id", "depth", "n_convs", saved.alias("saved"), "top", "end", "above", "leaf")
    nodes = scanned(nodes, "conv_id", [F.desc("depth")], ["saved"], ["below"], lambda s, v: (s[0] + v[0],), _added)
    passed = members.filter(~own).join(paths.select("conv_id", "total", "leaf"), "conv_id")
    passed = passed.groupBy("label", "depth").agg(F.sum("total").alias("passed"), F.sum("leaf").alias("leaves"))
    node = [F.col("label").alias("conv_id"), "depth"]
    for more in (hung.select(*node, "hung"), passed.select(*node, "passed", "leaves"), end_lists(members.filter("last")).select(*node, "ends_sha256")):
        nodes = nodes.join(more, ["conv_id", "depth"], "left")
    or_none = lambda c: F.coalesce(c, zero)
    return nodes.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"), "n_convs",
        (or_none("hung") + (F.col("depth") < F.col("end")).cast("long")).alias("n_children"), (F.col("leaf") + or_none("leaves")).alias("n_leaves"),
        (F.col("below") + or_none("passed")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
