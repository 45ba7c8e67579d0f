"""Graphs and problem tables derived from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arcspark.graph import Graph
from arcspark.sources.builders import from_arcs


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def handoff_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, w``: from each event's user to the next event's; w is 1 + event_id mod 9."""
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    # the following event is found by range-partitioned ranks, not by one global window
    from arcspark.sources.builders import numbered

    ranked = numbered(events, "rank", "ts", "event_id")
    after = ranked.select((F.col("rank") - 1).alias("rank"), F.col("user_id").alias("dst"))
    return ranked.join(after, "rank").select(F.col("user_id").alias("src"), "dst", (1 + F.col("event_id") % 9).cast("long").alias("w"))


def handoff(spark: SparkSession, sf_dir: str) -> Graph:
    return from_arcs(handoff_arcs(spark, sf_dir))


def whole_handoff(spark: SparkSession, sf_dir: str) -> Graph:
    """All handoffs over all users, those without any included."""
    return from_arcs(handoff_arcs(spark, sf_dir), read(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct())


def chain(spark: SparkSession, sf_dir: str) -> Graph:
    """From each event to the same user's next event: disjoint paths."""
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    after = F.lead("event_id").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    arcs = events.select(F.col("event_id").alias("src"), after.alias("dst")).where("dst is not null")
    return from_arcs(arcs, events.select(F.col("event_id").alias("id")))


def trade_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src, dst, w``: nations of customers and suppliers, w is the number of order lines."""
    customer, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    lines, supplier = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    joined = (
        lines.select("l_orderkey", "l_suppkey")
        .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("src")), "o_custkey")
        .join(supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst")), "l_suppkey")
    )
    return joined.groupBy("src", "dst").agg(F.count("*").alias("w"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """The trade graph over all nations."""
    return from_arcs(trade_arcs(spark, sf_dir), nations(spark, sf_dir))


REGION, NATION, CUSTOMER = 0, 1_000, 1_000_000


def hierarchy(spark: SparkSession, sf_dir: str) -> Graph:
    """Region to nation to customer, each kind in an id range of its own: a forest."""
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    arcs = nation.select(
        (F.col("n_regionkey") + REGION).cast("long").alias("src"), (F.col("n_nationkey") + NATION).cast("long").alias("dst")
    ).unionAll(customer.select((F.col("c_nationkey") + NATION).cast("long").alias("src"), (F.col("c_custkey") + CUSTOMER).cast("long").alias("dst")))
    ids = (
        region.select((F.col("r_regionkey") + REGION).cast("long").alias("id"))
        .unionAll(nation.select((F.col("n_nationkey") + NATION).cast("long").alias("id")))
        .unionAll(customer.select((F.col("c_custkey") + CUSTOMER).cast("long").alias("id")))
    )
    return from_arcs(arcs, ids)


def knapsack_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``problem_id, item_id, value, cost``: a problem for each part brand, with all its parts."""
    return read(spark, sf_dir, "part").select(
        F.col("p_brand").alias("problem_id"), F.col("p_partkey").alias("item_id"),
        F.floor("p_retailprice").cast("long").alias("value"), F.col("p_size").cast("long").alias("cost"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seg_id, x1, y1, x2, y2``: short segments on a wide integer grid, from order keys."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x, y = (k * 7919) % 4001, (k * 104729 + c * 31) % 4001
    return read(spark, sf_dir, "orders").select(
        k.cast("long").alias("seg_id"), x.cast("long").alias("x1"), y.cast("long").alias("y1"),
        (x + k % 41 - 20).cast("long").alias("x2"), (y + c % 37 - 18).cast("long").alias("y2"),
    )
