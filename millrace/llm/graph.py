"""Connected components over an edge table: alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.skew import join_by_key
from millrace.session import durable


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Hang every larger neighbour of a node on the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_by_key(both.where("v > u"), least, ["u"], 2 * total)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = join_by_key(down, least, ["u"], total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node it reaches) for every node with an edge.

    edges: u, v. Every round is written to the shared folder, so lineage stays short; the
    rounds end when one changes nothing, seen from a count and an order-free checksum. A node
    with a large share of the edges is no hot task (``join_by_key``)."""
    now = durable(edges.where("u != v").select("u", "v").distinct())
    print_of = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = print_of(now)
    while seen[0]:
        now = durable(_small_star(durable(_large_star(now, seen[0])), seen[0]))
        next_seen = print_of(now)
        if next_seen == seen:
            break
        seen = next_seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
