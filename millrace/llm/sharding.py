"""Reproducible sharding: a Feistel permutation with cycle walking over row numbers.

Native DataFrame expressions only. Rows get global numbers 0..N-1 without a global
sort: the hash of a row picks one of a fixed number of buckets, a window numbers the
rows of a bucket, and the buckets' running counts (one row a bucket) give the offsets.
A keyed permutation of 0..N-1 then shuffles the numbers, so shard and slot follow from
the permuted number alone: shard = p mod n, slot = p div n.

Edge cases: a null text has size 1 and checksum 0; a null id is a value like any other;
rows equal in every respect are counted first and spread afterwards, so a hot row is no
hot task; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import table

#: Rows that one inner explode of a repeated row makes.
SPREAD = 65536


def feistel(x: str, a: str, b: str, seed: int, rounds: int = 4) -> str:
    """SQL for a keyed bijection of 0..a*b-1: alternating rounds on x = left * b + right."""
    left, right = f"({x} div {b})", f"({x} % {b})"
    for i in range(rounds):
        key = f"{seed * 1000 + i}L"
        if i % 2 == 0:
            left = f"(({left} + pmod(xxhash64({key}, {right}), {a})) % {a})"
        else:
            right = f"(({right} + pmod(xxhash64({key}, {left}), {b})) % {b})"
    return f"({left} * {b} + {right})"


def numbered(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """``df`` (only ``keys``) with gapless ``row_no`` from 0 and the table's ``total``."""
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    hot = hot.withColumn("bucket", F.expr(f"pmod(xxhash64({', '.join(keys)}), {buckets})"))
    sums = hot.groupBy("bucket").agg(F.sum("copies").alias("rows"))
    # one row a bucket: a bounded table, so one task may number it and all may hold it
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "bucket",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"),
        F.sum("rows").over(Window.partitionBy(F.lit(1))).alias("total"),
    )
    within = Window.partitionBy("bucket").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = hot.withColumn("ahead", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(F.broadcast(offsets), "bucket")
    block = placed.withColumn("block", F.explode(F.expr(f"sequence(0L, copies - 1, {SPREAD}L)")))
    each = block.withColumn("k", F.explode(F.expr(f"sequence(block, least(block + {SPREAD}L, copies) - 1)")))
    return each.select(*keys, (F.col("offset") + F.col("ahead") + F.col("k")).alias("row_no"), "total")


def shard(docs: DataFrame, n_shards: int, *, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", buckets: int = 4096) -> DataFrame:
    """Every row of ``docs`` with its size, checksum, permuted number, shard and slot.

    The row counts of shards differ by one at most. ``seed`` names the shuffle: the same
    rows and seed give the same places, whatever the partitioning of the input.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text_col), F.lit(0)).cast("long").alias("text_crc32"),
    )
    at = numbered(rows, ["doc_id", "size", "text_crc32"], buckets)
    # the smallest grid of about sqrt(N) by sqrt(N) cells: hardly a number falls outside
    grid = at.withColumn("a", F.ceil(F.sqrt(F.col("total").cast("double"))).cast("long")).withColumn("b", F.expr("(total + a - 1) div a"))
    once = grid.withColumn("p", F.expr(feistel("row_no", "a", "b", seed)))
    # a cycle leaves 0..N-1 for a * b - N steps at most, so this many always suffice
    steps = "if(p < total, array(0L), sequence(1L, a * b - total))"
    walk = F.expr(f"aggregate({steps}, p, (x, i) -> if(x < total, x, {feistel('x', 'a', 'b', seed)}))")
    return once.withColumn("p", walk).select(
        "doc_id", "size", "text_crc32", F.col("p").alias("position"), F.expr(f"cast(p % {n_shards} as int)").alias("shard"), F.expr(f"p div {n_shards}").alias("slot")
    )


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``rows``."""
    placed = shard(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
