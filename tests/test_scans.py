"""Numbering and segmented scans at sizes where partitions matter, on hot keys, AQE on and off."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import dedupe
from millrace.streaming.changes import claim


@pytest.fixture(params=[(8, "true"), (64, "true"), (64, "false"), (200, "true")], ids=str)
def shuffled(spark, request):
    parts, adaptive = request.param
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize(("rows", "keys"), [(20_000, 5), (300_000, 1)])
def test_ranks_are_gapless(shuffled, rows, keys):
    data = shuffled.range(rows, numPartitions=7).select((F.xxhash64("id") % 1000).alias("v"), "id", F.pmod("id", F.lit(keys)).alias("host"), F.lit("p").alias("payload"))
    out = dedupe.ranked(data, "host", [F.desc("v"), F.asc("id")], "n")
    per = out.groupBy("host").agg(F.count(F.lit(1)).alias("c"), F.countDistinct("n").alias("d"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("payload").alias("p")).collect()
    assert {(r["c"], r["d"], r["lo"], r["hi"], r["p"]) for r in per} == {(rows // keys, rows // keys, 1, rows // keys, rows // keys)}
    want = data.withColumn("w", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("v"), "id"))).select("id", "w")
    assert out.join(want, "id").where("n != w").count() == 0
    placed = dedupe.numbered(data.orderBy(F.desc("v"), "id"))
    got = placed.agg(F.count(F.lit(1)), F.countDistinct("place"), F.min("place"), F.max("place")).first()
    assert tuple(got) == (rows, rows, 1, rows)
    after = Window.orderBy("place")
    assert placed.withColumn("b", F.lag("v").over(after)).where("b < v").count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_batches_and_stops_of_a_dominant_company(shuffled, seed):
    data = shuffled.range(20_000).select(F.when(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)) == 0, 1).otherwise(F.pmod(F.xxhash64("id"), F.lit(40))).alias("company"), F.col("id").alias("pos"), F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(9000))).alias("identity"))
    data = data.withColumn("company", F.when(F.col("company") == 7, None).otherwise(F.col("company")))
    known = data.where("pos % 3 = 0").select("identity").distinct()
    upto = Window.partitionBy("company").orderBy("pos", "identity").rowsBetween(Window.unboundedPreceding, 0)
    fresh = data.join(known.withColumn("k", F.lit(True)), "identity", "left").withColumn("f", F.sum(F.when(F.col("k"), 0).otherwise(1)).over(upto))
    want = fresh.select("pos", F.when(F.col("k").isNull(), F.floor((F.col("f") - 1) / 50)).alias("w"))
    got = dedupe.collect_batch(data, known, 50)
    assert got.count() == 20_000
    assert got.join(want, "pos").where(~F.col("batch_no").eqNullSafe(F.col("w"))).count() == 0

    stop = F.pmod(F.xxhash64("pos"), F.lit(3000)) == 0
    before = Window.partitionBy("company").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    kept = data.withColumn("s", F.max(stop).over(before)).where(~F.coalesce("s", F.lit(False)))
    assert sorted(r["pos"] for r in dedupe.until_stop(data, ["company"], "pos", stop).collect()) == sorted(r["pos"] for r in kept.collect())


def test_claims_of_a_dominant_run(shuffled):
    queue = shuffled.range(20_000).select(F.when(F.col("id") % 10 < 7, 1).otherwise(F.col("id") % 10).alias("run_id"), "id", F.when(F.col("id") % 4 == 0, "done").when(F.col("id") % 101 == 5, None).otherwise("pending").alias("status"), F.lit(0).alias("attempts"))
    out = claim(queue, 30)
    taken = out.where("status = 'running'")
    assert out.count() == 20_000 and {(r["run_id"], r["count"]) for r in taken.groupBy("run_id").count().collect()} == {(k, 30) for k in (1, 7, 8, 9)}
    first = {k: sorted(r["id"] for r in queue.where(f"run_id = {k} and status = 'pending'").orderBy("id").limit(30).collect()) for k in (1, 9)}
    assert {k: sorted(r["id"] for r in taken.where(f"run_id = {k}").collect()) for k in (1, 9)} == first
    assert taken.agg(F.sum("attempts")).first()[0] == 120


def test_running_sums_of_nothing(spark):
    empty = spark.createDataFrame([], "k bigint, v bigint")
    assert dedupe.running(empty, ["k"], ["v"], {"s": F.col("v")}).count() == 0
    assert dedupe.numbered(empty.orderBy("v")).count() == 0
