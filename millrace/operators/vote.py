"""Counting operators: votes with ties, histograms, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def vote(items: DataFrame, by: str, value: str) -> DataFrame:
    """Most frequent value of each group; two at the top are a conflict (null value)."""
    counts = items.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("votes"))
    top = counts.withColumn("__r", F.rank().over(Window.partitionBy(by).orderBy(F.desc("votes")))).where("__r = 1")
    return top.groupBy(by).agg(F.when(F.count(F.lit(1)) == 1, F.min(value)).alias(value), F.max("votes").alias("votes"), (F.count(F.lit(1)) > 1).alias("conflict"))


def histogram(rows: DataFrame, lists: str) -> DataFrame:
    """How often each entry of an array column occurs."""
    return rows.select(F.explode(lists).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    """Rows of each value of a column."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def run_stats(rows: DataFrame, key: str, kinds: dict[str, Column], newest: str) -> DataFrame:
    """Counters of one collection run by key: all rows, rows of each kind, the newest."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("parsed"), *[F.count_if(test).alias(name) for name, test in kinds.items()], F.max(newest).alias("newest"))


def import_counts(rows: DataFrame) -> DataFrame:
    """Counts by file and sheet, with totals of a file and of all."""
    return rows.rollup("path", "sheet").agg(F.count(F.lit(1)).alias("n_rows"))
