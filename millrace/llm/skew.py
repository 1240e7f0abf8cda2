"""Joins whose keys may be hot, without a hot task and without an unbounded broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it has over 1/MOST of the rows, so fewer than MOST keys are hot.
MOST = 2000


def join_by_key(rows: DataFrame, per_key: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` with a table of one row a key.

    ``per_key`` has a column ``n``, the number of ``rows`` of its key, and ``total`` is the
    number of all ``rows``. Hot keys number fewer than MOST whatever the data, so their rows
    of ``per_key`` are broadcast; the other keys are joined by shuffle, where each holds too
    few rows to make a task slow. Null keys join nothing. The column ``n`` is dropped."""
    hot = per_key.where(F.col("n") > total / MOST).drop("n")
    cold = per_key.where(F.col("n") <= total / MOST).drop("n")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))
