"""Row-set comparison of a Spark result with a DuckDB result, as the driver does it."""

from __future__ import annotations

import datetime
import decimal
import math


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if hasattr(x, "item"):
        return plain(x.item())
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(spark_df, duck_relation):
    mine = rows_of(spark_df.columns, spark_df.collect())
    theirs = rows_of(duck_relation.columns, duck_relation.fetchall())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    for a, b in zip(mine[1], theirs[1], strict=True):
        assert a == b
