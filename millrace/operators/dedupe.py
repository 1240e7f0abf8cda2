"""Window operators of postings: quality picks, batches, page windows, stop rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import durable


def pick_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a full order; rows with a blank key pass unpicked."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | (F.col(k).cast("string") == "")
    ranked = df.where(~blank).withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n").unionByName(df.where(blank))


def best_by_title(jobs: DataFrame) -> DataFrame:
    """One posting of each company and title key: detail page, confidence, longer text,
    newest, then id."""
    return pick_best(jobs, ["company_key", "title_key"], [F.desc("has_detail"), F.desc("confidence"), F.desc("jd_len"), F.desc("updated_at"), F.asc("id")])


def clean_up(jobs: DataFrame) -> DataFrame:
    """Every posting (by its id) with its fate: keep, duplicate_title, duplicate_url, shell
    or rename.

    Shells of a company go if it has any detail page; else its best shell stays, renamed.
    Firsts of a key are cut down before the shuffle, and facts of a company are partial
    aggregates, so a company with a large share of the rows makes no task slow."""
    order = [F.desc("has_detail"), F.desc("confidence"), F.desc("jd_len"), F.desc("updated_at"), F.asc("id")]

    def mark(rows: DataFrame, among: DataFrame, keys: list[str], name: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        first = among.withColumn("__n", nth).where("__n = 1").select("id", F.lit(True).alias(name))
        return rows.join(first, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))

    titled = mark(jobs, jobs, ["company_key", "title_key"], "__alive")
    alive = titled.where("__alive")
    named = mark(titled, alive, ["company_key", "identity", "title_key"], "__url")
    shells = mark(named, alive.where("is_shell"), ["company_key"], "__best")
    detail = alive.groupBy("company_key").agg(F.max(F.when(~F.col("is_shell"), 1).otherwise(0)).alias("__detail"))
    fate = (
        F.when(~F.col("__alive"), "duplicate_title")
        .when((F.col("identity") != "") & ~F.col("__url"), "duplicate_url")
        .when(F.col("is_shell") & (F.col("__detail") == 1), "shell")
        .when(F.col("is_shell") & ~F.col("__best"), "shell")
        .when(F.col("is_shell"), "rename")
        .otherwise("keep")
    )
    return shells.join(detail, "company_key", "left").withColumn("fate", fate).drop("__alive", "__url", "__best", "__detail")


def _stored_in_order(ordered: DataFrame) -> DataFrame:
    """A sorted table written once, with its range partition ``__p`` and the place there ``__m``
    as data: a sort that is run again may deal its rows otherwise."""
    return durable(ordered.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__m")))


def running(rows: DataFrame, by: list[str], order: list[Column | str], totals: dict[str, Column]) -> DataFrame:
    """Running sums of ``totals`` (whole numbers) within ``by``, up to and with each row.

    A segmented prefix sum in two levels: within a range partition of the sorted rows, then
    over the partitions that a key spans. A key with any share of the rows is spread over as
    many tasks as its rows fill, and no task sees more than a partition of it."""
    placed = _stored_in_order(rows.orderBy(*by, *order))
    part = ["__p", *by]
    local = Window.partitionBy(*part).orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*part).agg(*[F.sum(v).alias(f"__{n}") for n, v in totals.items()])
    before = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(part)], *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in totals])
    scanned = placed.withColumns({n: F.sum(v).over(local) for n, v in totals.items()})
    same = [scanned[k].eqNullSafe(before[f"__k{i}"]) for i, k in enumerate(part)]
    joined = scanned.join(before, reduce(lambda x, y: x & y, same))
    return joined.select(*rows.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in totals])


def numbered(ordered: DataFrame, name: str = "place") -> DataFrame:
    """``place`` from 1 in the order of a sorted table, without a single task for all rows:
    the stored range partitions are numbered on their own and shifted by the counts before."""
    placed = _stored_in_order(ordered)
    sizes = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__first"))
    # one row a partition: a bounded table
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = sizes.select("__p", "__first", before.alias("__before"))
    return placed.join(F.broadcast(shifts), "__p").withColumn(name, F.col("__m") - F.col("__first") + F.col("__before") + 1).drop("__p", "__m", "__first", "__before")


def ranked(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """Rank of a row within its key: a segmented count over one range-partitioned sort."""
    return running(rows, [key], order, {name: F.lit(1)}).withColumn(name, F.col(name).cast("int"))


def collect_batch(candidates: DataFrame, known: DataFrame, size: int, *, by: str = "company", pos: str = "pos", key: str = "identity") -> DataFrame:
    """Candidates with ``batch_no`` among the unknown ones of a company (from 0), and
    whether they were skipped as known before the first batch filled."""
    marked = candidates.join(known.select(F.col(key), F.lit(True).alias("__known")).distinct(), key, "left").withColumn("is_known", F.coalesce("__known", F.lit(False))).drop("__known")
    counted = running(marked, [by], [pos, key], {"__f": F.when(F.col("is_known"), 0).otherwise(1)})
    batch = F.when(~F.col("is_known"), F.floor((F.col("__f") - 1) / size)).cast("long")
    return counted.withColumn("batch_no", batch).withColumn("skipped", F.col("is_known") & (F.col("__f") < size)).drop("__f")


def page_window(rows: DataFrame, page: list[str], is_out: Column) -> DataFrame:
    """``outside`` for each row and ``stop`` for a page with any outside row."""
    return rows.withColumn("outside", is_out).withColumn("stop", F.max("outside").over(Window.partitionBy(*page)))


def until_stop(pages: DataFrame, group: list[str], pos: str, stop: Column) -> DataFrame:
    """Rows up to and with the first stop of each ordered group."""
    marked = pages.withColumn("__stop", F.coalesce(stop, F.lit(False)).cast("int"))
    return running(marked, group, [pos], {"__stops": F.col("__stop")}).where(F.col("__stops") == F.col("__stop")).drop("__stops", "__stop")


def replace_urls(urls: Column, replacements: Column) -> Column:
    """Ordered fold of replacements struct(key, url) over struct(key, url) entries: the
    first hit is replaced, later hits go, a missing one is appended, a null url removes."""

    def one(acc: Column, r: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda x: x["key"]), r["key"])
        kept = F.filter(acc, lambda x, i: (x["key"] != r["key"]) | ((i + 1 == at) & r["url"].isNotNull()))
        swapped = F.transform(kept, lambda x: F.when(x["key"] == r["key"], r).otherwise(x))
        return F.when((at == 0) & r["url"].isNotNull(), F.array_append(acc, r)).otherwise(swapped)

    return F.aggregate(replacements, urls, one)


def merge_lists(old: Column, new: Column) -> Column:
    """Union of two string arrays, order kept, blanks dropped."""
    empty = F.expr("cast(array() as array<string>)")
    return F.array_distinct(F.filter(F.concat(F.coalesce(old, empty), F.coalesce(new, empty)), lambda x: F.trim(x) != ""))
