"""Mutations as pure functions of old and new tables: upserts, overlays, queues."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import dates as D


def last_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str, fields: list[str], *, keep_old_when_null: tuple[str, ...] = (), tolerance: dict[str, float] | None = None) -> DataFrame:
    """The merged table with ``action``: inserted, updated, unchanged or kept.

    Text compares trimmed with blank as null, numbers within a tolerance; an active row is
    never demoted to pending. ``new`` holds one row a key (see ``last_of``)."""
    tolerance = tolerance or {}
    o, n = old.select(key, *[F.col(f).alias(f"__o_{f}") for f in fields], F.lit(True).alias("__old")), new.select(key, *[F.col(f).alias(f"__n_{f}") for f in fields], F.lit(True).alias("__new"))
    both = o.join(n, key, "full_outer")
    text = lambda c: F.nullif(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", ""), F.lit(""))
    values, same = {}, F.lit(True)
    for f in fields:
        was, now = F.col(f"__o_{f}"), F.col(f"__n_{f}")
        if f in keep_old_when_null:
            now = F.coalesce(now, was)
        if f == "status":
            now = F.when((was == "active") & (now == "pending_review"), was).otherwise(now)
        equal = F.coalesce(F.abs(was - now) <= tolerance[f], was.isNull() & now.isNull()) if f in tolerance else text(was).eqNullSafe(text(now))
        same = same & equal
        values[f] = now
    action = F.when(F.col("__new").isNull(), "kept").when(F.col("__old").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    changed = F.col("__new").isNotNull() & ~(F.col("__old").isNotNull() & same)
    return both.select(key, *[F.when(changed, values[f]).otherwise(F.col(f"__o_{f}")).alias(f) for f in fields], action.alias("action"))


def overlay(layers: list[DataFrame], key: str) -> DataFrame:
    """Rows by key where a later layer wins."""
    tagged = None
    for rank, layer in enumerate(layers):
        one = layer.withColumn("__rank", F.lit(rank))
        tagged = one if tagged is None else tagged.unionByName(one)
    return last_of(tagged, [key], [F.desc("__rank")]).drop("__rank")


def merge_company(old: DataFrame, new: DataFrame) -> DataFrame:
    """Companies by normalised name: new text wins unless blank, lists unite, and neither
    official nor rejected is taken back."""
    lists, texts = ["hint_apply_urls", "career_urls"], ["name", "company_nature", "industry"]
    joined = old.alias("o").join(new.alias("n"), "name_norm", "full_outer")
    pick = lambda f: F.coalesce(F.nullif(F.trim(F.col(f"n.{f}")), F.lit("")), F.col(f"o.{f}")).alias(f)
    empty = F.expr("cast(array() as array<string>)")
    unite = lambda f: F.array_union(F.coalesce(F.col(f"o.{f}"), empty), F.coalesce(F.col(f"n.{f}"), empty)).alias(f)
    status = F.when(F.col("o.verify_status").isin("official", "rejected"), F.col("o.verify_status")).otherwise(F.coalesce("n.verify_status", "o.verify_status"))
    return joined.select("name_norm", *[pick(f) for f in texts], *[unite(f) for f in lists], status.alias("verify_status"))


def soft_delete(jobs: DataFrame, gone: DataFrame) -> DataFrame:
    """Status deleted for the ids in ``gone``; others as they are."""
    marked = jobs.join(gone.select("id", F.lit(True).alias("__gone")).distinct(), "id", "left")
    return marked.withColumn("status", F.when(F.col("__gone"), "deleted").otherwise(F.col("status"))).drop("__gone")


def expire(jobs: DataFrame, as_of: date, days: int = 365) -> DataFrame:
    """Retention: postings whose latest date is past get deleted; the reference date stays."""
    dates = [F.col("open_at"), F.col("updated_at"), F.col("created_at")]
    return jobs.withColumn("age_date", D.age_date(*dates)).withColumn("status", F.when(D.past_retention(dates, as_of, days), "deleted").otherwise(F.col("status")))


def enqueue_once(queue: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """The queue with items that have no pending entry of the same keys."""
    pending = queue.where("status = 'pending'").select(*keys).distinct()
    return queue.unionByName(items.dropDuplicates(keys).join(pending, keys, "left_anti"), allowMissingColumns=True)


def queue_progress(queue: DataFrame) -> DataFrame:
    """Counts by state of each run; processed is done, error and skipped together."""
    n = lambda *states: F.sum(F.when(F.col("status").isin(*states), 1).otherwise(0)).cast("long")
    return queue.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[n(s).alias(s) for s in ("pending", "running", "done", "error", "skipped")],
        n("done", "error", "skipped").alias("processed"),
        F.coalesce(F.sum("new_count"), F.lit(0)).cast("long").alias("new_count"),
    )
