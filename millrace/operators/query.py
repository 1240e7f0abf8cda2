"""Posting queries: filters, semi and left joins, orders, top-up unions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import dates as D
from millrace.functions import text as T
from millrace.functions import vocab as V


def list_postings(
    jobs: DataFrame,
    *,
    status: tuple[str, ...] = ("active",),
    bucket: str | None = None,
    industry: str | None = None,
    nature: str | None = None,
    location: str | None = None,
    keyword: str | None = None,
    batch: str | None = None,
    target_as_of: date | None = None,
    picks: DataFrame | None = None,
    states: DataFrame | None = None,
    scope: str | None = None,
    as_of: date | None = None,
    limit: int | None = 2000,
    offset: int = 0,
) -> DataFrame:
    """Postings by status, facets, keyword and picks, newest first, with personal status.

    Conditions become one conjunction, so the scan gets what it can push down; ties of
    ``updated_at`` are broken by id. The deadline scope applies before the limit."""
    tests: list[Column] = [F.col("status").isin(*status)]
    if bucket and bucket != "全部":
        tests.append(F.col("recruit_bucket") == bucket)
    if nature:
        tests.append(F.col("company_nature") == nature)
    tests += [T.like_keyword(F.col(n), w) for n, w in (("industry", industry), ("work_location", location)) if w]
    if target_as_of:
        year = D.target_year(target_as_of)
        tests.append(F.col("recruit_bucket").isin("应届生实习", "日常实习") | (F.col("graduation_batch") == f"{year}届") | T.has_any(F.col("title"), (f"{year}届", f"{year}应届")))
    elif batch:
        tests.append(T.like_keyword(F.col("graduation_batch"), batch))
    if keyword:
        hits = [F.coalesce(T.like_keyword(F.col(n), keyword), F.lit(False)) for n in ("company", "title", "recruit_project", "graduation_batch")]
        tests.append(hits[0] | hits[1] | hits[2] | hits[3])
    if scope:
        tests.append(D.deadline_scope(F.col("deadline"), as_of) == scope)
    found = jobs
    for test in tests:
        found = found.where(test)
    if picks is not None:
        found = found.join(picks.select(F.col("job_id").alias("id")), "id", "left_semi")
    found = found.orderBy(F.desc("updated_at"), "id")
    found = found.offset(offset) if offset else found
    found = found.limit(limit) if limit else found
    return with_status(found, states) if states is not None else found


def with_status(jobs: DataFrame, states: DataFrame) -> DataFrame:
    """Personal status and note of each posting, with defaults."""
    mine = states.select(F.col("job_id").alias("id"), F.col("apply_status").alias("my_apply_status"), F.col("note").alias("my_note"))
    return jobs.join(mine, "id", "left").withColumns({"my_apply_status": F.coalesce("my_apply_status", F.lit(V.NO_STATUS)), "my_note": F.coalesce("my_note", F.lit(""))})


def by_ids(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the wanted ids (id, pos), in wanted order."""
    return jobs.join(ids, "id").orderBy("pos")


def known_keys(jobs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Identity keys of postings and of pending review payloads, each once."""
    return jobs.select("identity", "title_key").union(reviews.select("identity", "title_key")).distinct()


def by_payload(reviews: DataFrame, kinds: tuple[str, ...], field: str, test) -> DataFrame:
    """Entries of some kinds by a field of their JSON payload, with that field."""
    read = reviews.where(F.col("kind").isin(*kinds)).withColumn(field, F.get_json_object("payload", f"$.{field}"))
    return read.where(test(F.col(field)))


def unknown(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Candidates whose key is not known yet."""
    return candidates.join(known.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def best_match(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """Best candidate of each wanted row: by detail URL, then source URL, then title."""
    ways = [("detail_url", 1), ("source_url", 2), ("title", 3)]
    found = None
    for column, rank in ways:
        left = wanted.select("want_id", F.col(column).alias("k")).where(F.col("k") != "")
        right = candidates.select("candidate_id", "pos", F.col(column).alias("k"))
        hits = left.join(right, "k").select("want_id", "candidate_id", "pos", F.lit(rank).alias("way"))
        found = hits if found is None else found.unionByName(hits)
    first = Window.partitionBy("want_id").orderBy("way", "pos", "candidate_id")
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def top_up(first: DataFrame, rest: DataFrame, limit: int, order: list[Column], tag: tuple[str, str] = ("first", "rest")) -> DataFrame:
    """Rows of ``first``, topped up to ``limit`` by rows of ``rest`` with other ids."""
    more = rest.join(first.select("id"), "id", "left_anti")
    both = first.withColumn("source", F.lit(tag[0])).unionByName(more.withColumn("source", F.lit(tag[1])))
    return both.orderBy(F.when(F.col("source") == tag[0], 0).otherwise(1), *order).limit(limit)


def company_order(companies: DataFrame) -> DataFrame:
    """Companies with URLs that aren't rejected: trusted hosts, then career URLs, then
    official ones, then the newest."""
    from millrace.functions import urls as U

    urls = F.concat(F.coalesce("career_urls", F.expr("cast(array() as array<string>)")), F.coalesce("hint_apply_urls", F.expr("cast(array() as array<string>)")))
    first = lambda test: F.when(test, 0).otherwise(1)
    kept = companies.withColumn("urls", urls).where((F.size("urls") > 0) & (F.col("verify_status") != "rejected"))
    return kept.orderBy(first(F.exists("urls", U.is_trusted)), first(F.size("career_urls") > 0), first(F.col("verify_status") == "official"), F.desc("updated_at"), "id")
