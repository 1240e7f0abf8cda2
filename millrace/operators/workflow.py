"""Review, publication and sync of postings, as functions of tables to tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import classify as C
from millrace.functions import dates as D
from millrace.functions import records as R
from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.functions import vocab as V
from millrace.session import durable

PAYLOAD = "title string, company string, company_id string, source_url string, apply_url string, recruit_project string, recruit_bucket string, jd_text string, open_at string, published_at string, updated_at string"


def _marked(rows: DataFrame, ids: DataFrame, name: str, key: str = "id") -> DataFrame:
    return rows.join(ids.select(F.col("id").alias(key)).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The least row of each key by ``order``; a partial aggregate, so hot keys don't meet."""
    others = [x for x in rows.columns if x not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__r"))
    return best.select(*keys, "__r.*")


# keys and matches


def with_identity(jobs: DataFrame) -> DataFrame:
    """Postings with the keys that name them: identity URL, title key, shell or not."""
    key = lambda name: F.nullif(U.identity_url(F.col(name)), F.lit(""))
    shell = T.is_noise_title(F.col("title")) | C.is_portal_shell(F.col("title"), F.col("jd_text"))
    return jobs.withColumns({"identity": T.or_empty(F.coalesce(key("apply_url"), key("source_url"))), "title_key": T.title_key(F.col("title")), "is_shell": shell})


def match_for_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """new_id and the old posting (least id) that an incoming row is the same as: within a
    company, one identity URL and one title, or either a shell; where a side has no URL,
    one title. Both sides come from ``with_identity``."""
    c = F.col
    url, title = c("identity") != "", c("title_key") != ""
    # keys are many patterns a row: they are made once, not once a use
    keyed = lambda rows: durable(rows.select("id", "company", "identity", "title_key", F.coalesce("is_shell", F.lit(False)).alias("is_shell")))
    old, n = keyed(old), keyed(new).withColumnRenamed("id", "new_id")
    # least ids by key: no pair of rows that share a key is ever made
    least = old.groupBy("company", "identity", "title_key").agg(F.min("id").alias("any"), F.min(F.when(c("is_shell"), c("id"))).alias("shell"))
    by_url = least.where(url).groupBy("company", "identity").agg(F.min("any").alias("u_any"), F.min("shell").alias("u_shell"))
    by_both = least.where(url & title).select("company", "identity", "title_key", c("any").alias("b_any"))
    by_title = least.where(title).groupBy("company", "title_key").agg(F.min("any").alias("t_any"), F.min(F.when(~url, c("any"))).alias("t_bare"))
    met = n.join(by_url, ["company", "identity"], "left").join(by_both, ["company", "identity", "title_key"], "left").join(by_title, ["company", "title_key"], "left")
    same_url = F.when(c("is_shell"), c("u_any")).otherwise(F.least("u_shell", "b_any"))
    # a title alone decides only where a side has no URL
    found = met.select("new_id", F.least(same_url, F.when(url, c("t_bare")).otherwise(c("t_any"))).alias("old_id")).where("old_id is not null")
    return found.groupBy("new_id").agg(F.min("old_id").alias("old_id"))


def known_identities(jobs: DataFrame, reviews: DataFrame, company: str) -> DataFrame:
    """kind (url or title) and key of what is known of a company: live postings and pending
    review payloads, by application and source URL and by lower-case title."""
    live = jobs.where((F.col("company") == company) & F.col("status").isin("pending_review", "active", "abnormal")).select("apply_url", "source_url", "title")
    paid = reviews.where("status = 'pending'").select(F.from_json("payload", PAYLOAD).alias("p")).where(F.col("p.company") == company).select("p.apply_url", "p.source_url", "p.title")
    both = live.union(paid)
    keyed = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    keys = F.array(keyed("url", U.identity_url(F.col("apply_url"))), keyed("url", U.identity_url(F.col("source_url"))), keyed("title", F.lower(T.strip(T.or_empty(F.col("title"))))))
    return both.select(F.explode(keys).alias("k")).select("k.*").where("key != ''").distinct()


def known_candidates(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (id, title, apply_url, detail_url, source_url) with ``known``: a specific
    URL decides before any title; a source URL only together with the title."""
    c = F.col
    specific = lambda name: F.when((U.identity_url(c(name)) != "") & (F.contains(T.or_empty(c(name)), F.lit("__job=")) | (c("source_key") == "") | (U.identity_url(c(name)) != c("source_key"))), U.identity_url(c(name)))
    keyed = candidates.withColumn("source_key", U.identity_url(c("source_url"))).withColumn("specific", F.array_compact(F.array(specific("apply_url"), specific("detail_url")))).withColumn("title_low", F.lower(T.strip(T.or_empty(c("title")))))
    urls, titles = known.where("kind = 'url'").select("key").distinct(), known.where("kind = 'title'").select("key").distinct()
    wanted = keyed.select("id", F.explode("specific").alias("key"))
    hits = wanted.join(urls, "key").groupBy("id").agg(F.lit(True).alias("hit_url"))
    named = keyed.join(titles.select(c("key").alias("title_low"), F.lit(True).alias("hit_title")), "title_low", "left")
    sourced = named.join(urls.select(c("key").alias("source_key"), F.lit(True).alias("hit_source")), "source_key", "left").join(hits, "id", "left")
    yes = lambda name: F.coalesce(c(name), F.lit(False))
    facts = F.struct(F.when(F.size("specific") > 0, yes("hit_url")).alias("specific"), F.when(c("source_key") != "", yes("hit_source")).alias("source"))
    return sourced.withColumn("known", R.known_candidate(facts, (c("title_low") != "") & yes("hit_title"), F.lit(not urls.isEmpty()))).select(*candidates.columns, "known")


def append_unlike(table_rows: DataFrame, adapter_rows: DataFrame) -> DataFrame:
    """Rows of a page's table, and of its adapter those with another title and URL."""
    key = lambda df: df.withColumns({"__t": F.lower(T.strip(T.or_empty(F.col("title")))), "__u": U.identity_url(F.col("url"))})
    more = key(adapter_rows).join(key(table_rows).select("__t", "__u").distinct(), ["__t", "__u"], "left_anti")
    return table_rows.withColumn("source", F.lit("table")).unionByName(more.select(*adapter_rows.columns).withColumn("source", F.lit("adapter")))


def merge_channels(lists: list[DataFrame], limit: int) -> DataFrame:
    """Rows (title, url, recruit_project) of several channel lists: no social hiring, one of
    each title and URL without its query, the first ``limit`` in list order."""
    tagged = None
    for i, rows in enumerate(lists):
        one = rows.withColumn("__list", F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one)
    kept = tagged.where(~T.has_any(F.col("recruit_project"), ("社会招聘", "社招"))).withColumns({"__t": F.lower(T.strip(T.or_empty(F.col("title")))), "__u": F.substring_index(T.or_empty(F.col("url")), "?", 1)})
    return _first(kept, ["__t", "__u"], ["__list", "pos"]).orderBy("__list", "pos").limit(limit).drop("__t", "__u", "__list")


# states


def revert_to_review(jobs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active postings among ``ids`` go back to review without their sync stamp; the second
    table has the ids to revoke, which had been pushed."""
    hit = _marked(jobs, ids, "__hit").withColumn("__back", F.col("__hit") & (F.col("status") == "active"))
    revoked = hit.where(F.col("__back") & (T.strip(T.or_empty(F.col("cloud_updated_at"))) != "")).select("id")
    after = hit.withColumns({"status": F.when(F.col("__back"), "pending_review").otherwise(F.col("status")), "cloud_updated_at": F.when(~F.col("__back"), F.col("cloud_updated_at"))})
    return after.drop("__hit", "__back"), revoked


def mark_synced(jobs: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """The sync stamp of pushed postings; their own time of change stays."""
    return _marked(jobs, ids, "__hit").withColumn("cloud_updated_at", F.when(F.col("__hit"), F.lit(at)).otherwise(F.col("cloud_updated_at"))).drop("__hit")


def set_states(states: DataFrame, new: DataFrame) -> DataFrame:
    """Personal states (job_id, apply_status, note): new ones win, a null note keeps the old."""
    n = new.select("job_id", F.col("apply_status").alias("n_status"), F.col("note").alias("n_note"), F.lit(True).alias("__new"))
    both = states.join(n, "job_id", "full_outer")
    return both.select("job_id", F.when(F.col("__new"), F.col("n_status")).otherwise(F.col("apply_status")).alias("apply_status"), F.coalesce("n_note", "note").alias("note"))


def add_ids(ids: DataFrame, more: DataFrame) -> DataFrame:
    """An ordered id set (id, pos) with new ids behind the old ones."""
    last = ids.agg(F.max("pos")).first()[0]
    fresh = more.groupBy("id").agg(F.min("pos").alias("pos")).join(ids.select("id"), "id", "left_anti")
    return ids.select("id", "pos").unionByName(fresh.select("id", (F.col("pos") + F.lit(-1 if last is None else last) + 1).alias("pos")))


def drop_ids(ids: DataFrame, gone: DataFrame) -> DataFrame:
    return ids.join(gone.select("id").distinct(), "id", "left_anti")


def revoked_postings(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Postings to withdraw: the ids' rows that aren't active again, shown as deleted."""
    return jobs.join(ids.select("id"), "id", "left_semi").where("status != 'active'").withColumn("status", F.lit("deleted"))


def add_picks(picks: DataFrame, new: DataFrame) -> DataFrame:
    """Picks (job_id, collection, added_at) with new ones that aren't there yet."""
    once = _first(new, ["job_id", "collection"], ["added_at"])
    return picks.unionByName(once.join(picks.select("job_id", "collection"), ["job_id", "collection"], "left_anti"))


def list_picks(picks: DataFrame, collection: str) -> DataFrame:
    return picks.where(F.col("collection") == collection).orderBy(F.desc("added_at"), "job_id").select("job_id", "added_at")


def resolve_reviews(queue: DataFrame, ids: DataFrame, status: str, at: str) -> DataFrame:
    hit = _marked(queue, ids, "__hit")
    return hit.withColumns({"status": F.when(F.col("__hit"), F.lit(status)).otherwise(F.col("status")), "resolved_at": F.when(F.col("__hit"), F.lit(at)).otherwise(F.col("resolved_at"))}).drop("__hit")


def edit_payloads(queue: DataFrame, edits: DataFrame) -> DataFrame:
    """New payloads (id, payload, reason) of entries that are still pending; a null reason
    keeps the old."""
    e = edits.select("id", F.col("payload").alias("__p"), F.col("reason").alias("__r"))
    ok = F.col("__p").isNotNull() & (F.col("status") == "pending")
    return queue.join(e, "id", "left").withColumns({"payload": F.when(ok, F.col("__p")).otherwise(F.col("payload")), "reason": F.when(ok, F.coalesce("__r", "reason")).otherwise(F.col("reason"))}).drop("__p", "__r")


def publish_reviews(queue: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pending entries (of ``ids``) whose payload has a title and a source become postings;
    the queue has them as published."""
    pending = queue.where("status = 'pending'")
    chosen = pending if ids is None else pending.join(ids.select("id"), "id", "left_semi")
    read = chosen.select("id", F.from_json("payload", PAYLOAD).alias("p")).where((T.or_empty(F.col("p.title")) != "") & (T.or_empty(F.col("p.source_url")) != ""))
    jobs = read.select(F.col("id").alias("review_id"), "p.*", F.lit("active").alias("status"))
    done = _marked(queue, read.select("id"), "__hit").withColumn("status", F.when(F.col("__hit"), "published").otherwise(F.col("status"))).drop("__hit")
    return jobs, done


def promote_internships(queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``publish_reviews`` for payloads that show an internship, with its defaults."""
    p = F.from_json("payload", PAYLOAD)
    interns = queue.withColumn("p", p).where(R.is_internship(F.col("p.recruit_bucket"), F.col("p.title"), F.col("p.jd_text"), F.col("p.recruit_project"))).select("id")
    jobs, done = publish_reviews(queue, interns)
    bucket = F.coalesce(F.nullif(F.col("recruit_bucket"), F.lit("")), C.map_bucket(F.col("recruit_project"), F.col("title")), F.lit("日常实习"))
    project = F.coalesce(F.nullif(F.col("recruit_project"), F.lit("")), F.lit("日常实习"))
    return jobs.withColumn("recruit_bucket", bucket).withColumn("recruit_project", project), done


def approve(jobs: DataFrame, as_of: date, duties: Column, requirements: Column) -> DataFrame:
    """Pending postings without any reason against it become active; ``reasons`` says why
    the others don't."""
    reasons = F.when(F.col("status") == "pending_review", C.review_reasons(as_of, duties, requirements))
    judged = jobs.withColumn("reasons", reasons)
    return judged.withColumn("status", F.when(F.size("reasons") == 0, "active").otherwise(F.col("status")))


def expired_reviews(queue: DataFrame, as_of: date, days: int = V.RETENTION_DAYS) -> DataFrame:
    """Pending entries whose payload's latest date is past retention are ignored."""
    p = queue.withColumn("p", F.from_json("payload", PAYLOAD))
    past = D.past_retention([F.col("p.open_at"), F.col("p.published_at"), F.col("p.updated_at")], as_of, days)
    return p.withColumn("status", F.when((F.col("status") == "pending") & past, "ignored").otherwise(F.col("status"))).drop("p")


def spread_nature(companies: DataFrame, jobs: DataFrame, natures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A new nature (id, nature) for companies, and for their postings that have none."""
    clean = natures.select("id", T.clean_nature(F.col("nature")).alias("__n")).where("__n is not null")
    named = companies.join(clean, "id", "left").withColumn("company_nature", F.coalesce("__n", "company_nature")).drop("__n")
    filled = jobs.join(clean.withColumnRenamed("id", "company_id"), "company_id", "left")
    return named, filled.withColumn("company_nature", F.when(T.or_empty(F.col("company_nature")) == "", F.col("__n")).otherwise(F.col("company_nature"))).drop("__n")


def promote_trusted(companies: DataFrame) -> DataFrame:
    """Unverified companies with a trusted host among their URLs become official, with those
    URLs as career pages; aggregators stay as they are."""
    empty = F.expr("cast(array() as array<string>)")
    urls = F.filter(U.preferred(F.concat(F.coalesce("hint_apply_urls", empty), F.coalesce("career_urls", empty)), 10), U.is_trusted)
    judged = companies.withColumn("__u", urls)
    hit = (F.col("verify_status") == "unverified") & (F.size("__u") > 0) & ~T.is_aggregator(F.concat_ws(" ", "name", F.array_join("__u", " ")))
    return judged.withColumns({"verify_status": F.when(hit, "official").otherwise(F.col("verify_status")), "career_urls": F.when(hit, F.col("__u")).otherwise(F.col("career_urls"))}).drop("__u")


def upgrade_legacy(links: DataFrame, lookup: DataFrame) -> DataFrame:
    """Links (url) of the old form, by a lookup of (uuid, job_ad_id), in the new form."""
    path = U.path(F.col("url"))
    parts = links.withColumns({"__ch": F.regexp_extract(path, R.LEGACY_PATH, 1), "uuid": F.when(R.is_legacy_url(F.col("url")), F.lower(F.regexp_extract(path, R.LEGACY_PATH, 2)))})
    known = lookup.where(F.rlike("job_ad_id", F.lit(r"^\d+$"))).select(F.lower("uuid").alias("uuid"), "job_ad_id").dropDuplicates(["uuid"])
    new = F.concat(U.scheme(F.col("url")), F.lit("://"), U.part(F.col("url"), 2), F.lit("/"), F.col("__ch"), F.lit("/detail?jobAdId="), F.col("job_ad_id"))
    return parts.join(known, "uuid", "left").withColumn("current_url", F.coalesce(F.when(F.col("job_ad_id").isNotNull(), new), "url")).drop("__ch", "uuid", "job_ad_id")


# lists and counts


def valid_sessions(sessions: DataFrame, accounts: DataFrame, as_of: date, now: Column) -> DataFrame:
    """Sessions that haven't ended, of accounts that are enabled and not past their day."""
    live = accounts.where(R.is_valid_account(F.col("enabled"), F.col("expires_at"), as_of)).select("account")
    return sessions.where(F.col("session_expires") > now).join(live, "account")


def has_accounts(accounts: DataFrame, as_of: date) -> DataFrame:
    """One row: whether any account can be used."""
    return accounts.where(R.is_valid_account(F.col("enabled"), F.col("expires_at"), as_of)).limit(1).agg((F.count(F.lit(1)) > 0).alias("any_account"))


def cluster_order(rows: DataFrame, key: str = "company", *, descending: bool = False) -> DataFrame:
    """Rows by company cluster (six characters of the key, the key), title, page date and
    input position, all in one direction."""
    norm = T.company_key(F.col("company"))
    keys = {"company": [F.left(norm, F.lit(6)), norm], "title": [F.lower(T.or_empty(F.col("title")))], "updated": [F.coalesce("open_at", "list_updated_at", "published_at", F.lit(""))]}
    order = [*keys[key], *keys["company"], *keys["title"], *keys["updated"], F.col("pos")]
    return rows.orderBy(*[k.desc() if descending else k.asc() for k in order])


def find_company(wanted: DataFrame, companies: DataFrame) -> DataFrame:
    """want_id and company_id: by id, else by normalised name."""
    w = wanted.withColumns({"__cid": T.strip(T.or_empty(F.col("company_id"))), "__norm": T.company_key(F.col("company_name"))})
    by_id = companies.select(F.col("id").alias("__cid"), F.col("id").alias("__a"))
    by_name = companies.groupBy(F.col("name_norm").alias("__norm")).agg(F.min("id").alias("__b")).where("__norm != ''")
    return w.join(by_id, "__cid", "left").join(by_name, "__norm", "left").select("want_id", F.coalesce("__a", "__b").alias("company_id"))


def newest(rows: DataFrame, status: Column, time: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows of a status, newest first (ties by id)."""
    found = rows.where(status).orderBy(F.desc(time), "id")
    return (found.offset(offset) if offset else found).limit(limit)


def search_reviews(queue: DataFrame, keyword: str) -> DataFrame:
    """Entries whose payload's company or title has the keyword, else their reason or kind."""
    p = F.from_json("payload", PAYLOAD)
    low = lambda *cols: F.lower(F.concat_ws(" ", *cols))
    read = queue.withColumn("p", p)
    text = F.when(F.col("p").isNotNull(), low(F.col("p.company"), F.col("p.title"))).otherwise(low(F.col("reason"), F.col("kind")))
    return read.where(F.contains(text, F.lit(keyword.lower()))).drop("p")


def capped_by_company(reviews: DataFrame, jobs: DataFrame, n: int) -> DataFrame:
    """Reviews, then postings, one of each identity, the first ``n`` of every company."""
    from pyspark.sql.window import Window

    both = reviews.withColumn("__from", F.lit(0)).unionByName(jobs.withColumn("__from", F.lit(1)))
    once = _first(both, ["company", "identity"], ["__from", "id"])
    order = Window.partitionBy("company").orderBy("__from", "id")
    return once.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n", "__from")


def mark_outside(rows: DataFrame, as_of: date, months: int = V.LIST_MONTHS) -> DataFrame:
    """Rows with ``outside`` where their date lies before the window; none is dropped."""
    day = D.loose_date(F.coalesce(F.col("list_updated_at"), F.col("published_at")))
    return rows.withColumn("outside", F.coalesce(day < D.list_cutoff(as_of, months), F.lit(False)))


def action_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def dashboard(counts: dict[str, DataFrame]) -> DataFrame:
    """name and n: row counts of several tables, each one partial aggregate."""
    found = None
    for name, rows in counts.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        found = one if found is None else found.unionByName(one)
    return found

