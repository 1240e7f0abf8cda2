"""Collection as jobs over landed pages and feeds: parsed rows to routed postings."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import classify as C
from millrace.functions import dates as D
from millrace.functions import labels as L
from millrace.functions import pages as P
from millrace.functions import records as R
from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.functions import vocab as V
from millrace.operators import dedupe
from millrace.operators.workflow import _first
from millrace.session import durable
from millrace.sources import feeds
from millrace.sources import html as H

c = F.col


def posting_rows(parsed: DataFrame, companies: DataFrame, as_of: date) -> DataFrame:
    """Parsed rows (company_id, url, title, ...) with their company as full posting rows."""
    co = companies.select(c("id").alias("company_id"), c("name").alias("__seed"), "company_nature", "industry")
    joined = parsed.join(co, "company_id")
    named = T.group_and_company(c("__seed"), c("page_company"))
    some = lambda *names: F.coalesce(*[T.non_blank(c(n)) for n in names])
    return joined.withColumn("__g", named).select(
        "company_id", F.nullif(c("__g.group_name"), F.lit("")).alias("group_name"), c("__g.company").alias("company"), "company_nature", "industry", "title", c("url").alias("source_url"), F.coalesce(T.non_blank(c("apply_url")), c("url")).alias("apply_url"),
        "recruit_project", "recruit_bucket", "work_location", "deadline", some("published_at", "list_updated_at", "open_at").alias("open_at"), D.resolve_batch(c("title"), c("jd_text"), c("graduation_batch"), as_of).alias("graduation_batch"),
        "education", "salary_range", "headcount", "jd_text", F.coalesce(c("job_tags"), F.expr("cast(array() as array<string>)")).alias("job_tags"), "raw_category", F.coalesce(T.non_blank(c("parse_status")), F.lit("ok")).alias("parse_status"), "confidence", F.lit("pending_review").alias("status"),
    )


def handle_details(rows: DataFrame, as_of: date) -> DataFrame:
    """Parsed details (company, title, jd_text, url, recruit_project, recruit_bucket,
    work_location, graduation_batch, official, trusted, ...) after title repair, gates,
    project defaults and scoring: all columns, with ``fate`` (go, skip, chrome_title or
    company_mismatch) and the repaired values. What may go is routed by ``classify.routed``."""
    names = rows.columns
    raw = T.strip(T.or_empty(c("title")))
    repaired = rows.withColumn("__page", raw).withColumn("__clean", L.sanitized_title(raw)).withColumn("__found", F.when(c("__clean").isNull() | T.is_noise_title(raw), L.title_in_text(c("jd_text"))))
    place = F.when(~T.is_noise_place(c("work_location")), c("work_location"))
    one = repaired.withColumns({"title": F.coalesce("__found", "__clean"), "__place": F.coalesce(place, L.place_in_text(c("jd_text")))})
    facts = C.with_title_facts(one)
    closed = c("__closed_title") | T.is_closed_text(c("jd_text"))
    bare = c("title").isNull() | (c("__noise") & ~c("__shell"))
    fate = F.when(closed, "skip").when(bare & (c("__page") != "") & T.is_noise_title(c("__page")), "chrome_title").when(bare, "skip").when(c("__mismatch"), "company_mismatch").otherwise("go")
    social = C.is_social(c("title"), c("jd_text"), c("recruit_project"))
    told = facts.withColumns({"fate": fate, "__social": social})
    project = F.coalesce(T.non_blank(c("recruit_project")), F.when(c("__social"), "社会招聘").otherwise("校园招聘"))
    staged = told.withColumns({"recruit_project": project, "work_location": c("__place")})
    bucket = F.when(c("__social"), F.when(c("recruit_bucket") != "校招", c("recruit_bucket"))).otherwise(F.coalesce(T.non_blank(c("recruit_bucket")), C.map_bucket(c("recruit_project"), c("title")), F.lit("校招")))
    kept = staged.withColumn("recruit_bucket", bucket).withColumn("graduation_batch", D.resolve_batch(c("title"), c("jd_text"), c("graduation_batch"), as_of))
    score = C.confidence(c("trusted"), T.is_aggregator(F.concat_ws(" ", "title", "jd_text")))
    full = (T.or_empty(c("jd_text")) != "") & c("title").isNotNull()
    base = kept.withColumn("__s", score).withColumn("__s", F.when(full, F.least(F.lit(1.0), F.greatest(c("__s"), F.lit(0.75)))).when(c("__shell"), F.greatest(c("__s"), F.lit(0.6))).otherwise(c("__s")))
    year = str(D.target_year(as_of))
    wanted = T.has_any(F.concat_ws(" ", "title", "jd_text"), (f"{year}届", f"{year}应届", f"{year[2:]}届", f"{year[2:]}应届"))
    stale = C.is_stale_batch(c("graduation_batch"), c("recruit_bucket"), c("title"), as_of)
    boosted = F.when(wanted, F.least(c("__s") + 0.05, F.lit(1.0))).otherwise(c("__s"))
    final = F.round(F.when(stale, F.greatest(boosted - 0.15, F.lit(0.2))).otherwise(boosted), 6)
    return base.withColumns({"confidence": final, "stale_batch": stale}).select(*names, *[n for n in ("confidence", "graduation_batch", "fate", "stale_batch") if n not in names])


def feed_gate(items: DataFrame, per_feed: int = P.FEED_ITEMS) -> DataFrame:
    """Feed items (feed, pos, title, description) with ``gate``: skipped beyond the first
    items, as aggregator, as noise or as no hiring notice; else to be read."""
    late = c("pos") > per_feed
    gate = F.when(late, "late").when(T.is_aggregator(F.concat_ws(" ", "title", "description")), "aggregator").when(T.is_noise_title(c("title")), "noise").when(~T.matches(c("title"), P.FEED_WORDS), "other").otherwise("read")
    return items.withColumn("gate", gate)


def strict_match(wanted: DataFrame, candidates: DataFrame) -> DataFrame:
    """want_id and candidate_id: by application or detail URL; by source URL and then title
    only where the wanted row names no posting's page. The first candidate counts."""
    key = lambda name: F.nullif(U.identity_url(c(name)), F.lit(""))
    specific = lambda name: F.contains(F.lower(T.or_empty(c(name))), F.lit("#/job/")) | F.contains(T.or_empty(c(name)), F.lit("__job=")) | U.is_detail_url(T.or_empty(c(name)))
    low = lambda name: F.nullif(F.lower(T.strip(T.or_empty(c(name)))), F.lit(""))
    w = wanted.select("want_id", key("apply_url").alias("a"), key("source_url").alias("s"), low("title").alias("t"), (specific("apply_url") | specific("source_url")).alias("exact"))
    n = candidates.select("candidate_id", "pos", key("apply_url").alias("a"), key("detail_url").alias("d"), key("source_url").alias("s"), low("title").alias("t"))

    def hits(left: DataFrame, right: DataFrame, rank: int) -> DataFrame:
        return left.where("k is not null").join(right.where("k is not null"), "k").select("want_id", "candidate_id", "pos", F.lit(rank).alias("way"))

    open_ = w.where("not exact")
    found = hits(w.select("want_id", c("a").alias("k")), n.select("candidate_id", "pos", c("a").alias("k")).union(n.select("candidate_id", "pos", c("d").alias("k"))), 1)
    found = found.union(hits(open_.select("want_id", c("s").alias("k")), n.select("candidate_id", "pos", c("s").alias("k")), 2)).union(hits(open_.select("want_id", c("t").alias("k")), n.select("candidate_id", "pos", c("t").alias("k")), 3))
    return _first(found, ["want_id"], ["way", "pos", "candidate_id"]).select("want_id", "candidate_id", "way")


def reidentified(jobs: DataFrame, parses: DataFrame, matches: DataFrame) -> DataFrame:
    """Postings after a second reading: filled by their matched parse, with what changed and
    ``action`` (update, unchanged or missing)."""
    named = parses.select("candidate_id", F.struct(*[k for k in R.FILLABLE if k in parses.columns], *[k for k in ("company",) if k in parses.columns]).alias("n"))
    keys = [k for k in R.FILLABLE if k in jobs.columns and k in parses.columns]
    both = jobs.select("id", F.struct(*jobs.columns).alias("w")).join(matches.select(c("want_id").alias("id"), "candidate_id"), "id", "left").join(named, "candidate_id", "left")
    filled = both.withColumn("changed", F.when(c("n").isNotNull(), R.changes("w", "n", tuple(keys))))
    values = [F.when(c("n").isNotNull(), R.overlaid("w", "n", k)).otherwise(c(f"w.{k}")).alias(k) for k in keys]
    action = F.when(c("n").isNull(), "missing").when(F.size("changed") > 0, "update").otherwise("unchanged")
    return filled.select("id", *values, "changed", action.alias("action"))


def sync_seed_urls(companies: DataFrame, replacements: DataFrame) -> DataFrame:
    """Companies whose seed URLs follow corrected links: replacements are (id, pos, old_url,
    new_url); old ones are replaced in place, new ones join, trusted ones as career pages."""
    from millrace.operators.dedupe import replace_urls

    key = lambda u: F.coalesce(F.nullif(U.dedupe_url(u), F.lit("")), F.lower(u))
    ordered = replacements.where(key(c("old_url")) != key(c("new_url"))).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "old_url", "new_url"))).alias("__r"))
    pairs = F.transform("__r", lambda r: F.struct(key(r["old_url"]).alias("key"), F.when(U.looks_like_url(r["new_url"]), T.strip(r["new_url"])).alias("url")))
    empty, none = F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<struct<key:string,url:string>>)")
    new = F.filter(F.transform("__r", lambda r: T.strip(r["new_url"])), U.looks_like_url)

    def after(name: str, more: Column) -> Column:
        now = F.transform(F.coalesce(c(name), empty), lambda u: F.struct(key(u).alias("key"), u.alias("url")))
        return F.array_distinct(F.concat(F.transform(replace_urls(now, F.coalesce(c("__p"), none)), lambda x: x["url"]), more))

    joined = companies.join(ordered, "id", "left").withColumns({"__p": pairs, "__new": F.coalesce(new, empty)})
    return joined.withColumns({"hint_apply_urls": after("hint_apply_urls", c("__new")), "career_urls": after("career_urls", F.filter("__new", lambda u: U.is_trusted(u) | U.is_campus_url(u)))}).drop("__r", "__p", "__new")


def set_verify(companies: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verify status and career URLs (id, status, urls) of companies; others stay."""
    v = verdicts.select("id", c("status").alias("__s"), c("urls").alias("__u"))
    return companies.join(v, "id", "left").withColumns({"verify_status": F.coalesce("__s", "verify_status"), "career_urls": F.coalesce("__u", "career_urls")}).drop("__s", "__u")


def clear_social(jobs: DataFrame) -> DataFrame:
    """Clear social hiring is deleted, other texts lose repeated header lines."""
    action = C.campus_action(c("title"), c("jd_text"), c("recruit_project"), c("recruit_bucket"), c("raw_category"))
    text = L.strip_meta(c("jd_text"), [c("title"), c("company"), c("recruit_project"), c("recruit_bucket")])
    acted = jobs.withColumn("__a", action)
    return acted.withColumns({"status": F.when(c("__a") == "delete", "deleted").otherwise(c("status")), "jd_text": F.when(c("__a") == "keep", F.coalesce(text, c("jd_text"))).otherwise(c("jd_text"))}).drop("__a")


def start_run(queue: DataFrame, companies: DataFrame, run_id: str, *, reset: bool = False) -> DataFrame:
    """The queue with a run over companies (id): entries that are there stay; a reset
    cancels what other runs have left."""
    open_ = c("status").isin("pending", "running")
    old = queue.withColumn("status", F.when(open_ & F.lit(reset), "cancelled").otherwise(c("status")))
    there = queue.where(c("run_id") == run_id).select(c("company_id"))
    new = companies.where("id is not null").select(c("id").alias("company_id")).distinct().join(there, "company_id", "left_anti")
    return old.unionByName(new.select(F.lit(run_id).alias("run_id"), "company_id", F.lit("pending").alias("status"), F.lit(0).alias("attempts")))


def push_chunks(rows: DataFrame, send, size: int = V.PUSH_CHUNK) -> None:
    """Send rows to a sink in chunks from the tasks that hold them; ``send`` gets a list of
    dicts and has to be safe to repeat (an upsert), as a lost task is run again."""

    def run(part) -> None:
        chunk: list[dict] = []
        for row in part:
            chunk.append(row.asDict(recursive=True))
            if len(chunk) == size:
                send(chunk)
                chunk = []
        if chunk:
            send(chunk)

    rows.foreachPartition(run)


def migrated(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of an older table with the columns that it lacks, and buckets of older names."""
    filled = rows.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n not in rows.columns})
    bucket = F.when(~c("recruit_bucket").isin(*V.BUCKETS), C.normal_bucket(c("recruit_bucket"), c("recruit_project"), c("title"))).otherwise(c("recruit_bucket"))
    return filled.withColumn("recruit_bucket", bucket).select(*columns) if "recruit_bucket" in columns else filled.select(*columns)


def best_source(lists: list[tuple[str, DataFrame]], page: str = "page_id") -> DataFrame:
    """Rows of a page from the first of several sources that has any, with ``source``."""
    tagged = None
    for rank, (name, rows) in enumerate(lists):
        one = rows.withColumns({"source": F.lit(name), "__rank": F.lit(rank)})
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    best = tagged.groupBy(page).agg(F.min("__rank").alias("__rank"))
    return tagged.join(best, [page, "__rank"]).drop("__rank")


#: Why the clean-up deletes a posting, in the order of its report.
DELETIONS = ("noise_title", "closed_or_referral_title", "closed_or_referral_jd", "company_recruit_shell", "company_mismatch", "duplicate", "portal_shell_extra")


def deletions(jobs: DataFrame) -> DataFrame:
    """Shown and pending postings (id, company, title, jd_text, source_url, apply_url, ...)
    with the ``reason`` for which the clean-up deletes them; null for those that stay.

    Closed and noisy titles come first, then closed texts, then titles of another company;
    only what is left is compared within its company, where the best of a title stays, and
    shells beside details or beside a better shell go. Titles of company and season alone
    are no reason any more, so that counter stays at zero."""
    title, text = T.or_empty(c("title")), T.or_empty(c("jd_text"))
    first = F.when(T.is_closed_title(title), "closed_or_referral_title").when(T.is_noise_title(title), "noise_title").when(T.is_closed_text(text), "closed_or_referral_jd").when(T.title_mismatch(c("company"), title), "company_mismatch")
    url = F.coalesce(T.non_blank(c("apply_url")), c("source_url"))
    facts = {"company_key": T.company_key(c("company")), "title_key": T.title_key(title), "identity": F.coalesce(U.identity_url(url), F.lit("")), "has_detail": F.coalesce(U.is_detail_url(url), F.lit(False)), "jd_len": F.length(text), "is_shell": F.coalesce(C.is_portal_shell(title, text), F.lit(False))}
    judged = durable(jobs.where(c("status").isin("active", "pending_review")).withColumns({"reason": first, **facts}))
    fates = dedupe.clean_up(judged.where("reason is null")).select("id", F.when(F.startswith("fate", F.lit("duplicate")), "duplicate").when(c("fate") == "shell", "portal_shell_extra").alias("__fate"))
    return judged.drop(*facts).join(fates, "id", "left").withColumn("reason", F.coalesce("reason", "__fate")).drop("__fate")


def deletion_counts(jobs: DataFrame) -> DataFrame:
    """One row: deletions by each reason, all deletions, and the postings still shown."""
    told = deletions(jobs)
    return told.agg(F.count("reason").alias("deleted"), *[F.count_if(c("reason").eqNullSafe(r)).alias(r) for r in DELETIONS], F.count_if(c("reason").isNull() & (c("status") == "active")).alias("active_remaining"))


#: Confidence of a detail by its adapter: base, title, text over 40, place, kind.
DETAIL_POINTS = {"moka": (0.55, 0.15, 0.2, 0.05, 0.0), "zhiye": (0.55, 0.15, 0.2, 0.05, 0.0), "feishu": (0.6, 0.15, 0.15, 0.05, 0.05)}

#: A card's line of city, kind and category, and the words of kinds.
CARD_META = r"([\u4e00-\u9fffA-Za-z·、,/ ]{2,40})\s*[|｜]\s*(实习|正式|校招|社招|全职|兼职)\s*[|｜]\s*([^\n|｜]{2,40})"
REGULAR_WORDS, SOCIAL_WORDS = ("正式", "校招", "全职", "校园"), ("社招", "社会招聘")

INIT_JOBS = "array<struct<id string, title string, jobDescription string, description string, locations array<struct<cityName string>>>>"


def detail_records(pages: DataFrame, *, basic: bool = False) -> DataFrame:
    """Detail pages (page_id, url, html) by the rules of the source that their host belongs to:
    adapter, title, jd_text, recruit_project, recruit_bucket, work_location, raw_category,
    job_tags, parse_status, confidence, apply_url, source.

    A page is parsed once; the sources differ in what they read first (embedded postings and
    state, sections, a message's body), in how a noisy title is mended, in how kinds become
    projects, and in their confidence. Pages without title and text, and those of other
    hosts, go by the general rules; script-only list pages of one source are told as such.
    ``basic``: titles and headings by ``html.basic_heads``."""
    facts = H.detail_facts(pages, basic).withColumns({"adapter": U.adapter(c("url")), "blob": F.array_join(feeds.embedded_json(T.or_empty(c("html"))), "\n")})
    is_ = lambda *names: c("adapter").isin(*names)

    # an embedded posting: the one that the address names, else the only one
    jobs = F.filter(F.from_json(F.get_json_object(P.init_data(c("html")), "$.jobs"), INIT_JOBS), lambda j: T.or_empty(j["title"]) != "")
    own_id = F.regexp_extract(c("url"), r"(?i)(?:/jobs?/|/position/|jobadid=)([^/?#&]+)", 1)
    named = F.get(F.filter("jobs", lambda j: j["id"] == own_id), F.lit(0))
    chosen = F.coalesce(named, F.when(F.size("jobs") == 1, F.get("jobs", F.lit(0))))
    cities = lambda xs: F.nullif(F.array_join(F.array_distinct(F.filter(xs, lambda x: T.or_empty(x) != "")), " / "), F.lit(""))
    one = facts.withColumn("jobs", F.when(is_("moka"), jobs)).withColumn("job", chosen).withColumn("several", (F.size("jobs") > 1) & (own_id == ""))
    blob_cities = F.regexp_extract_all(F.regexp_extract("blob", r'"city_list"\s*:\s*\[(.*?)\]', 1), F.lit(r'"name"\s*:\s*"([^"]*)"'), F.lit(1))
    blob_kind = F.nullif(F.regexp_extract("blob", r'"recruit_type"\s*:\s*\{[^}]*?"name"\s*:\s*"([^"]*)"', 1), F.lit(""))
    blob_category = F.nullif(F.regexp_extract("blob", r'"(?:job_category|job_function)"\s*:\s*\{[^}]*?"name"\s*:\s*"([^"]*)"', 1), F.lit(""))
    meta = lambda i: F.nullif(T.strip(F.regexp_extract("head", CARD_META, i)), F.lit(""))
    two = one.withColumns(
        {
            "kind": F.when(is_("feishu"), F.coalesce(blob_kind, meta(2))),
            "category": F.when(is_("feishu"), F.coalesce(blob_category, meta(3))),
            "shown_place": F.when(is_("feishu"), F.coalesce(cities(blob_cities), meta(1))).when(is_("moka"), cities(F.transform("job.locations", lambda x: x["cityName"]))),
            "text": F.when(is_("wechat"), c("message")).otherwise(F.coalesce(T.non_blank(F.coalesce("job.jobDescription", "job.description")), R.dug_text(c("blob")), F.when(is_("zhiye", "feishu"), c("section")), T.non_blank(c("longest")))),
            "said": F.when(is_("wechat"), c("headline")).otherwise(F.coalesce("job.title", "title", R.dug_title(c("blob")))),
        }
    )
    noisy = T.is_noise_title(T.or_empty(c("said")))
    mended = F.when(is_("wechat"), T.non_blank(c("said"))).when(~noisy, F.when(is_("moka"), L.sanitized_title(c("said"))).otherwise(T.strip(c("said")))).when(is_("moka", "zhiye"), L.title_in_text(c("text")))
    three = two.withColumn("own_title", mended).withColumn("place", F.when(is_("feishu", "wechat"), c("shown_place")).otherwise(F.coalesce("shown_place", L.place_in_text(c("text")))))
    kind = T.strip(T.or_empty(c("kind")))
    told = F.concat(kind, F.lit(" "), T.or_empty(c("own_title")))
    worded = C.project_of(c("own_title"), F.when(is_("feishu"), kind).otherwise(c("text")))
    four = three.withColumn("worded", worded).withColumns(
        {
            "project": F.when(is_("feishu"), F.when(F.contains(told, F.lit("实习")), F.coalesce(F.nullif(kind, F.lit("")), F.lit("实习"))).when(T.has_any(told, REGULAR_WORDS), F.coalesce(F.nullif(kind, F.lit("")), F.lit("正式"))).when(T.has_any(told, SOCIAL_WORDS), F.coalesce(F.nullif(kind, F.lit("")), F.lit("社招"))).otherwise(F.coalesce(c("worded"), F.nullif(kind, F.lit("")), F.lit("校园招聘")))).when(is_("wechat"), F.coalesce(c("worded"), F.when(c("own_title").isNotNull(), "公众号公告"))).otherwise(c("worded")),
        }
    )
    mapped = C.map_bucket(F.when(is_("wechat"), c("worded")).otherwise(c("project")), c("own_title"))
    five = four.withColumn("bucket", F.when(is_("feishu"), F.when(F.contains(told, F.lit("实习")), "日常实习").when(T.has_any(told, REGULAR_WORDS + SOCIAL_WORDS), "校招").otherwise(F.coalesce(mapped, F.lit("校招")))).otherwise(mapped))

    general = P.general_records(five.select("page_id", "title", "longest", "html")).select(c("page_id").alias("g_id"), F.struct("title", "jd_text", "recruit_project", "recruit_bucket", "work_location", "parse_status", "confidence").alias("g"))
    shell = is_("hotjob") & P.is_spa_shell(c("html"))
    listed = (is_("moka") & c("several")) | shell
    by_rule = ~is_("generic", "hotjob") & (is_("wechat") | c("own_title").isNotNull() | c("text").isNotNull())
    state = five.withColumns({"listed": F.coalesce(listed, F.lit(False)), "ruled": F.coalesce(by_rule, F.lit(False)), "channel": R.channel_of_url(c("url"))}).drop("title", "longest", "html", "jobs", "job")
    joined = durable(state).join(general, c("page_id") == c("g_id"), "left")

    part = lambda test, x: F.when(F.coalesce(test, F.lit(False)), F.lit(x)).otherwise(F.lit(0.0))
    points = F.lit(0.0)
    for name, (base, title, text, place, known) in DETAIL_POINTS.items():
        sure = F.lit(base) + part(c("own_title").isNotNull(), title) + part(F.length("text") > 40, text) + part(c("place").isNotNull(), place) + part(c("kind").isNotNull(), known)
        points = F.when(is_(name), F.least(F.lit(0.95), sure)).otherwise(points)
    points = F.when(is_("wechat"), F.when(c("own_title").isNotNull() & c("text").isNotNull(), 0.65).otherwise(0.4)).otherwise(points)
    projects = F.coalesce(*[F.when(c("channel") == k, F.lit(v)) for k, v in {"campus": "校园招聘", "intern": "实习生招聘", "social": "社会招聘"}.items()])
    buckets = F.coalesce(*[F.when(c("channel") == k, F.lit(v)) for k, v in {"campus": "校招", "intern": "日常实习"}.items()])
    pick = lambda own, other, of_list=None: F.when(c("listed"), F.lit(None) if of_list is None else F.when(is_("hotjob"), of_list)).when(c("ruled"), own).otherwise(other)
    source = F.when(c("listed"), F.when(is_("hotjob"), "hotjob_list_shell").otherwise("moka_list")).when(c("ruled"), F.concat("adapter", F.lit("_detail"))).otherwise("general")
    title = pick(c("own_title"), c("g.title"))
    return joined.select(
        "page_id", "adapter", title.alias("title"), pick(c("text"), c("g.jd_text")).alias("jd_text"), pick(c("project"), c("g.recruit_project"), projects).alias("recruit_project"), pick(c("bucket"), c("g.recruit_bucket"), buckets).alias("recruit_bucket"),
        pick(c("place"), c("g.work_location")).alias("work_location"), pick(F.coalesce("category", "kind"), F.lit(None).cast("string")).alias("raw_category"), T.tags(T.or_empty(title)).alias("job_tags"),
        F.when(c("listed"), "needs_browser").when(c("ruled"), F.when(c("own_title").isNotNull(), "ok").otherwise("needs_browser")).otherwise(c("g.parse_status")).alias("parse_status"),
        F.round(F.when(c("listed"), F.lit(0.15)).when(c("ruled"), points).otherwise(c("g.confidence")), 6).alias("confidence"),
        F.when(is_("hotjob"), P.with_post_type(c("url"), c("channel"))).otherwise(c("url")).alias("apply_url"), source.alias("source"),
    )


def page_candidates(pages: DataFrame, as_of: date, months: int = V.LIST_MONTHS, *, basic: bool = False) -> DataFrame:
    """Postings that pages (page_id, url, html) offer: page_id, source, pos, title, link,
    outside (older than ``months``), notices of the page, and error where it offers none.

    Sources are tried in order: embedded data, job table, cards, links to details; a list of
    one yields to the page's own detail. What a passed-over source held is told in a notice.
    A page is parsed once, and a page's sources are compared by one aggregate. ``basic``:
    titles and headings by ``html.basic_heads``."""
    offered = H.page_sources(pages, basic)
    titled = offered.withColumn("own", T.strip_chrome(c("title")))
    link = F.when(c("link").isNotNull() & (c("source") > 1), H.absolute(c("link"), c("url"))).otherwise(c("link"))
    named = titled.withColumn("link", link).where((c("source") != 3) | U.is_detail_link(c("link"), c("title")))
    fit = (T.or_empty(c("title")) != "") & ~T.is_noise_title(T.or_empty(c("title"))) & ~T.is_closed_title(T.or_empty(c("title")))
    day = D.loose_date(c("updated"))
    judged = durable(named.withColumns({"fit": F.coalesce(fit, F.lit(False)) & ((c("source") != 4) | c("place").isNotNull()), "outside": F.coalesce(day < F.lit(as_of) - F.expr(f"interval {30 * months} days"), F.lit(False))}))

    by_source = judged.groupBy("page_id", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if("fit").alias("fit"), F.count_if(c("fit") & c("outside")).alias("outside"))
    tried = F.array_sort(F.collect_list(F.struct("source", "n", "fit", "outside")))  # at most one entry a source
    page = by_source.groupBy("page_id").agg(tried.alias("tried"))
    lists = F.filter("tried", lambda t: (t["source"] < 4) & (t["fit"] > 0))
    detail = F.exists("tried", lambda t: (t["source"] == 4) & (t["fit"] > 0))
    first = F.get(lists, F.lit(0))
    taken = F.when(first.isNotNull() & ((first["fit"] > 1) | ~detail), first["source"]).when(detail, F.lit(4))
    name = lambda i: F.element_at(F.array(*[F.lit(n) for n in H.SOURCES]), i + 1)
    passed = F.filter("tried", lambda t: (t["fit"] == 0) & (t["source"] < F.coalesce(c("taken"), F.lit(9))))
    unfit = F.transform(passed, lambda t: F.concat(name(t["source"]), F.lit(": "), t["n"].cast("string"), F.lit(" unusable")))
    late = F.get(F.filter("tried", lambda t: t["source"] == c("taken")), F.lit(0))["outside"]
    told = F.when(late > 0, F.array(F.concat(late.cast("string"), F.lit(" outside the window")))).otherwise(F.expr("cast(array() as array<string>)"))
    chosen = page.withColumn("taken", taken).select("page_id", "taken", F.concat(unfit, told).alias("notices"))

    empty = pages.select("page_id", H.blocked(F.lit(None).cast("int"), c("html")).alias("barred"), (T.or_empty(c("html")) == "").alias("blank"))
    fits = judged.where("fit").select("page_id", c("source").alias("taken"), "pos", "own", "title", "link", "outside")
    found = empty.join(chosen, "page_id", "left").join(fits, ["page_id", "taken"], "left")
    error = F.when(c("taken").isNotNull(), F.lit(None)).when(c("barred"), "access barrier").when(c("blank"), "empty page").otherwise("no posting")
    title = F.when(c("taken").isNotNull(), F.coalesce("own", "title"))
    return found.select("page_id", name(c("taken")).alias("source"), "pos", title.alias("title"), "link", "outside", F.coalesce("notices", F.expr("cast(array() as array<string>)")).alias("notices"), error.alias("error"))


def collect_pages(posts: DataFrame, known: DataFrame, budget: int, *, by: str = "company", page: str = "page", pos: str = "pos", key: str = "identity") -> DataFrame:
    """Posts of a company's pages in order, with ``action``: new, known, failed, left (the
    budget is spent) or unread (after the page where reading stops).

    Columns: the company, page, pos, key, ``ok`` (it would be published or queued) and
    ``outside`` (older than the window). Reading stops after a page with a post outside the
    window or with known keys only. A key is known from before (``known``), or from an earlier
    new post of the company; known posts cost no budget. Budgets are carried along by
    segmented running sums, so a company with most of the posts makes no task slow."""
    there = known.select(F.col(key), F.lit(True).alias("__known")).distinct()
    marked = durable(posts.join(there, key, "left").withColumn("__known", F.coalesce("__known", F.lit(False))))
    per_page = marked.groupBy(by, page).agg((F.max("outside") | F.min("__known")).alias("__stop"))
    read = dedupe.until_stop(per_page, [by], page, c("__stop")).select(by, page, F.lit(True).alias("__read"))
    at = F.struct(page, pos)
    seen = marked.join(read, [by, page], "left").withColumn("__read", F.coalesce("__read", F.lit(False)))
    open_ = c("__read") & ~c("__known")
    first = seen.where(open_ & c("ok")).groupBy(by, key).agg(F.min(at).alias("__first"))
    placed = seen.join(first, [by, key], "left").withColumn("__fresh", F.coalesce(open_ & c("ok") & (at == c("__first")), F.lit(False)))
    counted = dedupe.running(placed, [by], [page, pos], {"__n": F.when(c("__fresh"), 1).otherwise(0)})
    before = c("__n") - F.when(c("__fresh"), 1).otherwise(0)
    again = c("__known") | F.coalesce(at > c("__first"), F.lit(False))
    action = F.when(~c("__read"), "unread").when(before >= budget, "left").when(c("__fresh"), "new").when(again, "known").otherwise("failed")
    return counted.withColumn("action", action).select(*posts.columns, "action")


def page_run_stats(actions: DataFrame, by: str = "company", page: str = "page") -> DataFrame:
    """Counters of a company's collection: enum_total (most posts of a page), batch_new,
    skipped_known, failed, remaining (left over by the budget) and unread."""
    per_page = actions.groupBy(by, page).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c("action") == a).alias(a) for a in ("new", "known", "failed", "left", "unread")])
    return per_page.groupBy(by).agg(F.max("n").alias("enum_total"), F.sum("new").alias("batch_new"), F.sum("known").alias("skipped_known"), F.sum("failed").alias("failed"), F.sum("left").alias("remaining"), F.sum("unread").alias("unread"))


def snippet_natures(items: DataFrame, rules: dict[str, tuple[str, ...]]) -> DataFrame:
    """Search snippets (company, pos, text) that name their company, with the first nature
    whose phrases stand in them; ``vote.vote`` decides, and ties are conflicts."""
    name = T.squeeze(T.or_empty(c("company")))
    short = F.regexp_replace(name, r"(?:股份)?有限公司$|有限责任公司$|股份公司$|集团公司$|集团$|公司$", "")
    compact = T.squeeze(T.or_empty(c("text")))
    about = (name == "") | F.contains(compact, name) | ((F.length(short) >= 4) & F.contains(compact, short))
    nature = F.coalesce(*[F.when(T.has_any(c("text"), words), F.lit(n)) for n, words in rules.items()])
    return items.where(about).withColumn("nature", nature).where("nature is not null")


def login_step(state: tuple, at, ok: bool, failures: int, span) -> tuple[tuple, str]:
    """One attempt over an account's (failures, window start, lock end): the state after it,
    and whether it met a lock, failed or opened a session."""
    failed, opened, locked = state
    if locked is not None and locked > at:
        return state, "locked"
    if ok:
        return (0, None, None), "session"
    fresh = opened is None or opened < at - span
    failed, opened = (1, at) if fresh else (failed + 1, opened)
    return (failed, opened, at + span if failed >= failures else None), "failed"


def _fold_logins(failures: int, span: timedelta):
    """States of attempts (account, island, ts, id, ok) that come sorted: one at a time, so a
    task holds one state and a batch, whatever the number of an account's attempts."""

    def run(batches):
        key, state = None, (0, None, None)
        for batch in batches:
            told = []
            for account, island, at, ok in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if (account, island) != key:
                    key, state = (account, island), (0, None, None)
                state, result = login_step(state, at, ok, failures, span)
                told.append(result)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(2), pa.array(told, pa.string())], ["account", "id", "ts", "result"])

    return run


def login_locks(attempts: DataFrame, *, failures: int = V.LOGIN_FAILURES, minutes: int = V.LOGIN_WINDOW_MINUTES, hours: int = V.SESSION_HOURS) -> DataFrame:
    """Attempts (account, ts, id, ok) with ``result`` (locked, failed or session) and, for a
    session, ``expires_at``.

    The first failure opens a window; the fifth within it locks the account for as long;
    success clears both. Nothing of an account's state outlives a gap longer than the window,
    so an account is cut where a whole time slot of that width is empty, and its islands are
    folded by different tasks, in time order. Only attempts without such a gap follow each
    other in one task, one at a time."""
    kind = attempts.schema["account"].dataType.simpleString()
    rows = attempts.select("account", c("ts").cast("timestamp_ntz").alias("ts"), c("id").cast("bigint").alias("id"), F.coalesce("ok", F.lit(False)).alias("ok"))
    slot = F.floor(F.unix_seconds(c("ts").cast("timestamp")) / (60 * minutes))
    slotted = rows.withColumn("slot", slot)
    # slots are distinct by account: few rows, however many attempts
    slots = slotted.select("account", "slot").distinct()
    by = Window.partitionBy("account").orderBy("slot")
    begins = F.when(c("slot") - F.lag("slot").over(by) == 1, 0).otherwise(1)
    islands = slots.withColumn("begins", begins).withColumn("island", F.sum("begins").over(by)).select(c("account").alias("a"), c("slot").alias("s"), "island")
    placed = slotted.join(islands, c("account").eqNullSafe(c("a")) & (c("slot") == c("s"))).select("account", "island", "ts", "id", "ok")
    folded = placed.repartition("account", "island").sortWithinPartitions("account", "island", "ts", "id").mapInArrow(_fold_logins(failures, timedelta(minutes=minutes)), f"account {kind}, id bigint, ts timestamp_ntz, result string")
    return folded.withColumn("expires_at", F.when(c("result") == "session", c("ts") + F.expr(f"interval {hours} hours")))


def sessions_at(results: DataFrame, at: datetime) -> DataFrame:
    """account, id, expires_at of the sessions that live at a moment: an account's last login,
    unless it has expired (an earlier session ends with the next login)."""
    past = results.where((c("result") == "session") & (c("ts") <= F.lit(at).cast("timestamp_ntz")))
    last = past.groupBy("account").agg(F.max_by(F.struct("id", "expires_at"), F.struct("ts", "id")).alias("r")).select("account", "r.*")
    return last.where(c("expires_at") > F.lit(at).cast("timestamp_ntz"))
