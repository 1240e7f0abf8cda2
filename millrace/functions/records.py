"""Columns of a posting record: what a list shows, links, channels, small predicates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import classify as C
from millrace.functions import dates as D
from millrace.functions import labels as L
from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.functions import vocab as V

# fixed values
NO_JOB_CHROME = (
    r"(?iU)(欢迎登录|请登录|个人中心|用户登录|登录注册|修改密码|招聘系统|招贤纳才|招聘首页|招聘门户|微官网|兼容模式|旧版\s*IE|IE\s*浏览器|温馨提示|You need to enable JavaScript"
    r"|岗位已关闭|职位已关闭|网页已关停|页面已关闭)"
)
NO_JOB_ROLES = ("工程师", "开发", "算法", "产品", "运营", "设计", "分析师", "研究员", "专员", "经理", "管培", "实习", "顾问", "会计", "法务", "销售", "测试", "前端", "后端", "数据")
NO_JOB_ERRORS = ("未能识别为岗位页", "未能识别岗位信息", "页面内容为空", "列表为空", "无招聘", "岗位已关闭", "职位已关闭")
PATH_CHANNELS = (("campus", r"(?i)/(campus|school|campusrecruit|xyzp|campus-?job|校招)"), ("intern", r"(?i)/(interns?(?:\.html)?|internship|trainee|sxzp|实习)"), ("social", r"(?i)/(social|society|shzp|social-?recruit|社招)"))
QUERY_CHANNELS = (("campus", ("campus", "school")), ("intern", ("intern",)), ("social", ("social", "society")))
CHANNEL_KINDS = {"campus": ("校园招聘", "校招"), "intern": ("实习生招聘", "日常实习"), "social": ("社会招聘", None)}
POST_TYPES = {"campus": ("school", "campus"), "intern": ("intern", "interns", "internship"), "social": ("social", "society")}
LEGACY_PATH = r"(?i)^/(campus|intern|social)/jobs/([0-9a-f-]{16,})/?$"
CAREER_PATHS = ("/campus", "/campus/", "/recruit", "/recruit/", "/career", "/careers", "/school", "/joinus", "/about/recruit", "/jobs")
FILLABLE = ("title", "graduation_batch", "recruit_project", "recruit_bucket", "work_location", "open_at", "deadline", "source_url", "apply_url", "jd_text", "raw_category", "education", "salary_range", "headcount", "group_name")
FIELD_NAMES = {
    "title": "岗位名称", "graduation_batch": "毕业批次", "recruit_project": "招聘项目", "recruit_bucket": "类型", "work_location": "工作地点", "deadline": "截止时间",
    "source_url": "原文链接", "apply_url": "网申链接", "jd_text": "JD", "raw_category": "岗位类型", "education": "学历要求", "salary_range": "薪资范围",
}
TITLE_KEYS = ("title", "name", "jobtitle", "job_name", "postname")
TEXT_KEYS = ("description", "jobdescription", "job_description", "jd", "detail", "content")

c = F.col


def is_http(url: Column) -> Column:
    return F.coalesce(F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://")), F.lit(False))


# what a list shows


def page_updated(override: Column | None = None) -> Column:
    """Date of the page (never of the row) up to the minute, or a dash."""
    raw = F.coalesce(T.non_blank(c("open_at")), T.non_blank(c("list_updated_at")), T.non_blank(c("published_at")))
    raw = raw if override is None else F.coalesce(T.non_blank(override), raw)
    return F.coalesce(F.left(F.replace(raw, F.lit("T"), F.lit(" ")), F.lit(16)), F.lit("-"))


def job_url() -> Column:
    """The link to open: application, else source."""
    return T.strip(F.coalesce(F.nullif(c("apply_url"), F.lit("")), c("source_url"), F.lit("")))


def fill_url(apply: Column, source: Column) -> Column:
    """The first of the links that can be fetched, else whichever there is."""
    a, s = T.strip(T.or_empty(apply)), T.strip(T.or_empty(source))
    return F.when(is_http(a), a).when(is_http(s), s).when(a != "", a).otherwise(s)


def upload_progress(cloud: Column, local: Column) -> Column:
    """Not pushed, pushed, or changed since the push (times in ISO form compare as text)."""
    up, own = T.strip(T.or_empty(cloud)), T.strip(T.or_empty(local))
    short = F.left(up, F.lit(16))
    return F.when(up == "", "未推送").when((own != "") & (own > up), F.concat(F.lit("待推送（本地有更新 · 上次 "), short, F.lit("）"))).otherwise(F.concat(F.lit("已推送 "), short))


def shown_title(title: Column, text: Column) -> Column:
    return F.coalesce(L.sanitized_title(title), L.title_in_text(text), T.non_blank(title), F.lit("（无岗位名称）"))


def shown_place(place: Column) -> Column:
    return F.when(T.is_noise_place(place), "—").otherwise(T.strip(place))


def shown_text(text: Column) -> Column:
    return F.coalesce(T.strip_navigation(text), T.non_blank(text), F.lit("岗位介绍未解析"))


def shown_education(education: Column, text: Column, title: Column) -> Column:
    """The stored degree, else the text's (without its labels), else the title's."""
    return F.coalesce(T.non_blank(education), L.education_of(text, title), F.lit("-"))


def entry_title(company: Column, project: Column) -> Column:
    """Title of a portal that names no role."""
    name, p = F.coalesce(T.non_blank(company), F.lit("未知企业")), T.strip(T.or_empty(project))
    return F.when((p != "") & (p != "校园招聘") & ~T.is_noise_title(p), F.concat_ws(" ", name, p)).otherwise(F.concat(name, F.lit(" 校园招聘入口")))


def candidate_label(outside: Column) -> Column:
    """One line for a candidate: title, place, and a mark where it is out of the window."""
    label = F.coalesce(T.non_blank(c("title")), T.non_blank(c("apply_url")), F.lit("未命名岗位"))
    placed = F.when(T.or_empty(c("work_location")) != "", F.concat(label, F.lit("  ·  "), c("work_location"))).otherwise(label)
    when = F.coalesce(T.non_blank(c("list_updated_at")), T.non_blank(c("published_at")), F.lit(""))
    return F.when(outside, F.concat(F.lit("【超出近半年】"), placed, F.when(when != "", F.concat(F.lit("  ·  "), when)).otherwise(""))).otherwise(placed)


def candidate_preview(text: Column, size: int = 800) -> Column:
    t = T.or_empty(text)
    return F.when(F.length(t) <= size, t).otherwise(F.concat(F.left(t, F.lit(size)), F.lit("…")))


# overlays of one record by another


def overlaid(current: str, filled: str, key: str, only_empty: bool = False) -> Column:
    """A field after filling a form: non-blank new values win, or only into empty fields. A
    group may be cleared by a blank that isn't null."""
    old, new = T.strip(T.or_empty(c(f"{current}.{key}"))), T.strip(T.or_empty(c(f"{filled}.{key}")))
    if key == "group_name":
        kept = c(f"{filled}.{key}").isNull()
        return F.when(kept | ((old != "") & (new == "") & F.lit(only_empty)), old).otherwise(new)
    if key == "company":
        keep = (old != "") if only_empty else F.lit(False)
        return F.when((new != "") & (new != "未知企业") & ~keep, new).when(old == "", new).otherwise(old)
    blocked = (old != "") if only_empty else F.lit(False)
    return F.when((new == "") | blocked, old).otherwise(new)


def changes(before: str, after: str, keys: tuple[str, ...] = FILLABLE) -> Column:
    """Lines about the fields that a second reading changed."""

    def one(key: str) -> Column:
        old, new = T.strip(T.or_empty(c(f"{before}.{key}"))), T.strip(T.or_empty(c(f"{after}.{key}")))
        name = F.lit(FIELD_NAMES.get(key, key))
        size = lambda x: F.length(x).cast("string")
        if key == "jd_text":
            said = F.when(old != "", F.concat(name, F.lit("（"), size(old), F.lit("→"), size(new), F.lit(" 字；"), L.removed_summary(old, new), F.lit("）"))).otherwise(F.concat(name, F.lit("（新写入 "), size(new), F.lit(" 字）")))
        else:
            said = F.concat(name, F.lit("→"), F.when(F.length(new) <= 24, new).otherwise(F.concat(F.left(new, F.lit(23)), F.lit("…"))))
        return F.when((new != "") & (new != old), said)

    return F.array_compact(F.array(*[one(k) for k in keys]))


def hinted(detail: str, hint: str, key: str) -> Column:
    """A detail row's field, else that of its list row; a noise title gives way too."""
    own, other = c(f"{detail}.{key}"), c(f"{hint}.{key}")
    if key == "title":
        return F.when((T.is_noise_title(own) | (T.strip(T.or_empty(own)) == "")) & (T.or_empty(other) != "") & ~T.is_noise_title(other), other).otherwise(own)
    return F.coalesce(F.nullif(own, F.lit("")), other)


def links(apply: Column, listing: Column, page: Column) -> Column:
    """struct(apply_url, source_url): stand-ins and list pages are never the application."""
    a, s, p = (T.strip(T.or_empty(x)) for x in (apply, listing, page))
    say = lambda x, y: F.struct(x.alias("apply_url"), y.alias("source_url"))
    none = F.lit("")

    def judged(f: Column) -> Column:
        a, campus = f["a"], f["campus"]
        known = F.when(campus != "", campus).otherwise(a)
        return (
            F.when(is_http(a) & F.contains(a, F.lit("__job=")), say(none, F.when(campus != "", campus).otherwise(F.substring_index(a, "?", 1))))
            .when(is_http(a) & U.is_listing_url(a) & ~U.is_detail_url(a), say(none, known))
            .when(is_http(a), say(a, known))
            .otherwise(say(none, campus))
        )

    return T.let(F.struct(a.alias("a"), F.when(is_http(s), s).when(is_http(p), p).otherwise("").alias("campus")), judged)


# predicates


def no_posting(title: Column, text: Column) -> Column:
    """Whether fields look like a page without any posting."""
    facts = F.struct(T.strip(T.or_empty(title)).alias("t"), T.strip(T.or_empty(text)).alias("jd"))

    def judged(f: Column) -> Column:
        t, jd = f["t"], f["jd"]
        chrome = lambda x: T.matches(x, NO_JOB_CHROME)
        login = chrome(F.concat(t, F.lit("\n"), jd)) & ~T.has_any(t, NO_JOB_ROLES) & ((F.length(jd) < 80) | chrome(jd))
        return T.is_closed_title(t) | T.is_closed_text(jd) | ((t == "") & (jd == "")) | (L.is_shell_title(t) & (F.length(jd) < 40)) | login

    return T.let(facts, judged)


def result_without_posting(ok: Column, candidates: Column, error: Column, transport: Column) -> Column:
    """A reading that found no posting, as against one that failed on the way."""
    e = T.strip(T.or_empty(error))
    return F.when(ok & (candidates > 0), False).when(transport, False).when(e == "", True).otherwise(T.has_any(e, NO_JOB_ERRORS))


def needs_second_reading(url: Column, status: Column, text: Column) -> Column:
    low = F.lower(T.strip(F.coalesce(F.nullif(status, F.lit("")), F.lit("ok"))))
    return is_http(T.strip(url)) & (~low.isin("", "ok") | (F.length(T.strip(T.or_empty(text))) < 80))


def is_internship(bucket: Column, title: Column, text: Column, project: Column) -> Column:
    return (T.strip(T.or_empty(bucket)) == "日常实习") | T.has_any(F.concat_ws(" ", title, text, project, bucket), V.INTERNSHIP_WORDS)


def expiry(value: Column) -> Column:
    """Date of an ISO date or time; null for none."""
    return F.try_to_date(F.left(T.strip(T.or_empty(value)), F.lit(10)), "yyyy-MM-dd")


def is_valid_account(enabled: Column, expires: Column, as_of: date) -> Column:
    """Enabled and not past its last day."""
    return F.coalesce(enabled, F.lit(False)) & F.coalesce(expiry(expires) >= F.lit(as_of), F.lit(True))


def is_legacy_url(url: Column) -> Column:
    return F.contains(U.host(url), F.lit("zhiye.com")) & T.matches(U.path(url), LEGACY_PATH)


def channel_of_url(url: Column) -> Column:
    """campus, intern or social, by path and then by query."""
    path, query = F.lower(U.path(url)), F.lower(U.query(url))
    by_path = F.coalesce(*[F.when(T.matches(path, p), F.lit(name)) for name, p in PATH_CHANNELS])
    by_query = F.coalesce(*[F.when(T.has_any(query, words), F.lit(name)) for name, words in QUERY_CHANNELS])
    return F.when(path != "", F.coalesce(by_path, by_query))


def channel_kind(nav: Column, url: Column) -> Column:
    """struct(channel, project, bucket): highlighted navigation first, then the URL."""
    channel = F.coalesce(nav, channel_of_url(url))
    of = lambda i: F.coalesce(*[F.when(channel == k, F.lit(v[i])) for k, v in CHANNEL_KINDS.items() if v[i]])
    return F.struct(channel.alias("channel"), of(0).alias("project"), of(1).alias("bucket"))


def channel_of_fields(extra: Column, bucket: Column, project: Column, category: Column, title: Column) -> Column:
    """Channel from a stored one, else from hiring words."""
    stored, blob = F.lower(T.strip(T.or_empty(extra))), F.concat_ws(" ", T.or_empty(bucket), T.or_empty(project), T.or_empty(category), T.or_empty(title))
    return F.when(stored.isin(*POST_TYPES), stored).when(T.has_any(blob, ("实习", "intern")), "intern").when(T.has_any(blob, ("社会招聘", "社招")), "social").when(T.has_any(blob, ("校招", "校园招聘", "校园")), "campus")


def channel_of_post_type(kind: Column) -> Column:
    k = F.lower(T.strip(T.or_empty(kind)))
    return F.coalesce(*[F.when(k.isin(*words), F.lit(name)) for name, words in POST_TYPES.items()])


def is_paged_channel(channel: Column) -> Column:
    return F.coalesce(channel.isin("campus", "intern"), F.lit(False))


def official_source(company: Column, url: Column, snippet: Column) -> Column:
    """struct(status, reason): official, unverified or rejected."""
    say = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    return (
        F.when(T.is_aggregator(F.concat_ws(" ", T.or_empty(company), T.or_empty(url), T.or_empty(snippet))), say("rejected", "命中汇总黑名单"))
        .when(U.host(url) == "", say("unverified", "无效 URL"))
        .when(U.is_trusted(url), say("official", "可信 ATS/网申域名"))
        .when(F.contains(U.host(url), F.lit("mp.weixin.qq.com")), say("unverified", "公众号链接待人工确认官方归属"))
        .otherwise(say("unverified", "待验证官方归属"))
    )


def guessed_urls(hints: Column) -> Column:
    """Hints that may be a career page, with guessed paths of hosts that aren't trusted."""
    base = lambda u: F.concat(U.scheme(u), F.lit("://"), U.part(u, 2))
    more = lambda u: F.when(U.is_trusted(u) | (U.host(u) == ""), F.array(T.strip(u))).otherwise(F.concat(F.array(T.strip(u)), *[F.array(F.concat(base(u), F.lit(p))) for p in CAREER_PATHS]))
    return U.preferred(F.flatten(F.transform(F.filter(hints, U.looks_like_url), more)), 20)


def version(text: Column) -> Column:
    """Dotted version as numbers, which compare in order; what is no number counts as 0."""
    return F.transform(F.split(F.coalesce(F.nullif(text, F.lit("")), F.lit("0")), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def token_date(token: Column) -> Column:
    """Date of a platform version (2024.5.17.3), of 20240517, or of 2024517."""
    s = T.strip(T.or_empty(token))
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    dotted, eight, seven = r"^(20\d{2})\.(\d{1,2})\.(\d{1,2})(?:\.\d+)?$", r"^(\d{4})(\d{2})(\d{2})$", r"^(20\d{2})(\d)(\d{2})$"
    return F.coalesce(*[F.when(F.rlike(s, F.lit(p)), made(*[F.regexp_extract(s, p, i) for i in (1, 2, 3)])) for p in (dotted, eight, seven)])


def reference_date(text_date: Column, page_date: Column) -> Column:
    """struct(day, source): the posting's own date, the text's, the page's, the row's first."""
    say = lambda d, s: F.when(d.isNotNull(), F.struct(d.alias("day"), F.lit(s).alias("source")))
    return F.coalesce(say(D.loose_date(c("open_at")), "open_at"), say(D.loose_date(text_date), "labeled"), say(page_date, "page"), say(D.loose_date(c("created_at")), "created_at"))


def timeliness(reference: Column, as_of: date, months: int = V.LIST_MONTHS) -> Column:
    """keep, delete or keep_no_date."""
    return F.when(reference.isNull(), "keep_no_date").when(reference["day"] >= D.list_cutoff(as_of, months), "keep").otherwise("delete")


def known_candidate(urls: Column, titles: Column, known_any_url: Column) -> Column:
    """Whether a candidate is known. ``urls``: struct(specific, source) of booleans that say
    whether such a URL is known (null: it has none); a specific URL decides alone."""
    return F.when(urls["specific"].isNotNull(), F.when(known_any_url, urls["specific"]).otherwise(titles)).when(urls["source"].isNotNull(), urls["source"] & titles).otherwise(titles)


def job_counts(new: Column, skipped: Column, listed: Column, budget: int) -> Column:
    """struct(pending, total) of one company's run."""
    done = F.coalesce(new, F.lit(0)) + F.coalesce(skipped, F.lit(0))
    total = F.when(F.coalesce(listed, F.lit(0)) > 0, listed).when(done > 0, done).otherwise(F.lit(max(1, budget)))
    return F.struct(F.greatest(F.lit(0), total - done).cast("long").alias("pending"), total.cast("long").alias("total"))


def dug(payload: Column, keys: tuple[str, ...], least: int, most: int | None = None) -> Column:
    """First text under one of the keys anywhere in a JSON text, in reading order. The pattern
    never goes back (possessive), so a text of any length needs no stack."""
    named = r'(?i)"(?:' + "|".join(keys) + r')"\s*:\s*"((?:[^"\\]++|\\.)*+)"'
    read = F.transform(F.regexp_extract_all(T.or_empty(payload), F.lit(named), F.lit(1)), lambda s: T.strip(F.get(F.from_json(F.concat(F.lit('["'), s, F.lit('"]')), "array<string>"), F.lit(0))))
    fits = lambda s: (F.length(s) >= least) & ((F.length(s) <= most) if most else F.lit(True))
    return F.get(F.filter(read, fits), F.lit(0))


def dug_title(payload: Column) -> Column:
    return dug(payload, TITLE_KEYS, 2, 200)


def dug_text(payload: Column) -> Column:
    return dug(payload, TEXT_KEYS, 41)


def wire(job: str = "") -> list[Column]:
    """Columns of a posting as it is sent: tags as a list, defaults for what is missing."""
    at = lambda k: c(f"{job}{k}")
    empty = F.expr("cast(array() as array<string>)")
    plain = ("id", "company_id", "group_name", "company", "recruit_project", "recruit_bucket", "company_nature", "title", "source_url", "apply_url", "deadline", "work_location", "industry", "education", "salary_range", "headcount", "open_at", "graduation_batch", "jd_text", "raw_category", "updated_at")
    return [
        *[at(k).alias(k) for k in plain],
        F.coalesce(F.from_json(at("job_tags"), "array<string>"), empty).alias("job_tags"),
        F.coalesce(F.nullif(at("parse_status"), F.lit("")), F.lit("ok")).alias("parse_status"),
        F.coalesce(at("confidence"), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.nullif(at("status"), F.lit("")), F.lit("active")).alias("status"),
    ]


def boosted(confidence: Column, stale: Column, prefers: Column, shell: Column) -> Column:
    """Confidence of a collected row: a floor for rows with substance, and the season."""
    has_text = F.length(T.strip(T.or_empty(c("jd_text")))) >= V.LEAST_TEXT
    has_fact = (T.or_empty(c("work_location")) != "") | (T.or_empty(c("recruit_project")) != "")
    floor = F.when(has_text & has_fact, 0.75).when(shell, 0.6).otherwise(0.0)
    base = F.greatest(confidence, floor)
    return F.round(F.when(stale, F.greatest(F.lit(0.2), base - 0.15)).when(prefers, F.least(F.lit(1.0), base + 0.05)).otherwise(base), 6)


def records_of(rows: DataFrame, as_of: date) -> DataFrame:
    """``rows`` (id, title, jd_text) as normalised records: labelled values with their
    fallbacks. Facts are columns in stages, so each is computed once."""
    title, text = c("title"), c("jd_text")
    at = lambda k: F.try_element_at("__l", F.lit(k))
    one = rows.withColumn("__l", L.labelled_fields(text)).withColumn("__own", L.sanitized_title(title))
    two = one.withColumns({"__k": L.recruit_of(at("recruit_type"), at("work_type"), title), "__named": F.coalesce("__own", L.sanitized_title(at("title")))})
    three = two.withColumn("__project", F.coalesce(c("__k.project"), C.project_of(title, F.left(text, F.lit(2000)))))
    return three.select(
        "id",
        T.or_empty(F.coalesce("__named", L.title_in_text(text))).alias("title"),
        T.or_empty(c("__project")).alias("recruit_project"),
        T.or_empty(F.coalesce(c("__k.bucket"), F.when(c("__k.project").isNull(), C.map_bucket(c("__project"), title)))).alias("recruit_bucket"),
        T.or_empty(F.coalesce(F.when(~T.is_noise_place(at("work_location")), at("work_location")), L.place_in_text(text))).alias("work_location"),
        T.or_empty(at("open_at")).alias("open_at"),
        T.or_empty(at("deadline")).alias("deadline"),
        T.or_empty(F.coalesce(at("raw_category"), at("work_type"))).alias("raw_category"),
        T.or_empty(L.education_of(text, title, c("__l"))).alias("education"),
        T.or_empty(L.normal_salary(at("salary_range"))).alias("salary_range"),
        T.or_empty(L.normal_headcount(at("headcount"))).alias("headcount"),
        T.or_empty(at("company")).alias("company"),
        D.resolve_batch(title, text, F.lit(None).cast("string"), as_of).alias("graduation_batch"),
    )
