"""Rules over a page's source and visible text: its date, its kind, data it embeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import classify as C
from millrace.functions import dates as D
from millrace.functions import labels as L
from millrace.functions import records as R
from millrace.functions import text as T
from millrace.functions import urls as U

# fixed values: dates in pages, shells, title shells
LABELLED_DATE = r"(?:更新(?:日期|时间)|发布(?:日期|时间)|开放时间|岗位发布时间)\s*[:：]?\s*(20\d{2}[-/.年]\d{1,2}(?:[-/.月]\d{1,2})?日?)"
LATEST_DATE = r"(20\d{2}[-/.年]\d{1,2}(?:[-/.月]\d{1,2})?日?)\s*最新(?:发布)?"
VERSIONS = (r"(?i)['\"]version['\"]\s*:\s*['\"](20\d{2}\.\d{1,2}\.\d{1,2}\.\d+)['\"]", r"(?i)(?:stc\.beisen\.com|stc\.italent\.cn)/((?:20\d{2})\.\d{1,2}\.\d{1,2}\.\d+)/")
LOGO_DATES = (r"(?i)medias[_-]?(20\d{6})", r"(?i)(20\d{6})\s*logo")
BANNER_DATES = (r"(?i)(20\d{6}|20\d{2}[1-9]\d{2})[^\s\"'<>]*banner", r"(?i)banner[^\s\"'<>]*?(20\d{6}|20\d{2}[1-9]\d{2})")
SPA_SHELL = r"(?i)(?:recruitment-portal|id=[\"']app[\"']|id=[\"']root[\"']|id=[\"']ietips[\"']|You need to enable JavaScript|/pb/js/(?:school|interns|social)\.js)"
SERVED_LINK = r"(?i)/(?:campus|intern|social)/jobs/[0-9a-f-]{8,}"
LIST_SOURCES = ("moka_list", "zhiye_list", "feishu_list", "feishu_list_shell", "hotjob_list_shell", "hotjob_list_api")
SHELL_WORDS = ("校园招聘", "社会招聘", "实习生招聘", "校招", "社招", "招聘", "欢迎", "首页", "招聘首页", "招聘官网", "招聘门户")
FEED_WORDS = r"招聘|校招|实习|秋招|春招|管培|启航|星计划"
FEED_ITEMS = 15
POST_TYPE_PAGE = r"(?i)/pb/(?:posDetail|position)\.html"


def _first(html: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(T.or_empty(html), p, 1), F.lit("")) for p in patterns])


def _latest(html: Column, patterns: tuple[str, ...]) -> Column:
    found = F.concat(*[F.regexp_extract_all(T.or_empty(html), F.lit(p), F.lit(1)) for p in patterns])
    return F.array_max(F.transform(found, R.token_date))


def page_date(html: Column, text: Column) -> Column:
    """struct(day, source): labelled date, a date said to be the latest, the platform's
    version, the newest logo or banner. Text is looked at before source."""
    said = lambda p: F.coalesce(D.loose_date(_first(text, (p,))), D.loose_date(_first(html, (p,))))
    ranked = (("labeled", said(LABELLED_DATE)), ("inline_latest", said(LATEST_DATE)), ("platform_version", F.coalesce(*[R.token_date(_first(html, (p,))) for p in VERSIONS])), ("logo_media", _latest(html, LOGO_DATES)), ("banner_media", _latest(html, BANNER_DATES)))
    return F.coalesce(*[F.when(d.isNotNull(), F.struct(d.alias("day"), F.lit(s).alias("source"))) for s, d in ranked])


def is_spa_shell(html: Column) -> Column:
    """A page of scripts alone, without rows or links from the server."""
    table = F.contains(F.lower(html), F.lit("<table")) & T.has_any(html, ("职位名称", "岗位名称"))
    return T.matches(html, SPA_SHELL) & ~table & ~T.matches(html, SERVED_LINK)


def is_channel_title(title: Column) -> Column:
    """A portal's or channel's name in place of a role."""
    t = T.strip(T.or_empty(title))
    ends = lambda s, n: F.endswith(s, F.lit("校园招聘")) & (F.length(s) <= 12) | F.endswith(s, F.lit("实习生招聘")) & (F.length(s) <= n)
    return T.let(T.squeeze(t), lambda s: (t == "") | T.is_chrome_title(t) | T.is_noise_title(t) | s.isin(*SHELL_WORDS) | ends(s, 14) | F.endswith(s, F.lit("招聘官网")) | F.endswith(s, F.lit("招聘门户")))


def is_list_page(is_list: Column, source: Column, detail_links: Column, title: Column) -> Column:
    return F.coalesce(is_list, F.lit(False)) | F.coalesce(source.isin(*LIST_SOURCES), F.lit(False)) | (F.coalesce(detail_links, F.lit(0)) > 1) | T.is_noise_title(T.or_empty(title))


def is_social_row(channel: Column, project: Column) -> Column:
    """List rows of social hiring, which portals leave out."""
    return F.coalesce(channel == "social", F.lit(False)) | T.has_any(project, ("社会招聘",)) | (T.strip(T.or_empty(project)) == "社招")


def init_data(html: Column) -> Column:
    """JSON text of the page's init-data field, entities decoded; null if it is none."""
    raw = F.coalesce(_first(html, (r"(?is)<input[^>]+id=[\"']init-data[\"'][^>]*?value=\"(.*?)\"", r"(?is)<input[^>]+id=[\"']init-data[\"'][^>]*?value='(.*?)'", r"(?is)<input[^>]+value=\"([^\"]*)\"[^>]*id=[\"']init-data[\"']")))
    text = unescaped(raw)
    return F.when(F.try_parse_json(text).isNotNull() & F.startswith(F.ltrim(text), F.lit("{")), text)


def unescaped(text: Column) -> Column:
    """The five entities of attributes, the ampersand last."""
    out = text
    for entity, char in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def with_post_type(url: Column, hint: Column) -> Column:
    """A detail page's link with the post type that its script needs."""
    u = T.strip(T.or_empty(url))
    has = T.matches(U.query(u), r"(?:^|&)postType=[^&\s]+")
    channel = F.coalesce(R.channel_of_url(u), hint)
    kind = F.coalesce(*[F.when(channel == k, F.lit(v[0])) for k, v in R.POST_TYPES.items()])
    kept = F.array_join(F.filter(F.split(U.query(u), "&"), lambda f: (f != "") & (F.lower(F.substring_index(f, "=", 1)) != "posttype")), "&")
    made = F.concat(F.regexp_replace(u, r"[?#].*$", ""), F.lit("?"), F.when(kept != "", F.concat(kept, F.lit("&"))).otherwise(""), F.lit("postType="), kind, F.when(U.fragment(u) != "", F.concat(F.lit("#"), U.fragment(u))).otherwise(""))
    return F.when(F.contains(U.host(u), F.lit("hotjob.cn")) & T.matches(u, POST_TYPE_PAGE) & ~has & kind.isNotNull(), made).otherwise(u)


def parsed_confidence(title: Column, text: Column, bucket: Column, place: Column) -> Column:
    """Confidence of a page read by the general rules."""
    part = lambda test, x: F.when(F.coalesce(test, F.lit(False)), F.lit(x)).otherwise(F.lit(0.0))
    some = lambda c: T.or_empty(c) != ""
    return F.round(F.least(F.lit(0.85), F.lit(0.3) + part(some(title), 0.2) + part(F.length(text) > 80, 0.2) + part(some(bucket), 0.1) + part(some(place), 0.05)), 6)


def general_records(pages: DataFrame) -> DataFrame:
    """``pages`` (title, longest, html, ...) with the columns of a detail page by the general
    rules: embedded JSON, then the longest block. Facts are columns in stages."""
    kept = [n for n in pages.columns if n not in ("title", "longest", "html")]
    at = F.col
    one = pages.withColumn("__text", F.coalesce(R.dug_text(at("html")), T.non_blank(at("longest")))).withColumn("__own", L.sanitized_title(at("title")))
    two = one.withColumns({"title": F.coalesce("__own", L.title_in_text(at("__text"))), "jd_text": F.coalesce(T.strip_navigation(at("__text")), "__text"), "work_location": L.place_in_text(at("__text"))})
    three = two.withColumn("recruit_project", C.project_of(at("title"), at("__text")))
    four = three.withColumn("recruit_bucket", C.map_bucket(at("recruit_project"), at("title")))
    found = ["title", "jd_text", "recruit_project", "recruit_bucket", "work_location"]
    return four.select(*kept, *found, F.when(at("title").isNotNull(), "ok").otherwise("needs_browser").alias("parse_status"), parsed_confidence(at("title"), at("jd_text"), at("recruit_bucket"), at("work_location")).alias("confidence"))
