"""Landed JSON and XML feeds to posting rows; schemas are explicit, bodies are strings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from millrace.functions import dates as D
from millrace.functions import text as T

PAGED_LIST = "Code int, Count int, Data array<struct<Id string, JobAdName string, CategoryId string, LocNames array<string>, Duty string, Require string, PostDate string, HeadCount int, Salary string, Degree string>>"
PAGE_FORM = "state string, data struct<pageForm struct<totalPage int, currentPage int, pageData array<struct<postId string, postName string, company string, workPlaceStr string, publishDate string, recruitNumStr string, recruitType int, educationStr string, endDate string, projectName string>>>>"
JOB_LIST = "data struct<job_post_list array<struct<id string, title string, description string, requirement string, city_list array<struct<name string>>, recruit_type struct<name string>, job_category struct<name string>>>>"
JOBS_PAGE = "offset int, total int, jobs array<struct<id string, title string, hireMode int, status string, publishedAt string, openedAt string, updatedAt string, locations array<struct<cityName string, country string>>>>"

# fixed values: channel codes of the sources
CATEGORY_CHANNELS = {"1": "social", "2": "campus", "3": "intern"}
RECRUIT_TYPES = {1: "campus", 2: "social", 12: "intern"}
HIRE_MODES = {1: "social", 2: "campus"}
BUCKET_OF_CHANNEL = {"campus": "校招", "intern": "日常实习"}


def _coded(code: Column, table: dict) -> Column:
    return F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in table.items()])


def _bucket(channel: Column) -> Column:
    """Bucket of a channel; social has none."""
    return _coded(channel, BUCKET_OF_CHANNEL)


def places(names: Column) -> Column:
    """Distinct place names joined; null if there is none."""
    return F.nullif(F.array_join(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (F.trim(n) != ""))), " / "), F.lit(""))


def body_text(*parts: tuple[str, Column]) -> Column:
    """Headed parts of a job text; missing parts leave no heading."""
    return F.nullif(F.concat_ws("\n\n", *[F.when(T.non_blank(c).isNotNull(), F.concat(F.lit(h + "\n"), T.strip(c))) for h, c in parts]), F.lit(""))


def _body(raw: Column) -> Column:
    return F.regexp_replace(raw, "^﻿", "")


def read_paged_list(pages: DataFrame, raw: str = "body") -> DataFrame:
    """Envelope with Data[]; a page with another code than 200 has no rows."""
    rows = pages.select(F.from_json(_body(F.col(raw)), PAGED_LIST).alias("p")).where("p.Code = 200").select("p.Count", F.inline("p.Data"))
    channel = _coded(F.col("CategoryId"), CATEGORY_CHANNELS)
    made = rows.select(
        F.col("Id").alias("source_id"), T.non_blank(F.col("JobAdName")).alias("title"), channel.alias("channel"), _bucket(channel).alias("recruit_bucket"), places(F.col("LocNames")).alias("work_location"),
        body_text(("岗位职责", F.col("Duty")), ("任职要求", F.col("Require"))).alias("jd_text"), D.first_iso_date(F.col("PostDate")).alias("open_at"),
        F.nullif(F.col("HeadCount"), F.lit(0)).cast("string").alias("headcount"), F.col("Salary").alias("salary_range"), F.col("Degree").alias("education"),
    )
    return made.dropDuplicates(["source_id"])


def read_page_form(pages: DataFrame, raw: str = "body") -> DataFrame:
    """Nested page form; an end date in 2030 is a placeholder."""
    ok = pages.select(F.from_json(_body(F.col(raw)), PAGE_FORM).alias("p")).where("p.state in ('200', '0')").select(F.inline("p.data.pageForm.pageData"))
    channel = _coded(F.col("recruitType"), RECRUIT_TYPES)
    made = ok.select(
        F.col("postId").alias("source_id"), T.non_blank(F.col("postName")).alias("title"), F.col("company"), channel.alias("channel"), _bucket(channel).alias("recruit_bucket"), F.col("workPlaceStr").alias("work_location"),
        D.first_iso_date(F.col("publishDate")).alias("open_at"), F.when(~F.startswith("endDate", F.lit("2030")), F.left("endDate", F.lit(10))).alias("deadline"), F.col("recruitNumStr").alias("headcount"), F.col("educationStr").alias("education"), F.col("projectName").alias("recruit_project"),
    )
    return made.dropDuplicates(["source_id"])


def read_job_list(pages: DataFrame, raw: str = "body") -> DataFrame:
    """Card items of data.job_post_list."""
    rows = pages.select(F.from_json(_body(F.col(raw)), JOB_LIST).alias("p")).select(F.inline("p.data.job_post_list"))
    return rows.select(
        F.col("id").alias("source_id"), T.non_blank(F.col("title")).alias("title"), F.col("recruit_type.name").alias("recruit_project"), F.col("job_category.name").alias("raw_category"),
        places(F.col("city_list.name")).alias("work_location"), body_text(("职位描述", F.col("description")), ("职位要求", F.col("requirement"))).alias("jd_text"),
    ).dropDuplicates(["source_id"])


def read_jobs_pages(pages: DataFrame, raw: str = "body") -> DataFrame:
    """Offset pages of jobs[]; a job that two pages hold counts once."""
    rows = pages.select(F.from_json(_body(F.col(raw)), JOBS_PAGE).alias("p")).select(F.inline("p.jobs"))
    channel = _coded(F.col("hireMode"), HIRE_MODES)
    return rows.select(
        F.col("id").alias("source_id"), T.non_blank(F.col("title")).alias("title"), channel.alias("channel"), _bucket(channel).alias("recruit_bucket"), places(F.transform("locations", lambda x: x["cityName"])).alias("work_location"),
        F.left(F.coalesce("openedAt", "publishedAt"), F.lit(10)).alias("open_at"), F.left("updatedAt", F.lit(10)).alias("list_updated_at"),
    ).dropDuplicates(["source_id"])


DETAIL = "state string, data struct<postId string, postName string, company string, workPlaceStr string, workPlace string, publishDate string, recruitType int, educationStr string, education string, duty string, workContent string, serviceCondition string, remark string>"


def read_detail(pages: DataFrame, raw: str = "body") -> DataFrame:
    """One posting's detail body; where several hosts answered (``host_rank``), the first that
    has it counts."""
    ok = pages.select("host_rank", F.from_json(_body(F.col(raw)), DETAIL).alias("p")).where("p.state in ('200', '0') and p.data.postId is not null").select("host_rank", "p.data.*")
    part = lambda h, c: F.when(T.non_blank(F.col(c)).isNotNull(), F.when(F.contains(F.left(T.strip(F.col(c)), F.lit(20)), F.lit(h)), T.strip(F.col(c))).otherwise(F.concat(F.lit(h + "\n"), T.strip(F.col(c)))))
    text = F.nullif(F.concat_ws("\n\n", part("岗位职责", "duty"), part("工作内容", "workContent"), part("任职要求", "serviceCondition"), part("备注", "remark")), F.lit(""))
    channel = _coded(F.col("recruitType"), RECRUIT_TYPES)
    made = ok.select("host_rank", F.col("postId").alias("source_id"), T.non_blank(F.col("postName")).alias("title"), "company", channel.alias("channel"), _bucket(channel).alias("recruit_bucket"), F.coalesce("workPlaceStr", "workPlace").alias("work_location"), D.first_iso_date(F.col("publishDate")).alias("open_at"), F.coalesce("educationStr", "education").alias("education"), text.alias("jd_text"))
    others = [c for c in made.columns if c != "source_id"]
    return made.groupBy("source_id").agg(F.min_by(F.struct(*others), "host_rank").alias("r")).select("source_id", "r.*").drop("host_rank")


def page_requests(total: int, size: int, most: int = 50) -> list[tuple[int, int]]:
    """(offset, limit) of the pages of a list: at most 50 rows each, up to the total."""
    step = max(1, min(size, most))
    return [(at, min(step, total - at)) for at in range(0, max(0, total), step)]


def sliced_array(text: str, start: int) -> str | None:
    """The JSON array that opens at ``start``, brackets within strings left out of account."""
    depth, at, quoted = 0, start, False
    while at < len(text):
        ch = text[at]
        if quoted:
            at += ch == "\\"
            quoted = ch != '"'
        elif ch == '"':
            quoted = True
        elif ch in "[]":
            depth += 1 if ch == "[" else -1
            if not depth:
                return text[start : at + 1]
        at += 1
    return None


@F.pandas_udf(ArrayType(StringType()))
def _job_arrays(texts: pd.Series) -> pd.Series:
    """Arrays behind "jobs": in each text; brackets nest, so this is no regular expression."""
    marks = re.compile(r'"jobs"\s*:\s*\[')
    return pd.Series([[a for m in marks.finditer(t or "") if (a := sliced_array(t, m.end() - 1))] for t in texts])


EMBEDDED = "array<struct<id string, mjCode string, title string, publishedAt string>>"


def embedded_jobs(pages: DataFrame) -> DataFrame:
    """Postings that a page embeds (page_id, source_id, title, published): of its init-data,
    else of the first array behind "jobs": that has any."""
    from millrace.functions import pages as P

    read = lambda x: F.filter(F.from_json(x, EMBEDDED), lambda j: T.or_empty(j["title"]) != "")
    named = lambda x: F.filter(read(x), lambda j: F.coalesce(j["id"], j["mjCode"], j["publishedAt"]).isNotNull())
    first = pages.select("page_id", read(F.get_json_object(P.init_data(F.col("html")), "$.jobs")).alias("own"), _job_arrays(P.unescaped(T.or_empty(F.col("html")))).alias("arrays"))
    other = F.get(F.filter(F.transform("arrays", named), lambda x: F.size(x) > 0), F.lit(0))
    chosen = first.select("page_id", F.posexplode(F.when(F.coalesce(F.size("own"), F.lit(0)) > 0, F.col("own")).otherwise(other)).alias("pos", "j"))
    return chosen.select("page_id", "pos", F.coalesce("j.id", "j.mjCode").alias("source_id"), "j.title", F.col("j.publishedAt").alias("published"))


def decrypt_envelope(data: Column, iv: Column, key: Column) -> Column:
    """AES-128-CBC body as text; null where it can't be opened."""
    return F.try_aes_decrypt(F.concat(iv.cast("binary"), F.unbase64(data)), key.cast("binary"), F.lit("CBC"), F.lit("PKCS")).cast("string")


def embedded_json(html: Column) -> Column:
    """JSON blobs that pages assign to their well-known state names."""
    pattern = r"(?s)(?:__NEXT_DATA__[^>]*>|__INITIAL_STATE__\s*=\s*|__PRELOADED_STATE__\s*=\s*)(\{.*?\})\s*(?:;|</script>)"
    return F.filter(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda x: F.try_parse_json(x).isNotNull())


def merge_by_id(html_rows: DataFrame, api_rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of both by source_id: the API's values win, but for missing ones."""
    h, a = html_rows.alias("h"), api_rows.alias("a")
    return h.join(a, "source_id", "full_outer").select("source_id", *[F.coalesce(F.col(f"a.{c}"), F.col(f"h.{c}")).alias(c) for c in columns])


RSS = "channel struct<item array<struct<title string, link string, pubDate string>>>, entry array<struct<title string, link array<struct<_href string>>, updated string>>"


def read_rss(feeds: DataFrame, raw: str = "body") -> DataFrame:
    """Items of RSS bodies, Atom entries where a body has no item; title and link are needed."""
    parsed = feeds.withColumn("__p", F.from_xml(F.col(raw), RSS))
    atom = F.transform("__p.entry", lambda e: F.struct(e["title"].alias("title"), F.get(e["link"], F.lit(0))["_href"].alias("link"), e["updated"].alias("pubDate")))
    items = F.when(F.size("__p.channel.item") > 0, F.col("__p.channel.item")).otherwise(atom)
    kept = [c for c in feeds.columns if c != raw]
    each = parsed.select(*kept, F.posexplode(items).alias("pos", "i"))
    made = each.select(*kept, (F.col("pos") + 1).alias("pos"), "i.title", "i.link", F.col("i.pubDate").alias("published"))
    return made.where((F.trim("title") != "") & (F.trim("link") != ""))


def feed_url(base: Column, name: Column) -> Column:
    """Feed address: the template's {name}, or /name.xml after a base."""
    return F.when(F.contains(base, F.lit("{name}")), F.replace(base, F.lit("{name}"), F.url_encode(name))).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.url_encode(name), F.lit(".xml")))
