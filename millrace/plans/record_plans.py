"""Queries of record rules and of the review workflow.

Scalar rules run over all documents on hand-written cases: a document takes the case of its
id's remainder, and the DuckDB twin states what has to come out. Workflow queries run over
orders, events and parts in the roles of postings, reviews and companies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import labels as L
from millrace.functions import records as R
from millrace.functions import text as T
from millrace.operators import dedupe
from millrace.operators import workflow as W
from millrace.plans.registry import registry
from millrace.plans.roles import AS_OF, run_sql
from millrace.session import table

QUERIES, ORACLES, query = registry()

c = F.col


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, int | float) else "'" + value.replace("'", "''") + "'"


def _case(values, kind: str = "VARCHAR") -> str:
    arms = " ".join(f"WHEN {i} THEN {_literal(v)}" for i, v in enumerate(values))
    return f"CAST(CASE doc_id % {len(values)} {arms} END AS {kind})"


def cases(inputs: dict[str, list], outputs: dict[str, list]):
    """(function to the inputs by document, the twin's SQL for the outputs)."""
    kinds = lambda vs: "BOOLEAN" if any(isinstance(v, bool) for v in vs) else "BIGINT" if any(isinstance(v, int) for v in vs) else "VARCHAR"
    sizes = {len(v) for v in (*inputs.values(), *outputs.values())}
    if len(sizes) != 1:
        raise ValueError(f"cases of {sizes} rows")

    def rows(spark, sf_dir) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id")
        n = sizes.copy().pop()
        chosen = lambda vs: F.get(F.array(*[F.lit(v).cast({"BOOLEAN": "boolean", "BIGINT": "bigint", "VARCHAR": "string"}[kinds(vs)]) for v in vs]), F.pmod("doc_id", F.lit(n)).cast("int"))
        return docs.select(c("doc_id").alias("id"), *[chosen(vs).alias(k) for k, vs in inputs.items()])

    sql = "SELECT doc_id AS id, " + ", ".join(f"{_case(vs, kinds(vs))} AS {k}" for k, vs in outputs.items()) + " FROM documents"
    return rows, sql


TEXTS = [
    "工作地点：北京\n学历要求：本科及以上；不限专业\n薪资范围：10-20k|面议\n招聘人数：招若干人\n发布时间：2026年7月1日 最新\n招聘类别：社会招聘\n岗位职责：写代码\n改代码\n任职要求\n会写代码，能独立完成工作",
    "工作城市: 上海 · 浦东，\n学历层次：硕士研究生\n薪资：岗位职责\n招聘人数：5 人\n更新日期：2026-06-30\n招聘类型：校园招聘\nResponsibilities: build things\nSkills: Python\nRequirements: a degree",
    "一、任职资格：本科学历\n（二）工作职责：负责测试；招聘类型：秋招\n类型：其他",
    "只有一段说明文字，没有任何标签，但是长度超过四十个字，所以整段都应当作为职责一栏的正文来显示，不作任何拆分。",
    "工作性质：实习\n工作地点：\n学历要求：无\n截止时间：2026-09-01 23:59 前投递\n公司名称：远山集团有限公司",
    "",
    None,
]

_ROWS, _SQL = cases(
    {"jd_text": TEXTS, "title": ["算法工程师", "前端开发", "测试工程师", "数据分析师", "产品经理", "研发工程师（硕士及以上）", "管培生"]},
    {
        "place": ["北京", "上海 · 浦东", None, None, None, None, None],
        "education": ["本科及以上", "硕士", None, None, "无", None, None],
        "salary": ["10-20k", None, None, None, None, None, None],
        "headcount": ["若干", "5 人", None, None, None, None, None],
        "open_at": ["2026-07-01", "2026-06-30", None, None, None, None, None],
        "deadline": [None, None, None, None, "2026-09-01 23:59 前投递", None, None],
        "company": [None, None, None, None, "远山集团有限公司", None, None],
        "recruit_type": ["社会招聘", "校园招聘", "秋招", None, None, None, None],
        "project": ["社会招聘", "校园招聘", "秋招", None, "日常实习", None, None],
        "bucket": [None, "校招", "校招", None, "日常实习", None, None],
    },
)


@query(_SQL)
def labelled_facts(spark, sf_dir):
    """Labelled fields, and the project and bucket of labelled types."""
    rows = _ROWS(spark, sf_dir).withColumn("l", L.labelled_fields(c("jd_text")))
    at = lambda k: F.try_element_at("l", F.lit(k))
    kind = L.recruit_of(at("recruit_type"), at("work_type"), F.lit(None).cast("string"))
    return rows.withColumn("k", kind).select("id", at("work_location").alias("place"), at("education").alias("education"), at("salary_range").alias("salary"), at("headcount").alias("headcount"), at("open_at").alias("open_at"), at("deadline").alias("deadline"), at("company").alias("company"), at("recruit_type").alias("recruit_type"), c("k.project").alias("project"), c("k.bucket").alias("bucket"))


_SECT_ROWS, _SECT_SQL = cases(
    {"jd_text": TEXTS},
    {
        "duties": ["写代码\n改代码", "build things", "负责测试；招聘类型：秋招\n类型：其他", TEXTS[3], "", "", ""],
        "requirements": ["会写代码，能独立完成工作", "Python\na degree", "本科学历", "", "", "", ""],
    },
)


@query(_SECT_SQL)
def section_texts(spark, sf_dir):
    """Duties and requirements of a text."""
    rows = _SECT_ROWS(spark, sf_dir).withColumn("s", L.split_sections(c("jd_text"), L.labelled_fields(c("jd_text"))))
    return rows.select("id", "s.duties", "s.requirements")


_EDU_ROWS, _EDU_SQL = cases(
    {"jd_text": TEXTS, "title": ["算法工程师", "前端开发", "测试工程师", "数据分析师", "产品经理", "研发工程师（硕士及以上）", "管培生"], "education": [None, "", None, None, None, None, " 大专 "]},
    {"education": ["本科及以上", "硕士", "本科", "-", "学历要求：无", "硕士及以上", "大专"]},
)


@query(_EDU_SQL)
def education_shown(spark, sf_dir):
    """The stored degree, else the text's, else the title's, else a dash."""
    return _EDU_ROWS(spark, sf_dir).select("id", R.shown_education(c("education"), c("jd_text"), c("title")).alias("education"))


_SHOW_ROWS, _SHOW_SQL = cases(
    {
        "title": ["首页", "Java开发 - 招贤纳才", None, "登录", "算法工程师", "校园招聘系统"],
        "jd_text": ["岗位名称：数据分析师，全职\n负责报表", "x", "招贤纳才\n嵌入式工程师\n负责驱动", "CN-Store Leader 114438029 Shanghai\nSummary", None, "工作地点：无锡\n发布时间：2026-01-01"],
        "place": ["北京", "首页", None, " 上海 ", "更多", "x"],
    },
    {"title": ["数据分析师", "Java开发", "嵌入式工程师", "CN-Store Leader 114438029", "算法工程师", "校园招聘系统"], "place": ["北京", "—", "—", "上海", "—", "—"], "text": ["岗位名称：数据分析师，全职\n负责报表", "x", "嵌入式工程师\n负责驱动", "CN-Store Leader 114438029 Shanghai", "岗位介绍未解析", "工作地点：无锡\n发布时间：2026-01-01"]},
)


@query(_SHOW_SQL)
def shown_columns(spark, sf_dir):
    """Titles recovered from the text, places and texts without navigation."""
    return _SHOW_ROWS(spark, sf_dir).select("id", R.shown_title(c("title"), c("jd_text")).alias("title"), R.shown_place(c("place")).alias("place"), R.shown_text(c("jd_text")).alias("text"))


_PLACE_ROWS, _PLACE_SQL = cases(
    {"jd_text": ["工作地点：北京 • 海淀；其他", "base地 上海岗位职责：写", "工作城市：首页", "没有地点", None, "办公地址: - 深圳 -"]},
    {"place": ["北京·海淀", "上海", None, None, None, "深圳"]},
)


@query(_PLACE_SQL)
def places_in_texts(spark, sf_dir):
    """Work places behind their labels."""
    return _PLACE_ROWS(spark, sf_dir).select("id", L.place_in_text(c("jd_text")).alias("place"))


_META_ROWS, _META_SQL = cases(
    {
        "jd_text": ["算法工程师\n校园招聘\n工作地点：北京\n我们是谁\n\n岗位职责：\n写代码", "若干人\n任职要求：会写", "  \n", "深圳\n说明"],
        "title": ["算法工程师", "x", "x", "x"], "place": [None, None, None, "深圳"], "headcount": [None, "若干", None, None],
    },
    {"text": ["我们是谁\n岗位职责：\n写代码", "任职要求：会写", None, "说明"], "gone": ["已去掉重复页眉：算法工程师、校园招聘、工作地点：北京（3 行）", "已去掉重复页眉：若干人（1 行）", "无重复页眉可清理", "已去掉重复页眉：深圳（1 行）"]},
)


@query(_META_SQL)
def stripped_texts(spark, sf_dir):
    """Texts without repeated header lines, and what went."""
    rows = _META_ROWS(spark, sf_dir).withColumn("text", L.strip_meta(c("jd_text"), [c("title"), c("place"), c("headcount")]))
    return rows.select("id", "text", L.removed_summary(c("jd_text"), c("text")).alias("gone"))


_MERGE_ROWS, _MERGE_SQL = cases(
    {"old": [None, "短", "很长的正文" * 20, "很长的正文" * 20 + "写代码", None], "duties": ["写代码", "岗位职责：写代码", "写代码", "写代码", None], "reqs": ["会写", None, "Requirements: x", "会写", ""], "major": [None, None, None, "计算机", None]},
    {"text": ["工作职责：\n写代码\n\n任职要求：\n会写", "岗位职责：写代码", "很长的正文" * 20 + "\n\n工作职责：\n写代码\n\nRequirements: x", "很长的正文" * 20 + "写代码\n\n专业要求：\n计算机\n\n任职要求：\n会写", None]},
)


@query(_MERGE_SQL)
def merged_texts(spark, sf_dir):
    """Sections added to a text that lacks them."""
    return _MERGE_ROWS(spark, sf_dir).select("id", L.merge_sections(c("old"), c("duties"), c("reqs"), c("major")).alias("text"))


_LINK_ROWS, _LINK_SQL = cases(
    {
        "apply": ["https://a.com/jobs/1/detail?id=1", "https://a.com/campus?__job=x", "https://a.com/campus", None, "ftp://x", "https://a.com/job/9?__job=1"],
        "listing": ["https://a.com/campus", None, None, "https://a.com/campus", None, "https://b.com"],
        "page": [None, "https://a.com/p", None, None, "https://c.com", None],
    },
    {
        "apply_url": ["https://a.com/jobs/1/detail?id=1", "", "", "", "", ""],
        "source_url": ["https://a.com/campus", "https://a.com/p", "https://a.com/campus", "https://a.com/campus", "https://c.com", "https://b.com"],
        "fill": ["https://a.com/jobs/1/detail?id=1", "https://a.com/campus?__job=x", "https://a.com/campus", "https://a.com/campus", "ftp://x", "https://a.com/job/9?__job=1"],
        "kind": [None, None, None, None, None, None],
    },
)


@query(_LINK_SQL)
def record_links(spark, sf_dir):
    """Application and source links, and the link to open."""
    rows = _LINK_ROWS(spark, sf_dir).withColumn("l", R.links(c("apply"), c("listing"), c("page")))
    return rows.select("id", "l.apply_url", "l.source_url", R.fill_url(c("apply"), c("listing")).alias("fill"), F.lit(None).cast("string").alias("kind"))


_CH_ROWS, _CH_SQL = cases(
    {"url": ["https://a.com/campus/jobs", "https://a.com/x?type=intern", "https://a.com/shzp/1", "https://a.com", "https://a.com/interns.html", None], "nav": [None, None, "campus", None, None, "social"], "title": ["实习生", "社招经理", "校园大使", "工程师", "intern", None], "post": ["school", "society", "x", None, "Internship", "campus"]},
    {"channel": ["campus", "intern", "campus", None, "intern", "social"], "project": ["校园招聘", "实习生招聘", "校园招聘", None, "实习生招聘", "社会招聘"], "bucket": ["校招", "日常实习", "校招", None, "日常实习", None], "hint": ["intern", "social", "campus", None, "intern", None], "posted": ["campus", "social", None, None, "intern", "campus"], "paged": [True, True, True, False, True, False]},
)


@query(_CH_SQL)
def recruit_channels(spark, sf_dir):
    """Channels of URLs, navigation, fields and post types."""
    none = F.lit(None).cast("string")
    rows = _CH_ROWS(spark, sf_dir).withColumn("k", R.channel_kind(c("nav"), c("url")))
    return rows.select("id", "k.channel", "k.project", "k.bucket", R.channel_of_fields(none, none, none, none, c("title")).alias("hint"), R.channel_of_post_type(c("post")).alias("posted"), R.is_paged_channel(c("k.channel")).alias("paged"))


_SMALL_ROWS, _SMALL_SQL = cases(
    {
        "title": ["职位已关闭", "首页", "算法工程师", "欢迎登录 x", None, "校园招聘"], "jd_text": [None, "短", "短", "个人中心", "", "很长的正文" * 20],
        "bucket": ["日常实习", None, None, "校招", None, None], "status": ["ok", "failed", None, "", "ok", " OK "], "url": ["https://a.com", "https://a.com", "x", "https://a.com", None, "https://a.com"],
        "expires": ["2026-08-01", "2026-07-31", None, "2026-08-02T00:00:00Z", "bad", ""], "version": ["1.2.10", "1.10", "x.2", "", "2", None], "token": ["2024.5.17.3", "20240517", "2024517", "20241301", "abc", None],
        "error": ["页面内容为空", "", "timeout", None, "列表为空", "x"], "project": ["秋招", "校园招聘", None, "首页", "实习", ""],
    },
    {
        "no_job": [True, True, False, True, True, False], "intern": [True, False, False, False, False, False], "again": [True, True, False, True, False, False],
        "valid": [True, False, True, True, True, True], "version": ["1.2.10", "1.10", "0.2", "0", "2", "0"], "day": ["2024-05-17", "2024-05-17", "2024-05-17", None, None, None],
        "empty_result": [True, True, False, True, True, False], "entry": ["甲 秋招", "甲 校园招聘入口", "甲 校园招聘入口", "甲 校园招聘入口", "甲 实习", "甲 校园招聘入口"],
    },
)


@query(_SMALL_SQL)
def record_checks(spark, sf_dir):
    """Small predicates and scalars."""
    none = F.lit(None).cast("string")
    return _SMALL_ROWS(spark, sf_dir).select(
        "id", R.no_posting(c("title"), c("jd_text")).alias("no_job"), R.is_internship(c("bucket"), c("title"), none, none).alias("intern"), R.needs_second_reading(c("url"), c("status"), c("jd_text")).alias("again"),
        R.is_valid_account(F.lit(True), c("expires"), AS_OF).alias("valid"), F.array_join(R.version(c("version")).cast("array<string>"), ".").alias("version"), R.token_date(c("token")).cast("string").alias("day"),
        R.result_without_posting(F.lit(False), F.lit(0), c("error"), F.coalesce(c("error") == "timeout", F.lit(False))).alias("empty_result"), R.entry_title(F.lit("甲"), c("project")).alias("entry"),
    )


_OVER_ROWS, _OVER_SQL = cases(
    {"old": ["a", "a", "", None, "a"], "new": ["b", "", "b", None, " a "], "group": ["g", "", None, "h", ""], "company": ["未知企业", "乙", "", None, "乙"]},
    {
        "title": ["b", "a", "b", "", "a"], "kept": ["a", "a", "b", "", "a"], "group_name": ["g", "", "旧", "h", ""], "company_now": ["旧", "乙", "旧", "旧", "乙"],
        "changed": ["岗位名称→b", "", "岗位名称→b", "", ""],
    },
)


@query(_OVER_SQL)
def overlaid_records(spark, sf_dir):
    """A form filled by a second reading, and what changed."""
    rows = _OVER_ROWS(spark, sf_dir)
    was = F.struct(c("old").alias("title"), F.lit("旧").alias("group_name"), F.lit("旧").alias("company"))
    now = F.struct(c("new").alias("title"), c("group").alias("group_name"), c("company"))
    both = rows.select("id", was.alias("w"), now.alias("n"))
    said = F.array_join(R.changes("w", "n", ("title",)), ";")
    return both.select("id", R.overlaid("w", "n", "title").alias("title"), R.overlaid("w", "n", "title", True).alias("kept"), R.overlaid("w", "n", "group_name").alias("group_name"), R.overlaid("w", "n", "company").alias("company_now"), said.alias("changed"))


_HINT_ROWS, _HINT_SQL = cases(
    {"own": ["首页", "算法工程师", None, "xx"], "listed": ["产品经理", "产品经理", "首页", None], "place": ["北京", "", None, ""], "list_place": ["上海", "上海", None, "广州"], "outside": [True, False, True, False]},
    {"title": ["产品经理", "算法工程师", None, "xx"], "place": ["北京", "上海", None, "广州"], "label": ["【超出近半年】首页  ·  北京  ·  2025-01-02", "算法工程师", "【超出近半年】未命名岗位  ·  2025-01-02", "xx"]},
)


@query(_HINT_SQL)
def hinted_records(spark, sf_dir):
    """Detail rows with what their list rows add, and candidates' labels."""
    rows = _HINT_ROWS(spark, sf_dir)
    own = F.struct(c("own").alias("title"), c("place").alias("work_location"))
    hint = F.struct(c("listed").alias("title"), c("list_place").alias("work_location"))
    both = rows.select("id", own.alias("d"), hint.alias("h"), c("own").alias("title"), F.lit(None).cast("string").alias("apply_url"), c("place").alias("work_location"), F.lit(None).cast("string").alias("list_updated_at"), F.lit("2025-01-02").alias("published_at"), "outside")
    return both.select("id", R.hinted("d", "h", "title").alias("title"), R.hinted("d", "h", "work_location").alias("place"), R.candidate_label(c("outside")).alias("label"))


_DIG_ROWS, _DIG_SQL = cases(
    {"payload": ['{"a":{"title":"x","Name":"算法工程师"}}', '[{"jobTitle":"产品"},{"content":"short"}]', '{"description":"' + "长" * 50 + '"}', "no json", None]},
    {"title": ["算法工程师", "产品", None, None, None], "size": [0, 0, 50, 0, 0]},
)


@query(_DIG_SQL)
def dug_payloads(spark, sf_dir):
    """Title and text anywhere in a JSON payload."""
    return _DIG_ROWS(spark, sf_dir).select("id", R.dug_title(c("payload")).alias("title"), F.coalesce(F.length(R.dug_text(c("payload"))), F.lit(0)).cast("long").alias("size"))


_TIME_ROWS, _TIME_SQL = cases(
    {"open_at": ["2026-07-01", None, None, None, "2025-01-01"], "jd_text": [None, "发布时间：2026-05-05", "", None, None], "page": [None, None, "2026-06-06", None, None], "created_at": ["2024-01-01", "2024-01-01", "2024-01-01", None, None], "cloud": [None, "2026-07-01T10:00:00", "2026-07-03T10:00:00", "", "x"], "updated": ["a", "2026-07-02T00:00:00", "2026-07-02T00:00:00", "a", ""]},
    {
        "source": ["open_at", "labeled", "page", None, "open_at"], "action": ["keep", "keep", "keep", "keep_no_date", "delete"],
        "progress": ["未推送", "待推送（本地有更新 · 上次 2026-07-01T10:00）", "已推送 2026-07-03T10:00", "未推送", "已推送 x"],
    },
)


@query(_TIME_SQL)
def timeliness_actions(spark, sf_dir):
    """Which date counts, what follows, and the state of the upload."""
    rows = _TIME_ROWS(spark, sf_dir).withColumn("ref", R.reference_date(F.try_element_at(L.labelled_fields(c("jd_text")), F.lit("open_at")), F.to_date("page")))
    return rows.select("id", c("ref.source").alias("source"), R.timeliness(c("ref"), AS_OF).alias("action"), R.upload_progress(c("cloud"), c("updated")).alias("progress"))


@query(f"SELECT action, count(*) AS n FROM (SELECT {_case(['keep', 'keep', 'keep', 'keep_no_date', 'delete'])} AS action FROM documents) GROUP BY action")
def timeliness_counts(spark, sf_dir):
    """Postings by action."""
    return W.action_counts(timeliness_actions(spark, sf_dir))


_SRC_ROWS, _SRC_SQL = cases(
    {"company": ["甲", "校招汇总", "乙", "丙", "丁"], "url": ["https://app.mokahr.com/campus/1", "https://a.com", "https://mp.weixin.qq.com/s/1", "nope", "https://d.com/x"]},
    {"status": ["official", "rejected", "unverified", "unverified", "unverified"], "reason": ["可信 ATS/网申域名", "命中汇总黑名单", "公众号链接待人工确认官方归属", "无效 URL", "待验证官方归属"], "guesses": [1, 11, 11, 0, 11]},
)


@query(_SRC_SQL)
def source_verdicts(spark, sf_dir):
    """C17: official, unverified or rejected; career pages guessed from a host."""
    rows = _SRC_ROWS(spark, sf_dir).withColumn("v", R.official_source(c("company"), c("url"), F.lit("")))
    return rows.select("id", "v.status", "v.reason", F.size(R.guessed_urls(F.array("url"))).cast("long").alias("guesses"))


# the review workflow over orders in the role of postings

_JOBS = """SELECT o_orderkey AS id, 'c' || (o_custkey % 50) AS company, CASE o_orderkey % 5 WHEN 0 THEN '首页' ELSE '算法工程师 ' || (o_custkey % 7) END AS title,
  CASE o_orderkey % 3 WHEN 0 THEN '' ELSE 'https://a.com/job?id=' || (o_custkey % 40) END AS apply_url, 'https://a.com/list?id=1' AS source_url, CAST(NULL AS STRING) AS jd_text,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'deleted' ELSE 'pending_review' END AS status, CASE WHEN o_orderkey % 4 < 2 THEN '2026-01-01T00:00:00' END AS cloud_updated_at,
  o_custkey AS company_id, CASE o_orderkey % 6 WHEN 0 THEN '国企' ELSE '' END AS company_nature, CAST(o_orderdate AS STRING) AS updated_at FROM orders"""


def _jobs(spark, sf_dir) -> DataFrame:
    return spark.sql(_JOBS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


_J = f"WITH j AS ({_JOBS.replace('STRING', 'VARCHAR')})"


@query(
    _J + """, k AS (SELECT id, company, regexp_replace(title, '\\s', '', 'g') AS t, CASE WHEN apply_url = '' THEN 'https://a.com/list?id=1' ELSE apply_url END AS u, title = '首页' OR title NOT LIKE '%工程师%' AS shell, id % 2 = 1 AS is_new FROM j)
    SELECT n.id AS new_id, min(o.id) AS old_id FROM k n JOIN k o ON n.company = o.company AND n.u = o.u AND (n.t = o.t OR n.shell OR o.shell) WHERE n.is_new AND NOT o.is_new GROUP BY n.id"""
)
def upsert_matches(spark, sf_dir):
    """Which stored posting an incoming one is."""
    keyed = W.with_identity(_jobs(spark, sf_dir))
    return W.match_for_upsert(keyed.where("id % 2 = 0"), keyed.where("id % 2 = 1"))


@query(_J + " SELECT id, CASE WHEN id % 10 < 3 AND status = 'active' THEN 'pending_review' ELSE status END AS status, CASE WHEN NOT (id % 10 < 3 AND status = 'active') THEN cloud_updated_at END AS cloud_updated_at FROM j")
def reverted_postings(spark, sf_dir):
    """Active postings back to review."""
    j = _jobs(spark, sf_dir)
    return W.revert_to_review(j, j.where("id % 10 < 3").select("id"))[0].select("id", "status", "cloud_updated_at")


@query(_J + ", o AS (SELECT id, id AS pos FROM j WHERE id % 10 = 0) SELECT id, pos FROM o UNION ALL SELECT id, id + (SELECT max(pos) FROM o) + 1 FROM j WHERE id % 10 < 3 AND status = 'active' AND cloud_updated_at IS NOT NULL AND id % 10 <> 0")
def revoke_ids(spark, sf_dir):
    """Pushed postings that went back join the ids to revoke."""
    j = _jobs(spark, sf_dir)
    revoked = W.revert_to_review(j, j.where("id % 10 < 3").select("id"))[1]
    held = j.where("id % 10 = 0").select("id", c("id").alias("pos"))
    return W.add_ids(held, revoked.select("id", c("id").alias("pos")))


@query(_J + " SELECT id, 'deleted' AS status FROM j WHERE id % 10 IN (0, 1) AND NOT id % 20 = 0 AND status <> 'active'")
def revoked_snapshot(spark, sf_dir):
    """The revoked ids' postings that aren't active again, as deleted."""
    j = _jobs(spark, sf_dir)
    ids = W.drop_ids(j.where("id % 10 in (0, 1)").select("id", c("id").alias("pos")), j.where("id % 20 = 0").select("id"))
    return W.revoked_postings(j, ids).select("id", "status")


@query(_J + " SELECT id, CASE WHEN id % 3 = 0 THEN '2026-08-01' ELSE cloud_updated_at END AS cloud_updated_at, updated_at FROM j")
def synced_postings(spark, sf_dir):
    """The sync stamp of pushed postings."""
    j = _jobs(spark, sf_dir)
    return W.mark_synced(j, j.where("id % 3 = 0").select("id"), "2026-08-01").select("id", "cloud_updated_at", "updated_at")


@query("SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS apply_status, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'n' WHEN o_orderkey % 4 <> 0 THEN 'o' END AS note FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 4 <> 0")
def personal_states(spark, sf_dir):
    """Personal states where a null note keeps the old one."""
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("job_id"))
    old = o.where("job_id % 4 != 0").withColumns({"apply_status": F.lit("old"), "note": F.lit("o")})
    new = o.where("job_id % 2 = 0").withColumns({"apply_status": F.lit("new"), "note": F.when(c("job_id") % 3 == 0, "n")})
    return W.set_states(old, new)


@query("SELECT l_orderkey AS job_id, min(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_suppkey END) AS added_at FROM lineitem GROUP BY l_orderkey")
def picked_postings(spark, sf_dir):
    """Picks that are kept once, and their list (whole, newest first)."""
    lines = table(spark, sf_dir, "lineitem")
    old = lines.where("l_linenumber = 1").select(c("l_orderkey").alias("job_id"), F.lit("campus").alias("collection"), F.lit(0).cast("long").alias("added_at")).distinct()
    new = lines.where("l_linenumber > 1").select(c("l_orderkey").alias("job_id"), F.lit("campus").alias("collection"), c("l_suppkey").cast("long").alias("added_at"))
    return W.list_picks(W.add_picks(old, new), "campus").select("job_id", "added_at")


_REV = """SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'resolved' ELSE 'pending' END AS status, 'low' AS kind, 'why' AS reason,
  '{"title":"' || (CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '算法实习生' ELSE 'Java' END) || '","source_url":"https://a.com/' || event_id || '","company":"c' || (event_id % 9) || '","recruit_project":"' || (CASE event_id % 5 WHEN 0 THEN '秋招' ELSE '' END)
  || '","open_at":"' || (CASE event_id % 2 WHEN 0 THEN '2024-01-01' ELSE '2026-07-01' END) || '"}' AS payload FROM events"""


def _reviews(spark, sf_dir) -> DataFrame:
    return spark.sql(_REV.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


_RV = f"WITH r AS ({_REV}), p AS (SELECT *, json_extract_string(payload, '$.title') AS title, json_extract_string(payload, '$.recruit_project') AS project FROM r)"


@query(_RV + " SELECT id AS review_id, title, 'active' AS status FROM p WHERE status = 'pending' AND title <> ''")
def published_reviews(spark, sf_dir):
    """Pending payloads with a title and a source become postings."""
    return W.publish_reviews(_reviews(spark, sf_dir))[0].select("review_id", "title", "status")


@query(_RV + " SELECT id AS review_id, title, CASE WHEN project = '' THEN '日常实习' ELSE project END AS recruit_project, CASE WHEN title = '算法实习生' THEN '日常实习' END AS recruit_bucket FROM p WHERE status = 'pending' AND title = '算法实习生'")
def promoted_internships(spark, sf_dir):
    """Payloads that show an internship, with its defaults."""
    return W.promote_internships(_reviews(spark, sf_dir))[0].select("review_id", "title", "recruit_project", "recruit_bucket")


@query(_RV + " SELECT id, CASE WHEN status = 'pending' AND title <> '' THEN 'published' ELSE status END AS status, CASE WHEN id % 7 = 0 THEN 'x' END AS resolved_at, CASE WHEN status = 'pending' AND id % 11 = 0 THEN 'edited' ELSE reason END AS reason FROM p")
def review_lifecycle(spark, sf_dir):
    """Entries edited while pending, published, and stamped."""
    queue = _reviews(spark, sf_dir).withColumn("resolved_at", F.lit(None).cast("string"))
    edits = queue.where("id % 11 = 0").select("id", "payload", F.lit("edited").alias("reason"))
    done = W.publish_reviews(W.edit_payloads(queue, edits))[1]
    stamped = W.resolve_reviews(done.withColumn("was", c("status")), queue.where("id % 7 = 0").select("id"), "any", "x")
    return stamped.select("id", c("was").alias("status"), "resolved_at", "reason")


@query(_RV + " SELECT id, CASE WHEN status = 'pending' AND id % 2 = 0 THEN 'ignored' ELSE status END AS status FROM p")
def expired_entries(spark, sf_dir):
    """Pending entries whose payload is past retention."""
    return W.expired_reviews(_reviews(spark, sf_dir), AS_OF).select("id", "status")


@query(_RV + " SELECT id FROM p WHERE contains(lower('c' || (id % 9) || ' ' || title), 'java')")
def searched_reviews(spark, sf_dir):
    """entries by a keyword of their payload."""
    return W.search_reviews(_reviews(spark, sf_dir), "JAVA").select("id")


@query(_RV + " SELECT DISTINCT kind, key FROM (SELECT 'url' AS kind, 'https://a.com/' || id AS key FROM p WHERE status = 'pending' AND id % 9 = 3 UNION ALL SELECT 'title', lower(title) FROM p WHERE status = 'pending' AND id % 9 = 3 AND title <> '')")
def known_of_company(spark, sf_dir):
    """What is known of one company."""
    none = _jobs(spark, sf_dir).where("company = 'nobody'")
    return W.known_identities(none, _reviews(spark, sf_dir), "c3")


_CAND = "SELECT o_orderkey AS id, 'T' || (o_custkey % 30) AS title, CASE o_orderkey % 4 WHEN 0 THEN 'https://a.com/job?id=' || (o_custkey % 60) WHEN 1 THEN 'https://a.com/list' END AS apply_url, CAST(NULL AS STRING) AS detail_url, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE 'https://a.com/list' END AS source_url FROM orders"


@query(f"""WITH x AS ({_CAND.replace('STRING', 'VARCHAR')}) SELECT id, CASE id % 4 WHEN 0 THEN cast(regexp_extract(apply_url, '([0-9]+)$', 1) AS INT) < 20 WHEN 3 THEN cast(substr(title, 2) AS INT) < 10
  ELSE cast(substr(title, 2) AS INT) < 10 END AS known FROM x""")
def known_postings(spark, sf_dir):
    """A specific URL decides before the title, a list page only with it."""
    rows = spark.sql(_CAND.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    known = spark.range(20).selectExpr("'url' as kind", "'https://a.com/job?id=' || id as key").union(spark.range(10).selectExpr("'title'", "'t' || id")).union(spark.range(1).selectExpr("'url'", "'https://a.com/list'"))
    return W.known_candidates(rows, known).select("id", "known")


@query("SELECT p_partkey AS pos, 'table' AS source FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'adapter' FROM part WHERE p_partkey % 2 = 1 AND (lower(trim(p_brand)), p_size) NOT IN (SELECT lower(trim(p_brand)), p_size FROM part WHERE p_partkey % 2 = 0)")
def appended_rows(spark, sf_dir):
    """Table rows, then adapter rows with another title and URL."""
    p = table(spark, sf_dir, "part").select(c("p_partkey").alias("pos"), c("p_brand").alias("title"), F.concat(F.lit("https://a.com/job?id="), c("p_size").cast("string")).alias("url"))
    return W.append_unlike(p.where("pos % 2 = 0"), p.where("pos % 2 = 1")).select("pos", "source")


@query("SELECT pos FROM (SELECT p_partkey AS pos, p_partkey % 2 AS l, row_number() OVER (PARTITION BY lower(p_brand), p_size ORDER BY p_partkey % 2, p_partkey) AS n FROM part WHERE p_partkey % 5 <> 0) WHERE n = 1 ORDER BY l, pos LIMIT 200")
def merged_channels(spark, sf_dir):
    """Two channel lists as one, without social hiring (a list of 200 by its nature)."""
    p = table(spark, sf_dir, "part").select(c("p_partkey").alias("pos"), c("p_brand").alias("title"), F.concat(F.lit("https://a.com/"), c("p_size").cast("string"), F.lit("?x="), c("p_partkey").cast("string")).alias("url"), F.when(c("p_partkey") % 5 == 0, "社会招聘").otherwise("秋招").alias("recruit_project"))
    return W.merge_channels([p.where("pos % 2 = 0"), p.where("pos % 2 = 1")], 200).select("pos")


@query(_J + ", n AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0) SELECT j.id, CASE WHEN company_nature = '' THEN (CASE WHEN n.id IS NOT NULL THEN '民企' END) ELSE company_nature END AS company_nature FROM j LEFT JOIN n ON j.company_id = n.id")
def spread_natures(spark, sf_dir):
    """A company's new nature fills its postings."""
    customers = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), F.lit("").alias("company_nature"))
    natures = customers.where("id % 3 = 0").select("id", F.lit("民营企业").alias("nature"))
    return W.spread_nature(customers, _jobs(spark, sf_dir), natures)[1].select("id", "company_nature")


@query("SELECT c_custkey AS want_id, CASE WHEN c_custkey % 2 = 0 AND c_custkey <= (SELECT max(s_suppkey) FROM supplier) THEN cast(c_custkey AS VARCHAR) WHEN c_custkey % 3 = 0 THEN '1' END AS company_id FROM customer")
def found_companies(spark, sf_dir):
    """companies by id, else by name."""
    companies = table(spark, sf_dir, "supplier").select(c("s_suppkey").cast("string").alias("id"), F.when(c("s_suppkey") == 1, "晨光").otherwise(F.concat(F.lit("x"), c("s_suppkey").cast("string"))).alias("name_norm"))
    wanted = table(spark, sf_dir, "customer").select(c("c_custkey").alias("want_id"), F.when(c("c_custkey") % 2 == 0, c("c_custkey").cast("string")).alias("company_id"), F.when(c("c_custkey") % 3 == 0, " 晨光有限公司").alias("company_name"))
    return W.find_company(wanted, companies)


@query("SELECT o_orderkey AS id, o_orderdate AS t FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200 OFFSET 100")
def newest_page(spark, sf_dir):
    """a page of one status, newest first (a page by its nature)."""
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), c("o_orderdate").alias("t"), "o_orderstatus")
    return W.newest(o, c("o_orderstatus") == "F", "t", 200, 100).select("id", "t")


_ACC = "SELECT c_custkey AS account, c_custkey % 3 <> 0 AS enabled, CASE c_custkey % 4 WHEN 0 THEN '2026-07-31' WHEN 1 THEN '2026-08-01' END AS expires_at FROM customer"


def _accounts(spark, sf_dir) -> DataFrame:
    return spark.sql(_ACC.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))


@query(f"WITH a AS ({_ACC}) SELECT o_orderkey AS token, o_custkey AS account FROM orders JOIN a ON o_custkey = account WHERE enabled AND (expires_at IS NULL OR expires_at >= '2026-08-01') AND o_orderdate > DATE '1998-01-01'")
def live_sessions(spark, sf_dir):
    """Sessions that haven't ended, of usable accounts."""
    sessions = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("token"), c("o_custkey").alias("account"), c("o_orderdate").alias("session_expires"))
    return W.valid_sessions(sessions, _accounts(spark, sf_dir), AS_OF, F.lit("1998-01-01").cast("date")).select("token", "account")


@query(f"WITH a AS ({_ACC}) SELECT EXISTS (SELECT 1 FROM a WHERE enabled AND (expires_at IS NULL OR expires_at >= '2026-08-01')) AS any_account")
def any_account(spark, sf_dir):
    """Whether any account can be used."""
    return W.has_accounts(_accounts(spark, sf_dir), AS_OF)


@query("SELECT 'companies' AS name, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'pending', (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'active', (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') UNION ALL SELECT 'reviews', (SELECT count(*) FROM events WHERE event_type = 'error')")
def dashboard_counts(spark, sf_dir):
    """Counts of several tables."""
    o = table(spark, sf_dir, "orders")
    return W.dashboard({"companies": table(spark, sf_dir, "customer"), "pending": o.where("o_orderstatus = 'P'"), "active": o.where("o_orderstatus = 'O'"), "reviews": table(spark, sf_dir, "events").where("event_type = 'error'")})


@query("SELECT o_orderkey AS id, greatest(0, t - d)::BIGINT AS pending, t::BIGINT AS total FROM (SELECT *, CASE WHEN listed > 0 THEN listed WHEN d > 0 THEN d ELSE 50 END AS t FROM (SELECT o_orderkey, o_orderkey % 3 + o_orderkey % 4 AS d, o_orderkey % 5 AS listed FROM orders))")
def pending_counts(spark, sf_dir):
    """What is left of each company's run."""
    k = c("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("k", R.job_counts(k % 3, k % 4, k % 5, 50))
    return o.select(k.alias("id"), "k.pending", "k.total")


@query("SELECT o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY src, o_orderkey) AS n FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS src, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey % 2, o_orderkey) AS r FROM orders) WHERE r = 1) WHERE n <= 3")
def capped_supplements(spark, sf_dir):
    """Reviews, then postings, once each, three of every company."""
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), c("o_custkey").alias("company"), c("o_orderpriority").alias("identity"))
    return W.capped_by_company(o.where("id % 2 = 0"), o.where("id % 2 = 1"), 3).select("id")


@query("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN true ELSE false END AS outside FROM documents")
def outside_marks(spark, sf_dir):
    """Rows out of the window are marked, none is dropped."""
    d = table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), F.when(c("doc_id") % 3 == 0, "2025-12-01").alias("list_updated_at"), F.when(c("doc_id") % 3 == 1, "2026/07/01").alias("published_at"))
    return W.mark_outside(d, AS_OF).select("id", "outside")


@query("SELECT 'https://x.zhiye.com/campus/jobs/' || k AS url, CASE WHEN doc_id % 2 = 0 THEN 'https://x.zhiye.com/campus/detail?jobAdId=' || doc_id ELSE 'https://x.zhiye.com/campus/jobs/' || k END AS current_url FROM (SELECT doc_id, '00000000-0000-0000-' || lpad(cast(doc_id AS VARCHAR), 12, '0') AS k FROM documents)")
def current_links(spark, sf_dir):
    """Links of the old form through a lookup."""
    uuid = F.concat(F.lit("00000000-0000-0000-"), F.lpad(c("doc_id").cast("string"), 12, "0"))
    d = table(spark, sf_dir, "documents").withColumn("uuid", uuid)
    links = d.select(F.concat(F.lit("https://x.zhiye.com/campus/jobs/"), c("uuid")).alias("url"))
    return W.upgrade_legacy(links, d.where("doc_id % 2 = 0").select("uuid", c("doc_id").cast("string").alias("job_ad_id"))).select("url", "current_url")


@query("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'rejected' ELSE 'unverified' END AS verify_status, cast(CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_career FROM supplier")
def promoted_companies(spark, sf_dir):
    """C17: companies with a trusted host become official."""
    k = c("s_suppkey")
    urls = F.when(k % 4 == 0, F.array(F.lit("https://app.mokahr.com/campus/1"), F.lit("https://a.com"))).otherwise(F.array(F.lit("https://a.com")))
    companies = table(spark, sf_dir, "supplier").select(k.alias("id"), F.lit("甲").alias("name"), F.when(k % 4 == 1, "rejected").otherwise("unverified").alias("verify_status"), urls.alias("hint_apply_urls"), F.expr("cast(array() as array<string>)").alias("career_urls"))
    return W.promote_trusted(companies).select("id", "verify_status", F.size("career_urls").cast("long").alias("n_career"))


@query(_J + " SELECT id, '[]' AS tags, 'ok' AS parse_status, status FROM j")
def wire_rows(spark, sf_dir):
    """Postings as they are sent."""
    missing = {k: F.lit(None).cast("string") for k in ("group_name", "recruit_project", "recruit_bucket", "deadline", "work_location", "industry", "education", "salary_range", "headcount", "open_at", "graduation_batch", "raw_category", "parse_status", "job_tags")}
    jobs = _jobs(spark, sf_dir).withColumns(missing | {"confidence": F.lit(None).cast("double")})
    return jobs.select(*R.wire()).select("id", F.to_json("job_tags").alias("tags"), "parse_status", "status")


@query(_J + " SELECT id, row_number() OVER (ORDER BY left(company, 6), company, lower(title), updated_at, id) AS place FROM j")
def clustered_order(spark, sf_dir):
    """Postings by company cluster, title, date and position. The order is kept by
    a range-partitioned sort; places are numbered from each partition's count."""
    jobs = _jobs(spark, sf_dir).select("id", "company", "title", c("updated_at").alias("open_at"), F.lit(None).cast("string").alias("list_updated_at"), F.lit(None).cast("string").alias("published_at"), c("id").alias("pos"))
    return dedupe.numbered(W.cluster_order(jobs)).select("id", "place")


@query(_J + " SELECT id, CASE WHEN status = 'pending_review' AND id % 5 <> 0 THEN 'active' ELSE status END AS status FROM j")
def approved_postings(spark, sf_dir):
    """Complete and recent pending postings become active."""
    jobs = _jobs(spark, sf_dir).withColumns({"open_at": F.lit("2026-07-15"), "list_updated_at": F.lit(None).cast("string"), "published_at": F.lit(None).cast("string")})
    text = F.lit("负责写代码和改代码的全部工作")
    return W.approve(jobs, AS_OF, text, text).select("id", "status")


@query(f"SELECT id, title, recruit_project, recruit_bucket, work_location, open_at, education, graduation_batch FROM (SELECT doc_id AS id, {_case(['算法工程师', '前端开发', '测试工程师', '数据分析师', '产品经理', '研发工程师（硕士及以上）', '管培生'])} AS title, {_case(['社会招聘', '校园招聘', '秋招', '', '日常实习', '', ''])} AS recruit_project, {_case(['', '校招', '校招', '', '日常实习', '', '校招'])} AS recruit_bucket, {_case(['北京', '上海 · 浦东', '', '', '', '', ''])} AS work_location, {_case(['2026-07-01', '2026-06-30', '', '', '', '', ''])} AS open_at, {_case(['本科及以上', '硕士', '本科', '', '', '硕士及以上', ''])} AS education, '2027届' AS graduation_batch FROM documents)")
def parsed_records(spark, sf_dir):
    """A parsed page as a normalised record."""
    return R.records_of(_ROWS(spark, sf_dir), AS_OF).select("id", "title", "recruit_project", "recruit_bucket", "work_location", "open_at", "education", "graduation_batch")


#: Whole documents as postings, cut in two by their own length and labelled from their own
#: columns (SQL of both engines).
_LABELLED = """SELECT doc_id AS id, source, deg, first, rest, coalesce(lang, '') || chr(10) || '工作地点：' || source || chr(10) || '学历要求：' || deg || chr(10) || '岗位职责：' || chr(10) || first || chr(10) || '任职要求：' || chr(10) || rest AS body
  FROM (SELECT doc_id, lang, source, CASE doc_id % 4 WHEN 0 THEN '博士' WHEN 1 THEN '硕士及以上' WHEN 2 THEN '本科' ELSE '大专' END AS deg, 'a' || substr(text, 1, CAST(n_chars % 997 AS INT)) || 'b' AS first, 'c' || substr(text, CAST(n_chars % 997 AS INT) + 1) || 'd' AS rest
    FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)"""


@query(f"SELECT id, source AS place, deg AS education, length(regexp_replace(first, '\\s+', '', 'g')) AS n_duties, length(regexp_replace(rest, '\\s+', '', 'g')) AS n_requirements FROM ({_LABELLED})")
def whole_text_facts(spark, sf_dir):
    """Place, degree and both sections of whole texts."""
    rows = run_sql(spark, sf_dir, _LABELLED).withColumn("s", L.split_sections(c("body"), L.labelled_fields(c("body"))))
    dense = lambda x: F.length(F.regexp_replace(x, r"\s+", "")).cast("long")
    return rows.select("id", L.place_in_text(c("body")).alias("place"), L.education_of(c("body"), F.lit("")).alias("education"), dense(c("s.duties")).alias("n_duties"), dense(c("s.requirements")).alias("n_requirements"))


@query("""SELECT doc_id AS id, CASE WHEN length(t) >= 2 THEN t END AS title, CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) >= 41 THEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) END AS n_text
  FROM (SELECT doc_id, text, trim(substr(text, 1, 60), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents WHERE text IS NOT NULL)""")
def whole_text_payloads(spark, sf_dir):
    """Title and text dug out of nested JSON that holds whole texts."""
    nested = F.to_json(F.struct(c("doc_id").alias("id"), F.struct(F.struct(F.substring("text", 1, 60).alias("jobTitle"), F.array(F.struct(c("text").alias("jobDescription"))).alias("parts")).alias("job")).alias("data")))
    rows = table(spark, sf_dir, "documents").where("text is not null").select(c("doc_id").alias("id"), nested.alias("payload"))
    return rows.select("id", R.dug_title(c("payload")).alias("title"), F.length(R.dug_text(c("payload"))).cast("long").alias("n_text"))
