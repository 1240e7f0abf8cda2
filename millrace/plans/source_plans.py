"""Queries of the readers: bodies and pages are built from rows of the part table and read
back, and the twins take the same facts from the table itself. Also keyed mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import classify as C
from millrace.functions import dates as D
from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.operators import dedupe, mutate, vote
from millrace.operators import query as Q
from millrace.plans.record_plans import cases
from millrace.plans.registry import registry
from millrace.plans.roles import AS_OF
from millrace.session import table
from millrace.sources import feeds, xlsx
from millrace.sources import html as H
from millrace.streaming import changes

QUERIES, ORACLES, query = registry()

c = F.col


def _parts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("k"), c("p_name").alias("name"), c("p_brand").alias("brand"), c("p_size").alias("size"))


def _said(template: str) -> "F.Column":
    """A text with the row's values in place of [k], [name], [brand] and [size]."""
    out = F.lit(template)
    for name in ("k", "name", "brand", "size"):
        out = F.replace(out, F.lit(f"[{name}]"), c(name).cast("string"))
    return out


def _bodies(spark, sf_dir, template: str) -> DataFrame:
    return _parts(spark, sf_dir).select("k", _said(template).alias("body"))


_P = "SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_size AS size FROM part"


@query(f"WITH p AS ({_P}) SELECT 'a' || k AS source_id, name AS title, CASE k % 10 WHEN 1 THEN 'social' WHEN 2 THEN 'campus' WHEN 3 THEN 'intern' END AS channel, CASE k % 10 WHEN 2 THEN '校招' WHEN 3 THEN '日常实习' END AS recruit_bucket, brand || ' / Y' AS work_location, '岗位职责' || chr(10) || brand AS jd_text, '2026-07-02' AS open_at, CAST(size AS VARCHAR) AS headcount FROM p")
def paged_lists(spark, sf_dir):
    """A paged list's envelope, byte-order mark and repeats included."""
    one = '{"Id":"a[k]","JobAdName":" [name] ","CategoryId":"[last]","LocNames":["[brand]","[brand]","Y",""],"Duty":"[brand]","Require":" ","PostDate":"2026-07-02T00:00:00","HeadCount":[size]}'
    body = '﻿{"Code":200,"Count":2,"Data":[' + one + "," + one + "]}"
    pages = _bodies(spark, sf_dir, body).withColumn("body", F.replace("body", F.lit("[last]"), (c("k") % 10).cast("string")))
    bad = spark.range(1).selectExpr("cast(0 as bigint) as k", "'{\"Code\":500}' as body")
    return feeds.read_paged_list(pages.unionByName(bad)).select("source_id", "title", "channel", "recruit_bucket", "work_location", "jd_text", "open_at", "headcount")


@query(f"WITH p AS ({_P}) SELECT CAST(k AS VARCHAR) AS source_id, name AS title, brand AS company, 'intern' AS channel, '日常实习' AS recruit_bucket, CASE WHEN k % 2 = 0 THEN '2027-01-01' END AS deadline FROM p")
def page_forms(spark, sf_dir):
    """Nested page forms; an end in 2030 stands for none."""
    body = '{"state":"200","data":{"pageForm":{"totalPage":1,"currentPage":1,"pageData":[{"postId":"[k]","postName":"[name]","company":"[brand]","recruitType":12,"endDate":"[end]-01-01 00:00"}]}}}'
    pages = _bodies(spark, sf_dir, body).withColumn("body", F.replace("body", F.lit("[end]"), F.when(c("k") % 2 == 0, "2027").otherwise("2030")))
    return feeds.read_page_form(pages).select("source_id", "title", "company", "channel", "recruit_bucket", "deadline")


@query(f"WITH p AS ({_P}) SELECT CAST(k AS VARCHAR) AS source_id, name AS title, '校招' AS recruit_project, brand AS raw_category, 'X / Y' AS work_location, '职位描述' || chr(10) || name || chr(10) || chr(10) || '职位要求' || chr(10) || brand AS jd_text FROM p")
def job_lists(spark, sf_dir):
    """Card items of a paged list."""
    body = '{"data":{"job_post_list":[{"id":"[k]","title":"[name]","description":"[name]","requirement":"[brand]","city_list":[{"name":"X"},{"name":"Y"},{"name":"X"}],"recruit_type":{"name":"校招"},"job_category":{"name":"[brand]"}}]}}'
    return feeds.read_job_list(_bodies(spark, sf_dir, body)).select("source_id", "title", "recruit_project", "raw_category", "work_location", "jd_text")


@query(f"WITH p AS ({_P}) SELECT CAST(k AS VARCHAR) AS source_id, name AS title, 'campus' AS channel, brand AS work_location, '2026-01-02' AS open_at, '2026-03-04' AS list_updated_at FROM p")
def sealed_pages(spark, sf_dir):
    """Pages of an encrypted envelope, opened and read."""
    body = '{"offset":0,"total":1,"jobs":[{"id":"[k]","title":"[name]","hireMode":2,"publishedAt":"2026-01-02T3","updatedAt":"2026-03-04T5","locations":[{"cityName":"[brand]"}]}]}'
    key, iv = F.lit("0123456789abcdef"), F.lit("abcdef0123456789")
    sealed = _bodies(spark, sf_dir, body).select(F.aes_encrypt(c("body").cast("binary"), key.cast("binary"), F.lit("CBC"), F.lit("PKCS"), iv.cast("binary")).alias("x"))
    opened = sealed.select(feeds.decrypt_envelope(F.base64(F.substring("x", 17, 1 << 20)), iv, key).alias("body"))
    return feeds.read_jobs_pages(opened).select("source_id", "title", "channel", "work_location", "open_at", "list_updated_at")


@query(f"WITH p AS ({_P}) SELECT k, cast(n AS INT) AS pos, CASE n WHEN 1 THEN name ELSE brand END AS title, 'http://a/' || k || '/' || n AS link FROM p, (SELECT unnest([1, 2]) AS n) WHERE NOT (k % 2 = 1 AND n = 2)")
def feed_items(spark, sf_dir):
    """RSS items, or Atom entries where a body has no item."""
    rss = "<rss><channel><item><title>[name]</title><link>http://a/[k]/1</link></item><item><title>[brand]</title><link>http://a/[k]/2</link></item><item><title></title><link>x</link></item></channel></rss>"
    atom = "<feed><entry><title>[name]</title><link href='http://a/[k]/1'/><updated>x</updated></entry></feed>"
    pages = _parts(spark, sf_dir).select("k", F.when(c("k") % 2 == 0, _said(rss)).otherwise(_said(atom)).alias("body"))
    return feeds.read_rss(pages).select("k", c("pos").cast("int").alias("pos"), "title", "link")


@query(f"WITH p AS ({_P}) SELECT k AS page_id, CAST(k AS VARCHAR) AS source_id, CASE WHEN k % 2 = 0 THEN name ELSE brand END AS title FROM p")
def embedded_postings(spark, sf_dir):
    """Postings in init-data, else in the first array behind "jobs"."""
    own = '<input id="init-data" value="{&quot;jobs&quot;:[{&quot;id&quot;:&quot;[k]&quot;,&quot;title&quot;:&quot;[name]&quot;}]}">'
    loose = '<script>a = {"jobs":[{"title":"no [id]"}]}; b = {"jobs":[{"id":"[k]","title":"[brand]","x":["]"]}]}</script>'
    pages = _parts(spark, sf_dir).select(c("k").alias("page_id"), F.when(c("k") % 2 == 0, _said(own)).otherwise(_said(loose)).alias("html"))
    return feeds.embedded_jobs(pages).select("page_id", "source_id", "title")


@query(f"WITH p AS ({_P}) SELECT k, 2 AS n, '{{\"c\":' || k || '}}' AS last FROM p")
def embedded_states(spark, sf_dir):
    """JSON that pages assign to well-known names."""
    page = '<script>window.__INITIAL_STATE__ = {"a":{"b":[size]}};</script><script id="__NEXT_DATA__">{"c":[k]}</script><script>__PRELOADED_STATE__ = {bad;</script>'
    rows = _parts(spark, sf_dir).select("k", feeds.embedded_json(_said(page)).alias("j"))
    return rows.select("k", F.size("j").alias("n"), F.element_at("j", -1).alias("last"))


@query(f"WITH p AS ({_P}) SELECT CAST(k AS VARCHAR) AS source_id, name AS title, CASE WHEN k % 2 = 0 THEN 'X' ELSE 'Y' END AS work_location, '岗位职责' || chr(10) || brand AS jd_text FROM p")
def detail_bodies(spark, sf_dir):
    """A posting's detail, of the first host that has it."""
    body = '{"state":"200","data":{"postId":"[k]","postName":"[name]","workPlace":"[where]","duty":"[brand]","recruitType":1}}'
    first = _bodies(spark, sf_dir, body.replace("[where]", "X")).where("k % 2 = 0").withColumn("host_rank", F.lit(1))
    failed = _bodies(spark, sf_dir, '{"state":"500"}').where("k % 2 = 1").withColumn("host_rank", F.lit(1))
    second = _bodies(spark, sf_dir, body.replace("[where]", "Y")).withColumn("host_rank", F.lit(2))
    return feeds.read_detail(first.union(failed).union(second)).select("source_id", "title", "work_location", "jd_text")


@query(f"WITH p AS ({_P}) SELECT k, 'http://f/' || k || '.xml' AS plain, 'http://f?n=' || k || '&x' AS filled FROM p")
def feed_addresses(spark, sf_dir):
    """Feed addresses of a base or of a template."""
    name = c("k").cast("string")
    return _parts(spark, sf_dir).select("k", feeds.feed_url(F.lit("http://f/"), name).alias("plain"), feeds.feed_url(F.lit("http://f?n={name}&x"), name).alias("filled"))


def _spread(spark, rows: DataFrame) -> DataFrame:
    """Small rows dealt evenly to tasks before pages are made of them: a file's row group is one task."""
    return rows.repartition(max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions"))), "k")


def _pages_of(spark, sf_dir, template: str) -> DataFrame:
    return _spread(spark, _parts(spark, sf_dir)).select(c("k").alias("page_id"), F.concat(F.lit("https://x.cn/l?page="), c("size").cast("string")).alias("url"), _said(template).alias("html"))


@query(f"WITH p AS ({_P}) SELECT k AS page_id, '工程师 ' || name AS title, brand AS location, CAST(size AS VARCHAR) AS headcount FROM p")
def table_rows(spark, sf_dir):
    """Rows of job tables, headers in the second row, exact before fuzzy."""
    page = "<table><tr><td>notice</td></tr><tr><th>招聘岗位名称</th><th>工作地点</th><th>人数</th></tr><tr><td>工程师 [name]</td><td>[brand]</td><td>[size]</td></tr><tr><td></td><td>x</td></tr></table>"
    return H.job_tables(_pages_of(spark, sf_dir, page)).select("page_id", "title", "location", "headcount")


@query(f"WITH p AS ({_P}) SELECT k AS page_id, n - 1 AS pos, '工程师 ' || CASE n WHEN 1 THEN name ELSE brand END AS title, '/' || k || '/' || n AS apply_url, CASE n WHEN 1 THEN brand END AS location FROM p, (SELECT unnest([1, 2]) AS n)")
def card_rows(spark, sf_dir):
    """Cards of the first kind that a page has two of."""
    one = '<li class="x"><a href="/[k]/1"><b class="job-name">工程师 [name]</b></a><i class="work-city">[brand]</i></li>'
    two = '<li><a href="/[k]/2"><b class="job-name">工程师 [brand]</b></a></li>'
    return H.cards(_pages_of(spark, sf_dir, f'<div class="card"></div><ul class="job-list">{one}{two}</ul>')).select("page_id", "pos", "title", "apply_url", "location")


@query(f"WITH p AS ({_P}) SELECT k AS page_id, 'https://x.cn/l?page=' || (size + 1) AS next_url FROM p WHERE k % 3 <> 2")
def next_page_links(spark, sf_dir):
    """The pager's next link, or the page number stepped on; none if disabled."""
    pager = F.when(c("k") % 3 == 0, F.concat(F.lit('<a class="btn-next" href="?page='), (c("size") + 1).cast("string"), F.lit('#x">下一页</a>'))).when(c("k") % 3 == 1, F.lit('<a href="?page=1">1</a><a href="?page=900">900</a>')).otherwise(F.lit('<a class="disabled" href="?page=9">下一页</a>'))
    pages = _parts(spark, sf_dir).select(c("k").alias("page_id"), F.concat(F.lit("https://x.cn/l?page="), c("size").cast("string")).alias("url"), pager.alias("html"))
    return H.next_pages(pages)


@query(f"WITH p AS ({_P}) SELECT k AS page_id, 'campus' AS channel, 'https://x.cn/campus/' || k AS entry, false AS active FROM p UNION ALL SELECT k, 'intern', 'https://x.cn/i/' || size, true FROM p")
def channel_entries(spark, sf_dir):
    """Channel links of the navigation, and the highlighted one."""
    page = '<nav><a href="/x">校园招聘</a><a href="/campus/[k]">校园招聘</a><span class="current"><a href="i/[size]">实习生招聘</a></span></nav>'
    return H.nav_links(_spread(spark, _parts(spark, sf_dir)).select(c("k").alias("page_id"), F.lit("https://x.cn/").alias("url"), _said(page).alias("html")))


@query(f"WITH p AS ({_P}) SELECT k AS page_id, '晨光 ' || name AS text, 'https://r/' || k AS link FROM p")
def result_blocks(spark, sf_dir):
    """Blocks of a search page."""
    page = '<div class="vrwrap"><h3><a href="https://r/[k]">晨光</a></h3> <p>[name]</p></div><div class="vrwrap"> </div>'
    return H.search_results(_pages_of(spark, sf_dir, page)).select("page_id", "text", "link")


_C = "SELECT c_custkey AS k, c_nationkey AS n FROM customer"


@query(f"WITH c AS ({_C}) SELECT 'c' || k AS name_norm, CASE WHEN k % 3 = 0 THEN 'new' ELSE 'old' END AS name, CASE WHEN k % 2 = 0 THEN (CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END) ELSE 0 END + CASE WHEN k % 3 = 0 AND k % 2 <> 0 THEN 1 ELSE 0 END AS n_urls, CASE WHEN k % 5 = 0 THEN 'official' ELSE 'unverified' END AS verify_status FROM c")
def merged_companies(spark, sf_dir):
    """Companies by name; blanks keep, lists unite, official stays."""
    k = c("c_custkey")
    empty = F.expr("cast(array() as array<string>)")
    base = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), k.cast("string")).alias("name_norm"), k.alias("k"), F.lit(None).cast("string").alias("company_nature"), F.lit("").alias("industry"), empty.alias("career_urls"))
    old = base.withColumns({"name": F.lit("old"), "hint_apply_urls": F.when(c("k") % 2 == 0, F.array(F.lit("a"))).otherwise(empty), "verify_status": F.when(c("k") % 5 == 0, "official").otherwise("unverified")})
    new = base.where("k % 3 = 0").withColumns({"name": F.lit("new"), "hint_apply_urls": F.array(F.lit("b")), "verify_status": F.lit("unverified")})
    return mutate.merge_company(old, new).select("name_norm", "name", F.size("hint_apply_urls").alias("n_urls"), "verify_status")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'deleted' ELSE o_orderstatus END AS status FROM orders")
def deleted_postings(spark, sf_dir):
    """Postings marked as deleted."""
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), c("o_orderstatus").alias("status"))
    return mutate.soft_delete(o, o.where("id % 3 = 0").select("id")).select("id", "status")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 1 THEN 'deleted' ELSE 'active' END AS status FROM orders")
def expired_postings(spark, sf_dir):
    """Retention by the newest date that can be read."""
    k = c("o_orderkey") % 4
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), F.when(k == 1, "2025-07-31").when(k == 2, "2025/8/1").alias("open_at"), F.when(k == 3, "2026-01-01T00:00:00").alias("updated_at"), F.lit("2020-01-01").alias("created_old"), F.lit("active").alias("status"))
    return mutate.expire(o.withColumn("created_at", F.when(c("id") % 4 == 3, c("created_old"))), AS_OF).select("id", "status")


@query("SELECT k, status, count(*) AS n FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'pending' ELSE 'done' END AS status FROM supplier UNION ALL SELECT s_suppkey, 'pending' FROM supplier WHERE s_suppkey % 2 <> 0) GROUP BY ALL")
def queued_once(spark, sf_dir):
    """Entries that have no pending one of the same keys."""
    s = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("k"))
    queue = s.withColumn("status", F.when(c("k") % 2 == 0, "pending").otherwise("done"))
    again = s.union(s).withColumn("status", F.lit("pending"))
    return vote.counts_by(mutate.enqueue_once(queue, again, ["k"]).withColumn("b", F.struct("k", "status")), "b").select("b.k", "b.status", "n")


@query("SELECT p_partkey AS id, p_partkey * 7 % 1000 AS pos FROM part WHERE p_partkey % 3 = 0 ORDER BY pos, id")
def wanted_rows(spark, sf_dir):
    """rows of wanted ids, in wanted order."""
    p = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"))
    return Q.by_ids(p, p.where("id % 3 = 0").withColumn("pos", c("id") * 7 % 1000)).select("id", "pos")


@query("SELECT CAST(p_size AS VARCHAR) AS path, p_type AS sheet, count(*) AS n_rows FROM part GROUP BY ROLLUP (path, sheet)")
def import_totals(spark, sf_dir):
    """Counts by file and sheet, with totals."""
    return vote.import_counts(table(spark, sf_dir, "part").select(c("p_size").cast("string").alias("path"), c("p_type").alias("sheet")))


@query("SELECT user_id AS k, status FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id) WHERE status <> 'error' UNION ALL SELECT DISTINCT -1 - user_id, 'old' FROM events")
def pulled_rows(spark, sf_dir):
    """A table after the pulled changes; tombstones take rows away."""
    e = table(spark, sf_dir, "events").select(c("user_id").alias("k"), c("event_type").alias("status"), "ts", "event_id")
    old = e.select("k").distinct().union(e.select((-1 - c("k")).alias("k")).distinct()).withColumn("status", F.lit("old"))
    return changes.apply_changes(old, e, "k", "ts", "event_id", c("status") == "error")


@query("SELECT o_orderkey AS id, CASE WHEN st = 'running' AND a >= 3 THEN 'error' WHEN st = 'running' THEN 'pending' ELSE st END AS status FROM (SELECT o_orderkey, o_orderkey % 5 AS a, CASE WHEN o_orderstatus = 'O' THEN 'running' ELSE 'done' END AS st FROM orders)")
def resumed_queue(spark, sf_dir):
    """What was running is pending again, until its attempts are used up."""
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), F.when(c("o_orderstatus") == "O", "running").otherwise("done").alias("status"), (c("o_orderkey") % 5).alias("attempts"))
    return changes.run_queue(o).select("id", "status")


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'a|b|c' WHEN 1 THEN 'a|b' ELSE 'c' END AS urls FROM part")
def united_lists(spark, sf_dir):
    """Lists united in order, blanks dropped."""
    k, none = c("p_partkey") % 3, F.lit(None).cast("array<string>")
    old = F.when(k < 2, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(none)
    new = F.when(k != 1, F.array(F.lit("c"), F.lit(" "))).otherwise(none)
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), F.array_join(dedupe.merge_lists(old, new), "|").alias("urls"))


_MORE_ROWS, _MORE_SQL = cases(
    {
        "nature": ["国企", " 民营企业 ", "大型外资企业", "某某有限责任公司是一家央企控股", "事业单位\n", None], "seed": ["远山集团有限公司", "晨光", "晨光", "", "海川 - 实习", None], "page": ["海川电子", "晨光有限公司", None, "乙", "海川", None],
        "urls": ['["https://a", "x", "https://b"]', "https://c", "x", "[]", None, '["ftp://d"]'], "batch": ["2025届", "2027届", "2025届", None, "x", "2026届"], "title": ["开发", "开发", "实习生", "a", "b", "c"],
        "list": ["https://a.com/l?x=1#t", "https://a.com/l", "", "https://a.com/l?__job=o", None, "https://a.com"], "text": ["导航\nTeams\n正文", "招贤纳才", "a\n\n\n\nb", None, "  x  ", "Search Jobs"],
    },
    {
        "nature": ["国企", "民企", "外企", None, "事业单位", None], "group_name": ["远山集团", "", "", "", "", ""], "company": ["海川电子", "晨光有限公司", "晨光", "乙", "海川", "未知企业"], "same": [False, True, False, False, True, False],
        "n_urls": [2, 1, 0, 0, 0, 0], "stale": [True, False, False, False, False, True], "stand_in": ["https://a.com/l?x=1&__job=t", "https://a.com/l?__job=t", "?__job=t", "https://a.com/l?__job=t", "?__job=t", "https://a.com?__job=t"],
        "kept": ["导航\n正文", None, "a\n\nb", None, "x", None],
    },
)


@query(_MORE_SQL)
def further_scalars(spark, sf_dir):
    """Natures, batches, groups, stand-ins, lists, texts."""
    rows = _MORE_ROWS(spark, sf_dir).withColumn("g", T.group_and_company(c("seed"), c("page")))
    return rows.select(
        "id", T.clean_nature(c("nature")).alias("nature"), c("g.group_name").alias("group_name"), c("g.company").alias("company"), T.same_company(c("seed"), c("page")).alias("same"), F.size(U.parse_urls(c("urls"))).cast("long").alias("n_urls"),
        C.is_stale_batch(c("batch"), F.lit("校招"), c("title"), AS_OF).alias("stale"), U.synthetic_url(T.or_empty(c("list")), F.lit("t")).alias("stand_in"), T.strip_navigation(c("text")).alias("kept"),
    )


_SCORE_ROWS, _SCORE_SQL = cases(
    {
        "title": ["算法工程师", "算法工程师", "首页", "海川电子集团有限公司 开发", "晨光生物科技 校园招聘", "产品经理", None, "管培生"],
        "jd_text": ["岗位职责：" + "写代码。" * 30, "短", None, None, "长" * 90, "本职位仅限内部 " + "长" * 90, None, "正文" * 30],
        "source_url": ["https://a.com/job/1", "https://a.com/x", "https://a.com", "https://a.com", "https://a.com", "https://a.com/job/2", "x", "https://a.com/login"],
    },
    {"ok": [True, False, False, False, False, False, False, False], "points": [100, 45, 5, 12, 25, 5, 5, 8]},
)


@query(_SCORE_SQL)
def posting_points(spark, sf_dir):
    """A posting's score in hundredths, and whether it passes."""
    rows = _SCORE_ROWS(spark, sf_dir).withColumn("company", F.lit("晨光生物科技股份有限公司")).withColumn("s", C.posting_score())
    return rows.select("id", c("s.ok").alias("ok"), F.round(c("s.score") * 100).cast("long").alias("points"))


@query("SELECT doc_id AS id, DATE '2022-09-28' + cast(doc_id % 300 AS INT) AS day FROM documents")
def tick_dates(spark, sf_dir):
    """Dates of .NET ticks."""
    ticks = F.lit(638000000000000000) + (c("doc_id") % 300) * 864000000000
    return table(spark, sf_dir, "documents").select(c("doc_id").alias("id"), D.ticks_date(ticks).alias("day"))


def _books(spark, sf_dir) -> DataFrame:
    """Workbooks (path, content) of the parts, made in the tasks: a book a brand, with a sheet
    of companies, which is longer than a batch of the reader, and a sheet of notes. A brand's
    rows come sorted and go into its archive as they come, so that no task holds them."""
    import io
    import itertools
    import zipfile

    import pyarrow as pa

    def line(*texts) -> "F.Column":
        return F.concat(F.lit("<row>"), *[F.concat(F.lit('<c t="inlineStr"><is><t>'), F.coalesce(x.cast("string"), F.lit("")), F.lit("</t></is></c>")) for x in texts], F.lit("</row>"))

    def packed(batches):
        said = lambda *xs: "<row>" + "".join(f'<c t="inlineStr"><is><t>{x}</t></is></c>' for x in xs) + "</row>"
        lines = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for path, rows in itertools.groupby(lines, key=lambda row: row[0]):
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("xl/workbook.xml", '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s1" r:id="a"/><sheet name="表格说明" r:id="b"/></sheets></workbook>')
                z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/1.xml"/><Relationship Id="b" Target="/xl/worksheets/2.xml"/></Relationships>')
                z.writestr("xl/worksheets/2.xml", f"<worksheet><sheetData>{said('公司名称')}{said('不是公司')}</sheetData></worksheet>")
                with z.open("xl/worksheets/1.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f"<worksheet><sheetData>{said('名单')}{said('公司名称', '企业性质', '网申地址')}".encode())
                    for some in itertools.batched((row[1] for row in rows), 500):
                        sheet.write("".join(some).encode())
                    sheet.write(b"</sheetData></worksheet>")
            yield pa.RecordBatch.from_pydict({"path": [path], "content": [out.getvalue()]}, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    parts = table(spark, sf_dir, "part").select(c("p_brand").alias("path"), c("p_partkey").alias("k"), c("p_size").alias("size"))
    tasks = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = parts.repartition(tasks, "path").sortWithinPartitions("path", "k", "size")
    said = dealt.select("path", line(F.concat(F.lit("公司"), c("k").cast("string")), F.when(c("size") % 2 == 0, "国企").otherwise("民企"), F.concat(F.lit("https://a.com/campus/"), c("size").cast("string"))).alias("line"))
    return said.mapInArrow(packed, "path string, content binary")


@query("""WITH p AS (SELECT p_brand AS path, '公司' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN '国企' ELSE '民企' END AS nature, 'https://a.com/campus/' || p_size AS url, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS row_no FROM part)
  SELECT path, 's1' AS sheet, row_no, name || '|' || nature || '|' || url AS cells FROM p
  UNION ALL SELECT DISTINCT path, 's1', 0, '名单' FROM p UNION ALL SELECT DISTINCT path, 's1', 1, '公司名称|企业性质|网申地址' FROM p
  UNION ALL SELECT DISTINCT path, '表格说明', 0, '公司名称' FROM p UNION ALL SELECT DISTINCT path, '表格说明', 1, '不是公司' FROM p""")
def workbook_rows(spark, sf_dir):
    """All rows of all sheets of workbooks, sheet by sheet and in batches."""
    rows = xlsx.book_rows(_books(spark, sf_dir), batch=3)
    return rows.select("path", "sheet", "row_no", F.array_join("cells", "|").alias("cells"))


@query("SELECT p_brand AS path, '公司' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN '国企' ELSE '民企' END AS nature, 'https://a.com/campus/' || p_size AS url, 'unverified' AS status FROM part")
def workbook_companies(spark, sf_dir):
    """Companies of the sheets with a header, without sheets of notes."""
    made = xlsx.seed_companies(xlsx.book_rows(_books(spark, sf_dir)))
    return made.select("path", "name", c("company_nature").alias("nature"), F.array_join("hint_apply_urls", "|").alias("url"), c("verify_status").alias("status"))
