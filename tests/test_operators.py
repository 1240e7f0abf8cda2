"""Sources, sinks, streaming and mutations on small made-up rows."""

import datetime
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.functions import vocab as V
from millrace.operators import dedupe, mutate
from millrace.operators import query as Q
from millrace.sources import feeds, html, sinks, xlsx
from millrace.streaming import changes

PAGE = """<html><head><title>Jobs</title><script>var a='<a href="/no">no</a>'</script></head><body>
<table><tr><th>职位名称</th><th>工作地点</th><th>招聘人数</th></tr><tr><td>算法工程师</td><td>杭州</td><td>若干</td></tr><tr><td></td><td>x</td></tr></table>
<div class="job-card"><a href="j/1"><span class="job-name">A &amp; B</span></a><span class="loc">上海</span></div>
<div class="job-card"><a href="/j/2"><span class="job-name">C++开发</span></a></div>
<a href="?p=2" class="next">下一页</a><p>unclosed"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, "https://x.cn/a/list", PAGE), (2, "https://x.cn/b", None), (3, None, "")], "page_id bigint, url string, html string")
    assert [(r["title"], r["location"], r["headcount"]) for r in html.job_tables(pages).collect()] == [("算法工程师", "杭州", "若干")]
    assert [(r["title"], r["location"], r["apply_url"]) for r in html.cards(pages).orderBy("pos").collect()] == [("A & B", "上海", "j/1"), ("C++开发", None, "/j/2")]
    assert [r["next_url"] for r in html.next_pages(pages).collect()] == ["https://x.cn/a/list?p=2"]
    links = html.links(pages).select(html.absolute(F.col("href"), F.col("url")).alias("u")).collect()
    assert [r["u"] for r in links] == ["https://x.cn/a/j/1", "https://x.cn/j/2", "https://x.cn/a/list?p=2"]
    fields = {r["page_id"]: r["p"] for r in pages.select("page_id", html.page_fields("html").alias("p")).collect()}
    assert fields[1]["title"] == "Jobs" and "no" not in fields[1]["text"].split() and fields[2]["title"] is None


def test_pagers_cards_and_navigation(spark):
    numbered = '<div class="pager"><a href="?page=1">1</a><a href="?page=2">2</a><a href="?page=9">9</a></div>'
    rows = [
        (1, "https://x.cn/l?page=1", numbered),
        (2, "https://x.cn/l?page=5", numbered),
        (3, "https://x.cn/l", '<ul><li class="ant-pagination-disabled"><a href="?page=2" title="next page">2</a></li></ul>'),
        (4, "https://x.cn/l", '<a href="/l">下一页</a><a rel="next" href="/l?p=2#x">more</a>'),
        (5, "https://x.cn/l", "<p>none</p>"),
        (6, "https://x.cn/", '<nav><a href="/other">校园招聘</a><a href="/campus/jobs">校园招聘</a><a class="active" href="/interns.html">实习生招聘</a><a href="#">社会招聘</a></nav>'),
        (7, "https://x.cn/", '<div class="job-list"><div>工作地点：杭州 <a href="/1"><b class="job-name">甲工程师</b></a> 更新日期：2026-07-01</div><div><a href="/2"><b class="job-name">乙开发</b></a> 招聘人数：5人</div></div><div class="card"></div>'),
        (8, "https://x.cn/", '<div class="vrwrap"><a href="https://a">晨光</a> 国有企业</div><div class="vrwrap"></div>'),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r["page_id"]: r["next_url"] for r in html.next_pages(pages.where("page_id < 6")).collect()} == {1: "https://x.cn/l?page=2", 2: "https://x.cn/l?page=6", 4: "https://x.cn/l?p=2"}
    assert {r["channel"]: (r["entry"], r["active"]) for r in html.nav_links(pages.where("page_id = 6")).collect()} == {"campus": ("https://x.cn/campus/jobs", False), "intern": ("https://x.cn/interns.html", True), "social": (None, False)}
    cards = html.cards(pages.where("page_id = 7")).orderBy("pos").collect()
    assert [(r["title"], r["apply_url"], r["location"], r["updated"], r["headcount"]) for r in cards] == [("甲工程师", "/1", "杭州 甲工程师 更新日期：2026-07-01", "2026-07-01", None), ("乙开发", "/2", None, None, "5人")]
    assert [(r["text"], r["link"]) for r in html.search_results(pages).collect()] == [("晨光 国有企业", "https://a")]


def test_embedded_and_detail_bodies(spark):
    init = '<input id="init-data" value="{&quot;jobs&quot;:[{&quot;id&quot;:&quot;1&quot;,&quot;title&quot;:&quot;A [x&quot;}]}">'
    loose = '<script>x = {"jobs":[{"title":"no id"}]}; y = {"jobs" : [{"id":"2","title":"B ] \\" c"},{"id":"3"}]}</script>'
    pages = spark.createDataFrame([(1, init), (2, loose), (3, None), (4, '"jobs":[')], "page_id bigint, html string")
    assert [(r["page_id"], r["source_id"], r["title"]) for r in feeds.embedded_jobs(pages).orderBy("page_id").collect()] == [(1, "1", "A [x"), (2, "2", 'B ] " c')]
    body = '{"state":"200","data":{"postId":"p","postName":"t","duty":"d","serviceCondition":"任职要求：r","recruitType":12,"workPlace":"X","publishDate":"2026-01-02 03:04"}}'
    rows = feeds.read_detail(spark.createDataFrame([(2, body.replace('"t"', '"u"')), (1, body), (0, "junk"), (3, None)], "host_rank int, body string")).collect()
    assert [(r["title"], r["channel"], r["work_location"], r["open_at"], r["jd_text"]) for r in rows] == [("t", "intern", "X", "2026-01-02", "岗位职责\nd\n\n任职要求：r")]
    assert feeds.page_requests(120, 100) == [(0, 50), (50, 50), (100, 20)] and feeds.page_requests(0, 9) == []


def test_feeds(spark):
    body = '﻿{"Code":200,"Count":10,"Data":[{"Id":"a","JobAdName":" t ","CategoryId":"2","LocNames":[],"Duty":"d","Require":null,"PostDate":"0001-01-01T00:00:00","HeadCount":0},{"Id":"a","JobAdName":"t"},{"Id":"b","JobAdName":"u","CategoryId":"1","LocNames":["X","X","Y"],"PostDate":"2026-07-02T1","HeadCount":3}]}'
    pages = spark.createDataFrame([(body,), ('{"Code":500}',), ("junk",), (None,)], "body string")
    rows = {r["source_id"]: r for r in feeds.read_paged_list(pages).collect()}
    assert set(rows) == {"a", "b"}
    assert (rows["b"]["channel"], rows["b"]["work_location"], rows["b"]["open_at"], rows["b"]["headcount"]) == ("social", "X / Y", "2026-07-02", "3")
    rss = "<rss><channel><item><title>t1</title><link>http://a</link></item><item><title></title><link>x</link></item></channel></rss>"
    got = feeds.read_rss(spark.createDataFrame([(1, rss), (2, "<feed><entry><title>e</title><link href='http://b'/></entry></feed>")], "id int, body string")).collect()
    assert sorted((r["id"], r["title"], r["link"]) for r in got) == [(1, "t1", "http://a"), (2, "e", "http://b")]


def test_envelope(spark):
    sealed = spark.range(1).select(F.aes_encrypt(F.lit("hello").cast("binary"), F.lit("0123456789abcdef").cast("binary"), F.lit("CBC"), F.lit("PKCS"), F.lit("abcdef0123456789").cast("binary")).alias("x"))
    data = sealed.select(F.base64(F.substring("x", 17, 1000)).alias("d"))
    opened = lambda key: data.select(feeds.decrypt_envelope(F.col("d"), F.lit("abcdef0123456789"), F.lit(key)).alias("o")).first()["o"]
    assert opened("0123456789abcdef") == "hello"
    assert opened("ffffffffffffffff") != "hello"


def test_workbook(spark, tmp_path):
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'
    row = lambda n, *cells: f'<row r="{n}">{"".join(cells)}</row>'
    sheet = "<worksheet><sheetData>" + row(1, cell("A1", "说明")) + row(2, cell("A2", "公司名称（全称）"), cell("C2", "网申/投递 地址")) + row(3, cell("A3", "晨光"), cell("C3", "https://a.mokahr.com/x")) + row(4, cell("C4", "x")) + "</sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="企业" r:id="r1"/><sheet name="模板" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "a.xlsx").write_bytes(out.getvalue())
    (tmp_path / "b.xlsx").write_bytes(b"no archive")
    cells = xlsx.read_workbooks(spark, str(tmp_path))
    assert cells.where("error is null").count() == 8
    report = {r["path"][-6:]: (r["n_read"], r["n_new"], r["error"] is None) for r in xlsx.import_report(cells, xlsx.seed_companies(cells), spark.createDataFrame([("x",)], "name_norm string")).collect()}
    assert report == {"a.xlsx": (1, 1, True), "b.xlsx": (0, 0, False)}
    assert xlsx._shared(["a"], "0") == "a" and xlsx._shared(["a"], "7") == "" == xlsx._shared(["a"], "")
    rows = xlsx.seed_companies(cells).collect()
    assert [(r["name"], list(r["hint_apply_urls"]), r["verify_status"]) for r in rows] == [("晨光", ["https://a.mokahr.com/x"], "official")]


def test_sinks(spark, tmp_path):
    jobs = spark.createDataFrame([("a", None), ('q"x', "t,u")], "company string, title string")
    sinks.export_csv(jobs, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part*")))
    assert text.startswith("﻿公司,岗位") and '"q""x","t,u"' in text
    sinks.snapshot(jobs, str(tmp_path / "s"), "v1")
    assert sinks.restore(spark, str(tmp_path / "s"), "v1").count() == 2
    sinks.snapshot(jobs.union(jobs), str(tmp_path / "s"), "v1")  # written again
    sinks.snapshot(jobs, str(tmp_path / "s"), "v2")
    assert sinks.restore(spark, str(tmp_path / "s"), "v1").count() == 4
    assert [r["version"] for r in sinks.versions(spark, str(tmp_path / "s")).collect()] == ["v2", "v1"]


def test_change_stream(spark, tmp_path):
    feed = spark.createDataFrame([(1, "k", 1, "a"), (2, "k", 2, "b"), (3, "l", 1, "deleted"), (4, "m", 1, "a")], "n int, key string, ts int, status string")
    feed.repartition(2).write.parquet(str(tmp_path / "feed"))
    table = spark.createDataFrame([("l", 0, "a"), ("z", 0, "a")], "key string, ts int, status string")
    want = {("k", "b"), ("m", "a"), ("z", "a")}
    out = changes.apply_changes(table, feed.select("key", "ts", "status", "n"), "key", "ts", "n", F.col("status") == "deleted")
    assert {(r["key"], r["status"]) for r in out.collect()} == want
    seen = []
    stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "feed"))
    follow = lambda: changes.follow(stream, str(tmp_path / "cp"), lambda df, _: seen.extend(r["n"] for r in df.collect())).awaitTermination()
    follow()
    follow()  # replay from the checkpoint brings nothing twice
    assert sorted(seen) == [1, 2, 3, 4]


def test_streaming_windows_equal_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    q = changes.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("locks").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("locks").collect())) == sorted(map(tuple, changes.windowed_counts(events).collect()))


def test_login_stream_equals_batch(spark, tmp_path):
    from millrace.operators import collect

    minute = lambda m: datetime.datetime(2026, 8, 1) + datetime.timedelta(minutes=m)
    rows = [(7, minute(2 * i), i, i in (2, 30)) for i in range(32)] + [(8, minute(20 * i), 100 + i, False) for i in range(8)]
    attempts = spark.createDataFrame(rows, "account bigint, ts timestamp, id bigint, ok boolean")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for n, part in enumerate((attempts.where("ts < '2026-08-01 00:30:00'"), attempts.where("ts >= '2026-08-01 00:30:00'"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
        stream = spark.readStream.schema(attempts.schema).parquet(str(tmp_path / "in" / "*"))
        out = changes.follow_logins(stream, late="5 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        out.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r["id"], r["result"]) for r in spark.read.parquet(str(tmp_path / "out")).where("result in ('failed', 'locked', 'session')").collect()}
    want = {(r["id"], r["result"]) for r in collect.login_locks(attempts).collect()}
    assert got == want and {r for _, r in want} == {"failed", "locked", "session"}



def test_collected_rows_in_chunks(spark, tmp_path):
    from millrace.operators import collect

    out = str(tmp_path)

    def send(chunk):  # an upsert by id: repeating it changes nothing
        import os

        assert len(chunk) <= 3
        for row in chunk:
            with open(os.path.join(out, str(row["id"])), "w") as f:
                f.write(row["title"])

    collect.push_chunks(spark.range(20).selectExpr("id", "concat('t', id) as title"), send, 3)
    assert sorted(int(p.name) for p in tmp_path.iterdir()) == list(range(20))


def test_unused_corners(spark, sf_dir):
    """Functions that no query calls: company merge, expiry, lookups, feeds and URLs."""
    from millrace.functions import classify as C

    as_of = datetime.date(2026, 8, 1)
    kind = "name_norm string, name string, company_nature string, industry string, hint_apply_urls array<string>, career_urls array<string>, verify_status string"
    old = spark.createDataFrame([("a", "A", "国企", None, ["u"], None, "official"), ("b", "B", "", "x", [], [], "unverified")], kind)
    new = spark.createDataFrame([("a", "", "民企", "y", ["v", "u"], ["c"], "unverified"), ("c", "C", None, None, None, None, "unverified")], kind)
    merged = {r["name_norm"]: tuple(r)[1:] for r in mutate.merge_company(old, new).collect()}
    assert merged == {"a": ("A", "民企", "y", ["u", "v"], ["c"], "official"), "b": ("B", "", "x", [], [], "unverified"), "c": ("C", None, None, [], [], "unverified")}
    jobs = spark.createDataFrame([(1, "2025-01-01", None, None, "active"), (2, None, "2026-07-01", None, "active"), (3, None, None, None, "active")], "id int, open_at string, updated_at string, created_at string, status string")
    assert {r["id"]: r["status"] for r in mutate.expire(jobs, as_of).collect()} == {1: "deleted", 2: "active", 3: "active"}
    assert [r["id"] for r in Q.by_ids(jobs, spark.createDataFrame([(3, 0), (1, 1)], "id int, pos int")).collect()] == [3, 1]
    keys = spark.createDataFrame([("u", "t"), ("u", "t")], "identity string, title_key string")
    assert Q.known_keys(keys, keys).count() == 1
    one = lambda x: spark.range(1).select(x.alias("x")).first()["x"]
    assert one(feeds.feed_url(F.lit("http://f/{name}.rss"), F.lit("a b"))) == "http://f/a+b.rss" and one(feeds.feed_url(F.lit("http://f/"), F.lit("a"))) == "http://f/a.xml"
    assert one(D.ticks_date(F.lit(638000000000000000))) == datetime.date(2022, 9, 28) and one(D.ticks_date(F.lit(5))) is None
    stand_in = one(U.synthetic_url(F.lit("https://a.com/l?x=1&__job=old#t"), F.lit("岗 a"), F.lit(None).cast("string"), F.lit("杭州" * 200)))
    assert stand_in.startswith("https://a.com/l?x=1&__job=%E5%B2%97+a+%7C+%E6%9D%AD") and stand_in.count("%E6%9D%AD") == 117
    assert one(U.parse_urls(F.lit('["https://a", "x", " https://b "]'))) == ["https://a", "https://b"] and one(U.parse_urls(F.lit("https://c"))) == ["https://c"] and one(U.parse_urls(F.lit("x"))) == []
    assert one(U.preferred(F.array(F.lit("https://a.com/login"), F.lit("https://a.mokahr.com/x"), F.lit("https://a.mokahr.com/x"), F.lit("")))) == ["https://a.mokahr.com/x", "https://a.com/login"]
    assert one(U.is_listing_url(F.lit("https://a.com/campus/"))) and not one(U.is_listing_url(F.lit("https://a.com/campus/?jobId=3")))
    assert one(T.is_noise_place(F.lit("团队"))) and one(C.project_of(F.lit("x"), F.lit("春招 秋招"))) == "秋招"
    assert one(C.is_stale_batch(F.lit("2025届"), F.lit("校招"), F.lit("x"), as_of)) and not one(C.is_stale_batch(F.lit("2025届"), F.lit("日常实习"), F.lit("x"), as_of))
    blob = '<script>window.__INITIAL_STATE__ = {"a":{"b":1}};</script><script id="__NEXT_DATA__" type="x">{"c":2}</script>'
    assert one(feeds.embedded_json(F.lit(blob))) == ['{"a":{"b":1}}', '{"c":2}']
    form = '{"state":"0","data":{"pageForm":{"pageData":[{"postId":"1","postName":" t ","recruitType":2,"endDate":"2030-01-01","publishDate":"2026-01-01x"},{"postId":"1"}]}}}'
    assert [(r["source_id"], r["channel"], r["deadline"], r["open_at"]) for r in feeds.read_page_form(spark.createDataFrame([(form,), ("x",)], "body string")).collect()] == [("1", "social", None, "2026-01-01")]
    listed = '{"data":{"job_post_list":[{"id":"1","title":"t","description":"d","city_list":[{"name":"X"},{"name":"X"}]}]}}'
    assert [(r["work_location"], r["jd_text"]) for r in feeds.read_job_list(spark.createDataFrame([(listed,)], "body string")).collect()] == [("X", "职位描述\nd")]
    paged = '{"jobs":[{"id":"1","title":"t","hireMode":2,"publishedAt":"2026-01-01T0","locations":[{"cityName":"X"}]},{"id":"1"}]}'
    assert [(r["channel"], r["recruit_bucket"], r["open_at"]) for r in feeds.read_jobs_pages(spark.createDataFrame([(paged,)], "body string")).collect()] == [("campus", "校招", "2026-01-01")]


def test_mutations(spark):
    old = spark.createDataFrame([(1, "a", "active"), (2, "b", "active")], "id int, name string, status string")
    new = spark.createDataFrame([(1, " a ", "pending_review"), (3, "c", "active")], "id int, name string, status string")
    assert {r["id"]: r["action"] for r in mutate.upsert(old, new, "id", ["name", "status"]).collect()} == {1: "unchanged", 2: "kept", 3: "inserted"}
    queue = spark.createDataFrame([("x", "pending"), ("y", "done")], "k string, status string")
    items = spark.createDataFrame([("x", "pending"), ("y", "pending"), ("y", "pending")], "k string, status string")
    assert sorted(map(tuple, mutate.enqueue_once(queue, items, ["k"]).collect())) == [("x", "pending"), ("y", "done"), ("y", "pending")]
    assert mutate.soft_delete(old, old.where("id = 1").select("id")).where("status = 'deleted'").count() == 1
    runs = spark.createDataFrame([("running", 3), ("running", 1), ("done", 1)], "status string, attempts int")
    assert sorted(r["status"] for r in changes.run_queue(runs).collect()) == ["done", "error", "pending"]


def test_replace_urls(spark):
    kind = "array<struct<key:string,url:string>>"
    df = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")], [("a", "9"), ("b", None), ("c", "7")])], f"u {kind}, r {kind}")
    assert [tuple(x) for x in df.select(dedupe.replace_urls(F.col("u"), F.col("r")).alias("x")).first()["x"]] == [("a", "9"), ("c", "7")]


def test_scalars(spark):
    df = spark.createDataFrame([("2026年8月1日",), ("2026-2-31",), ("2026/08",), ("x",), (None,)], "d string")
    assert [r[0] for r in df.select(D.loose_date(F.col("d"))).collect()] == [datetime.date(2026, 8, 1), datetime.date(2026, 2, 1), datetime.date(2026, 8, 1), None, None]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(U.identity_url(F.lit("HTTPS://A.cn/b/?jobId=3&utm_source=q#x"))) == "https://a.cn/b?jobId=3"
    assert one(T.company_core(F.lit("晨光集团有限公司 - 实习"))) == "晨光"
    assert one(T.group_and_company(F.lit("远山集团"), F.lit("海川电子")))["group_name"] == "远山集团"
    assert one(T.clean_nature(F.lit("民营企业"))) == "民企"


def test_best_match(spark):
    wanted = spark.createDataFrame([(1, "d1", "s1", "t"), (2, "", "s2", "t2")], "want_id int, detail_url string, source_url string, title string")
    offers = spark.createDataFrame([(10, 0, "x", "s1", "t"), (11, 1, "d1", "", ""), (12, 2, "", "zz", "t2")], "candidate_id int, pos int, detail_url string, source_url string, title string")
    assert {r["want_id"]: r["candidate_id"] for r in Q.best_match(wanted, offers).collect()} == {1: 11, 2: 12}


@pytest.mark.parametrize("longest", [1 << 20, 3])
def test_hits_of_one_pass(spark, longest):
    """Every word list is answered from a text's hits as by looking for its words in the text."""
    rng = random.Random(3)
    bits = [*V.BODY_WORDS, "岗位", "的", "a ", "é", "招聘", "校", "2026"]
    texts = [(None,), ("",)] + [("".join(rng.choices(bits, k=rng.choice([1, 2, 4, 30]))),) for _ in range(400)]
    lists = [V.CLOSED_WORDS, V.SOCIAL_WORDS, V.INTERN_PHRASES, V.INTERNSHIP_WORDS, V.OPEN_WORDS, V.CAMPUS_PROJECT_WORDS, V.LABELS_OF_KIND, ("届",), ("应届",)]
    found = spark.createDataFrame(texts, "t string").withColumn("h", T.hits(F.col("t"), longest=longest))
    for row in found.select("t", F.array(*[T.among(F.col("h"), words) for words in lists]).alias("says")).collect():
        assert row["says"] == [any(w in (row["t"] or "") for w in words) for words in lists]
