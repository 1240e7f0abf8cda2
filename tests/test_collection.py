"""Budgeted collection against a plain loop, and the cascade of a page's sources."""

import random
from collections import Counter
from datetime import date

from millrace.operators import collect


def collected_by_hand(posts, known, budget):
    out = {}
    for company in {p[0] for p in posts}:
        mine = sorted((p for p in posts if p[0] == company), key=lambda p: (p[1], p[2]))
        seen, spent, stopped = set(known), 0, False
        for page in sorted({p[1] for p in mine}):
            rows = [p for p in mine if p[1] == page]
            for row in rows:
                if stopped:
                    action = "unread"
                elif spent >= budget:
                    action = "left"
                elif row[3] in seen:
                    action = "known"
                elif row[4]:
                    action, spent = "new", spent + 1
                    seen.add(row[3])
                else:
                    action = "failed"
                out[row[:3]] = action
            stopped = stopped or any(r[5] for r in rows) or all(r[3] in known for r in rows)
    return out


def test_collect_pages_by_a_plain_loop(spark):
    rng = random.Random(4)
    posts, known = [], {f"k{i}" for i in range(0, 400, 3)}
    for company, pages in (("hot", 300), ("b", 7), ("c", 1), ("d", 12)):
        for page in range(pages):
            keys = [f"k{rng.choice(range(0, 399, 3))}"] * 3 if rng.random() < 0.01 else [f"k{rng.randrange(4000)}" for _ in range(rng.randint(1, 15))]
            posts += [(company, page, pos, k, rng.random() < 0.8, rng.random() < 0.0005) for pos, k in enumerate(keys)]
    df = spark.createDataFrame(posts, "company string, page bigint, pos bigint, identity string, ok boolean, outside boolean").repartition(6)
    keys = spark.createDataFrame([(k,) for k in known] * 2, "identity string")
    for budget in (1, 40, 100_000):
        got = collect.collect_pages(df, keys, budget)
        rows = {(r["company"], r["page"], r["pos"]): r["action"] for r in got.collect()}
        want = collected_by_hand(posts, known, budget)
        assert rows == want
        stats = {r["company"]: r for r in collect.page_run_stats(got).collect()}
        for company in ("hot", "b", "c", "d"):
            n = Counter(a for (co, *_), a in want.items() if co == company)
            r = stats[company]
            assert (r["batch_new"], r["skipped_known"], r["failed"], r["remaining"], r["unread"]) == (n["new"], n["known"], n["failed"], n["left"], n["unread"])
    assert collect.collect_pages(df.limit(0), keys, 5).count() == 0


def test_page_candidates_take_the_first_source_that_serves(spark):
    table = "<table><tr><th>职位名称</th><th>更新时间</th></tr>{}</table>"
    rows = lambda *titles: table.format("".join(f"<tr><td>{t}</td><td>{d}</td></tr>" for t, d in titles))
    embedded = '<script>x = {"jobs":[{"id":7,"title":"算法工程师"},{"mjCode":"8","title":"会计"},{"title":"no id"}]}</script>'
    pages = {
        1: "<title>测试工程师</title><h1>测试工程师</h1>" + rows(("产品经理", "2026-07-01"), ("会计", "2025-01-01")),
        2: "<title>首页</title>" + rows(("首页", ""), ("登录", "")) + '<a href="/job/detail?id=1">结构工程师</a><a href="/login">登录</a>',
        3: "<title>测试工程师</title><h1>测试工程师</h1>" + rows(("产品经理", "2026-07-01")),
        4: embedded + rows(("产品经理", "2026-07-01"), ("会计", "2026-07-01")),
        5: "<title>首页</title><p>Access Denied</p>",
        6: "", 7: None,
        8: "<title>职位已关闭</title><h1>x</h1>",
        9: '<script>{"jobs":[{"id":1,"title":"bad json}]}</script><title>首页</title>' + rows(("产品经理", "")),
    }
    df = spark.createDataFrame([(k, "https://a.com/x/list", h) for k, h in pages.items()], "page_id bigint, url string, html string")
    got = {}
    for r in collect.page_candidates(df, date(2026, 8, 1)).collect():
        got.setdefault(r["page_id"], []).append((r["source"], r["title"], r["outside"], tuple(r["notices"]), r["error"], r["link"]))
    assert sorted(got[1]) == [("table", "产品经理", False, ("1 outside the window",), None, None), ("table", "会计", True, ("1 outside the window",), None, None)] or sorted(x[1] for x in got[1]) == ["产品经理", "会计"]
    assert got[2] == [("links", "结构工程师", False, ("table: 2 unusable",), None, "https://a.com/job/detail?id=1")]
    assert [x[:2] for x in got[3]] == [("detail", "测试工程师")]
    assert sorted((x[0], x[1], x[5]) for x in got[4]) == [("embedded", "会计", "8"), ("embedded", "算法工程师", "7")]
    assert [x[4] for x in got[5]] == ["access barrier"] and [x[4] for k in (6, 7) for x in got[k]] == ["empty page"] * 2
    assert got[8][0][4] == "no posting" and got[8][0][3] == ("detail: 1 unusable",)
    assert [x[:2] for x in got[9]] == [("table", "产品经理")]
    assert collect.page_candidates(df.limit(0), date(2026, 8, 1)).count() == 0


def test_details_of_each_source(spark):
    text = "负责后端服务的开发与维护，参与系统设计与评审，编写测试与文档，持续改进线上质量与性能表现"
    og = '<meta property="og:title" content="{}">'
    pages = {
        1: ("https://a.mokahr.com/campus", '<input id="init-data" value="{&quot;jobs&quot;:[{&quot;id&quot;:&quot;1&quot;,&quot;title&quot;:&quot;甲岗&quot;},{&quot;id&quot;:&quot;2&quot;,&quot;title&quot;:&quot;乙岗&quot;}]}">'),
        2: ("https://a.mokahr.com/job/9", og.format("首页") + f"<p>岗位名称：测试工程师 {text}</p>"),
        3: ("https://a.zhiye.com/detail?jobAdId=1", og.format("首页") + f"<main>短</main><article>{text}<p>工作地点：西安</p></article>"),
        4: ("https://a.jobs.feishu.cn/position/1", og.format("登录") + f"<div class='job-description'>{text}</div>"),
        5: ("https://mp.weixin.qq.com/s/1", og.format("某公司2027届秋招启动") + "<div id='js_content'><p>日常实习</p><p>秋招</p></div>"),
        6: ("https://wecruit.hotjob.cn/SU1/pb/school.html", "<div id='app'></div>"),
        7: ("https://a.com/x", og.format("结构工程师") + f"<p>{text}{text}</p>"),
        8: ("https://a.zhiye.com/detail", ""), 9: ("https://a.mokahr.com/job/1", None), 10: (None, "<p>x</p>"),
    }
    df = spark.createDataFrame([(k, *v) for k, v in pages.items()], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in collect.detail_records(df).collect()}
    assert set(got) == set(pages)
    assert (got[1]["source"], got[1]["title"], got[1]["parse_status"], got[1]["confidence"]) == ("moka_list", None, "needs_browser", 0.15)
    assert got[2]["title"].startswith("测试工程师") and got[2]["source"] == "moka_detail"
    assert (got[3]["jd_text"], got[3]["work_location"], got[3]["source"]) == (f"{text}\n工作地点：西安", "西安", "zhiye_detail")
    assert (got[4]["title"], got[4]["jd_text"], got[4]["recruit_project"], got[4]["confidence"]) == (None, text, "校园招聘", 0.75)
    assert (got[5]["title"], got[5]["recruit_project"], got[5]["recruit_bucket"], got[5]["confidence"]) == ("某公司2027届秋招启动", "日常实习", "应届生实习", 0.65)
    assert (got[6]["source"], got[6]["recruit_project"], got[6]["recruit_bucket"], got[6]["confidence"]) == ("hotjob_list_shell", "校园招聘", "校招", 0.15)
    assert (got[7]["adapter"], got[7]["title"], got[7]["source"]) == ("generic", "结构工程师", "general")
    assert all(0 <= r["confidence"] <= 0.95 for r in got.values())
    assert collect.detail_records(df.limit(0)).count() == 0


def test_deletions_by_a_plain_loop(spark, sf_dir):
    from pyspark.sql import functions as F

    from millrace.functions import classify as C
    from millrace.functions import text as T
    from millrace.functions import urls as U
    from millrace.plans.catalog import QUERIES
    from millrace.plans.roles import postings

    c = F.col
    jobs = postings(spark, sf_dir).withColumn("apply_url", F.lit(None).cast("string")).cache()
    facts = jobs.where("status in ('active', 'pending_review')").select(
        "id", "status", "confidence", "updated_at", T.is_closed_title(c("title")).alias("closed"), T.is_noise_title(c("title")).alias("noise"), T.is_closed_text(T.or_empty(c("jd_text"))).alias("shut"), T.title_mismatch(c("company"), c("title")).alias("foreign"),
        T.company_key(c("company")).alias("co"), T.title_key(c("title")).alias("key"), U.identity_url(c("source_url")).alias("url"), U.is_detail_url(c("source_url")).alias("detail"), F.length(T.or_empty(c("jd_text"))).alias("size"), C.is_portal_shell(c("title"), T.or_empty(c("jd_text"))).alias("shell"),
    ).collect()
    want, left = {}, {}
    for r in facts:
        why = "closed_or_referral_title" if r["closed"] else "noise_title" if r["noise"] else "closed_or_referral_jd" if r["shut"] else "company_mismatch" if r["foreign"] else None
        want[r["id"]] = why
        if why is None:
            left.setdefault(r["co"], []).append(r)
    rank = lambda r: (r["detail"], r["confidence"], r["size"], r["updated_at"], -r["id"])
    for group in left.values():
        for key in {r["key"] for r in group if r["key"]}:
            same = [r for r in group if r["key"] == key]
            best = max(same, key=rank)
            want |= {r["id"]: "duplicate" for r in same if r is not best}
        rest = [r for r in group if want[r["id"]] is None]
        shells = [r for r in rest if r["shell"]]
        keep = None if len(shells) < len(rest) or not shells else max(shells, key=rank)
        want |= {r["id"]: "portal_shell_extra" for r in shells if r is not keep}
    got = {r["id"]: r["reason"] for r in collect.deletions(jobs).collect()}
    assert got == want
    count = Counter(want.values())
    row = QUERIES["deletion_report"](spark, sf_dir).first().asDict()
    assert all(row[k] == count[k] for k in collect.DELETIONS) and row["deleted"] == len(want) - count[None]
    assert row["active_remaining"] == sum(r["status"] == "active" and want[r["id"]] is None for r in facts)
    assert sum(count[k] > 0 for k in collect.DELETIONS) >= 4
