"""Texts of pages are used whole, however long they are."""

import random

from pyspark.sql import functions as F

from __spark_entry__ import queries
from millrace.functions import text as T
from millrace.functions import vocab as V


def test_page_texts_use_whole_blocks(spark, tmp_path):
    long = "甲b 😀" * 15000  # 60,000 characters
    rows = [
        (1, f"<h1>t</h1><p>{long}</p><p>end</p>"),
        (2, f"<div>{'x' * 20001}</div>"),
        (3, f"<div>{'x' * 19999}</div><div>{'y' * 25000}<b>{'z' * 5000}</b></div>"),
        (4, f"<ul>{'<li>ab</li>' * 9000}</ul>"),
        (5, ""),
        (6, None),
    ]
    pages = [(i, f"https://x.cn/{i}", h) for i, h in rows]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["n_text"], r["n_longest"]) for r in queries()["page_texts"](spark, str(tmp_path)).collect()}
    assert got == {1: (2 + 60000 + 4, 60000), 2: (20001, 20001), 3: (19999 + 1 + 30000, 30000), 4: (3 * 9000 - 1, 2), 5: (0, 0), 6: (0, 0)}


def test_chrome_is_found_as_by_the_whole_pattern(spark):
    rng = random.Random(4)
    bits = ["招聘官网", "招聘门户", "招聘", "官网", "集团", "股份", "有限公司", "有限公", "甲", "x", " ", "　", "\n", "-", "|", "career", "Careers", "Search Jobs", "ſearchjobs", "jobs at  apple", "JOBS AT APPLE", "招贤纳才", "招聘首页", "招聘网站", "找到你的理想职位", "职位列表", "—", "–", "y" * 41]
    lines = ["", *("".join(rng.choices(bits, k=rng.randint(1, 7))) for _ in range(20000))]
    found = spark.createDataFrame([(x,) for x in lines], "t string").select(F.rlike("t", F.lit(V.CHROME_TITLE)).alias("whole"), F.rlike("t", F.lit(V.CHROME_FOUND)).alias("found")).collect()
    assert all(r["whole"] == r["found"] for r in found) and {r["whole"] for r in found} == {True, False}


def test_chrome_is_searched_without_counted_runs(spark):
    line = spark.createDataFrame([("t",)], "t string")
    plan = line.select(T.strip_navigation(F.col("t")))._jdf.queryExecution().toString()
    assert "招聘官网" in plan and ".{2,40}" not in plan
