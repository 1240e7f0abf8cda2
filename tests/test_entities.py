"""Titles and headings of pages against the twins that decode three entities only."""

import duckdb
import pytest

from millrace.plans.catalog import ORACLES, QUERIES
from millrace.sources import html
from tests.compare import assert_same

HEADS = ["Ores*** the&&&amp", "token = &quot;73ab", "a &lt;b&gt; &amp;amp; c", "x&#39;s &copy;", "plain words", "A & B", "Tom &lt", "a &amp;quot; b"]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("heads"))
    rows = [(3 * i + j, f"https://x.cn/{i}/{j}", f"<html><head><title>{h}</title></head><body><h1>{h}</h1><a href=\"/q?a=1&amp;b=2\">{h}</a></body></html>") for i, h in enumerate(HEADS) for j in range(3)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{path}/pages.parquet/*.parquet')")
    return path, con


@pytest.mark.parametrize("name", ["page_title_links", "feishu_details", "hotjob_details", "moka_details", "zhiye_details", "url_candidates"])
def test_heads_as_in_the_twin(spark, made, name):
    path, con = made
    assert_same(QUERIES[name](spark, path), con.sql(ORACLES[name]))


def test_other_readers_decode_all():
    page = "<title>a &quot;b&quot; &copy</title><h1><a href='?x=&quot;'>c &raquo;</a></h1>"
    assert (html.parse(page).title, html.parse(page).heading) == ('a "b" ©', "c »")
    basic = html.parse(page, basic=True)
    assert (basic.title, basic.heading, basic.links[0]["href"]) == ("a &quot;b&quot; &copy", "c &raquo;", '?x="')
