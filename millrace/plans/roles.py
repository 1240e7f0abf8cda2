"""Role mapping: the driver's tables in the roles of postings, companies and pages.

``POSTINGS`` is SQL that Spark and DuckDB both run; its texts and dates are made up so that
every rule meets every kind of value."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from millrace.session import table

AS_OF = date(2026, 8, 1)

POSTINGS = """
SELECT d.doc_id AS id,
  CASE d.doc_id % 4 WHEN 0 THEN '晨光生物科技股份有限公司' WHEN 1 THEN '远山集团有限公司' WHEN 2 THEN source ELSE '海川电子 - 实习' END AS company,
  CASE d.doc_id % 16 WHEN 0 THEN '算法工程师（2027届）' WHEN 1 THEN 'Java后端开发 实习生' WHEN 2 THEN '校园招聘' WHEN 3 THEN '首页'
    WHEN 4 THEN '产品经理【2025】' WHEN 5 THEN 'xx' WHEN 6 THEN '景顺长城基金 研究员' WHEN 7 THEN '晨光生物科技 校园招聘入口'
    WHEN 8 THEN '职位已关闭' WHEN 9 THEN 'Search Jobs - 招贤纳才' WHEN 10 THEN '数据分析师 - 招贤纳才(中国)' WHEN 11 THEN '{{item.postName}}'
    WHEN 12 THEN '26届管培生' WHEN 13 THEN '嵌入式工程师 ' || (d.doc_id % 50) WHEN 14 THEN '暑期实习 QA 测试' ELSE '微官网' END AS title,
  CASE d.doc_id % 6 WHEN 0 THEN '校园招聘' WHEN 1 THEN '日常实习' WHEN 2 THEN '社会招聘' WHEN 3 THEN '秋招' WHEN 5 THEN '提前批' END AS recruit_project,
  CASE d.doc_id % 7 WHEN 0 THEN '校招' WHEN 1 THEN '日常实习' WHEN 2 THEN '应届生实习' END AS recruit_bucket,
  CASE d.doc_id % 5 WHEN 0 THEN '社招类' WHEN 1 THEN '校园' ELSE '' END AS raw_category,
  CASE d.doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '招聘类别：社会招聘 ' || text WHEN 2 THEN '岗位职责：' || text WHEN 3 THEN '短文'
    WHEN 4 THEN '本职位仅限内部 ' || text ELSE text END AS jd_text,
  CASE d.doc_id % 5 WHEN 0 THEN 'https://app.mokahr.com/campus/' || d.doc_id
    WHEN 1 THEN 'https://Careers.example.com/jobs/' || d.doc_id || '/?utm_source=a&jobId=' || d.doc_id || '#top'
    WHEN 2 THEN 'https://example.com/login' WHEN 3 THEN 'https://jobs.feishu.cn/index/position/' || d.doc_id || '/detail' ELSE 'ftp://x' END AS source_url,
  CASE d.doc_id % 6 WHEN 0 THEN (2024 + d.doc_id % 4) || '-' || (1 + d.doc_id % 12) || '-' || (1 + d.doc_id % 31)
    WHEN 1 THEN (2024 + d.doc_id % 4) || '年' || (1 + d.doc_id % 12) || '月' || (1 + d.doc_id % 28) || '日'
    WHEN 2 THEN (2024 + d.doc_id % 4) || '/0' || (1 + d.doc_id % 9) || '/1' || (d.doc_id % 10) || ' 08:30'
    WHEN 3 THEN (2024 + d.doc_id % 4) || '.' || (1 + d.doc_id % 12) || '.' || (1 + d.doc_id % 28)
    WHEN 5 THEN (2024 + d.doc_id % 4) || '-' || (1 + d.doc_id % 12) END AS open_at,
  CAST(NULL AS STRING) AS published_at, CAST(NULL AS STRING) AS list_updated_at,
  CASE d.doc_id % 5 WHEN 0 THEN '2026-07-15' WHEN 1 THEN '2026-08-05' WHEN 2 THEN '2026-12-31' WHEN 4 THEN '长期有效' END AS deadline,
  '2026-0' || (1 + d.doc_id % 8) || '-15T00:00:00' AS updated_at, '2025-0' || (1 + d.doc_id % 9) || '-01' AS created_at,
  CASE d.doc_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'pending_review' ELSE 'deleted' END AS status,
  CAST(d.doc_id % 21 AS DOUBLE) / 20 AS confidence,
  CASE d.doc_id % 8 WHEN 0 THEN '2027届' WHEN 1 THEN '2025届' END AS graduation_batch,
  coalesce(quality, 0) = 1 AS official
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def run_sql(spark: SparkSession, sf_dir: str, sql: str, **frames: DataFrame) -> DataFrame:
    """Spark SQL over the driver's tables, named as parameters."""
    import re

    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    used = {n: table(spark, sf_dir, n) for n in names if re.search(rf"\b{n}\b", sf_free(sql))}
    frames = used | frames
    for n in frames:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
    return spark.sql(sql.replace("{{item.postName}}", "{{{{item.postName}}}}"), **frames)


def sf_free(sql: str) -> str:
    """The statement without its string literals."""
    import re

    return re.sub(r"'[^']*'", "''", sql)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, POSTINGS)
