"""Sinks: CSV export, published snapshots with a manifest."""

from __future__ import annotations

import json
import time
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: exported columns and their headings
EXPORT = {"company": "公司", "title": "岗位", "recruit_project": "招聘项目", "recruit_bucket": "类型", "work_location": "工作地点", "education": "学历", "salary_range": "薪资", "headcount": "人数", "open_at": "发布时间", "deadline": "截止时间", "graduation_batch": "届别", "industry": "行业", "company_nature": "企业性质", "apply_url": "投递链接", "source_url": "来源链接", "jd_text": "岗位介绍"}


def export_csv(jobs: DataFrame, path: str) -> None:
    """Headed CSV parts, null as empty; the first heading starts with a byte-order mark."""
    columns = [F.coalesce(F.col(c).cast("string") if c in jobs.columns else F.lit(None).cast("string"), F.lit("")).alias(("﻿" if i == 0 else "") + h) for i, (c, h) in enumerate(EXPORT.items())]
    jobs.select(*columns).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def checksum(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free checksum that repeated rows change."""
    mark = F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))
    row = df.agg(F.count(F.lit(1)), F.coalesce(mark, F.lit(0).cast("decimal(38,0)"))).first()
    return row[0], int(row[1]) % (1 << 62)


MANIFEST = "version string, stamp bigint, path string, n_rows bigint, mark bigint, written_at string"


def _files(spark: SparkSession, folder: str):
    """The folder's file system and its path constructor."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def snapshot(df: DataFrame, folder: str, version: str, written_at: datetime | None = None) -> None:
    """Write a version: its rows to a path of their own, then one pointer file.

    Data paths and pointers are never written twice. The pointer gets its name by a rename
    once all is in place, so readers see the old rows or the new ones of a version, and a
    write that fails leaves the old ones; of several pointers the newest counts."""
    spark = df.sparkSession
    path = f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{path}")
    n, mark = checksum(spark.read.schema(df.schema).parquet(f"{folder}/{path}"))
    stamp = time.time_ns()
    at = (written_at or datetime.now(UTC)).isoformat(timespec="seconds")
    line = json.dumps({"version": version, "stamp": stamp, "path": path, "n_rows": n, "mark": mark, "written_at": at})
    files, make = _files(spark, folder)
    name = f"{stamp:020d}-{uuid.uuid4().hex}.json"
    out = files.create(make(f"{folder}/manifest/_{name}"))
    out.write(bytearray(line.encode()))
    out.close()
    if not files.rename(make(f"{folder}/manifest/_{name}"), make(f"{folder}/manifest/{name}")):
        raise OSError(f"the pointer of {version} could not be placed")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """version, path, n_rows, mark and written_at of all versions, by their newest pointers."""
    rows = spark.read.schema(MANIFEST).json(f"{folder}/manifest")
    others = ["path", "n_rows", "mark", "written_at"]
    return rows.groupBy("version").agg(F.max_by(F.struct(*others), "stamp").alias("r")).select("version", "r.*")


def versions(spark: SparkSession, folder: str, keep: int = 14) -> DataFrame:
    """The newest ``keep`` versions of a snapshot folder."""
    return manifest(spark, folder).orderBy(F.desc("version")).limit(keep)


def restore(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """Rows of a version, verified against its manifest."""
    found = manifest(spark, folder).where(F.col("version") == version).first()
    if found is None:
        raise ValueError(f"there is no version {version}")
    df = spark.read.parquet(f"{folder}/{found['path']}")
    if checksum(df) != (found["n_rows"], found["mark"]):
        raise ValueError(f"version {version} doesn't match its manifest")
    return df


def expire(spark: SparkSession, folder: str, as_of: datetime, days: int = 14) -> list[str]:
    """Remove versions written more than ``days`` before ``as_of``, with what superseded or
    failed writes of that age have left; the versions that went. Pointers go before the data
    that they name, so no reader is led to a path that is gone. The newest version stays."""
    files, make = _files(spark, folder)
    cut = as_of - timedelta(days=days)
    pointers = [(r["version"], r["stamp"], r["path"], r["written_at"], r["name"]) for r in spark.read.schema(MANIFEST).json(f"{folder}/manifest").select("*", F.input_file_name().alias("name")).collect()]  # one row a version written
    newest = max(pointers, key=lambda p: (p[0], p[1]), default=None)
    current = {v: max(p[1] for p in pointers if p[0] == v) for v, *_ in pointers}
    old = lambda p: datetime.fromisoformat(p[3]) < cut
    gone = [p for p in pointers if p is not newest and old(p)]
    for p in gone:
        files.delete(make(p[4]), False)
    kept = {p[2] for p in pointers} - {p[2] for p in gone}
    for entry in files.listStatus(make(f"{folder}/data")):
        name = f"data/{entry.getPath().getName()}"
        if name not in kept and (name in {p[2] for p in gone} or entry.getModificationTime() < cut.timestamp() * 1000):
            files.delete(entry.getPath(), True)
    return sorted({p[0] for p in gone if p[1] == current[p[0]]})
