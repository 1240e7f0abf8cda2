"""Login states in batch and stream, snapshots that are rewritten and expire, workbooks by sheet."""

import io
import random
import zipfile
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import collect
from millrace.sources import sinks, xlsx
from millrace.streaming import changes

ATTEMPT = "account bigint, ts timestamp_ntz, id bigint, ok boolean"


def attempts_of(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        account = 1 if rng.random() < 0.6 else rng.choice([2, 3, 4, None])  # one account has most of them
        rows.append((account, datetime(2026, 8, 1) + timedelta(seconds=60 * rng.randrange(20_000)), i, rng.choice([True, False, False, False, None])))
    return rows


def states_by_hand(rows, failures, minutes):
    span, state, out = timedelta(minutes=minutes), {}, {}
    for account, ts, i, ok in sorted(rows, key=lambda r: (r[1], r[2])):
        failed, opened, locked = state.get(account, (0, None, None))
        if locked and locked > ts:
            out[i] = "locked"
        elif ok:
            state[account], out[i] = (0, None, None), "session"
        else:
            failed, opened = (1, ts) if opened is None or opened < ts - span else (failed + 1, opened)
            state[account], out[i] = (failed, opened, ts + span if failed >= failures else None), "failed"
    return out


@pytest.mark.parametrize(("failures", "minutes"), [(5, 15), (2, 40), (3, 1)])
def test_login_states_by_a_plain_loop(spark, failures, minutes):
    rows = attempts_of(minutes, 6000)
    got = collect.login_locks(spark.createDataFrame(rows, ATTEMPT).repartition(5), failures=failures, minutes=minutes).collect()
    want = states_by_hand(rows, failures, minutes)
    assert {r["id"]: r["result"] for r in got} == want and len(got) == len(rows) and set(want.values()) == {"locked", "failed", "session"}
    assert all((r["expires_at"] == r["ts"] + timedelta(hours=12)) if r["result"] == "session" else r["expires_at"] is None for r in got)
    at = datetime(2026, 8, 7, 5)
    live = {}
    for r in sorted(got, key=lambda r: (r["ts"], r["id"])):
        if r["result"] == "session" and r["ts"] <= at:
            live[r["account"]] = (r["id"], r["expires_at"])
    open_ = {(r["account"], r["id"], r["expires_at"]) for r in collect.sessions_at(spark.createDataFrame(got, "account bigint, id bigint, ts timestamp_ntz, result string, expires_at timestamp_ntz"), at).collect()}
    assert open_ == {(k, *v) for k, v in live.items() if v[1] > at} and open_
    assert collect.login_locks(spark.createDataFrame([], ATTEMPT)).count() == 0


def test_login_stream_equals_the_loop_and_ends_sessions(spark, tmp_path):
    rows = [r for r in attempts_of(3, 400) if r[0] is not None]
    rows = sorted(((a, ts, i, bool(ok)) for a, ts, i, ok in rows), key=lambda r: r[1])
    late = (9, datetime(2026, 9, 30), 10_000, False)  # moves the watermark past all sessions
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        parts = [rows[:130], rows[130:260], rows[260:], [late], [(9, datetime(2026, 10, 1), 10_001, False)]]
        for n, part in enumerate(parts):  # one run each: states outlive a restart
            spark.createDataFrame(part, ATTEMPT).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
            stream = spark.readStream.schema(ATTEMPT).parquet(str(tmp_path / "in" / "*"))
            changes.follow_logins(stream, failures=3, minutes=40).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    told = {r["id"]: r["result"] for r in out if r["result"] in ("locked", "failed", "session") and r["id"] < 10_000}
    assert told == states_by_hand(rows, 3, 40)
    ends = {r["id"]: (r["result"], r["at"]) for r in out if r["result"] in ("expired", "replaced")}
    logins = sorted((r for r in rows if told[r[2]] == "session"), key=lambda r: (r[0], r[1], r[2]))
    for k, (account, ts, i, _) in enumerate(logins):
        following = logins[k + 1] if k + 1 < len(logins) and logins[k + 1][0] == account else None
        expires = ts + timedelta(hours=12)
        assert ends[i] == (("replaced", following[1]) if following and following[1] < expires else ("expired", expires))


def test_snapshots_survive_failed_writes_and_expire(spark, tmp_path):
    folder = str(tmp_path / "s")
    rows = spark.range(10).selectExpr("id", "cast(id as string) as t")
    day = lambda n: datetime(2026, 8, 1, tzinfo=UTC) + timedelta(days=n)
    sinks.snapshot(rows, folder, "v1", day(0))
    broken = rows.select("id", F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("t")).alias("t"))
    with pytest.raises(Exception, match="lost"):
        sinks.snapshot(broken, folder, "v1", day(1))
    assert sinks.restore(spark, folder, "v1").count() == 10  # the old rows, whole
    held = sinks.restore(spark, folder, "v1")
    sinks.snapshot(rows.limit(4), folder, "v1", day(2))
    assert sinks.restore(spark, folder, "v1").count() == 4 and held.count() == 10  # a reader keeps what it opened
    sinks.snapshot(rows, folder, "v2", day(20))
    sinks.snapshot(rows, folder, "v3", day(21))
    assert [r["version"] for r in sinks.versions(spark, folder).collect()] == ["v3", "v2", "v1"]
    assert sinks.expire(spark, folder, day(21)) == ["v1"]
    assert [r["version"] for r in sinks.versions(spark, folder).collect()] == ["v3", "v2"]
    assert sinks.restore(spark, folder, "v2").count() == 10
    with pytest.raises(ValueError, match="no version"):
        sinks.restore(spark, folder, "v1")
    assert sinks.expire(spark, folder, day(400)) == ["v2"]  # the newest version stays
    assert sinks.restore(spark, folder, "v3").count() == 10
    assert len(list((tmp_path / "s" / "data").iterdir())) <= 2


def book(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(names))) + "</Relationships>")
        for i, n in enumerate(names):
            z.writestr(f"xl/worksheets/s{i}.xml", sheets[n])
    return out.getvalue()


def sheet(rows):
    return "<worksheet><sheetData>" + "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{x}</t></is></c>' for x in r) + "</row>" for r in rows) + "</sheetData></worksheet>"


def test_workbooks_by_sheet_and_batch(spark, tmp_path):
    many = [[f"n{i}", str(i)] for i in range(7001)]
    (tmp_path / "a.xlsx").write_bytes(book({"large": sheet(many), "small": sheet([["x"], [], ["y"]]), "broken": sheet([["1"], ["2"]])[:-30]}))
    (tmp_path / "b.xlsx").write_bytes(b"no archive")
    (tmp_path / "c.xlsx").write_bytes(book({"none": sheet([])}))
    rows = xlsx.read_workbooks(spark, str(tmp_path)).collect()
    of = lambda name: sorted((r["row_no"], list(r["cells"])) for r in rows if r["sheet"] == name and r["error"] is None)
    assert of("large") == list(enumerate(many)) and of("small") == [(0, ["x"]), (1, []), (2, ["y"])] and of("none") == []
    assert of("broken") == [(0, ["1"])]
    assert sorted((r["path"][-6:], r["sheet"]) for r in rows if r["error"]) == [("a.xlsx", "broken"), ("b.xlsx", None)]


def test_change_feed_restarts_in_the_middle_of_a_page(spark, tmp_path):
    import json

    from millrace.sources.change_feed import PagedReader, read_changes

    store, schema = tmp_path / "store.json", "id bigint, updated_at string, status string"

    def fetch(cursor, limit):  # a service: rows in cursor order, strictly after the cursor
        rows = sorted((tuple(r) for r in json.loads(store.read_text())), key=lambda r: (r[1], r[0]))
        return [r for r in rows if cursor is None or (r[1], r[0]) > tuple(cursor)][:limit]

    day = lambda n: f"2026-08-{n:02d}T00:00:00"
    rows = [(i, day(1 + i // 12), "deleted" if i % 5 == 4 else "active") for i in range(50)]  # many share a time
    store.write_text(json.dumps(rows))
    taken, failing = [], [True]

    def fold(df, batch):
        got = [tuple(r) for r in df.collect()]
        taken.append((batch, got))
        if batch == 2 and failing[0]:
            raise ValueError("lost in the middle")

    def run():
        feed = read_changes(spark, fetch, schema, page=7)
        q = feed.writeStream.foreachBatch(fold).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="lost in the middle"):
        run()
    failing[0] = False
    run()
    assert [sorted(r) for b, r in taken if b == 2][0] == [sorted(r) for b, r in taken if b == 2][1]  # repeated as it was
    by_batch = dict(taken)
    assert sorted(r for got in by_batch.values() for r in got) == sorted(rows)
    assert max(len(got) for got in by_batch.values()) == 7
    store.write_text(json.dumps([*rows, (3, day(20), "deleted"), (60, day(20), "active")]))
    run()
    assert sorted(r for b, got in taken if b > max(by_batch) for r in got) == [(3, day(20), "deleted"), (60, day(20), "active")]
    reader = PagedReader(fetch, 1, 0, 7)
    start, ids = reader.initialOffset(), []
    for _ in range(20):
        part, start = reader.read(start)
        ids += [r[0] for r in part]
    assert len(ids) == 52 and list(reader.readBetweenOffsets(start, start)) == []
    assert [r[0] for r in reader.readBetweenOffsets(reader.initialOffset(), {"time": day(1), "id": 4})] == [0, 1, 2, 3, 4]
