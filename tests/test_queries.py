"""Every registered query against its DuckDB twin, and what has no twin against plain Python."""

import pytest

import __spark_entry__
from millrace.plans.catalog import ORACLES, QUERIES
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["host", "page_id", "identity", "n_links", "host_rank"]
    assert out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scores_are_bounded(spark, sf_dir):
    rows = QUERIES["posting_scores"](spark, sf_dir).collect()
    assert rows and all(0 <= r["score"] <= 1 and r["ok"] == (r["ok"] and r["score"] >= 0.55) for r in rows)


def test_clean_up_keeps_one_of_each_title(spark, sf_dir):
    rows = QUERIES["clean_up_fates"](spark, sf_dir).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    assert {r["fate"] for r in rows} <= {"keep", "duplicate_title", "duplicate_url", "shell", "rename"}


def test_login_states_by_a_plain_loop(spark, sf_dir):
    import datetime

    span, state, want = datetime.timedelta(minutes=600), {}, {}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type in ('error', 'view')").collect()
    for e in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        failed, opened, locked = state.get(e["user_id"], (0, None, None))
        if locked and locked > e["ts"]:
            want[e["event_id"]] = "locked"
            continue
        if e["event_type"] == "view":
            state[e["user_id"]], want[e["event_id"]] = (0, None, None), "session"
            continue
        failed, opened = (1, e["ts"]) if opened is None or opened < e["ts"] - span else (failed + 1, opened)
        state[e["user_id"]], want[e["event_id"]] = (failed, opened, e["ts"] + span if failed >= 2 else None), "failed"
    got = {r["id"]: r["result"] for r in QUERIES["login_states"](spark, sf_dir).collect()}
    assert got == want and set(want.values()) == {"locked", "session", "failed"}


def test_section_query(spark, sf_dir):
    rows = QUERIES["section_split"](spark, sf_dir).collect()
    assert any(r["duties_len"] for r in rows)
