"""Queries of the relational operators over the star-schema and event tables, which stand in
for companies, postings, queues, picks and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import dedupe, mutate, query as Q, vote
from millrace.plans.registry import registry
from millrace.session import table
from millrace.streaming import changes

QUERIES, ORACLES, query = registry()


def _orders(spark, sf_dir):
    """Orders as postings with a company."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("id"), F.col("c_name").alias("company"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("updated_at"),
        F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "deleted").otherwise("pending_review").alias("status"), F.lit(None).cast("string").alias("recruit_project"), F.lit(None).cast("string").alias("graduation_batch"),
    )


_O = """WITH j AS (SELECT o_orderkey AS id, c_name AS company, o_orderpriority AS title, o_orderdate AS updated_at,
  CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'deleted' ELSE 'pending_review' END AS status FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


@query(
    _O + """ SELECT j.id, company, coalesce(s.apply_status, '未投递') AS my_apply_status, coalesce(s.note, '') AS my_note FROM j
    LEFT JOIN (SELECT l_orderkey AS id, max(CASE l_returnflag WHEN 'R' THEN '已投递' ELSE '面试' END) AS apply_status, max(l_linestatus) AS note FROM lineitem GROUP BY l_orderkey) s ON j.id = s.id
    WHERE status = 'active' AND (contains(lower(title), 'urgent') OR contains(lower(company), 'urgent'))"""
)
def posting_filter_keyword(spark, sf_dir):
    """Keyword filter and personal status with defaults."""
    lines = table(spark, sf_dir, "lineitem")
    states = lines.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.max(F.when(F.col("l_returnflag") == "R", "已投递").otherwise("面试")).alias("apply_status"), F.max("l_linestatus").alias("note"))
    found = Q.list_postings(_orders(spark, sf_dir), keyword="URGENT", states=states, limit=None)
    return found.select("id", "company", "my_apply_status", "my_note")


@query(_O + " SELECT id, company FROM j WHERE status IN ('active', 'pending_review') AND id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def posting_semi_picks(spark, sf_dir):
    """Only picked postings."""
    picks = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("job_id"))
    return Q.list_postings(_orders(spark, sf_dir), status=("active", "pending_review"), picks=picks, limit=None).select("id", "company")


@query(_O + " SELECT status, count(*) AS n FROM j GROUP BY status")
def posting_status_counts(spark, sf_dir):
    """Postings by status."""
    return vote.counts_by(_orders(spark, sf_dir), "status")


_QUEUE = "SELECT o_custkey % 20 AS run_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'running' WHEN '2-HIGH' THEN 'done' WHEN '3-MEDIUM' THEN 'error' WHEN '5-LOW' THEN 'skipped' ELSE 'pending' END AS status, cast(o_orderkey % 5 AS BIGINT) AS new_count, o_orderkey AS id FROM orders"


def _queue(spark, sf_dir):
    return spark.sql(_QUEUE.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


@query(f"WITH q AS ({_QUEUE}) SELECT run_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("pending", "running", "done", "error", "skipped")) + ", count(*) FILTER (status IN ('done', 'error', 'skipped')) AS processed, cast(sum(new_count) AS BIGINT) AS new_count FROM q GROUP BY run_id")
def queue_progress_pivot(spark, sf_dir):
    """Progress of each run."""
    return mutate.queue_progress(_queue(spark, sf_dir))


@query(f"WITH q AS ({_QUEUE}) SELECT id, run_id, CASE WHEN n <= 3 THEN 'running' ELSE status END AS status FROM (SELECT *, CASE WHEN status = 'pending' THEN row_number() OVER (PARTITION BY run_id, status ORDER BY id) ELSE 1000000000 END AS n FROM q)")
def queue_claim(spark, sf_dir):
    """The next three items of each run are claimed."""
    return changes.claim(_queue(spark, sf_dir).withColumn("attempts", F.lit(0)), 3).select("id", "run_id", "status")


@query("SELECT p_brand AS brand, CASE WHEN count(*) = 1 THEN min(p_type) END AS nature, max(votes) AS votes, count(*) > 1 AS conflict FROM (SELECT p_brand, p_type, votes, rank() OVER (PARTITION BY p_brand ORDER BY votes DESC) AS r FROM (SELECT p_brand, p_type, count(*) AS votes FROM part GROUP BY ALL)) WHERE r = 1 GROUP BY p_brand")
def nature_vote(spark, sf_dir):
    """Majority vote; ties are conflicts."""
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("nature"))
    return vote.vote(parts, "brand", "nature")


@query("SELECT l_orderkey AS company, l_linenumber AS pos, CASE WHEN NOT known THEN (sum(CASE WHEN known THEN 0 ELSE 1 END) OVER w - 1)::BIGINT // 2 END AS batch_no FROM (SELECT *, l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) AS known FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)")
def collect_batch_cap(spark, sf_dir):
    """Unknown candidates in batches of two."""
    known = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("identity"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("company"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("identity"))
    return dedupe.collect_batch(rows, known, 2).select("company", "pos", "batch_no")


@query("SELECT l_orderkey AS key, count(*) AS parsed, count(*) FILTER (l_returnflag = 'N') AS published, count(*) FILTER (l_returnflag = 'R') AS errors, max(l_shipdate) AS newest FROM lineitem GROUP BY l_orderkey")
def collect_stats_rollup(spark, sf_dir):
    """Counts of one collection run."""
    flag = F.col("l_returnflag")
    lines = table(spark, sf_dir, "lineitem").withColumn("key", F.col("l_orderkey"))
    return vote.run_stats(lines, "key", {"published": flag == "N", "errors": flag == "R"}, newest="l_shipdate")


@query("SELECT p.doc_id FROM documents p WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = p.doc_id)")
def known_anti_join(spark, sf_dir):
    """Candidates that are not known."""
    known = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return Q.unknown(table(spark, sf_dir, "documents").select("doc_id"), known, "doc_id")


@query("SELECT conv_id, turn, outside, max(outside) OVER (PARTITION BY conv_id) AS stop FROM (SELECT conv_id, turn, length(coalesce(text, '')) > 200 AS outside FROM conversations)")
def lookback_page_window(spark, sf_dir):
    """Rows outside a window stop their page."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return dedupe.page_window(rows, ["conv_id"], F.col("n") > 200).select("conv_id", "turn", "outside", "stop")


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, coalesce(max(CASE WHEN length(text) > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM conversations) WHERE stopped = 0")
def paginate_stop_prefix(spark, sf_dir):
    """Rows up to and with the first stop."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return dedupe.until_stop(rows, ["conv_id"], "turn", F.length("text") > 200).select("conv_id", "turn")


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type IN ('error', 'click') AND cast(json_extract_string(props, '$.k') AS BIGINT) > 50")
def review_json_filter(spark, sf_dir):
    """Rows by a field of their JSON payload."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.col("props").alias("payload"))
    return Q.by_payload(rows, ("error", "click"), "k", lambda k: k.cast("long") > 50).select("event_id", F.col("k").cast("long").alias("k"))


@query("SELECT event_id, ts FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-05 00:00:00', 10) ORDER BY ts, event_id LIMIT 1000")
def cursor_page(spark, sf_dir):
    """A page of the feed after a composite cursor (a top-k by its nature)."""
    feed = table(spark, sf_dir, "events").select("event_id", "ts")
    return changes.page_after(feed, F.lit("2024-01-05 00:00:00").cast("timestamp_ntz"), F.lit(10), time="ts", id_col="event_id")


_LAST = "SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_event, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY user_id"


@query(f"SELECT user_id, last_event, last_type FROM ({_LAST}) WHERE last_type <> 'error'")
def tombstone_apply(spark, sf_dir):
    """The last change of each key; errors are tombstones."""
    feed = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("last_event"), F.col("event_type").alias("last_type"), "ts")
    last = changes.latest(feed, "user_id", "ts", "last_event")
    return last.where("last_type != 'error'").select("user_id", "last_event", "last_type")


@query("SELECT id, status FROM (SELECT id, status, row_number() OVER (PARTITION BY id ORDER BY layer DESC) AS r FROM (SELECT DISTINCT user_id AS id, 'active' AS status, 0 AS layer FROM events WHERE event_type = 'view' UNION ALL SELECT DISTINCT user_id, 'deleted', 1 FROM events WHERE event_type = 'error' AND value > 100 UNION ALL SELECT DISTINCT user_id, 'revoked', 2 FROM events WHERE event_type = 'purchase' AND value > 240)) WHERE r = 1")
def publish_overlay(spark, sf_dir):
    """Active, then deleted, then revoked."""
    e = table(spark, sf_dir, "events")
    layer = lambda test, status: e.where(test).select(F.col("user_id").alias("id")).distinct().withColumn("status", F.lit(status))
    return mutate.overlay([layer("event_type = 'view'", "active"), layer("event_type = 'error' and value > 100", "deleted"), layer("event_type = 'purchase' and value > 240", "revoked")], "id").select("id", "status")


_UP = """WITH o AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS score, CASE WHEN c_nationkey % 2 = 0 THEN 'active' ELSE 'pending_review' END AS status FROM customer WHERE c_custkey % 3 <> 0),
  n AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN c_name || ' x' ELSE ' ' || c_name END AS name, c_acctbal + (CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0.0001 END) AS score, 'pending_review' AS status FROM customer WHERE c_custkey % 4 <> 0)"""


@query(
    _UP + """ SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'inserted'
    WHEN trim(coalesce(n.name, o.name)) = trim(o.name) AND abs(o.score - n.score) <= 0.01 THEN 'unchanged' ELSE 'updated' END AS action FROM o FULL JOIN n ON o.id = n.id"""
)
def upsert_actions(spark, sf_dir):
    """What an upsert does to each row; active is never demoted."""
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").selectExpr("c_custkey as id", "c_name as name", "c_acctbal as score", "case when c_nationkey % 2 = 0 then 'active' else 'pending_review' end as status")
    new = c.where("c_custkey % 4 <> 0").selectExpr("c_custkey as id", "case c_custkey % 5 when 0 then null when 1 then c_name || ' x' else ' ' || c_name end as name", "c_acctbal + (case when c_custkey % 7 = 0 then 1 else 0.0001d end) as score", "'pending_review' as status")
    return mutate.upsert(old, new, "id", ["name", "score", "status"], keep_old_when_null=("name",), tolerance={"score": 0.01}).select("id", "action")


@query("SELECT id, source FROM (SELECT s_suppkey AS id, 'first' AS source, s_acctbal AS bal FROM supplier UNION ALL SELECT c_custkey, 'rest', c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)) ORDER BY CASE source WHEN 'first' THEN 0 ELSE 1 END, bal DESC, id LIMIT 120")
def topup_union(spark, sf_dir):
    """A list topped up to its size by another (a top-k by its nature)."""
    first = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    rest = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    return Q.top_up(first, rest, 120, [F.desc("bal"), F.asc("id")]).select("id", "source")


@query("SELECT user_id, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS failures, count(*) >= 5 AS locked FROM events WHERE event_type = 'error' GROUP BY ALL")
def login_lockout(spark, sf_dir):
    """Failures by user and 15-minute window (the streaming form is ``windowed_counts``)."""
    return changes.windowed_counts(table(spark, sf_dir, "events"))


@query("""SELECT s_suppkey AS id, n_name AS nation, row_number() OVER (ORDER BY CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 1 END, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 1 END, CASE WHEN r_name = 'ASIA' THEN 0 ELSE 1 END, s_acctbal DESC, s_suppkey) AS pos
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 7 <> 0 AND (s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 OR s_suppkey % 2 = 0)""")
def company_priority_order(spark, sf_dir):
    """Companies with URLs by trusted host, career page, official and newest."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    k, empty = F.col("s_suppkey"), F.expr("cast(array() as array<string>)")
    url = lambda test, u: F.when(test, F.array(F.lit(u))).otherwise(empty)
    status = F.when(k % 7 == 0, "rejected").when(F.col("r_name") == "ASIA", "official").otherwise("unverified")
    hints = F.concat(url(k % 5 == 0, "https://app.mokahr.com/x"), url(k % 2 == 0, "https://a.com"))
    companies = joined.select(k.alias("id"), F.col("n_name").alias("nation"), url(k % 3 == 0, "https://a.com/campus").alias("career_urls"), hints.alias("hint_apply_urls"), status.alias("verify_status"), F.col("s_acctbal").alias("updated_at"))
    return dedupe.numbered(Q.company_order(companies), "pos").select("id", "nation", "pos")


@query("SELECT coalesce(h.id, a.id) AS source_id, coalesce(a.name, h.name) AS name FROM (SELECT o_orderkey AS id, o_orderpriority AS name FROM orders WHERE o_orderkey % 2 = 0) h FULL JOIN (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS name FROM orders WHERE o_orderkey % 3 = 0) a ON h.id = a.id")
def merge_sources(spark, sf_dir):
    """Rows of two sources by id; the second wins but for missing values."""
    from millrace.sources.feeds import merge_by_id

    o = table(spark, sf_dir, "orders")
    first = o.where("o_orderkey % 2 = 0").selectExpr("o_orderkey as source_id", "o_orderpriority as name")
    second = o.where("o_orderkey % 3 = 0").selectExpr("o_orderkey as source_id", "case when o_orderkey % 9 <> 0 then o_orderstatus end as name")
    return merge_by_id(first, second, ["name"])
