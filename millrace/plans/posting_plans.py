"""Queries over the posting role: classification, dates, dedupe, routes."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import classify as C
from millrace.functions import dates as D
from millrace.functions import labels as L
from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.functions import vocab as V
from millrace.operators import dedupe, query as Q, vote
from millrace.plans.registry import registry
from millrace.plans.roles import AS_OF, POSTINGS, postings, run_sql

QUERIES, ORACLES, query = registry()

P = f"WITH p AS ({POSTINGS})"


def rx(pattern: str) -> str:
    """A pattern in RE2 form: without the white-space flag, quotes doubled for SQL."""
    plain = pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("(?Us)", "(?s)")
    return plain.replace(r"(社会招聘|社招)\b", r"(社会招聘|社招)([^一-鿿\w]|$)").replace(r"(校园招聘|校招|秋招|春招)\b", r"(校园招聘|校招|秋招|春招)([^一-鿿\w]|$)").replace("'", "''")


def m(expr: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({expr}, '{rx(pattern)}'), false)"


def any_of(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


def listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


ROLE, SQZ = any_of("{0}", V.ROLE_WORDS), r"regexp_replace({0}, '\s+', '', 'g')"
CLOSED = m("{0}", V.CLOSED_TITLE)


def sqz(e: str) -> str:
    return SQZ.format(e)


def closed_sql(e: str) -> str:
    return f"({m(sqz(e), V.CLOSED_TITLE)} OR {m(e, V.CLOSED_TITLE)})"


def in_noise_sql(e: str) -> str:
    return f"({e} = '' OR {sqz(e)} IN ({listed(V.NOISE_TITLES)}) OR {e} IN ({listed(V.NOISE_TITLES)}) OR lower({sqz(e)}) IN ({listed(V.NOISE_TITLES)}) OR lower({e}) IN ({listed(V.NOISE_TITLES)}))"


def chrome_sql(e: str) -> str:
    parts = f"list_filter(regexp_split_to_array({e}, '\\s*[-—–|]\\s*'), lambda x: x <> '')"
    odd = f"len(list_filter({parts}, lambda x: {m('x', V.CHROME_TITLE)} OR {in_noise_sql('x')})) > 0"
    role = f"len(list_filter({parts}, lambda x: {any_of('x', V.ROLE_WORDS)})) > 0"
    return f"({e} <> '' AND ({m(e, V.CHROME_TITLE)} OR {m(sqz(e), V.CHROME_TITLE)} OR {m(e, V.BROWSER_TIP)} OR (lower({sqz(e)}) IN ('searchjobs', 'jobsatapple', 'careers', 'career') AND {in_noise_sql(e)}) OR (len({parts}) >= 2 AND {odd} AND NOT {role})))"


def cut_sql(e: str) -> str:
    return f"nullif(trim(regexp_replace({e}, '{rx(V.CHROME_SUFFIX)}', ''), ' -—–|'), '')"


def noise_sql(e: str) -> str:
    """The title cascade over a column that is trimmed and not null."""
    cut, t = cut_sql(e), f"coalesce({cut_sql(e)}, {e})"
    return f"""(CASE WHEN length({e}) < 2 THEN true
      WHEN {m(sqz(e), '^(?:' + V.NOISE_PLACEHOLDER + ')$')} OR lower({sqz(e)}) IN ({listed(V.NOISE_PLACEHOLDER_WORDS)}) THEN true
      WHEN {m(e, V.TEMPLATE_TOKEN)} OR {m(e, V.CHANNEL_TITLE)} THEN true
      WHEN NOT ({cut} IS NOT NULL AND {cut} <> {e} AND NOT {chrome_sql(cut)}) AND ({chrome_sql(e)} OR {chrome_sql(t)}) THEN true
      WHEN {in_noise_sql(t)} OR {m(sqz(t), V.NOISE_TITLE)} OR {m(t, V.NOISE_TITLE)} THEN true
      WHEN {m(sqz(t), V.NOISE_NAV_TITLE)} OR {closed_sql(t)} THEN true
      ELSE {sqz(t)} IN ('公告', '通知', '详情') END)"""


def loose_sql(e: str) -> str:
    """Loose date of the formats that the role mapping writes."""
    s = f"replace(replace(replace(regexp_replace({e}, '[T ].*$', ''), '年', '-'), '月', '-'), '日', '')"
    y, mo, d = (f"try_cast(regexp_extract({s}, '^(\\d{{4}})[-/.](\\d{{1,2}})(?:[-/.](\\d{{1,2}}))?$', {i}) AS INT)" for i in (1, 2, 3))
    first = f"make_date({y}, {mo}, 1)"
    whole = f"{first} + (coalesce({d}, 1) - 1)"
    return f"(CASE WHEN {y} IS NULL THEN NULL WHEN month({whole}) <> {mo} THEN {first} ELSE cast({whole} AS DATE) END)"


def bucket_sql(project: str, title: str) -> str:
    p, text = f"coalesce({project}, '')", f"coalesce({project}, '') || ' ' || coalesce({title}, '')"
    return f"(CASE WHEN {m(p, V.SOCIAL)} AND NOT {any_of(p, V.CAMPUS_PROJECT_WORDS)} THEN NULL WHEN {any_of(text, V.INTERN_WORDS)} THEN (CASE WHEN {m(text, V.INTERN_GRADUATE)} THEN '应届生实习' ELSE '日常实习' END) WHEN {any_of(text, V.CAMPUS_WORDS)} THEN '校招' END)"


BLOB = "coalesce(recruit_project, '') || ' ' || coalesce(title, '') || ' ' || substr(coalesce(jd_text, ''), 1, 800)"
INTERN = f"(coalesce(recruit_bucket, '') IN ('应届生实习', '日常实习') OR coalesce({bucket_sql('recruit_project', 'title')} IN ('应届生实习', '日常实习'), false) OR {any_of(BLOB, V.INTERN_PHRASES)})"
SOCIAL = f"""(CASE WHEN {m("coalesce(recruit_project, '')", V.SOCIAL)} AND NOT {any_of("coalesce(recruit_project, '')", V.CAMPUS_PROJECT_WORDS)} THEN true
  WHEN {m('jd_text', V.LABELLED_SOCIAL)} THEN true WHEN {m('jd_text', V.LABELLED_CAMPUS)} THEN false
  WHEN {any_of(BLOB, V.CAMPUS_PROJECT_WORDS + ('应届',))} THEN false ELSE {m(BLOB, V.SOCIAL)} END)"""
YEARS = "list_transform(regexp_extract_all({0}, '(20\\d{{2}}|[2-3]\\d)\\s*(?:届|应届)', 1), lambda x: CASE WHEN x::INT < 100 THEN x::INT + 2000 ELSE x::INT END)"
BATCH = "list_max(" + YEARS + ")"
TITLE_YEAR = f"coalesce({BATCH.format('title')}, try_cast(regexp_extract(title, '[（(【](20\\d{{2}})[）)】]', 1) AS INT))".replace("{{", "{").replace("}}", "}")
TARGET = f"""(CASE WHEN {INTERN} AND coalesce({BATCH.format('title')} < 2027, false) THEN 'wrong_grad_batch' WHEN {INTERN} THEN ''
  WHEN {SOCIAL} THEN 'not_target_hiring'
  WHEN coalesce(coalesce({TITLE_YEAR}, {BATCH.format("coalesce(jd_text, '')")}, try_cast(substr(graduation_batch, 1, 4) AS INT)) <> 2027, false) THEN 'wrong_grad_batch'
  WHEN coalesce({loose_sql('open_at')} < DATE '2025-01-01', false) THEN 'not_current_campus' ELSE '' END)"""
FRESH_TEXT = "coalesce(title, '') || ' ' || coalesce(jd_text, '') || ' ' || coalesce(recruit_project, '')"
STALE = f"(coalesce({loose_sql('open_at')} < DATE '2026-08-01' - 90, false) OR coalesce({loose_sql('updated_at')} < DATE '2026-08-01' - 90, false))"
FRESH = f"""(CASE WHEN coalesce(try_cast(deadline AS DATE) < DATE '2026-08-01', false) THEN 'deadline_passed'
  WHEN {any_of(FRESH_TEXT + " || ' ' || coalesce(recruit_bucket, '')", V.INTERNSHIP_WORDS)} THEN 'ok'
  WHEN {STALE} AND {any_of(FRESH_TEXT + " || ' ' || coalesce(deadline, '')", V.OPEN_WORDS + V.INTERNSHIP_WORDS)} THEN 'ok'
  WHEN {STALE} THEN 'stale_anomaly' ELSE 'ok' END)"""
END = V.RECRUIT_END


def core_sql(e: str) -> str:
    s = f"trim(regexp_replace({e}, '{rx(V.CHANNEL_SUFFIX)}', ''))"
    for x in V.COMPANY_SUFFIXES:
        s = f"regexp_replace({s}, '^(..+){x}$', '\\1')"
    return f"trim({s})"


SHELL = f"(NOT {any_of('title', V.ROLE_WORDS)} AND ((length({core_sql('company')}) >= 2 AND contains(regexp_replace(title, '{rx(END)}', ''), {core_sql('company')}) AND {m('title', END)}) OR {m('title', '^.{2,40}?' + END)}))"
MISMATCH = f"""(length({core_sql('company')}) >= 2 AND NOT (contains(title, {core_sql('company')}) OR contains(title, company) OR contains(title, substr({core_sql('company')}, 1, 4)))
  AND len(list_filter(list_transform(regexp_extract_all(title, '{rx(V.COMPANY_ENTITY)}', 1), lambda x: {core_sql('x')}), lambda e: length(e) >= 2 AND NOT (contains(e, {core_sql('company')}) OR contains({core_sql('company')}, e)) AND substr(e, 1, 2) <> substr({core_sql('company')}, 1, 2))) > 0)"""


def labelled(df: DataFrame, **columns) -> DataFrame:
    return df.select("id", *[v.alias(k) for k, v in columns.items()])


@query(f"{P} SELECT id, {noise_sql('title')} AS noise, {closed_sql('title')} AS closed, {chrome_sql('title')} AS chrome, {cut_sql('title')} AS cut FROM p")
def noise_titles(spark, sf_dir):
    """The title cascade."""
    t = F.col("title")
    return labelled(postings(spark, sf_dir), noise=T.is_noise_title(t), closed=T.is_closed_title(t), chrome=T.is_chrome_title(t), cut=T.strip_chrome(t))


@query(
    f"""SELECT doc_id, line_no, regexp_replace(regexp_replace(translate(regexp_replace(lower(trim(line)), '\\s+', '', 'g'), '{V.TITLE_PUNCTUATION.replace("'", "''")}', ''), '20\\d{{2}}届?', '', 'g'), '(^|[^0-9])[0-9]{{2}}届', '\\1', 'g') AS norm
    FROM (SELECT doc_id, cast(unnest(range(len(x))) AS BIGINT) AS line_no, unnest(x) || ' (2027届) ' || doc_id AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"""
)
def title_normalise(spark, sf_dir):
    """T01 on every line of every document."""
    from millrace.session import table

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    line = F.concat("line", F.lit(" (2027届) "), F.col("doc_id").cast("string"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.title_key(line).alias("norm"))


@query(f"{P} SELECT id, {loose_sql('open_at')} AS open_date, greatest({loose_sql('open_at')}, {loose_sql('updated_at')}, {loose_sql('created_at')}) AS age_date FROM p")
def loose_dates(spark, sf_dir):
    """D01 and the newest of three dates."""
    c = F.col
    return labelled(postings(spark, sf_dir), open_date=D.loose_date(c("open_at")), age_date=D.age_date(c("open_at"), c("updated_at"), c("created_at")))


@query(f"{P} SELECT id, greatest({loose_sql('open_at')}, {loose_sql('updated_at')}, {loose_sql('created_at')}) AS age_date FROM p WHERE coalesce(greatest({loose_sql('open_at')}, {loose_sql('updated_at')}, {loose_sql('created_at')}) < DATE '2026-08-01' - 120, false)")
def retention_expired(spark, sf_dir):
    """Rows past a retention of 120 days."""
    dates = [F.col(x) for x in ("open_at", "updated_at", "created_at")]
    p = postings(spark, sf_dir).where(D.past_retention(dates, AS_OF, 120))
    return p.select("id", D.age_date(*dates).alias("age_date"))


@query(f"{P} SELECT id, {BATCH.format('title')} AS title_year, {TITLE_YEAR} AS bare_year, coalesce({TITLE_YEAR}, {BATCH.format(chr(39) + chr(39))}, try_cast(substr(graduation_batch, 1, 4) AS INT), 2027) || '届' AS batch FROM p")
def graduation_batches(spark, sf_dir):
    """Graduation years of titles, and the resolved batch."""
    c = F.col
    return labelled(postings(spark, sf_dir), title_year=D.batch_year(c("title")), bare_year=D.title_batch_year(c("title")), batch=D.resolve_batch(c("title"), F.lit(None).cast("string"), c("graduation_batch"), AS_OF))


@query(f"{P} SELECT id, {bucket_sql('recruit_project', 'title')} AS mapped, coalesce(CASE WHEN recruit_bucket IS NOT NULL THEN {bucket_sql('recruit_bucket', 'title')} END, {bucket_sql('recruit_project', 'title')}) AS normal FROM p")
def bucket_mapping(spark, sf_dir):
    """Buckets of projects and titles."""
    c = F.col
    return labelled(postings(spark, sf_dir), mapped=C.map_bucket(c("recruit_project"), c("title")), normal=C.normal_bucket(c("recruit_bucket"), c("recruit_project"), c("title")))


@query(f"{P} SELECT id, {INTERN} AS intern, {SOCIAL} AS social, {TARGET} AS kind FROM p")
def target_kinds(spark, sf_dir):
    """Intern, social, and why a row isn't of the target season."""
    c = F.col
    return labelled(postings(spark, sf_dir), intern=C.is_intern(c("title"), c("jd_text"), c("recruit_bucket"), c("recruit_project")), social=C.is_social(c("title"), c("jd_text"), c("recruit_project")), kind=C.target_check(AS_OF)["kind"])


_CBLOB = "coalesce(recruit_project, '') || ' ' || coalesce(recruit_bucket, '') || ' ' || coalesce(raw_category, '') || ' ' || coalesce(title, '') || ' ' || substr(coalesce(jd_text, ''), 1, 800)"


@query(f"""{P} SELECT id, CASE WHEN {SOCIAL} OR ({m('raw_category', V.SOCIAL)} AND NOT {m('raw_category', V.KEEP_CAMPUS)})
  OR ({m(_CBLOB, V.SOCIAL)} AND ((NOT {m(_CBLOB, V.KEEP_CAMPUS)} AND NOT contains({_CBLOB}, '应届')) OR (contains({_CBLOB}, '社会招聘') AND NOT {m(_CBLOB, '(校园招聘|实习生招聘|日常实习)')}))) THEN 'delete' ELSE 'keep' END AS action FROM p""")
def campus_actions(spark, sf_dir):
    """Clear social hiring goes."""
    c = F.col
    return labelled(postings(spark, sf_dir), action=C.campus_action(c("title"), c("jd_text"), c("recruit_project"), c("recruit_bucket"), c("raw_category")))


@query(f"{P} SELECT id, {FRESH} AS freshness FROM p")
def freshness_class(spark, sf_dir):
    """Freshness with its reason left out."""
    return labelled(postings(spark, sf_dir), freshness=C.freshness(AS_OF)["status"])


@query(f"{P} SELECT id, CASE WHEN try_cast(deadline AS DATE) IS NULL THEN 'none' WHEN cast(deadline AS DATE) < DATE '2026-08-01' THEN 'expired' WHEN cast(deadline AS DATE) <= DATE '2026-08-08' THEN 'soon' ELSE 'later' END AS scope FROM p".replace(" cast(deadline", " try_cast(deadline"))
def deadline_scopes(spark, sf_dir):
    """none, expired, soon or later."""
    return labelled(postings(spark, sf_dir), scope=D.deadline_scope(F.col("deadline"), AS_OF))


@query(
    f"""{P} SELECT id, {core_sql('company')} AS core, contains({core_sql('company')}, 'src') AS is_source, {MISMATCH} AS mismatch, {SHELL} AS company_shell FROM p"""
)
def company_names(spark, sf_dir):
    """Cores of company names, foreign companies and shells in titles."""
    c = F.col
    core = T.company_core(c("company"))
    return labelled(postings(spark, sf_dir), core=core, is_source=F.contains(core, F.lit("src")), mismatch=T.title_mismatch(c("company"), c("title")), company_shell=C.company_recruit_title(c("company"), c("title")))


_TAGS = "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(title), {chr(39)}{w.lower()}{chr(39)})' if w.isascii() else f'contains(title, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{t}' END" for t, ws in V.TAG_WORDS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"{P} SELECT id, array_to_string({_TAGS}, ',') AS tags FROM p")
def title_tags(spark, sf_dir):
    """Coarse tags of titles."""
    return labelled(postings(spark, sf_dir), tags=F.array_join(T.tags(F.col("title")), ","))


_CONF = f"""(CASE WHEN {any_of('title', V.AGGREGATOR_WORDS)} THEN 0.1 WHEN {noise_sql('title')} THEN 0.05 WHEN {MISMATCH} THEN 0.15
  ELSE round(least(0.35 + (CASE WHEN starts_with(source_url, 'http') THEN 0.25 ELSE 0.0 END) + (CASE WHEN recruit_bucket IS NOT NULL THEN 0.15 ELSE 0.0 END)
    + (CASE WHEN length(jd_text) > 40 THEN 0.15 ELSE 0.0 END) + (CASE WHEN official THEN 0.2 ELSE 0.0 END), 1.0), 6) END)"""


@query(f"{P} SELECT id, cast({_CONF} AS DOUBLE) AS score FROM p")
def confidence_score(spark, sf_dir):
    """C11: confidence of collected rows."""
    return labelled(postings(spark, sf_dir), score=C.confidence(F.col("official"), T.is_aggregator(F.col("title"))))


@query()
def posting_scores(spark, sf_dir):
    """Score, verdict and reason (its link rule reads text and URL patterns together)."""
    return postings(spark, sf_dir).withColumn("s", C.posting_score()).select("id", "s.*")


_HOST = "lower(regexp_extract(source_url, '^[^:/?#]+://([^/?#]*)', 1))"
_TRUST = "(regexp_matches(source_url, '^https?://') AND (" + " OR ".join(f"contains({_HOST}, '{h}')" for h in V.TRUSTED_HOSTS) + "))"
_CHECK = f"""(CASE WHEN {any_of('title', V.AGGREGATOR_WORDS)} THEN 'review' WHEN {closed_sql('title')} OR {m('jd_text', V.CLOSED_TEXT)} THEN 'drop'
  WHEN {noise_sql('title')} AND NOT {SHELL} THEN 'drop' WHEN {MISMATCH} THEN 'review' WHEN NOT official AND NOT {_TRUST} THEN 'verify'
  WHEN recruit_project IS NULL OR confidence < 0.55 THEN 'review' ELSE 'publish' END)"""
_KIND = f"""(CASE WHEN {any_of('title', V.AGGREGATOR_WORDS)} THEN 'aggregator' WHEN {MISMATCH} THEN 'title_mismatch' WHEN recruit_project IS NULL THEN 'missing_fields' ELSE 'low_confidence' END)"""
_EARLY = f"({closed_sql('title')} OR {m('jd_text', V.CLOSED_TEXT)} OR ({noise_sql('title')} AND NOT contains(title, company) AND NOT {SHELL}))"
_ROUTE = f"""SELECT id, CASE WHEN {_EARLY} THEN 'drop' WHEN {TARGET} <> '' THEN 'review' WHEN {FRESH} = 'deadline_passed' THEN 'drop' WHEN {FRESH} = 'stale_anomaly' THEN 'review' ELSE {_CHECK} END AS route,
  CASE WHEN {_EARLY} THEN '' WHEN {TARGET} <> '' THEN {TARGET} WHEN {FRESH} = 'deadline_passed' THEN '' WHEN {FRESH} = 'stale_anomaly' THEN 'stale_over_3m' WHEN {_CHECK} = 'review' THEN {_KIND} ELSE '' END AS kind FROM p"""


@query(f"{P} {_ROUTE}")
def publish_route(spark, sf_dir):
    """Publish, review, verify or drop."""
    return C.routed(postings(spark, sf_dir), AS_OF, F.col("official"), U.is_trusted(F.col("source_url")), T.is_aggregator(F.col("title"))).select("id", "route", "kind")


@query(f"{P}, r AS ({_ROUTE}) SELECT route, kind, count(*) AS n FROM r GROUP BY ALL")
def route_counts(spark, sf_dir):
    """Routed rows by kind."""
    return publish_route(spark, sf_dir).groupBy("route", "kind").agg(F.count(F.lit(1)).alias("n"))


_REASONS = f"""list_filter([CASE WHEN {noise_sql('title')} THEN '岗位名称无效' END, CASE WHEN length({sqz("coalesce(jd_text, '')")}) < 10 THEN '岗位要求不完整' END,
  CASE WHEN length({sqz("coalesce(recruit_project, '')")}) < 10 THEN '任职要求不完整' END,
  CASE WHEN {loose_sql('open_at')} IS NULL THEN '岗位发布时间缺失' WHEN {loose_sql('open_at')} < DATE '2026-08-01' - 90 THEN '岗位发布时间超过3个月' WHEN {loose_sql('open_at')} > DATE '2026-08-01' THEN '岗位发布时间晚于今天' END], lambda x: x IS NOT NULL)"""


@query(f"{P} SELECT reason, count(*) AS n FROM (SELECT unnest({_REASONS}) AS reason FROM p) GROUP BY reason")
def auto_review_reasons(spark, sf_dir):
    """Histogram of the reasons against automatic approval."""
    reasons = C.review_reasons(AS_OF, F.col("jd_text"), F.col("recruit_project"))
    return vote.histogram(postings(spark, sf_dir).withColumn("reasons", reasons), "reasons")


_KEY = "regexp_replace(regexp_replace(translate(regexp_replace(lower(title), '\\s+', '', 'g'), '" + V.TITLE_PUNCTUATION.replace("'", "''") + "', ''), '20\\d{2}届?', '', 'g'), '(^|[^0-9])[0-9]{2}届', '\\1', 'g')"


@query(
    f"""{P} SELECT id, company, title_key FROM (
    SELECT id, company, {_KEY} AS title_key, row_number() OVER (PARTITION BY company, {_KEY}
      ORDER BY regexp_matches(source_url, '/detail$') DESC, confidence DESC, length(coalesce(jd_text, '')) DESC, updated_at DESC, id) AS n FROM p) WHERE n = 1"""
)
def dedupe_by_title_quality(spark, sf_dir):
    """The best posting of each company and title."""
    p = postings(spark, sf_dir).withColumns({"company_key": F.col("company"), "title_key": T.title_key(F.col("title")), "has_detail": F.rlike("source_url", F.lit("/detail$")), "jd_len": F.length(T.or_empty(F.col("jd_text")))})
    return dedupe.best_by_title(p).select("id", "company", "title_key")


@query()
def clean_up_fates(spark, sf_dir):
    """What the clean-up does to every posting."""
    c = F.col
    p = postings(spark, sf_dir).withColumns({"company_key": T.company_key(c("company")), "title_key": T.title_key(c("title")), "identity": U.identity_url(c("source_url")), "has_detail": U.is_detail_url(c("source_url")), "jd_len": F.length(T.or_empty(c("jd_text"))), "is_shell": C.is_portal_shell(c("title"), c("jd_text"))})
    return dedupe.clean_up(p).select("id", "fate")


@query(
    f"""{P} SELECT id, regexp_replace(lower(regexp_extract(source_url, '^([^:/?#]+):', 1)) || '://' || lower(regexp_extract(source_url, '^[^:/?#]+://([^/?#]*)', 1)) || regexp_replace(regexp_extract(source_url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '')
      || CASE WHEN contains(source_url, 'jobId=') THEN '?jobId=' || id ELSE '' END, '^ftp://x$', 'ftp://x') AS identity,
    CASE WHEN {_TRUST} THEN true ELSE false END AS trusted, regexp_matches(lower(source_url), 'login') AS nav FROM p"""
)
def posting_urls(spark, sf_dir):
    """T02, T03, F11, F15 on posting URLs."""
    u = F.col("source_url")
    return labelled(postings(spark, sf_dir), identity=U.identity_url(u), trusted=U.is_trusted(u), nav=U.is_nav_url(u))


@query(
    f"""{P} SELECT id, coalesce(nullif(trim(title), ''), '-') AS title, CASE WHEN length(s) <= 96 THEN s ELSE substr(s, 1, 95) || '…' END AS preview,
    coalesce(recruit_project, '-') AS project, replace(substr(coalesce(open_at, ''), 1, 16), 'T', ' ') AS page_updated
    FROM (SELECT *, trim(regexp_replace(coalesce(jd_text, ''), '\\s+', ' ', 'g')) AS s FROM p)"""
)
def display_rows(spark, sf_dir):
    """The review projection."""
    c = F.col
    updated = F.left(F.replace(F.coalesce(T.non_blank(c("open_at")), T.non_blank(c("list_updated_at")), T.non_blank(c("published_at")), F.lit("")), F.lit("T"), F.lit(" ")), F.lit(16))
    return labelled(postings(spark, sf_dir), title=T.or_dash(c("title")), preview=T.clip(c("jd_text")), project=T.or_dash(c("recruit_project")), page_updated=updated)


@query(
    f"""{P} SELECT id, title, updated_at FROM p WHERE status IN ('active', 'pending_review') AND (contains(lower(title), 'java') OR contains(lower(company), 'java') OR contains(lower(coalesce(recruit_project, '')), 'java'))
    AND (recruit_bucket IN ('应届生实习', '日常实习') OR graduation_batch = '2027届' OR contains(title, '2027届')) ORDER BY updated_at DESC, id LIMIT 50"""
)
def list_postings_keyword(spark, sf_dir):
    """Keyword, target season, order and limit (the list's own page size)."""
    found = Q.list_postings(postings(spark, sf_dir), status=("active", "pending_review"), keyword="JAVA", target_as_of=AS_OF, limit=50)
    return found.select("id", "title", "updated_at")


@query()
def section_split(spark, sf_dir):
    """T13, T14 over all documents: lengths of duties and requirements, and a labelled type
    (``section_texts`` and ``labelled_facts`` have twins on hand-written texts)."""
    p = postings(spark, sf_dir).withColumn("l", L.labelled_fields(F.col("jd_text"))).withColumn("s", L.split_sections(F.col("jd_text"), F.col("l")))
    return p.select("id", F.length("s.duties").alias("duties_len"), F.length("s.requirements").alias("reqs_len"), F.try_element_at("l", F.lit("recruit_type")).alias("recruit_type"))


@query("SELECT doc_id, " + any_of("text", V.AGGREGATOR_WORDS) + " OR contains(text, 'idiot') AS flagged FROM documents")
def aggregator_flag(spark, sf_dir):
    """F17 with a pattern of the blocklist."""
    from millrace.session import table

    return table(spark, sf_dir, "documents").select("doc_id", T.is_aggregator(F.col("text"), ("idiot",)).alias("flagged"))




def _word_of(number: str) -> str:
    """A project word (or none) by a number from 0 to 10, in SQL."""
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(V.PROJECT_WORDS)) + " ELSE '' END"


#: Whole documents with project words in the title and at two places of the text (SQL of both
#: engines).
_WORDED = f"""SELECT doc_id AS id, substr(coalesce(text, ''), 1, 40) || CASE doc_id % 3 WHEN 0 THEN {_word_of('doc_id % 11')} ELSE '' END || CASE doc_id % 4 WHEN 0 THEN ' 算法开发' WHEN 1 THEN ' 市场QA' ELSE '' END AS title,
  substr(coalesce(text, ''), 1, 300 * CAST(doc_id % 7 AS INT)) || {_word_of("CAST((doc_id % 121 - doc_id % 11) / 11 AS BIGINT)")} || substr(coalesce(text, ''), 300 * CAST(doc_id % 7 AS INT) + 1) || {_word_of("doc_id % 13")} AS body FROM documents"""
_FIRST_WORD = "CASE " + " ".join(f"WHEN contains(title || ' ' || body, '{w}') THEN '{w}'" for w in V.PROJECT_WORDS) + " END"


@query(f"SELECT id, project, {bucket_sql('project', 'title')} AS bucket, array_to_string({_TAGS}, ',') AS tags FROM (SELECT *, {_FIRST_WORD} AS project FROM ({_WORDED}))")
def classified_texts(spark, sf_dir):
    """Project, bucket and tags of whole titles and texts."""
    rows = run_sql(spark, sf_dir, _WORDED).withColumn("x", C.classified(F.col("title"), F.col("body")))
    return rows.select("id", "x.project", "x.bucket", F.array_join("x.tags", ",").alias("tags"))
