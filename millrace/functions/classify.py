"""Rule classification of postings: hiring kind, freshness, scores, routes.

Every rule is one Column expression over the posting columns (title, jd_text, source_url,
recruit_project, recruit_bucket, graduation_batch, company, open_at, published_at, updated_at,
created_at, deadline, confidence); missing values never raise.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.functions import vocab as V

c = F.col


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *[T.or_empty(p) for p in parts])


def _window(text: Column) -> Column:
    return F.left(T.or_empty(text), F.lit(V.TEXT_WINDOW))


def map_bucket(project: Column, title: Column) -> Column:
    """Bucket of a project and title: a social project blocks, intern words come first."""
    return T.let(T.strip(T.or_empty(project)), lambda p: T.let(_joined(p, title), lambda text: _mapped(p, text)))


def _mapped(p: Column, text: Column) -> Column:
    social = T.matches_cjk(p, V.SOCIAL) & ~T.has_any(p, V.CAMPUS_PROJECT_WORDS)
    intern = F.when(T.matches(text, V.INTERN_GRADUATE), "应届生实习").otherwise("日常实习")
    return F.when(social, F.lit(None)).when(T.has_any(text, V.INTERN_WORDS), intern).when(T.has_any(text, V.CAMPUS_WORDS), "校招")


def normal_bucket(bucket: Column, project: Column, title: Column) -> Column:
    return F.coalesce(F.when(T.strip(T.or_empty(bucket)) != "", map_bucket(bucket, title)), map_bucket(project, title))


def project_of(title: Column, body: Column) -> Column:
    """First of the ordered project words in title or body."""
    return T.let(_joined(title, body), lambda text: F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in V.PROJECT_WORDS]))


def classified(title: Column, body: Column) -> Column:
    """Project (the first of the ordered words in title or body), its bucket, and the title's
    tags, as one struct."""
    return T.let(project_of(title, body), lambda p: F.struct(p.alias("project"), map_bucket(p, title).alias("bucket"), T.tags(title).alias("tags")))


def is_intern(title: Column, jd: Column, bucket: Column, project: Column) -> Column:
    kinds = ("应届生实习", "日常实习")
    mapped = F.coalesce(map_bucket(project, title).isin(*kinds), F.lit(False))
    return T.strip(T.or_empty(bucket)).isin(*kinds) | mapped | T.let(_joined(project, title, _window(jd)), lambda blob: T.has_any(blob, V.INTERN_PHRASES))


def is_social(title: Column, jd: Column, project: Column) -> Column:
    """Social hiring: the project's word, then labels in the text, then words at large."""
    return T.let(T.strip(T.or_empty(project)), lambda p: T.let(_joined(p, title, _window(jd)), lambda blob: _social(p, blob, jd)))


def _social(p: Column, blob: Column, jd: Column) -> Column:
    return (
        F.when(T.matches_cjk(p, V.SOCIAL) & ~T.has_any(p, V.CAMPUS_PROJECT_WORDS), True)
        .when(T.matches_cjk(jd, V.LABELLED_SOCIAL), True)
        .when(T.matches_cjk(jd, V.LABELLED_CAMPUS), False)
        .when(T.has_any(blob, V.CAMPUS_PROJECT_WORDS + ("应届",)), False)
        .otherwise(T.matches_cjk(blob, V.SOCIAL))
    )


def _social_of(p: Column, pair: Column, jd: Column, head: Column, whole: Column) -> Column:
    """``_social`` over the hits of the text's head and of the whole text."""
    labelled = T.among(whole, V.LABELS_OF_KIND)
    campus = V.CAMPUS_PROJECT_WORDS + ("应届",)
    return (
        F.when(T.matches_cjk(p, V.SOCIAL) & ~T.has_any(p, V.CAMPUS_PROJECT_WORDS), True)
        .when(labelled & T.matches_cjk(jd, V.LABELLED_SOCIAL), True)
        .when(labelled & T.matches_cjk(jd, V.LABELLED_CAMPUS), False)
        .when(T.has_any(pair, campus) | T.among(head, campus), False)
        .otherwise(T.matches_cjk(pair, V.SOCIAL) | T.among(head, V.SOCIAL_WORDS))
    )


def campus_action(title: Column, jd: Column, project: Column, bucket: Column, category: Column) -> Column:
    """delete for clear social hiring, else keep."""
    return T.let(_joined(project, bucket, category, title, _window(jd)), lambda blob: _action(blob, title, jd, project, category))


def _action(blob: Column, title: Column, jd: Column, project: Column, category: Column) -> Column:
    by_category = T.matches_cjk(category, V.SOCIAL) & ~T.matches_cjk(category, V.KEEP_CAMPUS)
    bare = ~T.matches_cjk(blob, V.KEEP_CAMPUS) & ~F.contains(blob, F.lit("应届"))
    strong = F.contains(blob, F.lit("社会招聘")) & ~T.matches(blob, "(校园招聘|实习生招聘|日常实习)")
    return F.when(is_social(title, jd, project) | by_category | (T.matches_cjk(blob, V.SOCIAL) & (bare | strong)), "delete").otherwise("keep")


def dates_of() -> dict[str, Column]:
    """The dates of a posting's date columns."""
    return {k: D.loose_date(c(k)) for k in ("open_at", "published_at", "updated_at", "deadline")}


def target_facts(title: Column, jd: Column, intern: Column, social: Column, d: dict[str, Column], batch: Column | None = None) -> dict[str, Column]:
    """What the season check looks at; ``batch`` is the text's year where it is known."""
    own = F.when(F.rlike(T.strip(T.or_empty(c("graduation_batch"))), F.lit(r"^20\d{2}届$")), F.left(T.strip(c("graduation_batch")), F.lit(4)).try_cast("int"))
    return {
        "intern": intern,
        "title_year": D.batch_year(title),
        "year": F.coalesce(D.title_batch_year(title), D.batch_year(jd) if batch is None else batch, own),
        "published": F.coalesce(d["open_at"], d["published_at"]),
        "social": social,
    }


def target_verdict(f, as_of: date) -> Column:
    """The season check over its facts (columns by name, or a struct)."""
    target, cutoff, year = D.target_year(as_of), D.publish_cutoff(as_of), f["year"]
    say = lambda ok, kind, reason: F.struct(F.lit(ok).alias("ok"), F.lit(kind).alias("kind"), reason.alias("reason"))
    named = lambda year: F.concat(year.cast("string"), F.lit("届"))
    return (
        F.when(f["intern"] & F.coalesce(f["title_year"] < target, F.lit(False)), say(False, "wrong_grad_batch", F.concat(F.lit("实习岗标题含旧届"), named(f["title_year"]), F.lit(f"，当前目标为{target}届"))))
        .when(f["intern"], say(True, "", F.lit("")))
        .when(f["social"], say(False, "not_target_hiring", F.lit("社招/非目标招聘（非日常实习且非目标应届校招）")))
        .when(F.coalesce(year < target, F.lit(False)), say(False, "wrong_grad_batch", F.concat(F.lit("校招届别为"), named(year), F.lit(f"，当前目标为{target}届"))))
        .when(F.coalesce(year > target, F.lit(False)), say(False, "wrong_grad_batch", F.concat(F.lit("校招届别为"), named(year), F.lit(f"，与目标{target}届不符"))))
        .when(F.coalesce(f["published"] < F.lit(cutoff), F.lit(False)), say(False, "not_current_campus", F.concat(F.lit("发布时间 "), f["published"].cast("string"), F.lit(f" 早于目标届{target}届招聘季窗口（{cutoff.isoformat()} 起），非当年校招信息"))))
        .otherwise(say(True, "", F.lit("")))
    )


def target_check(as_of: date) -> Column:
    """struct(ok, kind, reason): intern postings, or campus postings of the target season."""
    title, jd = c("title"), c("jd_text")
    facts = target_facts(title, jd, is_intern(title, jd, c("recruit_bucket"), c("recruit_project")), is_social(title, jd, c("recruit_project")), dates_of())
    return T.let(F.struct(*[v.alias(k) for k, v in facts.items()]), lambda f: target_verdict(f, as_of))


def is_stale_batch(batch: Column, bucket: Column, title: Column, as_of: date) -> Column:
    year = F.regexp_extract(T.strip(T.or_empty(batch)), r"^(20\d{2})届$", 1).try_cast("int")
    return ~F.contains(_joined(bucket, title), F.lit("实习")) & F.coalesce(year < D.target_year(as_of), F.lit(False))


def freshness_facts(as_of: date, days: int, d: dict[str, Column], whole: Column | None = None) -> dict[str, Column]:
    """What the freshness check looks at; ``whole`` are the text's hits where they are known."""
    fields = (c("title"), c("recruit_project"), *([c("jd_text")] if whole is None else []))
    says = lambda other, words: T.has_any(_joined(*fields, c(other)), words) | (F.lit(False) if whole is None else T.among(whole, words))
    published = F.when(T.strip(T.or_empty(c("open_at"))) != "", d["open_at"]).otherwise(d["published_at"])
    return {
        "intern": says("recruit_bucket", V.INTERNSHIP_WORDS),
        "hiring": says("deadline", V.OPEN_WORDS + V.INTERNSHIP_WORDS),
        "stale": D.any_before([published, d["open_at"], d["updated_at"]], as_of, days),
        "passed": F.coalesce(d["deadline"] < F.lit(as_of), F.lit(False)),
    }


def freshness_verdict(f, days: int) -> Column:
    """The freshness check over its facts."""
    say = lambda status, reason: F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    return (
        F.when(f["passed"], say("deadline_passed", "截止日期已过"))
        .when(f["intern"], say("ok", "实习岗位纳入正常"))
        .when(f["stale"] & f["hiring"], say("ok", "超窗但仍在招"))
        .when(f["stale"], say("stale_anomaly", f"最新信息发布时间超过近{days}天（约{max(1, days // 30)}个月），判为异常"))
        .otherwise(say("ok", "ok"))
    )


def freshness(as_of: date, days: int = V.LOOKBACK_DAYS) -> Column:
    """struct(status, reason): deadline_passed, stale_anomaly or ok."""
    return T.let(F.struct(*[v.alias(k) for k, v in freshness_facts(as_of, days, dates_of()).items()]), lambda f: freshness_verdict(f, days))


def recruit_title_of(t: Column, core: Column) -> Column:
    """``company_recruit_title`` of a trimmed title and a company's core."""
    # the core may hold any characters: compare the title's head with it instead of a pattern
    named = (F.length(core) >= 2) & F.contains(F.regexp_replace(t, V.RECRUIT_END, ""), core) & T.matches(t, V.RECRUIT_END)
    return ~T.has_any(t, V.ROLE_WORDS) & (named | T.matches(t, r"^.{2,40}?" + V.RECRUIT_END))


def company_recruit_title(company: Column, title: Column) -> Column:
    """A company's name with a recruiting word instead of a role."""
    return T.let(T.strip(T.or_empty(title)), lambda t: T.let(T.company_core(company), lambda core: recruit_title_of(t, core)))


def real_title(company: Column, title: Column) -> Column:
    return T.let(T.strip(T.or_empty(title)), lambda t: (F.length(t) >= 2) & ~T.is_noise_title(t) & ~company_recruit_title(company, t) & (T.has_any(t, V.ROLE_WORDS) | T.matches(t, V.REAL_TITLE_PARTS)))


def is_portal_shell(title: Column, jd: Column) -> Column:
    t, text = T.strip(T.or_empty(title)), T.strip(T.or_empty(jd))
    return T.is_noise_title(t) | T.has_any(t, V.SHELL_TITLE_WORDS) | ((F.length(text) < V.LEAST_TEXT) & ~T.matches(t, V.REAL_TITLE_PARTS))


def posting_score() -> Column:
    """struct(ok, score, reason): whether a row is a posting, in ordered gates."""
    t, jd, url, company = T.strip(T.or_empty(c("title"))), T.strip(T.or_empty(c("jd_text"))), T.or_empty(c("source_url")), c("company")
    facts = F.struct(
        t.alias("t"), F.length(jd).alias("n"), T.is_noise_title(t).alias("noise"), T.is_closed_title(t).alias("closed"), T.is_closed_text(jd).alias("closed_text"),
        U.is_nav_url(url, t).alias("nav"), T.title_mismatch(company, t).alias("mismatch"), company_recruit_title(company, t).alias("shell"),
        real_title(company, t).alias("real"), U.is_detail_link(url, t).alias("detail"), T.matches(url, V.DETAIL_URL).alias("detail_url"),
        T.has_any(jd, V.SECTION_WORDS).alias("sections"), T.has_any(t, V.ROLE_WORDS).alias("role"),
    )
    say = lambda ok, score, reason: F.struct(F.lit(ok).alias("ok") if isinstance(ok, bool) else ok.alias("ok"), (F.lit(score) if isinstance(score, float) else score).alias("score"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    part = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(0.0))

    def score_of(f: Column) -> Column:
        n = f["n"]
        url_part = F.when(f["detail"], 0.2).when(f["detail_url"], 0.15).otherwise(0.0)
        text_part = F.when(n >= 80, 0.2).when(n >= V.LEAST_TEXT, 0.1).when(n > 0, 0.0).otherwise(-0.15)
        raw = F.lit(0.2) + F.when(f["real"], 0.35).otherwise(0.05) + url_part + text_part + part(f["sections"], 0.1) + part(f["role"], 0.05)
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 6)

    def judged(f: Column, score: Column) -> Column:
        n, real, passed = f["n"], f["real"], score >= V.PASS_MARK
        why = F.concat_ws("；", F.when(real, "标题像职位名"), F.when(f["detail"], "URL像详情"), F.when(n >= 80, "有JD正文"), F.when(f["sections"], "JD含职责/要求"), F.when(n == 0, "无JD"))
        weak = F.concat(F.lit("岗位置信不足("), F.format_number(score, 2), F.lit(")："), why)
        return (
            F.when(f["t"] == "", say(False, 0.05, "无岗位标题"))
            .when(f["noise"], say(False, 0.05, F.when(f["closed"], "噪声标题（关停/内推壳页）").otherwise("噪声标题（导航/登录/门户壳页）")))
            .when(f["closed_text"], say(False, 0.05, "详情表明职位已关闭或仅内部推荐"))
            .when(f["nav"], say(False, 0.08, "导航/登录类链接"))
            .when(f["mismatch"], say(False, 0.12, "标题公司名与种子严重不符"))
            .when(f["shell"], say(False, F.when(n >= 80, 0.25).otherwise(0.15), "标题像公司名+校园招聘（非具体岗位）"))
            .when(~real, say(False, score, "缺少真实职位名"))
            .when(n < V.LEAST_TEXT, say(False, F.least(score, F.lit(0.45)), "无岗位介绍/JD"))
            .otherwise(say(passed, score, F.when(passed, F.coalesce(F.nullif(why, F.lit("")), F.lit("ok"))).otherwise(weak)))
        )

    return T.let(facts, lambda f: T.let(score_of(f), lambda score: judged(f, score)))


def confidence(official: Column, aggregator: Column) -> Column:
    """Confidence of a collected row."""
    part = lambda test, x: F.when(F.coalesce(test, F.lit(False)), F.lit(x)).otherwise(F.lit(0.0))
    total = part(T.or_empty(c("title")) != "", 0.35) + part(F.startswith(c("source_url"), F.lit("http")), 0.25) + part(T.or_empty(c("recruit_bucket")) != "", 0.15) + part(F.length("jd_text") > V.LEAST_TEXT, 0.15) + part(official, 0.2)
    return F.when(aggregator, 0.1).when(T.is_noise_title(c("title")), 0.05).when(T.title_mismatch(c("company"), c("title")), 0.15).otherwise(F.round(F.least(total, F.lit(1.0)), 6))


def publish_verdict(f, official: Column, trusted: Column, aggregator: Column, least: float) -> Column:
    """The gates before publication over the facts closed, noise, shell and mismatch."""
    conf = F.coalesce(c("confidence"), F.lit(0.0))
    say = lambda ok, reason: F.struct(F.lit(ok).alias("ok"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    missing = (T.or_empty(c("title")) == "") | (T.or_empty(c("source_url")) == "") | (T.or_empty(c("recruit_project")) == "")
    return (
        F.when(aggregator, say(False, V.CHECK_TEXTS["aggregator"]))
        .when(f["closed"], say(False, V.CHECK_TEXTS["closed"]))
        .when(f["noise"] & ~f["shell"], say(False, V.CHECK_TEXTS["noise"]))
        .when(f["mismatch"], say(False, V.CHECK_TEXTS["mismatch"]))
        .when(~official & ~trusted, say(False, V.CHECK_TEXTS["source"]))
        .when(missing, say(False, V.CHECK_TEXTS["missing"]))
        .when(conf < least, say(False, F.concat(F.lit(V.CHECK_TEXTS["confidence"] + " ("), F.format_number(conf, 2), F.lit(")"))))
        .otherwise(say(True, "ok"))
    )


def publish_check(official: Column, trusted: Column, aggregator: Column, least: float = V.PASS_MARK) -> Column:
    """struct(ok, reason): ordered gates before a row is published."""
    title = c("title")
    facts = {"closed": T.is_closed_title(title) | T.is_closed_text(c("jd_text")), "noise": T.is_noise_title(title), "shell": company_recruit_title(c("company"), title), "mismatch": T.title_mismatch(c("company"), title)}
    return publish_verdict(facts, official, trusted, aggregator, least)


def review_kind(reason: Column) -> Column:
    r = T.or_empty(reason)
    return F.when(T.has_any(r, ("置信度", "岗位置信")), "low_confidence").when(F.contains(r, F.lit("汇总")), "aggregator").when(F.contains(r, F.lit("不符")), "title_mismatch").when(F.contains(r, F.lit("硬字段")), "missing_fields").otherwise("needs_review")


def with_title_facts(rows: DataFrame) -> DataFrame:
    """``rows`` with __raw, __core, __closed_title, __noise, __shell and __mismatch of title
    and company. Facts are columns in stages, so each is computed once and the plan stays
    small however often the rules mention them."""
    at = F.col
    one = rows.withColumns({"__raw": T.strip(T.or_empty(c("title"))), "__company": T.strip(T.or_empty(c("company")))})
    two = one.withColumns({"__cut": T.strip_chrome(at("__raw")), "__compact0": T.squeeze(at("__raw")), "__core": T.company_core(at("__company"))})
    three = two.withColumns({"__t": F.coalesce("__cut", "__raw"), "__cut_compact": T.squeeze(at("__cut"))})
    four = three.withColumns({
        "__compact": F.coalesce("__cut_compact", "__compact0"),
        "__chrome_raw": T.chrome_of(at("__raw"), at("__compact0")),
        "__chrome_cut": F.when(at("__cut") == at("__raw"), F.lit(None)).otherwise(T.chrome_of(at("__cut"), at("__cut_compact"))),
        "__closed_title": T.matches(at("__compact0"), V.CLOSED_TITLE) | T.matches(at("__raw"), V.CLOSED_TITLE),
        "__shell": recruit_title_of(at("__raw"), at("__core")),
        "__mismatch": T.mismatch_of(at("__company"), at("__raw"), at("__core")),
    })
    closed = T.matches(at("__compact"), V.CLOSED_TITLE) | T.matches(at("__t"), V.CLOSED_TITLE)
    noise = T.noise_cascade(at("__raw"), at("__cut"), at("__t"), at("__compact"), at("__compact0"), at("__chrome_raw"), F.coalesce("__chrome_cut", "__chrome_raw"), closed)
    return four.withColumn("__noise", noise).drop("__cut", "__compact0", "__t", "__cut_compact", "__compact", "__chrome_raw", "__chrome_cut")


def routed(rows: DataFrame, as_of: date, official: Column, trusted: Column, aggregator: Column, *, days: int = V.LOOKBACK_DAYS, least: float = V.PASS_MARK) -> DataFrame:
    """``rows`` with route (publish, review, verify or drop), kind and reason."""
    names, at = rows.columns, F.col
    title, jd, project = c("title"), c("jd_text"), T.strip(T.or_empty(c("recruit_project")))
    facts = with_title_facts(rows).withColumns({"__p": project, "__head": T.hits(_window(jd)), "__whole": T.hits(jd), "__pair": _joined(c("recruit_project"), title), **{f"__d_{k}": v for k, v in dates_of().items()}})
    days_of = {k: at(f"__d_{k}") for k in ("open_at", "published_at", "updated_at", "deadline")}
    kinds = ("应届生实习", "日常实习")
    intern = T.strip(T.or_empty(c("recruit_bucket"))).isin(*kinds) | F.coalesce(_mapped(at("__p"), at("__pair")).isin(*kinds), F.lit(False)) | T.has_any(at("__pair"), V.INTERN_PHRASES) | T.among(at("__head"), V.INTERN_PHRASES)
    batch = F.when(T.among(at("__whole"), ("届",)), D.batch_year(jd))
    target = target_facts(title, jd, intern, _social_of(at("__p"), at("__pair"), jd, at("__head"), at("__whole")), days_of, batch)
    fresh = freshness_facts(as_of, days, days_of, at("__whole"))
    told = facts.withColumns({"__closed": at("__closed_title") | T.among(at("__whole"), V.CLOSED_WORDS), **{f"__t_{k}": v for k, v in target.items()}, **{f"__f_{k}": v for k, v in fresh.items()}})
    checked = told.withColumns({
        "__target": target_verdict({k: at(f"__t_{k}") for k in target}, as_of),
        "__fresh": freshness_verdict({k: at(f"__f_{k}") for k in fresh}, days),
        "__check": publish_verdict({k: at(f"__{k}") for k in ("closed", "noise", "shell", "mismatch")}, official, trusted, aggregator, least),
    })
    say = lambda to, kind, reason: F.struct(F.lit(to).alias("route"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), reason.alias("reason"))
    target, fresh, check = at("__target"), at("__fresh"), at("__check")
    noise = at("__noise") & ~F.contains(T.or_empty(title), c("company")) & ~at("__shell")
    to = (
        F.when(at("__closed"), say("drop", "", F.lit("closed")))
        .when(noise, say("drop", "", F.lit("noise")))
        .when(~target["ok"], say("review", target["kind"], target["reason"]))
        .when(fresh["status"] == "deadline_passed", say("drop", "", fresh["reason"]))
        .when(fresh["status"] == "stale_anomaly", say("review", "stale_over_3m", fresh["reason"]))
        .when(check["ok"], say("publish", "", F.lit("ok")))
        .when(is_source_reject(check["reason"]), say("verify", "", check["reason"]))
        .when(is_noise_skip(check["reason"]), say("drop", "", check["reason"]))
        .otherwise(say("review", review_kind(check["reason"]), check["reason"]))
    )
    return checked.withColumn("__r", to).select(*names, "__r.*")


def is_source_reject(reason: Column) -> Column:
    """Reasons about a source's trust, which go to source verification."""
    return F.contains(T.or_empty(reason), F.lit("源未验证"))


def is_noise_skip(reason: Column) -> Column:
    """Reasons that skip a row without any review."""
    return T.has_any(reason, ("关停", "内部推荐", "噪声标题"))


def review_reasons(as_of: date, duties: Column, requirements: Column, least: int = 10, months: int = V.REVIEW_MONTHS) -> Column:
    """Reasons against automatic approval; an empty array is eligible."""
    published = F.coalesce(D.loose_date(c("open_at")), D.loose_date(c("list_updated_at")), D.loose_date(c("published_at")))
    size = lambda x: F.length(T.squeeze(T.or_empty(x)))
    age = lambda day: F.when(day.isNull(), "岗位发布时间缺失").when(day < D.list_cutoff(as_of, months), "岗位发布时间超过3个月").when(day > F.lit(as_of), "岗位发布时间晚于今天")
    return F.array_compact(
        F.array(
            F.when(T.strip(T.or_empty(c("company"))) == "", "公司缺失"),
            F.when(T.is_noise_title(c("title")), "岗位名称无效"),
            F.when(size(duties) < least, "岗位要求不完整"),
            F.when(size(requirements) < least, "任职要求不完整"),
            T.let(published, age),
        )
    )
