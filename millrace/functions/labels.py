"""Labelled fields and sections of a job text, and the scalars made of them; all Column
expressions. A text is cut at its labels by marking them and splitting at the marks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import text as T
from millrace.functions import vocab as V

# fixed values: labels by the field that they open, in the order of their first mention
LABELS = {
    "recruit_type": ("招聘类型", "招聘类别", "招聘项目", "类型"),
    "work_type": ("工作性质", "工作类型", "职位类型", "岗位类型"),
    "raw_category": ("岗位类别", "职能类别"),
    "open_at": ("岗位发布时间", "发布时间", "发布日期", "开放时间", "更新日期", "更新时间"),
    "deadline": ("截止时间", "截止日期", "投递截止", "报名截止"),
    "work_location": ("工作地点", "工作地", "工作城市", "办公地点", "办公地址", "所在城市", "上班地点", "岗位地址", "工作地址", "base地"),
    "title": ("职位名称", "岗位名称"),
    "company": ("公司名称", "招聘单位", "用人单位", "所属公司"),
    "education": ("学历要求", "学历层次"),
    "salary_range": ("薪资范围", "薪酬范围", "薪资待遇", "薪酬待遇", "薪资", "月薪", "年薪", "薪酬", "待遇"),
    "headcount": ("招聘人数", "需求人数", "用人名额", "招人人数", "招聘名额", "招若干人"),
    "jd_major": ("专业要求", "专业需求"),
    "jd_duties": (
        "工作职责", "岗位职责", "职位职责", "主要职责", "核心职责", "工作任务", "岗位使命", "你将负责", "你需要做", "您将负责", "您需要做", "职位概述", "职位描述",
        "岗位描述", "工作描述", "岗位介绍", "工作内容", "职责描述", "我们需要你", "Job Description", "Job Responsibilities", "Key Responsibilities",
        "Role Responsibilities", "Your Responsibilities", "Responsibilities", "Job Duties", "Duties", "What you'll do", "What you’ll do", "What you will do", "What you do",
    ),
    "jd_requirements": (
        "任职要求", "任职职责", "任职资格", "岗位要求", "能力要求", "资格要求", "岗位资格", "任职标准", "基本条件", "胜任条件", "申请资格", "职位要求", "你需要具备",
        "您需要具备", "我们希望你", "我们期望你", "任职条件", "Job Requirements", "Essential Requirements", "Preferred Qualifications", "Requirements", "Qualifications",
        "Skills", "Who you are", "Who We're Looking For", "Who We’re Looking For", "What we're looking for", "What we’re looking for", "What we are looking for",
        "About you", "Must Have", "Nice to Have",
    ),
}
#: A heading that the split counts as duties although the fields count it as requirements.
DUTY_TOO = ("岗位要求",)
STOP_HEADINGS = ("福利待遇", "薪酬福利", "员工福利", "职位亮点", "公司介绍", "企业介绍", "关于我们", "申请方式", "投递方式", "联系方式", "工作地点", "办公地点", "薪资待遇", "其他信息")
NUMBERED = r"(?:(?:[一二三四五六七八九十]+|\d+)\s*[、.．)]\s*|[（(](?:[一二三四五六七八九十]+|\d+)[）)]\s*)?"
RECRUIT_TYPES = r"^(校园招聘|社会招聘|实习生招聘|校招|社招|应届生实习|日常实习|暑期实习|暑假实习|寒假实习|秋招|春招|全职|实习)"
PORTAL_CHROME = r"(招聘系统|校园招聘|社会招聘|实习生招聘|欢迎登录|个人中心)"
META_LABELS = (
    "岗位名称", "职位名称", "招聘类别", "招聘类型", "招聘项目", "工作性质", "工作类型", "职位类型", "岗位类型", "岗位类别", "职能类别", "工作地点", "工作城市", "上班地点",
    "岗位地址", "工作地址", "base地", "公司名称", "招聘单位", "用人单位", "所属公司", "学历要求", "学历层次", "薪资范围", "薪酬范围", "薪资待遇", "薪酬待遇", "薪资", "月薪",
    "年薪", "薪酬", "待遇", "招聘人数", "需求人数", "用人名额", "招人人数", "招聘名额", "招若干人", "截止时间", "截止日期", "投递截止", "报名截止", "岗位发布时间", "发布时间",
    "发布日期", "开放时间", "更新日期", "更新时间", "类型",
)
BARE_META = ("校园招聘", "社会招聘", "实习生招聘", "校招", "社招", "秋招", "春招", "全职", "实习", "日常实习", "暑期实习", "暑假实习", "寒假实习", "兼职")
DEGREES = ("博士", "硕士", "本科", "大专")
TITLE_DEGREE = r"[（(]\s*((?:博士研究生|硕士研究生|博士|硕士|本科|大专|专科)(?:及以上|以上)?)\s*[）)]"
SHORT_NOISE = ("工作职责", "岗位职责", "任职要求", "任职资格", "岗位要求", "专业要求", "学历要求", "responsibilities", "requirements", "qualifications", "skills", "duties")
SALARY_NOISE, HEADCOUNT_NOISE = (*SHORT_NOISE, "招聘人数"), (*SHORT_NOISE, "薪资范围", "薪资")
HEADCOUNT = r"(?U)^招?\s*(若干|若干人|[0-9]+(?:\s*[-~～到至]\s*[0-9]+)?\s*人?)$"
INTERN_KINDS = ("应届生实习", "日常实习", "暑期实习", "暑假实习", "寒假实习")
SHELL_TITLES = ("校园招聘", "社会招聘", "实习生招聘", "招聘", "招聘详细", "招聘系统--招聘详细", "招贤纳才", "招聘首页", "SearchJobs")
CODE_TITLE = r"^((?:[A-Z]{2}-)?[A-Za-z一-鿿][\w一-鿿\s/&:,.+·-]{1,70}?)\s+(\d{6,})(?!\w)"
PLACE_LABEL = r"(?iU)(?:工作地点|工作地|工作城市|办公地点|办公地址|所在城市|岗位地址|工作地址|base\s*地|上班地点)\s*[:：]?\s*([^\n；;|｜]{2,60})"
TITLE_LABEL = r"(?iU)(?:职位名称|岗位名称|Role|Job\s*Title)\s*[:：]\s*([^\n，,]{2,80})"
NOT_A_TITLE = r"(?i)^(招聘类别|发布时间|工作地点|工作职责|任职资格|岗位职责|岗位要求|职位描述|职位类别|职位类型|学历要求|薪资|福利|搜索结果|Summary|Overview)"

SECTIONS = ("jd_duties", "jd_requirements", "jd_major")
_OPEN, _CLOSE = "\u0001", "\u0002"


def _any(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


_ALL = {w: field for field, words in LABELS.items() for w in words}
_SPLIT = {w: "d" for w in (*LABELS["jd_duties"], *DUTY_TOO)} | {w: "r" for w in LABELS["jd_requirements"] if w not in DUTY_TOO} | {w: "s" for w in STOP_HEADINGS}
_BODY_START = rf"(?i)^(?:{_any((*LABELS['jd_major'], *LABELS['jd_duties'], *LABELS['jd_requirements']))})\s*[:：]?"
_BARE_HEADING = rf"(?i)^(?:{_any((*LABELS['jd_major'], *LABELS['jd_duties'], *LABELS['jd_requirements']))})\s*[:：]?\s*$"
_META = rf"(?i)^(?:{_any(META_LABELS)})\s*[:：]?.*$"


def cut_at(text: Column, words) -> Column:
    """array<struct(label, value)>: what stands between a label and the next one."""
    label = rf"(?imU)(?:^|\n|(?<=[。；;]))\s*{NUMBERED}({_any(words)})(?:\s*[:：]\s*|\s*(?=\n|$))"
    marked = F.split(F.regexp_replace(T.strip(T.or_empty(text)), label, f"{_OPEN}$1{_CLOSE}"), _OPEN)
    rest = F.slice(marked, F.lit(2), F.size(marked))
    return F.transform(rest, lambda s: F.struct(F.lower(F.substring_index(s, _CLOSE, 1)).alias("label"), T.strip(F.substring_index(s, _CLOSE, -1)).alias("value")))


def _looked_up(label: Column, names: dict[str, str]) -> Column:
    keys = F.split(F.lit("\n".join(dict.fromkeys(w.lower() for w in names))), "\n")
    values = F.split(F.lit("\n".join({w.lower(): f for w, f in names.items()}.values())), "\n")
    return F.get(values, F.array_position(keys, label).cast("int") - 1)


def is_noise_section(value: Column) -> Column:
    """A portal's top bar in place of a section."""
    v = T.strip(T.or_empty(value))
    return (v == "") | (F.regexp_count(v, F.lit(PORTAL_CHROME)) >= 2) | (F.startswith(v, F.lit("招聘系统")) & (F.length(v) < 80))


def _appended(old: Column, value: Column) -> Column:
    longer = F.when(F.length(old) >= F.length(value), old).otherwise(value)
    return F.when(old == "", value).when(F.contains(old, value) | F.contains(value, old), longer).otherwise(F.concat(old, F.lit("\n"), value))


def _joined(entries: Column) -> Column:
    """Values of sections of one kind as one text."""
    return F.aggregate(entries, F.lit(""), lambda acc, e: _appended(acc, e["value"]))


def first_part(value: Column) -> Column:
    """First line up to a bar, without separators around it."""
    line = T.strip(F.regexp_replace(T.strip(T.or_empty(value)), r"(?s)[\n\r].*$", ""))
    return F.btrim(T.strip(F.regexp_replace(line, r"(?s)[|｜].*$", "")), F.lit(" ，,;；"))


def normal_education(value: Column) -> Column:
    """Degree in its short form, or the value itself; null for none."""
    v = T.strip(F.regexp_replace(T.strip(T.or_empty(value)), r"(?s)[;；|/｜].*$", ""))
    plus = T.matches(v, r"及以上|以上|及更[高低]")
    named = lambda d: F.when(plus, F.lit(d + "及以上")).otherwise(F.lit(d))
    found = F.coalesce(*[F.when(F.contains(v, F.lit(w)), named(d)) for w, d in [*((d, d) for d in DEGREES), ("研究生", "硕士"), ("专科", "大专"), ("学士", "本科")]])
    return F.when(T.strip(T.or_empty(value)).isin("", "-", "—", "无", "不限"), F.lit(None)).otherwise(F.coalesce(found, T.strip(F.left(v, F.lit(40)))))


def _short(value: Column, noise: tuple[str, ...]) -> Column:
    v = first_part(value)
    odd = v.isin("", "-", "—", "无", *noise) | (F.length(v) > 40) | T.matches(v, _BODY_START) | T.matches(v, r"^\d{4}-\d{1,2}-\d{1,2}$")
    return F.when(~odd, v)


def normal_salary(value: Column) -> Column:
    return _short(value, SALARY_NOISE)


def normal_headcount(value: Column) -> Column:
    v = _short(value, HEADCOUNT_NOISE)
    got = T.strip(F.regexp_extract(v, HEADCOUNT, 1))
    return F.when(got.isin("若干", "若干人"), "若干").when(got != "", got).otherwise(v)


def _cleaned(field: Column, label: Column, value: Column) -> Column:
    """A field's value as it is stored, or null."""
    v = first_part(value)
    dated = T.strip(F.regexp_replace(v, r"(?U)\s*最新(?:发布)?\s*$", ""))
    return (
        F.when(field.isin(*SECTIONS), F.when(~is_noise_section(value), value))
        .when(v == "", F.lit(None))
        .when((field == "recruit_type") & (label == "类型") & ~T.matches(v, RECRUIT_TYPES), F.lit(None))
        .when(field.isin("work_location", "title", "company", "raw_category"), T.strip(F.left(v, F.lit(80))))
        .when(field == "open_at", F.coalesce(D.loose_date(dated).cast("string"), T.strip(F.left(dated, F.lit(40)))))
        .when(field == "deadline", T.strip(F.left(v, F.lit(40))))
        .when(field == "education", T.strip(F.left(F.coalesce(normal_education(v), v), F.lit(40))))
        .when(field == "salary_range", normal_salary(v))
        .when(field == "headcount", normal_headcount(v))
        .otherwise(v)
    )


def labelled_fields(text: Column) -> Column:
    """map(field, value): the first value of a field; sections of one kind are joined."""
    named = F.transform(cut_at(text, _ALL), lambda s: F.struct(_looked_up(s["label"], _ALL).alias("field"), s["label"].alias("label"), s["value"].alias("value")))
    valued = F.transform(named, lambda s: F.struct(s["field"].alias("field"), _cleaned(s["field"], s["label"], s["value"]).alias("value")))
    entries = F.filter(valued, lambda s: F.coalesce(s["value"], F.lit("")) != "")

    def gathered(kept: Column) -> Column:
        fields = F.array_distinct(F.transform(kept, lambda s: s["field"]))
        own = lambda f: F.filter(kept, lambda s: s["field"] == f)
        return F.map_from_arrays(fields, F.transform(fields, lambda f: F.when(f.isin(*SECTIONS), _joined(own(f))).otherwise(F.get(own(f), F.lit(0))["value"])))

    return T.let(entries, gathered)


def unlabelled_body(text: Column) -> Column:
    """The text without lines of labelled facts, if some substance is left."""
    lines = F.transform(F.split(T.or_empty(text), r"\r?\n"), T.strip)
    kept = F.filter(lines, lambda s: (s == "") | ~(T.matches(s, _META) | T.one_of(s, BARE_META) | is_noise_section(s)))
    return T.let(T.strip(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")), lambda body: F.when((F.length(body) < 40) | is_noise_section(body), "").otherwise(body))


def split_sections(text: Column, labels: Column) -> Column:
    """struct(duties, requirements) of a text and its ``labelled_fields``."""
    found = F.filter(cut_at(text, _SPLIT), lambda s: ~is_noise_section(s["value"]))

    def split(entries: Column) -> Column:
        of = lambda kind: _joined(F.filter(entries, lambda s: _looked_up(s["label"], _SPLIT) == kind))
        other = lambda own, field: F.when(own == "", T.or_empty(F.try_element_at(labels, F.lit(field)))).otherwise(own)
        return F.struct(other(of("d"), "jd_duties").alias("d"), other(of("r"), "jd_requirements").alias("r"))

    def filled(s: Column) -> Column:
        bare = T.let(unlabelled_body(T.strip(T.or_empty(text))), lambda b: F.when(b != s["r"], b).otherwise(""))
        return F.struct(F.when((s["d"] == "") & (F.length(s["r"]) < 40), bare).otherwise(s["d"]).alias("duties"), s["r"].alias("requirements"))

    return T.let(T.let(found, split), filled)


def title_education(title: Column) -> Column:
    return normal_education(F.nullif(F.regexp_extract(T.or_empty(title), TITLE_DEGREE, 1), F.lit("")))


def education_of(text: Column, title: Column, labels: Column | None = None) -> Column:
    """Degree from the label (which alone decides where there is one), a line of the
    requirements, any line, any word, the title."""
    raw = T.strip(T.or_empty(text))
    labels = F.expr("cast(map() as map<string,string>)") if labels is None else labels
    labelled = F.nullif(T.or_empty(F.try_element_at(labels, F.lit("education"))), F.lit(""))
    said = normal_education(F.nullif(F.regexp_extract(raw, r"(?U)学历要求\s*[:：]\s*([^\n\r]+)", 1), F.lit("")))
    section = F.nullif(T.strip(F.regexp_extract(raw, r"(?siU)(?:任职要求|任职资格|任职职责)\s*[:：]?\s*(.+?)(?=\n\s*(?:工作职责|岗位职责|专业要求|福利)|$(?![\n]))", 1)), F.lit(""))
    wanted = F.coalesce(F.nullif(T.or_empty(F.try_element_at(labels, F.lit("jd_requirements"))), F.lit("")), section, raw)

    def within(blob: Column) -> Column:
        lines = F.filter(F.split(blob, r"[\n\r]+"), lambda x: F.contains(x, F.lit("学历")) | F.contains(x, F.lit("学位")))
        by_line = F.get(F.filter(F.transform(lines, normal_education), lambda x: x.isNotNull()), F.lit(0))
        named = lambda d: F.when(F.contains(blob, F.lit(d)), F.when(T.matches(blob, d + ".{0,6}(?:及以上|以上)"), F.lit(d + "及以上")).otherwise(F.lit(d)))
        return F.coalesce(by_line, *[named(d) for d in DEGREES], F.when(F.contains(blob, F.lit("研究生")), F.lit("硕士")))

    read = F.coalesce(said, T.let(wanted, within), T.let(raw, within), title_education(title))
    return F.when(labelled.isNotNull(), normal_education(labelled)).otherwise(read)


def sanitized_title(title: Column) -> Column:
    """A title without a site's name; null where nothing but chrome is left."""
    return T.let(T.strip_chrome(title), lambda t: F.when(~(T.is_noise_title(t) | T.is_chrome_title(t)), t))


def is_shell_title(title: Column) -> Column:
    t = T.strip(T.or_empty(title))
    return (t == "") | T.is_noise_title(t) | T.is_chrome_title(t) | T.one_of(T.squeeze(t), SHELL_TITLES)


def title_in_text(text: Column) -> Column:
    """A role's name from its label, a line with a posting's code, or the first plain line."""
    body = F.coalesce(T.strip_navigation(text), T.strip(T.or_empty(text)))

    def found(t: Column) -> Column:
        lines = F.transform(F.split(t, r"\r?\n"), lambda x: T.strip(F.regexp_replace(x, r"(?U)\s+", " ")))
        role = lambda x: T.strip(F.regexp_extract(x, CODE_TITLE, 1))
        known = lambda r: T.matches(r, r"^[A-Z]{2}-") | T.has_any(F.lower(r), tuple(w.lower() for w in V.ROLE_WORDS)) | T.matches(r, r"(?i)(Leader|Manager|Specialist|工程师|经理|专家|实习)")
        coded = F.filter(F.slice(lines, 1, 30), lambda x: (F.length(x) <= 100) & T.matches(x, CODE_TITLE) & known(role(x)))
        named = F.transform(coded, lambda x: sanitized_title(F.concat(role(x), F.lit(" "), F.regexp_extract(x, CODE_TITLE, 2))))
        plain = F.filter(F.slice(lines, 1, 12), lambda x: F.length(x).between(2, 80) & ~T.matches(x, V.NAV_LINE) & ~T.matches(x, NOT_A_TITLE) & ~T.matches(x, "[：:]"))
        first = lambda xs: F.get(F.filter(xs, lambda x: x.isNotNull()), F.lit(0))
        return F.coalesce(sanitized_title(F.nullif(T.strip(F.regexp_extract(t, TITLE_LABEL, 1)), F.lit(""))), first(named), first(F.transform(plain, sanitized_title)))

    return T.let(body, lambda t: F.when(t != "", found(t)))


def place_in_text(text: Column) -> Column:
    """A work place behind its label; null for navigation words."""
    cut = F.regexp_replace(F.regexp_extract(T.strip(T.or_empty(text)), PLACE_LABEL, 1), r"(?s)(?:岗位职责|工作职责|职位职责|任职要求|任职资格|岗位要求|学历要求).*$", "")
    place = F.regexp_replace(F.btrim(cut, F.lit(" \t-—–:：，,")), r"(?U)\s*[·•]\s*", "·")
    return F.when(~T.is_noise_place(place), place)


def _token(c: Column) -> Column:
    return F.lower(T.squeeze(T.strip(T.or_empty(c))))


def strip_meta(text: Column, values: list[Column]) -> Column:
    """A text without header lines that repeat structured values, up to its first section."""
    tokens = F.filter(F.array(*[_token(v) for v in values], *[F.lit(w) for w in BARE_META]), lambda x: F.length(x) >= 2)
    some = F.exists(F.array(*[T.or_empty(v) for v in values]), lambda v: F.contains(v, F.lit("若干")))
    known = F.concat(tokens, F.when(some, F.array(*[F.lit(w) for w in ("若干", "若干人", "招若干人")])).otherwise(F.expr("cast(array() as array<string>)")))

    def stripped(lines: Column, dup: Column) -> Column:
        starts = F.filter(F.transform(lines, lambda x, i: F.when(T.matches(T.strip(x), _BODY_START), i)), lambda i: i.isNotNull())
        at = F.coalesce(F.get(starts, F.lit(0)), F.size(lines))
        head = F.filter(F.slice(lines, F.lit(1), at), lambda x: (T.strip(x) != "") & ~T.matches(T.strip(x), _META) & ~F.array_contains(dup, _token(x)))
        body = F.slice(lines, at + 1, F.size(lines))
        whole = F.transform(F.concat(head, body), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
        return F.nullif(T.strip(F.regexp_replace(F.array_join(whole, "\n"), r"\n{3,}", "\n\n")), F.lit(""))

    return T.let(F.split(T.strip(T.or_empty(text)), r"\r?\n"), lambda lines: T.let(known, lambda dup: stripped(lines, dup)))


def removed_lines(old: Column, new: Column) -> Column:
    """Non-blank lines of the old text that the new one lacks, in order."""
    lines = lambda c: F.filter(F.transform(F.split(T.or_empty(c), r"\r?\n"), T.strip), lambda x: x != "")
    return T.let(lines(new), lambda kept: F.filter(lines(old), lambda x: ~F.array_contains(kept, x)))


def removed_summary(old: Column, new: Column) -> Column:
    """What a clean-up took off: four lines and the count."""
    was, now = T.strip(T.or_empty(old)), T.strip(T.or_empty(new))
    gone = removed_lines(old, new)
    said = lambda g: F.concat(F.lit("已去掉重复页眉："), F.array_join(F.slice(g, 1, 4), "、"), F.when(F.size(g) > 4, F.concat(F.lit(" 等共 "), F.size(g).cast("string"), F.lit(" 行"))).otherwise(F.concat(F.lit("（"), F.size(g).cast("string"), F.lit(" 行）"))))
    squeezed = F.concat(F.lit("已压缩空白（原文 "), F.length(was).cast("string"), F.lit(" → "), F.length(now).cast("string"), F.lit(" 字）"))
    return F.when(was == now, "无重复页眉可清理").otherwise(T.let(gone, lambda g: F.when(F.size(g) == 0, squeezed).otherwise(said(g))))


def merge_sections(existing: Column, duties: Column, requirements: Column, major: Column) -> Column:
    """Sections added to a text that lacks their first 40 characters; a text under 60
    characters is replaced."""
    old = T.non_blank(existing)
    headed = lambda v, words: T.matches(F.left(F.ltrim(v), F.lit(80)), rf"(?i)^(?:{_any(words)})\s*[:：]?")

    def block(value: Column, heading: str, words) -> Column:
        v = T.non_blank(value)
        missing = F.coalesce(~F.contains(old, F.left(v, F.lit(40))), F.lit(True))
        return F.when(v.isNotNull() & missing, F.when(headed(v, words), v).otherwise(F.concat(F.lit(heading + "：\n"), v)))

    parts = F.array_compact(F.array(block(major, "专业要求", LABELS["jd_major"]), block(duties, "工作职责", LABELS["jd_duties"]), block(requirements, "任职要求", LABELS["jd_requirements"])))
    return T.let(parts, lambda p: F.when(F.size(p) == 0, old).when(F.coalesce(F.length(old) < 60, F.lit(True)), F.array_join(p, "\n\n")).otherwise(F.concat(F.regexp_replace(old, r"(?U)\s+$", ""), F.lit("\n\n"), F.array_join(p, "\n\n"))))


def drop_bare_headings(text: Column) -> Column:
    kept = F.filter(F.split(T.or_empty(text), r"\r?\n"), lambda x: ~T.matches(T.strip(x), _BARE_HEADING))
    return F.nullif(T.strip(F.array_join(kept, "\n")), F.lit(""))


def recruit_of(recruit_type: Column, work_type: Column, title: Column) -> Column:
    """struct(project, bucket) from labelled types: internship first, explicit social hiring
    is never campus."""
    from millrace.functions import classify as C

    rt, wt = T.strip(T.or_empty(recruit_type)), T.strip(T.or_empty(work_type))
    say = lambda p, b: F.struct(p.alias("project"), b.alias("bucket"))
    none, lit = F.lit(None).cast("string"), F.lit

    def judged(f: Column) -> Column:
        rt, wt, blob = f["rt"], f["wt"], f["blob"]
        social, in_work = T.has_any(rt, ("社会招聘", "社招")), F.contains(wt, lit("实习"))
        intern = (T.has_any(blob, (*INTERN_KINDS, "实习生", "实习岗")) | in_work | (rt == "实习")) & ~(social & ~in_work & (rt != "实习"))
        kind = F.coalesce(*[F.when(F.contains(blob, lit(k)), lit(k)) for k in INTERN_KINDS], F.when(F.contains(rt, lit("实习")), rt), lit("日常实习"))
        campus = T.has_any(rt, V.CAMPUS_PROJECT_WORDS)
        season = F.when(F.contains(rt, lit("秋招")), "秋招").when(F.contains(rt, lit("春招")), "春招").when(F.contains(rt, lit("校园")) | (rt == "校招"), "校园招聘").otherwise(rt)
        full = F.contains(wt, lit("全职")) | F.contains(rt, lit("全职"))
        other = F.when(rt != "", F.coalesce(C.project_of(rt, title), rt))
        later = lambda p: F.coalesce(C.map_bucket(p, title), C.map_bucket(wt, title))
        return (
            F.when(intern, say(kind, F.coalesce(C.map_bucket(kind, title), lit("日常实习"))))
            .when(social, say(lit("社会招聘"), none))
            .when(campus, say(season, lit("校招")))
            .when(F.contains(blob, lit("社会招聘")) | T.matches(blob, "(?<![校园])社招"), say(lit("社会招聘"), none))
            .when(full, say(lit("校园招聘"), lit("校招")))
            .when(T.has_any(other, ("社会招聘", "社招")), say(lit("社会招聘"), none))
            .otherwise(say(other, F.when(other.isNotNull(), F.coalesce(C.map_bucket(C.project_of(rt, title), title), later(other)))))
        )

    return T.let(F.struct(rt.alias("rt"), wt.alias("wt"), F.concat_ws(" ", rt, wt, T.or_empty(title)).alias("blob")), judged)
