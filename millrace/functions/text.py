"""String expressions on posting columns; all stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import vocab as V


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: rules that mention a value many times
    would otherwise grow into expressions too large to compile."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: All white space of Unicode, and the separators that count as such.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Trim all Unicode white space; null stays null. Looks at the ends alone."""
    return F.btrim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    """Drop all Unicode white space."""
    return F.regexp_replace(c, r"(?U)\s+", "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def non_blank(c: Column) -> Column:
    """The trimmed value, or null."""
    return F.nullif(strip(c), F.lit(""))


def heads(words: tuple[str, ...]) -> str:
    """A look ahead that passes over what can begin none of the words, most of a text."""
    ascii_heads = sorted({w[0] for w in words if w[0].isascii()})
    rest = r"[^\x00-\x7F]" if any(not w[0].isascii() for w in words) else ""
    return f"(?={'|'.join([*filter(None, [rest]), *map(re.escape, ascii_heads)])})"


def has_any(c: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words stands in the text (false for null)."""
    return F.rlike(or_empty(c), F.lit(heads(words) + "(?:" + "|".join(re.escape(w) for w in words) + ")"))


def hits(c: Column, words: tuple[str, ...] = V.BODY_WORDS, longest: int = 1 << 20) -> Column:
    """The words that stand in the text, from one pass: at each place the longest that
    begins there (``among`` knows the beginnings of words). Longer texts than ``longest``,
    whose hits might fill the memory, are searched word by word."""
    first, ordered = sorted({w[0] for w in words}), sorted(words, key=lambda w: (-len(w), w))
    places = f"(?=[{re.escape(first[0])}-{re.escape(first[-1])}])(?=({'|'.join(map(re.escape, ordered))}))"
    found = F.array_distinct(F.regexp_extract_all(or_empty(c), F.lit(places), F.lit(1)))
    return F.when(F.coalesce(F.length(c), F.lit(0)) <= longest, found).otherwise(F.filter(F.split(F.lit("\n".join(words)), "\n"), lambda w: F.contains(c, w)))


def among(found: Column, wanted: tuple[str, ...], words: tuple[str, ...] = V.BODY_WORDS) -> Column:
    """Whether any of the wanted words, all of them in ``words``, is among a text's hits."""
    return F.arrays_overlap(found, F.split(F.lit("\n".join(w for w in words if w.startswith(wanted))), "\n"))


def one_of(c: Column, words: tuple[str, ...]) -> Column:
    """``isin`` of a long list of texts without line ends, as one folded array."""
    return F.array_contains(F.split(F.lit("\n".join(words)), "\n"), c)


def matches(c: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(c, F.lit(pattern)), F.lit(False))


def matches_cjk(c: Column, pattern: str) -> Column:
    """``matches`` of a pattern that begins with a character outside ASCII; quick on long
    texts of other scripts."""
    return matches(c, r"(?=[^\x00-\x7F])(?:" + pattern + ")")


def fold_ascii(c: Column) -> Column:
    """Lower case of A-Z alone, as the keyword search compares."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_keyword(c: Column, keyword: str) -> Column:
    """Substring test without regard to ASCII case; % and _ are ordinary characters."""
    folded = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in keyword)
    return F.contains(fold_ascii(c), F.lit(folded))


def title_key(c: Column) -> Column:
    """Title without case, white space, punctuation and graduation batch, for equality."""
    bare = F.translate(squeeze(F.lower(strip(or_empty(c)))), V.TITLE_PUNCTUATION, "")
    return F.regexp_replace(F.regexp_replace(bare, r"20\d{2}届?", ""), r"(?<!\d)\d{2}届", "")


def clip(c: Column, size: int = V.CLIP) -> Column:
    """One line of at most ``size`` characters, an ellipsis included."""
    flat = strip(F.regexp_replace(or_empty(c), r"(?U)\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.left(flat, F.lit(size - 1)), F.lit("…")))


def or_dash(c: Column) -> Column:
    return F.coalesce(non_blank(c), F.lit("-"))


def tags(title: Column) -> Column:
    """Coarse tags of a title in table order; ASCII words without regard to case."""
    t, low = or_empty(title), F.lower(or_empty(title))
    hit = lambda w: F.contains(low, F.lit(w.lower())) if w.isascii() else F.contains(t, F.lit(w))
    return F.array_compact(F.array(*[F.when(reduce(or_, [hit(w) for w in words]), F.lit(tag)) for tag, words in V.TAG_WORDS.items()]))


def clean_nature(c: Column) -> Column:
    """Company nature out of the vocabulary, longest contained word first; else null."""
    s = F.replace(non_blank(c), F.lit("\n"), F.lit(""))
    fold = lambda w: F.lit(V.NATURE_SYNONYMS.get(w, w))
    exact = F.coalesce(*[F.when(s == w, fold(w)) for w in V.NATURES])
    inside = F.coalesce(*[F.when(F.contains(s, F.lit(w)), fold(w)) for w in sorted(V.NATURES, key=lambda w: -len(w))])
    return F.coalesce(exact, F.when(F.length(s) <= 12, inside))


def strip_channel(c: Column) -> Column:
    """Company name without a recruiting channel at its end."""
    return strip(F.regexp_replace(strip(or_empty(c)), V.CHANNEL_SUFFIX, ""))


def company_core(c: Column) -> Column:
    """Comparable core of a company name: legal suffixes taken off in order."""
    s = strip_channel(c)
    for suffix in V.COMPANY_SUFFIXES:
        s = F.regexp_replace(s, f"(?s)^(.{{2,}}){suffix}$", "$1")
    return strip(s)


def company_key(c: Column) -> Column:
    s = F.lower(strip(or_empty(c)))
    for part in V.COMPANY_KEY_DROPS:
        s = F.replace(s, F.lit(part), F.lit(""))
    return s


def same_company(a: Column, b: Column) -> Column:
    x, y = company_key(a), company_key(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def group_label(seed: Column) -> Column:
    s = strip(or_empty(seed))
    cut = F.coalesce(*[F.when(F.endswith(s, F.lit(x)), strip(F.left(s, F.length(s) - len(x)))) for x in ("有限责任公司", "股份有限公司", "有限公司")], s)
    return F.when(cut != "", cut).otherwise(s)


def group_and_company(seed: Column, page: Column) -> Column:
    """struct(group_name, company): a page that names another company than its seed is a
    subsidiary of the seed's group."""
    s, p = strip_channel(seed), strip_channel(page)
    named = F.when(p != "", p).when(s != "", s).otherwise("未知企业")
    grouped = (p != "") & (s != "") & ~same_company(s, p)
    return F.struct(F.when(grouped, group_label(s)).otherwise("").alias("group_name"), named.alias("company"))


def is_aggregator(c: Column, extra: tuple[str, ...] = ()) -> Column:
    return has_any(c, V.AGGREGATOR_WORDS + extra) | matches(c, V.AGGREGATOR_COUNT)


def is_closed_title(title: Column) -> Column:
    return let(strip(or_empty(title)), lambda t: matches(squeeze(t), V.CLOSED_TITLE) | matches(t, V.CLOSED_TITLE))


def is_closed_text(text: Column) -> Column:
    return matches_cjk(text, V.CLOSED_TEXT)


def strip_chrome(title: Column) -> Column:
    """Title without a site name at its end; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(strip(or_empty(title)), V.CHROME_SUFFIX, ""), r"^[ \-—–|\t]+|[ \-—–|\t]+$", ""), F.lit(""))


def in_noise_titles(title: Column) -> Column:
    return let(strip(or_empty(title)), lambda t: let(squeeze(t), lambda compact: _in_noise(t, compact)))


def _in_noise(t: Column, compact: Column) -> Column:
    return (t == "") | one_of(compact, V.NOISE_TITLES) | one_of(t, V.NOISE_TITLES) | one_of(F.lower(compact), V.NOISE_TITLES) | one_of(F.lower(t), V.NOISE_TITLES)


def is_chrome_title(title: Column) -> Column:
    """Site chrome instead of a role: known phrases, browser tips, or chrome in one part of
    a title of several parts without a role word in any."""
    return let(strip(or_empty(title)), lambda t: let(squeeze(t), lambda compact: chrome_of(t, compact)))


def chrome_of(t: Column, compact: Column) -> Column:
    """``is_chrome_title`` of a trimmed title, with and without white space."""
    parts = F.filter(F.split(t, r"(?U)\s*[-—–|]\s*"), lambda p: p != "")
    odd = F.exists(parts, lambda p: matches(p, V.CHROME_FOUND) | in_noise_titles(p))
    role = F.exists(parts, lambda p: has_any(p, V.ROLE_WORDS))
    phrase = matches(t, V.CHROME_FOUND) | matches(compact, V.CHROME_FOUND)
    tip = matches(t, V.BROWSER_TIP) | matches(compact, V.BROWSER_TIP)
    known = F.lower(compact).isin("searchjobs", "jobsatapple", "careers", "career")
    return (t != "") & (phrase | tip | known & _in_noise(t, compact) | ((F.size(parts) >= 2) & odd & ~role))


def is_noise_title(title: Column) -> Column:
    """Ordered cascade: blank, placeholder, template token, channel shell, site chrome after
    taking off a site suffix, known titles, navigation, closed."""
    return let(strip(or_empty(title)), lambda raw: let(strip_chrome(raw), lambda cut: let(F.coalesce(cut, raw), lambda t: let(squeeze(t), lambda compact: noise_cascade(raw, cut, t, compact, squeeze(raw), is_chrome_title(raw), is_chrome_title(cut), is_closed_title(t))))))


def noise_cascade(raw: Column, cut: Column, t: Column, compact: Column, compact0: Column, chrome_raw: Column, chrome_cut: Column, closed: Column) -> Column:
    """The cascade over its facts: the title, cut and not, squeezed, and what is chrome."""
    clean = cut.isNotNull() & (cut != raw) & ~chrome_cut
    chrome_t = F.when(cut.isNotNull(), chrome_cut).otherwise(chrome_raw)
    detail = (matches(t, r"(?U)招聘系统\s*[-—–]{1,2}\s*招聘详细") | F.endswith(compact, F.lit("招聘详细"))) & ~has_any(compact, ("岗", "工程师", "实习"))
    return (
        F.when(F.length(raw) < 2, True)
        .when(matches(compact0, f"^(?:{V.NOISE_PLACEHOLDER})$") | one_of(F.lower(compact0), V.NOISE_PLACEHOLDER_WORDS), True)
        .when(matches(raw, V.TEMPLATE_TOKEN) | matches(raw, V.CHANNEL_TITLE), True)
        .when(~clean & (chrome_raw | chrome_t), True)
        .when(in_noise_titles(t) | matches(compact, V.NOISE_TITLE) | matches(t, V.NOISE_TITLE), True)
        .when(matches(t, V.BROWSER_TIP) | matches(compact, V.BROWSER_TIP), True)
        .when(matches(compact, V.NOISE_NAV_TITLE) | matches(t, V.NOISE_NAV_TITLE), True)
        .when(detail | closed, True)
        .otherwise(compact.isin("首页", "提示", "公告", "通知", "详情", "更多"))
    )


def is_noise_place(place: Column) -> Column:
    loc = strip(or_empty(place))
    compact = squeeze(loc)
    return (F.length(compact) <= 1) | one_of(F.lower(compact), V.NOISE_PLACES) | one_of(F.lower(loc), V.NOISE_PLACES)


def strip_navigation(text: Column) -> Column:
    """Text without navigation and chrome lines, runs of blank lines as one; null if empty."""
    lines = F.transform(F.split(strip(or_empty(text)), r"\r?\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    kept = F.filter(lines, lambda x: (strip(x) == "") | ~(matches(strip(x), V.NAV_LINE) | is_chrome_title(x)))
    flat = F.transform(kept, lambda x: F.when(strip(x) == "", "").otherwise(x))
    return F.nullif(strip(F.regexp_replace(F.array_join(flat, "\n"), r"\n{3,}", "\n\n")), F.lit(""))


def title_mismatch(company: Column, title: Column) -> Column:
    """Whether the title names another company than the given one."""
    return let(strip(or_empty(company)), lambda c: let(strip(or_empty(title)), lambda t: let(company_core(c), lambda core: mismatch_of(c, t, core))))


def mismatch_of(c: Column, t: Column, core: Column) -> Column:
    """``title_mismatch`` of a trimmed company and title and the company's core."""
    short = F.left(core, F.lit(4))
    other = F.exists(
        F.transform(F.regexp_extract_all(t, F.lit(V.COMPANY_ENTITY), F.lit(1)), company_core),
        lambda e: (F.length(e) >= 2) & ~(F.contains(e, core) | F.contains(core, e)) & (F.left(e, F.lit(2)) != F.left(core, F.lit(2))),
    )
    return (c != "") & (t != "") & (F.length(core) >= 2) & ~(F.contains(t, core) | F.contains(t, c) | F.contains(t, short)) & other
