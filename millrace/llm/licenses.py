"""License scan: an exact set-similarity join of text blocks with notice templates.

Native DataFrame expressions only. Blocks are windows over a document's whole word
sequence, so a notice may be wrapped over lines. A template of n words stands in a window of
ceil(n / threshold) consecutive words that begins at one of its words, if the window holds
at least ``threshold`` of its distinct words, all words that it can't do without (the name
and version of the licence), and none that tells of another licence. Blocks are at least
twice as long as any window and overlap by half, so each window lies whole in one. Words
outside all templates can't add to an overlap, so a block keeps only its template words,
ordered by how rare they are over all blocks, and only blocks with a word that some template
can't do without are kept. Then

* length filter: a block needs ceil(threshold * |T|) template words;
* prefix filter: in that order, the block's first |B| - need + 1 words and the template's
  first |T| - need + 1 words share one;
* positional filter: what can still follow the shared words must reach the need;
* verification: the windows of the block, word by word.

Every filter is lossless for the windows. What is shared out by broadcast is the table of one
group of templates; templates of more than ``MAX_GROUP_WORDS`` words make several groups.

Edge cases: null text is empty (no words, no labels, score 0); a document may repeat, with
or without its id; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import durable, table

#: Word characters of the contract, in either case.
CHARS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD, GAP = f"[^{CHARS}]+", f"[{CHARS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

class Template(NamedTuple):
    """A notice: label, words, words that must stand in it, and words of other licences."""

    label: str
    text: str
    needs: tuple[str, ...] = ()
    against: tuple[str, ...] = ()


#: Names of variants that make another licence.
OF_CC, OF_GPL = ("nc", "sa", "nd", "noncommercial", "sharealike", "noderivatives", "noderivs"), ("lesser", "library", "affero")

#: Notices in common use.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache", "2")),
    Template("apache-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("compliance", "license")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution", "forms")),
    Template("bsd-conditions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions", "copyright")),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative", "commons", "attribution", "4"), OF_CC),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc", "by", "nc", "4"), ("sa", "nd")),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc", "by", "sa", "4"), ("nc", "nd")),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived", "copyright")),
    Template("disclaimer", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("software", "warranty")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu", "general", "public", "3"), OF_GPL),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu", "general", "public"), OF_GPL),
    Template("gpl-warranty", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ("program", "warranty")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission", "fee")),
    Template("mit", "released under the mit license", ("mit", "license")),
    Template("mit-condition", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("copyright", "permission")),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission", "charge")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla", "2")),
    Template("reserved-notice", "copyright all rights reserved", ("rights", "reserved")),
)

LEAST_STRIDE, MAX_GROUP_WORDS = 24, 20_000


def window_of(template: Template, threshold: float) -> int:
    """Words of the windows in which a template is looked for."""
    return math.ceil(len(template.text.split()) / threshold - 1e-9)


def stride_of(templates: tuple, threshold: float = 0.8) -> int:
    """Words from one block to the next; a block has twice as many."""
    return max([LEAST_STRIDE, *(window_of(t, threshold) for t in templates)])


def groups_of(templates: tuple, most: int) -> list[tuple]:
    """Templates in groups of at most ``most`` distinct words (or of one template)."""
    groups: list[list] = []
    words: set[str] = set()
    for t in templates:
        own = {*t.text.split(), *t.against}
        if not groups or len(words | own) > most:
            groups.append([])
            words = set()
        groups[-1].append(t)
        words |= own
    return [tuple(g) for g in groups]


def lowered(text: Column) -> Column:
    """``lower`` of ASCII letters. Of other characters only two have a lower case with an
    ASCII letter in it (Kelvin sign, dotted capital I); they are kept out of its way."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131")))


def phrase_places(words: str, phrases: dict[str, str]) -> Column:
    """Label and start word of every occurrence of a phrase in an array of words. Only
    arrays that hold all words of a phrase are looked through place by place."""
    none = F.expr("cast(array() as array<struct<label:string,at:bigint>>)")

    def places_of(phrase: str, label: str) -> Column:
        parts = phrase.split()
        stands = lambda i: reduce(and_, [F.get(words, i + k).eqNullSafe(p) for k, p in enumerate(parts)])
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)
        all_there = reduce(and_, [F.array_contains(words, p) for p in parts])
        return F.when(all_there, F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("at")))).otherwise(none)

    return F.concat(*[places_of(p, label) for p, label in phrases.items()])


def template_table(spark: SparkSession, templates: tuple, order: list[str], threshold: float) -> DataFrame:
    """One row for each template word in the template's prefix: a bounded table."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for t in templates:
        words = sorted(set(t.text.split()), key=rank.__getitem__)
        need = math.ceil(threshold * len(words) - 1e-9)
        rows += [(w, i, t.label, len(words), need, words, window_of(t, threshold), list(t.needs), list(t.against)) for i, w in enumerate(words[: len(words) - need + 1])]
    return spark.createDataFrame(rows, "token string, t_at int, label string, t_size int, need int, t_words array<string>, window int, needs array<string>, against array<string>")


def template_blocks(words: str, templates: tuple, least: int, stride: int) -> Column:
    """The template words, with their places, of every block that may hold a template."""
    literal = lambda xs: F.array(*[F.lit(x) for x in sorted(xs)])
    told = literal({w for t in templates for w in t.text.split()})
    vocabulary = literal({w for t in templates for w in (*t.text.split(), *t.against)})
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - stride, F.lit(1)), F.lit(stride))
    block = lambda at: F.slice(words, at, 2 * stride)
    may = lambda at: F.size(F.array_intersect(told, block(at))) >= least
    if all(t.needs for t in templates):  # a block without any of these words holds no template
        telling = literal({w for t in templates for w in t.needs})
        may = lambda at: F.arrays_overlap(telling, block(at)) & (F.size(F.array_intersect(told, block(at))) >= least)
    placed = lambda at: F.filter(F.transform(block(at), lambda w, i: F.struct(i.alias("pos"), w.alias("token"))), lambda x: F.array_contains(vocabulary, x["token"]))
    return F.transform(F.filter(starts, may), placed)


def best_window() -> Column:
    """Most template words of a window (columns of a block with a template); 0 for none."""
    hits = F.filter("block", lambda x: F.array_contains("t_words", x["token"]))

    def held(start: Column) -> Column:
        inside = lambda x: (x["pos"] >= start["pos"]) & (x["pos"] < start["pos"] + F.col("window"))
        tokens = F.transform(F.filter("block", inside), lambda x: x["token"])
        fits = (F.size(F.array_except("needs", tokens)) == 0) & ~F.arrays_overlap("against", tokens)
        return F.when(fits, F.size(F.array_intersect("t_words", tokens))).otherwise(0)

    return F.coalesce(F.array_max(F.transform(hits, held)), F.lit(0))


def matches(base: DataFrame, column: str, templates: tuple, threshold: float) -> DataFrame:
    """rid, label, held: the containment of every template of one group in a document."""
    vocabulary = sorted({w for t in templates for w in (*t.text.split(), *t.against)})
    least = min(math.ceil(threshold * len(set(t.text.split())) - 1e-9) for t in templates)
    each = base.select("rid", F.explode(column).alias("block"))
    # corpus-wide frequency of each template word: at most one row a word comes back
    seen = each.select(F.explode(F.array_distinct(F.transform("block", lambda x: x["token"]))).alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in seen.collect()}
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    ordered = F.array(*[F.lit(w) for w in order if any(w in t.text.split() for t in templates)])

    blocks = each.withColumn("b", F.array_intersect(ordered, F.transform("block", lambda x: x["token"])))
    prefix = blocks.select("rid", "block", "b", F.posexplode(F.slice("b", F.lit(1), F.greatest(F.size("b") - least + 1, F.lit(0)))).alias("b_at", "token"))
    index = F.broadcast(template_table(base.sparkSession, templates, order, threshold))
    ahead = F.least(F.col("t_size") - F.col("t_at"), F.size("b") - F.col("b_at"))
    pairs = prefix.join(index, "token").where((F.size("b") >= F.col("need")) & (ahead >= F.col("need")) & (F.size(F.array_intersect("t_words", "b")) >= F.col("need")))
    held = pairs.withColumn("shared", best_window()).where("shared >= need")
    return held.groupBy("rid", "label").agg(F.max(F.col("shared") / F.col("t_size")).alias("held"))


def scan(docs: DataFrame, *, phrases: dict[str, str] | None = None, templates: tuple = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: n_words, places of base phrases, template matches, score.

    ``found`` has every (label, containment) of the templates met by some window; ``score``
    is the best containment, and 1 where a base phrase stands."""
    phrases = PHRASES if phrases is None else phrases
    groups = groups_of(tuple(Template(*t) for t in templates), MAX_GROUP_WORDS)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    worded = rows.select("doc_id", F.array_remove(F.split(lowered(F.col("text")), GAP), "").alias("words"))
    least = lambda g: min(math.ceil(threshold * len(set(t.text.split())) - 1e-9) for t in g)
    blocks = [template_blocks("words", g, least(g), stride_of(g, threshold)).alias(f"blocks{i}") for i, g in enumerate(groups)]
    placed = worded.select("doc_id", F.size("words").cast("long").alias("n_words"), phrase_places("words", phrases).alias("places"), *blocks)
    base = durable(placed.select(F.monotonically_increasing_id().alias("rid"), "*"))

    best = reduce(DataFrame.unionByName, [matches(base, f"blocks{i}", g, threshold) for i, g in enumerate(groups)])
    found = best.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("label", "held"))).alias("found"))
    empty = F.expr("cast(array() as array<struct<label:string,held:double>>)")
    joined = base.select("rid", "doc_id", "n_words", "places").join(found, "rid", "left").withColumn("found", F.coalesce("found", empty))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["held"])), F.lit(0.0)))
    return joined.select("doc_id", "n_words", "places", "found", score.alias("score"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and template notices in every document."""
    found = scan(table(spark, sf_dir, "documents"))
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base = F.transform("places", lambda p: p["label"])
    starts = F.transform("places", lambda p: p["at"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.concat(base, F.transform("found", lambda x: x["label"]))).alias("labels"),
        "score",
    )


def _values(rows: list[str]) -> str:
    return "(VALUES " + ", ".join(rows) + ")"


OP10_SQL = f"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rid, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
worded AS (SELECT doc_id, rid, text, regexp_extract_all(text, '{WORD}') AS w FROM docs),
each AS (SELECT rid, w, unnest(range(len(w))) AS i FROM worded),
phrases(parts, label) AS (SELECT * FROM {_values([f"({p.split()!r}, '{v}')" for p, v in PHRASES.items()])}),
places AS (SELECT rid, label, i FROM each JOIN phrases ON w[i + 1] = parts[1] WHERE w[i + 1 : i + len(parts)] = parts),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY rid),
templates(label, t, size, needs, against) AS (SELECT label, list_distinct(t), size, needs, against::VARCHAR[] FROM {_values([f"('{t.label}', {t.text.split()!r}, {window_of(t, 0.8)}, {list(t.needs)!r}, {list(t.against)!r})" for t in TEMPLATES])} x(label, t, size, needs, against)),
near AS (SELECT rid, w, label, t, size, needs, against FROM worded, templates WHERE list_has_all(w, needs) AND len(list_intersect(t, list_distinct(w))) >= ceil(0.8 * len(t) - 1e-9)),
starts AS (SELECT *, unnest(range(len(w))) AS i FROM near),
windows AS (SELECT rid, label, t, needs, against, list_distinct(w[i + 1 : i + size]) AS s FROM starts WHERE list_contains(t, w[i + 1])),
held AS (
  SELECT rid, label, max(len(list_intersect(t, s)) / len(t)) AS held
  FROM windows WHERE list_has_all(s, needs) AND NOT list_has_any(s, against) AND len(list_intersect(t, s)) >= ceil(0.8 * len(t) - 1e-9) GROUP BY rid, label),
found AS (SELECT rid, list(label) AS labels, max(held) AS held FROM held GROUP BY rid)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
  cast(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(held, 0.0) END AS DOUBLE) AS score
FROM worded LEFT JOIN base b USING (rid) LEFT JOIN found f USING (rid)
"""
