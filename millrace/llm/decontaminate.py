"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of every benchmark item (an item
of fewer words is one shorter pattern). Patterns of one length share a table set:

* shift: for each block of two words, how far the search may move on when the block ends
  the place looked at; a block that no pattern holds skips whole windows;
* buckets: patterns by the hash of their last block, for blocks of shift 0;
* confirmation: the words of text and pattern are compared byte by byte.

The search runs in each task over Arrow batches, many stretches of text in step, and no
text is shuffled. Pattern tables are shared out by broadcast in blocks of items of some
``MAX_ITEM_BYTES`` of text (twice that at most): a larger benchmark is searched block by
block, each against all documents, and the hits of a document are merged by key. An item
larger than a sixteenth of that is cut into overlapping stretches first.

Edge cases: null text has no words; an item without words has no window; an item that
repeats is found once, a document that repeats is reported for each row; an empty benchmark
hits nothing; an empty table gives an empty result; other columns pass by unread.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.licenses import GAP, LOWER, UPPER, WORD
from millrace.llm.text import LOWER as LOWER_BYTE
from millrace.llm.text import as_buffers, pieces, words_of
from millrace.session import durable, table

#: Bytes of item text whose pattern tables one pass shares out (some 20 times as much).
MAX_ITEM_BYTES = 4 << 20

#: Words that one lane of the search covers.
LANE = 256

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_SHIFT_BITS = 18


class PatternSet:
    """Shift table and suffix buckets for patterns of ``m`` words."""

    def __init__(self, m: int, patterns: dict[bytes, list[int]], hashes: np.ndarray) -> None:
        """patterns: space-joined words to item numbers; hashes: their word hashes."""
        self.m, self.b = m, min(2, m)
        self.texts, self.items = list(patterns), list(patterns.values())
        blocks = self.blocks(hashes.reshape(-1)).reshape(len(self.texts), m)
        self.shift = np.full(1 << _SHIFT_BITS, m - self.b + 1, np.int32)
        for end in range(self.b - 1, m):
            np.minimum.at(self.shift, self.slot(blocks[:, end]), m - 1 - end)
        suffix = blocks[:, m - 1]
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]
        self.hashes = hashes[self.order]

    def blocks(self, words: np.ndarray) -> np.ndarray:
        """Hash of the block of words that ends at each word."""
        if self.b == 1:
            return words
        out = words.copy()
        with np.errstate(over="ignore"):
            out[1:] += words[:-1] * _PAIR
        return out

    @staticmethod
    def slot(blocks: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((blocks * _PAIR) >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64)

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Word positions where a block of shift 0 ends."""
        blocks, n = self.blocks(words), len(words)
        lanes = np.arange(0, n, LANE)
        at, stop = np.maximum(lanes, self.m - 1), np.minimum(lanes + LANE, n)
        found = []
        live = at < stop
        at, stop = at[live], stop[live]
        while len(at):
            move = self.shift[self.slot(blocks[at])]
            found.append(at[move == 0])
            at = at + np.maximum(move, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def search(self, words: np.ndarray, spell) -> Iterator[tuple[int, int]]:
        """(first word, pattern number) of every occurrence."""
        at = self.candidates(words)
        if not len(at):
            return
        ends = self.blocks(words)[at]
        lo, hi = np.searchsorted(self.suffix, ends, "left"), np.searchsorted(self.suffix, ends, "right")
        hit = hi > lo
        at, lo, n = at[hit], lo[hit], (hi - lo)[hit]
        for a in range(0, len(at), 65536):  # bounds what a bucket of many patterns makes
            part = slice(a, a + 65536)
            first = np.repeat(at[part], n[part]) - self.m + 1
            which = np.repeat(lo[part], n[part]) + np.arange(int(n[part].sum())) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            same = np.ones(len(first), bool)
            for k in range(self.m):
                same &= words[first + k] == self.hashes[which, k]
            for f, w in zip(first[same].tolist(), self.order[which[same]].tolist(), strict=True):
                if spell(f, f + self.m) == self.texts[w]:
                    yield f, w


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Function from a range of words to their lower-case spelling, space-joined."""

    def spell(a: int, b: int) -> bytes:
        raw = LOWER_BYTE[data[starts[a] : ends[b - 1]]].tobytes()
        base = starts[a]
        return b" ".join([raw[s - base : e - base] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)])

    return spell


def pattern_sets(texts: list[str | None], window: int) -> list[PatternSet]:
    """Pattern sets by length, with items named by their place in ``texts``."""
    data, offsets = as_buffers(pa.array(texts, pa.large_string()))
    starts, ends, hashed, rows = words_of(data, offsets)
    spell = spelled(data, starts, ends)
    by_length: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
    places: dict[int, list[int]] = defaultdict(list)
    for item, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        m = min(window, b - a)
        for at in range(a, b - m + 1) if m else ():
            known = by_length[m].setdefault(spell(at, at + m), [])
            if not known:
                places[m].append(at)
            if item not in known:
                known.append(item)
    return [PatternSet(m, p, hashed[np.array(places[m])[:, None] + np.arange(m)]) for m, p in by_length.items()]


def search_batch(texts: pa.Array, sets: list[PatternSet]) -> Iterator[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each row: word count, hit spans (merged, half-open), items found."""
    data, offsets = as_buffers(texts)
    for lo, hi in pieces(offsets):
        part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, words, rows = words_of(part, offs)
        spell = spelled(part, starts, ends)
        spans, items = defaultdict(list), defaultdict(set)
        for s in sets:
            for first, which in s.search(words, spell):
                row = int(np.searchsorted(rows, first, "right")) - 1
                if first + s.m <= rows[row + 1]:  # no window crosses from text to text
                    spans[row].append((first - int(rows[row]), first + s.m - int(rows[row])))
                    items[row].update(s.items[which])
        for row in range(hi - lo):
            yield int(rows[row + 1] - rows[row]), merged(spans.get(row, [])), sorted(items.get(row, ()))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def hits_udf(spark: SparkSession, ids: list, texts: list, window: int, id_type: str):
    """Arrow UDF: text to (n_words, spans, items) for some benchmark items."""
    shared = spark.sparkContext.broadcast((ids, pattern_sets(texts, window)))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kind = pa.string() if id_type == "string" else pa.int64()
    shape = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(kind))])

    @F.arrow_udf(f"n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<{id_type}>")
    def hits(column: pa.Array) -> pa.Array:
        names, sets = shared.value
        rows = []
        for n_words, spans, items in search_batch(column, sets):
            rows.append({"n_words": n_words, "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted({names[i] for i in items if names[i] is not None})})
        return pa.array(rows, shape)

    return hits.asNondeterministic()


def _cut_items(items: DataFrame, window: int, most: int) -> DataFrame:
    """Distinct items, those of over ``most`` bytes cut into stretches of words that overlap
    by a window less one word, so that each window stands whole in one of them."""
    size = F.octet_length("text")
    distinct = items.where(size > 0).distinct()
    step = max(window, most // 64)
    words = F.filter(F.split("text", GAP), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)), F.lit(step))
    long = distinct.where(size > most).select("item_id", words.alias("w"))
    cut = long.select("item_id", F.explode(F.transform(starts, lambda at: F.array_join(F.slice("w", at, step + window - 1), " "))).alias("text"))
    return distinct.where(size <= most).unionByName(cut.where(F.octet_length("text") > 0).distinct())


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_item_bytes: int = MAX_ITEM_BYTES, prefix: str | None = None) -> DataFrame:
    """One row a document: doc_id, text, n_words, hit ``spans`` of words, ``items`` found.
    With a ``prefix`` the row keeps all columns of ``docs``, and the three results carry it
    before their names."""
    spark = docs.sparkSession
    item_rows = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    id_type = "string" if dict(item_rows.dtypes)["item_id"] == "string" else "bigint"
    named = item_rows.select(F.col("item_id").cast(id_type).alias("item_id"), "text")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text")) if prefix else docs.select(F.struct(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).alias("row"), F.col(text_col).alias("text"))
    named_as = lambda found: found.select("row.*", *[F.col(c).alias((prefix or "") + c) for c in ("n_words", "spans", "items")])

    def one_pass(rows: DataFrame, block: DataFrame) -> DataFrame:
        got = block.collect()  # within twice max_item_bytes
        hits = hits_udf(spark, [r["item_id"] for r in got], [r["text"] for r in got], window, id_type)
        return rows.withColumn("hits", hits("text")).select(*rows.columns, "hits.*")

    named = _cut_items(named, window, max_item_bytes // 16)
    total, count = named.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n_blocks = -(-(total or 0) // max_item_bytes)
    if n_blocks <= 1:
        return named_as(one_pass(keyed, named))

    # blocks of items by hash, finer until the largest keeps the bound
    number = lambda n: F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    largest = lambda: named.groupBy(number(n_blocks).alias("k")).agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0]
    while n_blocks < 16 * count and largest() > 2 * max_item_bytes:
        n_blocks *= 2
    rows = durable(keyed.withColumn("rid", F.monotonically_increasing_id()))
    part = None
    for k in range(n_blocks):
        block = named.where(number(n_blocks) == k)
        hits = one_pass(rows.select("rid", "text"), block).drop("text")
        part = hits if part is None else part.unionByName(hits.where(F.size("spans") > 0))
    whole = part.groupBy("rid").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )

    def union(acc, s):
        """Fold sorted spans into disjoint ones."""
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        touches = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"])
        return F.when(touches, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.array_append(acc, s))

    spans = F.aggregate("found", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), union)
    return named_as(rows.join(whole, "rid").withColumn("spans", spans))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and benchmark items of every document."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    names = F.array_sort(F.array_distinct(F.transform("items", lambda i: i.cast("string"))))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP4_SQL = f"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[a : a + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS a FROM items WHERE len(w) > 0)),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w FROM documents),
lengths AS (SELECT DISTINCT m FROM windows),
grams AS (
  SELECT rid, a, m, array_to_string(w[a : a + m - 1], ' ') AS g
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS a FROM docs, lengths WHERE len(w) >= m)),
hits AS (SELECT rid, a, g.m, item_id FROM grams g JOIN windows USING (m, g)),
words AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(a, a + m)) AS pos FROM (SELECT DISTINCT rid, a, m FROM hits)) GROUP BY rid),
found AS (SELECT rid, list_sort(list(DISTINCT cast(item_id AS VARCHAR))) AS ids FROM hits GROUP BY rid)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, cast(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(array_to_string(coalesce(ids, []), ',')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""
