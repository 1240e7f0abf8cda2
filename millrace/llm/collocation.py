"""Phrase collocations: a generalised suffix automaton a shard, reduced globally.

A shard is a run of a task's documents of about ``SHARD_WORDS`` words. Its automaton is built
level by level and bounded in depth: a node of depth d is a phrase of d words, its suffix link
leads to the phrase without the first word, and its endpos count is the number of places where
it ends. A phrase whose places all have the same word before it is no state of its own: it
lies on the link of the longer phrase that has the same places. The shard is enumerated state
by state (a state lists its suffixes of equal count), which gives each phrase of up to
``depth`` words once with its count; Spark adds the counts of all shards.

Before that two exact prunings shrink what is shuffled: a phrase reaches ``least`` places only
if each word of it does, and a longer one only if both phrases that are one word shorter do.
Frequent words and phrases are told by Bloom filters of a fixed size, which pass a few others
and never hold back a frequent one; the counts of what passes are exact.

A candidate within a longer one is subsumed by it when it occurs mostly there. The longer
phrase's suffix link and the link of its beginning name what it may subsume.

Edge cases: null and empty texts have no words, and a null language is ``und``; repeated rows
count each; a text of any length is one row of its shard; ties are ordered by phrase in UTF-8
byte order; an empty table gives an empty result; other columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.skew import join_by_key
from millrace.llm.text import LOWER, as_buffers, pieces
from millrace.session import durable, table

#: Words of a shard (some 200 bytes of memory a word), and phrases of a batch that leaves it.
SHARD_WORDS, BATCH = 1 << 18, 1 << 16

#: Bits of a Bloom filter (fixed, so that what a task holds never grows) and its hashes.
FILTER_BITS, FILTER_HASHES = 1 << 26, 3

#: Bytes between words, and bytes that end a piece (. , ; : ! ? and line ends).
BLANKS, STOPS = b" \t", b".,;:!?\n\x0b\x0c\r"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(STOPS)] = 2

COUNTS = "lang string, size int, phrase string, f bigint"


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of rows in order (ASCII lower case), whether each opens a piece, and its row."""
    data, offsets = as_buffers(texts)
    kind = _KIND[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] |= inside[edge]
    starts = np.flatnonzero(first)
    row = np.searchsorted(offsets, starts, "right") - 1
    stops = np.searchsorted(np.flatnonzero(kind == 2), starts)
    opens = np.ones(len(starts), bool)
    opens[1:] = (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])
    kept = LOWER[data[inside]]
    lens = np.add.reduceat(inside.view(np.uint8), starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    at = np.concatenate(([0], np.cumsum(lens)))
    words = pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(kept.tobytes())])
    return words, opens, row


class SuffixAutomaton:
    """States of the substrings of up to ``depth`` words of word sequences.

    ``words`` are small integers, ``before[i]`` is the number of words of the same sequence
    before place i (as far as ``depth``), and ``allowed(ends, size)`` tells which places may
    end a phrase of ``size`` words. Arrays by node: ``size``, ``end`` (one place where it
    ends), ``count`` (endpos) and ``link`` (its suffix link, a node; -1 at words)."""

    def __init__(self, words: np.ndarray, before: np.ndarray, depth: int, allowed=None) -> None:
        places = np.arange(len(words))
        if allowed is not None:
            places = places[allowed(places, 1)]
        node_at = np.full(len(words), -1, np.int64)
        parent, made = None, 0
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        span = int(words.max()) + 1 if len(words) else 1
        for size in range(1, depth + 1):
            if size > 1:  # lengthen to the left: the node reached so far and the word before
                places = places[(before[places] >= size - 1) & (node_at[places] >= 0)]
                if allowed is not None:
                    places = places[allowed(places, size)]
                parent = node_at[places]
            key = words[places - size + 1].astype(np.int64) + (0 if parent is None else parent * span)
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(order) else np.zeros(0, np.int64)
            count = np.diff(np.append(head, len(order)))
            first = order[head]
            link = np.full(len(head), -1, np.int64) if parent is None else parent[first]
            self.levels.append((places[first], count, link))
            node_at = np.full(len(words), -1, np.int64)
            node_at[places[order]] = np.repeat(np.arange(made, made + len(head)), count)
            made += len(head)
        self.size = np.repeat(np.arange(1, depth + 1), [len(e) for e, _, _ in self.levels])
        self.end, self.count, self.link = (np.concatenate(x) for x in zip(*self.levels, strict=True))

    def states(self) -> np.ndarray:
        """Nodes that are states: no longer phrase has all their places."""
        inner = np.flatnonzero(self.link >= 0)
        same = inner[self.count[self.link[inner]] == self.count[inner]]
        state = np.ones(len(self.size), bool)
        state[self.link[same]] = False
        return np.flatnonzero(state)

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, ends, counts) of all phrases: each state's longest one, and along suffix
        links those that share its places."""
        node, end = self.states(), None
        end = self.end[node]
        while len(node):
            for size in np.unique(self.size[node]).tolist():
                of = self.size[node] == size
                yield size, end[of], self.count[node[of]]
            link = self.link[node]
            go = (link >= 0) & (self.count[link] == self.count[node])
            node, end = link[go], end[go]


class Bloom:
    """A set of strings with false positives and no false negatives."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    @staticmethod
    def places(hashes: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
        low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32)
        return [((low + np.uint64(k) * high) % np.uint64(8 * len(bits))).astype(np.int64) for k in range(FILTER_HASHES)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in self.places(hashes, self.bits):
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_strings(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, for filters only (equal strings, equal hashes)."""
    data, offsets = as_buffers(strings)
    out = np.zeros(len(strings), np.uint64)
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(np.diff(offsets).max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        for lo, hi in pieces(offsets):
            lens = np.diff(offsets[lo : hi + 1])
            rank = np.arange(offsets[hi] - offsets[lo]) - np.repeat(offsets[lo:hi] - offsets[lo], lens)
            value = (data[offsets[lo] : offsets[hi]].astype(np.uint64) + np.uint64(1)) * power[rank]
            some = np.flatnonzero(lens)
            if len(some):
                out[lo + some] = np.add.reduceat(value, (offsets[lo:hi] - offsets[lo])[some])
    return _mixed(out)


def hash_of_phrase(word_hashes: list[np.ndarray]) -> np.ndarray:
    """Hash of a phrase from those of its words in order (the language counts as one)."""
    with np.errstate(over="ignore"):
        return reduce(lambda h, w: _mixed(h * np.uint64(0x9E3779B97F4A7C15) + w), word_hashes)


def bloom_of(phrases: DataFrame) -> Bloom:
    """A filter of all rows (lang, phrase): one partial filter a task, then joined."""
    n_bytes = FILTER_BITS // 8

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.zeros(n_bytes, np.uint8) if bits is None else bits
            split = pc.split_pattern(batch.column(1), " ")
            flat, size = hash_strings(pc.list_flatten(split)), np.asarray(pc.list_value_length(split))
            start = np.cumsum(size) - size
            value = hash_strings(batch.column(0))
            for k in range(int(size.max())):
                more = np.flatnonzero(size > k)
                value[more] = hash_of_phrase([value[more], flat[start[more] + k]])
            for at in Bloom.places(value, bits):
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        if bits is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        for batch in batches:
            for one in batch.column(1):
                own = np.frombuffer(one.as_buffer(), np.uint8)
                bits = own.copy() if bits is None else np.bitwise_or(bits, own, out=bits)
        if bits is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["part", "bits"])

    some = phrases.select("lang", "phrase").coalesce(16).mapInArrow(part, "part int, bits binary")
    rows = some.coalesce(1).mapInArrow(joined, "part int, bits binary").collect()
    return Bloom(np.frombuffer(rows[0]["bits"], np.uint8) if rows else np.zeros(n_bytes, np.uint8))


def _count_shards(sizes: tuple[int, ...], filters: dict[int, object], shard_words: int):
    """Counts of the phrases of ``sizes`` words in the shards of a task. ``filters[k]`` (shared
    with the workers) holds the frequent phrases of k words."""

    def shard(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        words, opens, row = split_words(rows["text"].combine_chunks())
        if not len(words):
            return
        langs = pc.fill_null(rows["lang"].combine_chunks(), "und").dictionary_encode()
        coded = words.dictionary_encode()
        word, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        lang = langs.indices.to_numpy().astype(np.int64)[row]
        if 0 in sizes:  # all word occurrences of a language
            n = np.bincount(lang, minlength=len(langs.dictionary))
            yield made(langs.dictionary, 0, pa.array([""] * len(n), pa.large_utf8()), n)
        piece = np.cumsum(opens) - 1
        before = np.arange(len(word)) - np.flatnonzero(opens)[piece]
        lang_hash, name_hash = hash_strings(langs.dictionary), hash_strings(names)

        def allowed(ends: np.ndarray, size: int) -> np.ndarray:
            ok = np.ones(len(ends), bool)
            for k in (k for k in filters if k <= size):  # the leftmost k words: the others passed at a smaller size
                at = ends[ok] - (size - k)
                parts = [lang_hash[lang[at]], *(name_hash[word[at - j]] for j in range(k - 1, -1, -1))]
                ok[ok] = Bloom(filters[k].value).has(hash_of_phrase(parts))
            return ok

        # a word of another language is another word
        automaton = SuffixAutomaton(lang * len(names) + word, before, max(sizes), allowed if filters else None)
        for size, end, count in automaton.phrases():
            if size in sizes:
                order = np.lexsort([word[end - j] for j in range(size)])  # neighbours alike: smaller shuffle files
                for at in range(0, len(order), BATCH):
                    some = order[at : at + BATCH]
                    parts = [names.take(pa.array(word[end[some] - j])) for j in range(size - 1, -1, -1)]
                    yield made(langs.dictionary.take(pa.array(lang[end[some]])), size, pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_utf8())) if size > 1 else parts[0], count[some])

    def made(langs: pa.Array, size: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([langs.cast(pa.string()), pa.array(np.full(len(counts), size, np.int32)), phrases.cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "size", "phrase", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_bytes = [], 0
        for batch in batches:
            lo = 0
            _, offsets = as_buffers(batch.column(1))
            for a, b in pieces(offsets, shard_words):
                held.append(batch.slice(a, b - a))
                n_bytes += int(offsets[b] - offsets[a])
                if n_bytes >= 6 * shard_words:
                    yield from shard(held)
                    held, n_bytes = [], 0
                    pa.default_memory_pool().release_unused()
        if held:
            yield from shard(held)

    return run


def phrase_counts(docs: DataFrame, sizes: tuple[int, ...], *, least: int, filters: dict[int, object], lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, size, phrase, f of phrases with at least ``least`` places (size 0: all words)."""
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("length(text) > 0")
    counted = texts.mapInArrow(_count_shards(sizes, filters, SHARD_WORDS), COUNTS)
    return counted.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("size") == 0))


def frequent_phrases(docs: DataFrame, *, depth: int, least: int, **columns: str) -> DataFrame:
    """Stored counts of all phrases of up to ``depth`` words with ``least`` places or more,
    and of all words of a language (size 0), one size a pass."""
    context = docs.sparkSession.sparkContext
    found = durable(phrase_counts(docs, (0, 1), least=least, filters={}, **columns))
    levels, last = [found], found.where("size = 1")
    for size in range(2, depth + 1):
        shared = context.broadcast(bloom_of(last).bits)
        last = durable(phrase_counts(docs, (size,), least=least, filters={size - 1: shared}, **columns))
        levels.append(last)
    return reduce(DataFrame.unionByName, levels)


def _part(phrase: str, first: int, n: str) -> F.Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, F.expr(n)), " ")


def scored(frequent: DataFrame, depth: int) -> DataFrame:
    """lang, phrase, size, a, k, l, r, score of all candidates, by their lowest-scoring cut.

    The score is a ratio of whole numbers, computed exactly (38 digits) and floored."""
    candidates = frequent.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    cut = lambda k: F.array(
        F.struct(F.lit(k).alias("k"), F.lit(True).alias("left"), _part("phrase", 1, f"{k}").alias("part")),
        F.struct(F.lit(k).alias("k"), F.lit(False).alias("left"), _part("phrase", k + 1, f"size - {k}").alias("part")),
    )
    cuts = F.concat(*[F.when(F.col("size") > k, cut(k)).otherwise(F.array()) for k in range(1, depth)])
    parts = durable(candidates.select("*", F.explode(cuts).alias("cut")).select("lang", "phrase", "size", "a", "cut.*"))
    asked = parts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))
    known = asked.join(frequent.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    halves = join_by_key(parts, durable(known), ["lang", "part"], parts.count())
    both = halves.groupBy("lang", "phrase", "size", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(1000000 * ({whole('a')} * {whole('a')})) div ({whole('l')} * {whole('r')})")
    lowest = both.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    return lowest.select("lang", "phrase", "size", "a", "m.*")


def subsumed(frequent: DataFrame, percent: int) -> DataFrame:
    """lang, phrase of candidates that occur mostly (``percent`` of 100) in a longer one.

    Only phrases one word longer need a look: one that is longer still lies no more often in
    the text than the phrase between. They name what they hold by their suffix link and by
    that of their reverse (the phrase without its last word)."""
    longer = frequent.where("size >= 3")
    inner = F.array(_part("phrase", 2, "size - 1"), _part("phrase", 1, "size - 1"))
    held = longer.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return frequent.where("size >= 2").join(held, ["lang", "phrase"]).where(f"100 * longer >= {percent} * f").select("lang", "phrase")


def collocations(docs: DataFrame, *, depth: int = 3, least: int = 10, percent: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's first ``top`` candidates: lang, rank, phrase, a, l, r, n, score, size, k."""
    frequent = frequent_phrases(docs, depth=depth, least=least, lang_col=lang_col, text_col=text_col)
    left = durable(scored(frequent, depth).join(subsumed(frequent, percent), ["lang", "phrase"], "left_anti"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within salted parts of a language, so that no task sorts all of one language
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best)
    some = left.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    n = frequent.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "size", "k")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of two or three words of each language."""
    return collocations(table(spark, sf_dir, "documents")).drop("size", "k")


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
lists AS (
  SELECT lang, row_number() OVER () AS p, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces),
words AS (SELECT lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists),
total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
ahead AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY p ORDER BY i)),
f AS (
  SELECT lang, 1 AS size, w AS phrase, count(*) AS f FROM ahead GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, 2, w || ' ' || w2, count(*) FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cand AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
halves AS (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:], ' ') AS tail
  FROM cand, (VALUES (1), (2)) AS s(k) WHERE k < size),
cuts AS (
  SELECT h.lang, h.phrase, h.a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * h.a * h.a) // (l.f::HUGEINT * r.f) AS score
  FROM halves h JOIN f l ON l.lang = h.lang AND l.phrase = h.head JOIN f r ON r.lang = h.lang AND r.phrase = h.tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a AS longer FROM cand WHERE size = 3),
subsumed AS (SELECT DISTINCT lang, phrase FROM cand JOIN held USING (lang, phrase) WHERE 100 * longer >= 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM lowest JOIN total USING (lang) ANTI JOIN subsumed USING (lang, phrase)
QUALIFY rank <= 2000
"""
