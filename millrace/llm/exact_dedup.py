"""Exact dedup by composable polynomial fingerprints.

A text is the byte polynomial G(s) = sum (s_i + 1) * r^i modulo two primes. Chunks are
hashed on their own and combined by length-shifted arithmetic, G(a + b) = G(a) +
r^len(a) * G(b), so a huge text is hashed chunk by chunk, in any order and grouping: by
many tasks where it has over ``HUGE`` bytes (``combine`` states the rule). Documents of equal fingerprint and length then undergo a comparison of
their bytes: their texts are cut into chunks, and each chunk number of a fingerprint must
have one content. The comparison is a partial aggregate (least and greatest chunk), so it
streams, and a hot fingerprint meets in no task. Groups that fail it are told apart by
their SHA-256, so that only equal texts share a group.

Edge cases: null text counts as empty, and empty texts are one group; rows that repeat
with their id form a group of which one row is kept; an empty table gives an empty result;
other columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.skew import join_by_key
from millrace.llm.text import as_buffers, pieces
from millrace.session import durable, table

#: Two primes below 2^31 and a base for each, fixed so that fingerprints stay comparable.
PRIMES, BASES = (2147483647, 2147483629), (1000003, 69069)

#: Bytes hashed at once, bytes compared at once, and bytes beyond which tasks share a text.
CHUNK, COMPARED, HUGE = 4096, 65536, 16 << 20

#: Fingerprints held by every task while texts are picked for comparison; more are joined.
MAX_SHARED = 1_000_000


def combine(first: tuple[int, int], second: tuple[int, int], prime: int, base: int) -> tuple[int, int]:
    """(hash, length) of two adjoining stretches from those of each."""
    return (first[0] + pow(base, first[1], prime) * second[0]) % prime, first[1] + second[1]


def _table_of_powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += step
    return out


def fingerprints(texts: pa.Array, primes: tuple[int, int] = PRIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes and the byte length of each row."""
    data, offsets = as_buffers(texts)
    lengths = np.diff(offsets)
    out = [np.zeros(len(lengths), np.uint64) for _ in primes]
    inner = [_table_of_powers(b, p, CHUNK) for b, p in zip(BASES, primes, strict=True)]
    for lo, hi in pieces(offsets):
        rows = np.flatnonzero(lengths[lo:hi]) + lo
        if not len(rows):
            continue
        per = -(-lengths[rows] // CHUNK)
        row_at = np.concatenate(([0], np.cumsum(per)[:-1]))
        number = np.arange(int(per.sum())) - np.repeat(row_at, per)
        begin = np.repeat(offsets[rows], per) + number * CHUNK
        size = np.minimum(CHUNK, np.repeat(offsets[rows + 1], per) - begin)
        for k, (base, prime) in enumerate(zip(BASES, primes, strict=True)):
            p = np.uint64(prime)
            chunk = np.empty(len(begin), np.uint64)
            step = max(1, (1 << 20) // CHUNK)
            span = np.concatenate(([0], np.cumsum(size)))
            c = 0
            while c < len(begin):  # about a megabyte of text at a time, whole chunks
                d = max(c + step, int(np.searchsorted(span, span[c] + (1 << 20), "right")) - 1)
                d = min(d, len(begin))
                n, s = size[c:d], span[c:d] - span[c]
                rank = np.arange(int(n.sum())) - np.repeat(s, n)
                value = (data[begin[c] : begin[d - 1] + size[d - 1]].astype(np.uint64) + np.uint64(1)) * inner[k][rank]
                chunk[c:d] = np.add.reduceat(value, s) % p
                c = d
            shift = _table_of_powers(pow(base, CHUNK, prime), prime, int(per.max()))
            out[k][rows] = np.add.reduceat(chunk * shift[number] % p, row_at) % p
    return out[0], out[1], lengths


def fingerprint_udf(primes: tuple[int, int] = PRIMES):
    """Arrow UDF: text to one long from both hashes."""

    @F.arrow_udf(T.LongType())
    def fingerprint(texts: pa.Array) -> pa.Array:
        high, low, _ = fingerprints(texts, primes)
        return pa.array(((high << np.uint64(32)) | low).view(np.int64))

    return fingerprint.asNondeterministic()


def _chunk_hashes(batches: Iterator[pa.RecordBatch], primes: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """(rid, high, low): each chunk's hashes, shifted to the chunk's place in its text."""
    for batch in batches:
        high, low, _ = fingerprints(batch.column(2).cast(pa.binary()), primes)
        at = np.asarray(batch.column(1)).tolist()
        shifted = [[int(h) * pow(base, n, prime) % prime for h, n in zip(hashes, at, strict=True)] for hashes, base, prime in zip((high, low), BASES, primes, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in shifted)], ["rid", "high", "low"])


def fingerprinted(texts: DataFrame, primes: tuple[int, int] = PRIMES, huge_bytes: int = HUGE) -> DataFrame:
    """Stored rows (rid, doc_id, fp, n_bytes, quick, text_sha256) of texts (doc_id, text).

    A text over ``huge_bytes`` is stored in chunks, which many tasks hash on their own; its
    hash is the sum of the chunks' hashes, each shifted by the length before it."""
    small = F.octet_length("text") <= huge_bytes
    facts = ["doc_id", F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("quick"), F.sha2("text", 256).alias("text_sha256")]
    first = texts.select((F.monotonically_increasing_id() * 2).alias("rid"), fingerprint_udf(primes)(F.when(small, F.col("text")).otherwise("")).alias("fp"), *facts)
    rows = durable(first.select("rid", "doc_id", "fp", "n_bytes", "quick", "text_sha256"))
    if rows.where(F.col("n_bytes") > huge_bytes).isEmpty():
        return rows
    rows = rows.where(F.col("n_bytes") <= huge_bytes)
    huge = texts.where(~small).select((F.monotonically_increasing_id() * 2 + 1).alias("rid"), F.col("text").cast("binary").alias("bytes"), *facts)
    step = max(1, huge_bytes // 4)
    cut = huge.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("n_bytes") - 1, F.lit(step))))
    chunks = durable(cut.select("rid", F.col("at").cast("long").alias("at"), F.substring("bytes", F.col("at") + 1, F.lit(step)).alias("chunk"), "doc_id", "n_bytes", "quick", "text_sha256"))
    hashed = chunks.select("rid", "at", "chunk").repartition("rid", "at").mapInArrow(lambda b: _chunk_hashes(b, primes), "rid bigint, high bigint, low bigint")
    whole = hashed.groupBy("rid").agg((F.sum("high") % primes[0]).alias("high"), (F.sum("low") % primes[1]).alias("low"))
    known = chunks.where("at = 0").select("rid", "doc_id", "n_bytes", "quick", "text_sha256")
    composed = known.join(whole, "rid").withColumn("fp", F.shiftleft("high", 32).bitwiseOR(F.col("low")))
    return rows.unionByName(durable(composed.select(*rows.columns)))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", primes: tuple[int, int] = PRIMES, huge_bytes: int = HUGE) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of a group of equal texts is kept (null is smallest)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = fingerprinted(texts, primes, huge_bytes)

    # texts to compare are found again by a quick hash, not by hashing them a second time: one
    # that meets it by chance fails the comparison, and then SHA-256 decides
    key = ["fp", "n_bytes"]
    several = durable(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    named = durable(rows.select(*key, "quick").distinct().join(_shared_if_small(several), key, "left_semi"))
    measured = texts.select(F.col("text").cast("binary").alias("bytes"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("quick"))
    again = measured.join(_shared_if_small(named), ["n_bytes", "quick"])
    cut = again.select(*key, "bytes", F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"(n_bytes - 1) div {COMPARED}"), F.lit(0)))).alias("chunk_no"))
    chunks = cut.select(*key, "chunk_no", F.substring("bytes", F.col("chunk_no") * COMPARED + 1, F.lit(COMPARED)).alias("chunk"))
    spread = chunks.groupBy(*key, "chunk_no").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    mixed = durable(spread.where("least != most").select(*key, F.lit(True).alias("mixed")).distinct())

    sub = F.lit("")
    if not mixed.isEmpty():
        rows = rows.join(_shared_if_small(mixed), key, "left")
        sub = F.when(F.col("mixed"), F.col("text_sha256")).otherwise("")
    told = rows.select("rid", "doc_id", "text_sha256", *key, sub.alias("sub"))
    group = [*key, "sub"]
    best = durable(told.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"), F.coalesce(F.max_by("rid", "doc_id"), F.max("rid")).alias("best")))
    joined = join_by_key(told, best.withColumn("group_size", F.col("n")), group, rows.count())
    return joined.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("best")).alias("kept"), "text_sha256")


def _shared_if_small(keys: DataFrame) -> DataFrame:
    """Broadcast up to MAX_SHARED keys (16 bytes each); join more by shuffle."""
    return F.broadcast(keys) if keys.count() <= MAX_SHARED else keys


def keep_decided(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """Rows of ``docs`` that a decision (doc_id, text_sha256, kept) lets stay. Rows equal in
    id and text share their decisions: as one of them where any is kept, else none."""
    per_row = decided.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows"))
    touched = durable(per_row.where(~F.col("stays") | (F.col("rows") > 1)).select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("stays").alias("__stays")))
    hashed = docs.withColumn("__text", F.sha2(F.coalesce("text", F.lit("")), 256))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__sha"))
    marked = hashed.join(_shared_if_small(touched), same, "left")
    untouched = marked.where(F.col("__sha").isNull()).select(*docs.columns)
    one_of = marked.where(F.col("__stays")).dropDuplicates(["__id", "__sha"]).select(*docs.columns)
    return untouched.unionByName(one_of)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and the row of equal text that stays."""
    return dedup(table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
