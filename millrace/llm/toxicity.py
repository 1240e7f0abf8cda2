"""Toxicity: non-negative positive-unlabelled learning over words and word beginnings.

Confirmed toxic rows are the positives, text at large is unlabelled, and the risk is
corrected by the class prior, which is estimated from both. A text is the set of its words and of their first 4, 5 and 6
bytes (which meet inflected forms), each with the root of its rate per 100 words (texts
under 50 words count as 50). One Spark aggregate counts in how many sampled texts of either
kind each of these occurs; all that stand in more positives than chance explains
(``LEAST_DEVIATION``, in standard deviations) become the model's inputs, however many they
are, so only those reach the driver. The model is fitted on sparse rows.

Edge cases: null and empty texts have no features and get the model's base score; without
positives every score is 0.5; repeated rows get one score; an empty table gives an
empty result; other columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.nnpu import Linear, Sparse, capped, held_out, learn, samples
from millrace.llm.text import LOWER, as_buffers, pieces, words_of
from millrace.session import durable, table

MAX_POSITIVES, MAX_UNLABELLED = 8_000, 16_000
PREFIXES = (4, 5, 6)

#: A feature must be so far above the count of positives that chance gives, in standard
#: deviations, stand in so many of them, and be so many times (log) as common as at large.
LEAST_DEVIATION, LEAST_TEXTS, LEAST_LEAN = 5.0, 3, 0.7
LEAST_WORDS = 50


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, 64-bit feature) of all words and beginnings, a stretch of rows at a time, with
    the number of words of the row beside it."""
    data, offsets = as_buffers(texts)
    for lo, hi in pieces(offsets):
        part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, hashed, rows = words_of(part, offs)
        owner = np.repeat(np.arange(lo, hi), np.diff(rows))
        owners, found, words = [owner], [hashed], np.diff(rows)
        lowered, lengths = LOWER[part], ends - starts
        for n in PREFIXES:
            long = np.flatnonzero(lengths > n)
            key = np.full(len(long), n, np.uint64)
            for k in range(n):
                key = (key << np.uint64(8)) | lowered[starts[long] + k].astype(np.uint64)
            owners.append(owner[long])
            found.append(key * np.uint64(0x9E3779B97F4A7C15))
        owner = np.concatenate(owners)
        yield owner, np.concatenate(found), words[owner - lo]


class Vocabulary:
    """Finds chosen 64-bit features: a small slot table first, then the key itself."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.sort(keys)
        self.slots = np.zeros(1 << 20, bool)
        self.slots[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def matrix(self, texts: pa.Array) -> Sparse:
        """Texts by features; the value is the root of the feature's rate."""
        n, rows, numbers, values = max(len(self.keys), 1), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for owner, found, words in features(texts):
            may = self.slots[(found >> np.uint64(44)).astype(np.int64)]
            owner, found, words = owner[may], found[may], words[may]
            at = np.minimum(np.searchsorted(self.keys, found), n - 1)
            real = self.keys[at] == found if len(self.keys) else np.zeros(len(found), bool)
            pair, first, times = np.unique(owner[real].astype(np.int64) * n + at[real], return_index=True, return_counts=True)
            rows.append(pair // n)
            numbers.append(pair % n)
            values.append(np.sqrt(100 * times / np.maximum(words[real][first], LEAST_WORDS)))
        return Sparse(np.concatenate(rows), np.concatenate(numbers), np.concatenate(values), (len(texts), len(self.keys)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pos, unl = (np.asarray(batch.column(k).is_valid()).astype(np.int64) for k in (1, 2))
        for owner, found, _ in features(batch.column(0)):
            order = np.lexsort((owner, found))
            o, f = owner[order], found[order]
            fresh = np.ones(len(f), bool)
            fresh[1:] = (f[1:] != f[:-1]) | (o[1:] != o[:-1])
            o, f = o[fresh], f[fresh]
            keys, at = np.unique(f, return_inverse=True)
            n_pos = np.bincount(at, weights=pos[o], minlength=len(keys)).astype(np.int64)
            n_unl = np.bincount(at, weights=unl[o], minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n_pos), pa.array(n_unl)], ["feature", "n_pos", "n_unl"])


def train(docs: DataFrame, labels: DataFrame, usable, *, label_col: str = "toxic", max_pos: int = MAX_POSITIVES, max_unl: int = MAX_UNLABELLED) -> tuple[Linear, Vocabulary]:
    """Model and vocabulary, from bounded samples."""
    sample = samples(docs, labels, label_col, usable, max_pos=max_pos, max_unl=max_unl)
    n_pos, n_unl = sample.agg(F.count("p_draw"), F.count("u_draw")).first()
    counts = sample.select("text", "p_draw", "u_draw").mapInArrow(_count, "feature bigint, n_pos bigint, n_unl bigint").groupBy("feature").agg(F.sum("n_pos").alias("p"), F.sum("n_unl").alias("u"))
    counted = counts.where(F.col("p") >= LEAST_TEXTS)
    expected = F.col("u") * (n_pos / max(n_unl, 1))
    lean = F.log((F.col("p") + 0.5) / (n_pos + 1)) - F.log((F.col("u") + 0.5) / (n_unl + 1))
    above = (F.col("p") - expected) / F.sqrt(expected + 1)
    chosen = counted.where((above >= LEAST_DEVIATION) & (lean >= LEAST_LEAN)).select("feature").toArrow()["feature"]
    vocabulary = Vocabulary(np.asarray(chosen, np.int64).view(np.uint64))
    n_features = len(vocabulary.keys)

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("v", T.DoubleType())])))
    def entries(texts: pa.Array) -> pa.Array:
        x = vocabulary.matrix(texts)
        offsets = np.searchsorted(x.row, np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x.col, pa.int32()), pa.array(x.value)], ["n", "v"]))

    found = durable(sample.select("p_draw", "u_draw", entries.asNondeterministic()("text").alias("f")))

    def matrix(rows: DataFrame) -> Sparse:
        lists = rows.select("f").toArrow()["f"].combine_chunks()
        cells = lists.flatten()
        row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
        return Sparse(row, np.asarray(cells.field("n"), np.int64), np.asarray(cells.field("v"), float), (len(lists), n_features))

    return learn(matrix(capped(found, "p_draw", max_pos)), matrix(capped(found, "u_draw", max_unl)), l2=3e-4)[0], vocabulary


def score_toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 5, fold: int = 0) -> DataFrame:
    """docs (doc_id, text) with held_out and score."""
    apart = held_out("doc_id", folds, fold)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, ~apart))

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        model, vocabulary = shared.value
        return pa.array(model.score(vocabulary.matrix(texts)))

    return docs.select("doc_id", apart.alias("held_out"), score.asNondeterministic()("text").alias("score"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
