"""Quality classifier: positive-unlabelled learning over measures of the whole text.

Trusted positives are rows labelled 1, unlabelled rows are web text at large; the class
prior is estimated from both, and labels of 0 are never read. A text becomes some twenty measures of its bytes and
words (shares of character classes, repetition, line shape); each measure is cut into
quantile bins learnt from the unlabelled sample, so that the linear model can bend.

Edge cases: null and empty texts are scored like any text (all measures zero); without
labelled positives every score is 0.5; repeated rows get one score; an
empty table gives an empty result; other columns pass by unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.nnpu import Linear, capped, held_out, learn, samples
from millrace.llm.text import as_buffers, pieces, words_of
from millrace.session import durable, table

#: Classes of bytes; what no class names is class 0.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".,;:'\"-()", "!?", "*#%&$@^~_=+", "|<>[]{}\\/")
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate(CLASSES, 1):
    _CLASS[[ord(_c) for _c in _chars]] = _i
_CLASS[0x80:] = len(CLASSES) + 1
N_CLASSES = len(CLASSES) + 2
N_MEASURES = N_CLASSES + 9

MAX_POSITIVES, MAX_UNLABELLED, BINS = 10_000, 20_000, 12


def measures(texts: pa.Array) -> np.ndarray:
    """One row of measures a text."""
    data, offsets = as_buffers(texts)
    out = np.zeros((len(offsets) - 1, N_MEASURES))
    for lo, hi in pieces(offsets):
        part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        n, size = hi - lo, np.maximum(np.diff(offs), 1).astype(float)
        row = np.repeat(np.arange(n), np.diff(offs))
        counts = np.bincount(row * N_CLASSES + _CLASS[part], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
        starts, ends, hashed, rows = words_of(part, offs)
        words = np.diff(rows)
        some = np.maximum(words, 1).astype(float)
        owner = np.repeat(np.arange(n), words)
        same_doc = owner[1:] == owner[:-1]
        again = np.bincount(owner[1:][same_doc & (hashed[1:] == hashed[:-1])], minlength=n)
        order = np.lexsort((hashed, owner))
        h, o = hashed[order], owner[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        distinct = np.bincount(o[fresh], minlength=n)
        capital = (part[starts] >= 65) & (part[starts] <= 90) if len(starts) else np.zeros(0, bool)
        lengths = (ends - starts).astype(float)
        total = np.bincount(owner, weights=lengths, minlength=n)
        squares = np.bincount(owner, weights=lengths**2, minlength=n)
        block = out[lo:hi]
        block[:, :N_CLASSES] = counts / size[:, None]
        block[:, N_CLASSES:] = np.column_stack(
            [
                np.log1p(np.diff(offs)),
                np.log1p(words),
                distinct / some,
                again / some,
                total / some,
                np.sqrt(np.maximum(squares / some - (total / some) ** 2, 0)),
                np.bincount(owner[capital], minlength=n) / some,
                some / (counts[:, 5] + 1),
                counts[:, 1] / np.maximum(counts[:, 1] + counts[:, 2], 1),
            ]
        )
    return out


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Indicator of the bin of each measure."""
    out = np.zeros((len(x), x.shape[1] * (edges.shape[1] + 1)), np.float32)
    for k in range(x.shape[1]):
        out[np.arange(len(x)), k * (edges.shape[1] + 1) + np.searchsorted(edges[k], x[:, k], "right")] = 1
    return out


def measure_udf():
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def measure(texts: pa.Array) -> pa.Array:
        x = measures(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * N_MEASURES, pa.int32()), pa.array(x.reshape(-1)))

    return measure.asNondeterministic()


def train(docs: DataFrame, labels: DataFrame, usable, *, label_col: str = "quality", max_pos: int = MAX_POSITIVES, max_unl: int = MAX_UNLABELLED) -> tuple[Linear, np.ndarray]:
    """Model and bin edges, from bounded samples (their measures come to the driver)."""
    sample = samples(docs, labels, label_col, usable, max_pos=max_pos, max_unl=max_unl)
    measured = durable(sample.select("p_draw", "u_draw", measure_udf()("text").alias("x")))
    matrix = lambda rows: np.asarray(rows.select("x").toArrow()["x"].combine_chunks().flatten(), float).reshape(-1, N_MEASURES)
    pos, unl = matrix(capped(measured, "p_draw", max_pos)), matrix(capped(measured, "u_draw", max_unl))
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.quantile(unl, cuts, axis=0).T if len(unl) else np.zeros((N_MEASURES, BINS - 1))
    return learn(binned(pos, edges), binned(unl, edges))[0], edges


def quality_scorer(docs: DataFrame, labels: DataFrame, *, folds: int = 3, fold: int = 1):
    """Function from a text column to its score, learnt from ``docs`` and ``labels`` outside
    the held-out fold."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, ~held_out("doc_id", folds, fold)))

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        own, cut = shared.value
        return pa.array(own.score(binned(measures(texts), cut)).astype(float))

    return score.asNondeterministic()


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    score = quality_scorer(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), score("text").alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
