"""Non-negative positive-unlabelled learning of a linear model, and its samples.

The risk of a scorer f under the logistic loss l, with class prior p, is

    p * E_pos[l(f)] + max(0, E_unl[l(-f)] - p * E_pos[l(-f)])

The second term estimates the loss on negatives without a negative example. Where it falls
below zero (only overfitting does that), a step raises it again instead. The class prior is
estimated from the two samples too; rows labelled 0 are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import durable


@dataclass
class Linear:
    """Weights and bias; ``score`` is the modelled chance of the positive class."""

    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.weights + self.bias)


@dataclass
class Sparse:
    """Rows of few values each: entries (row, col, value), sorted by row."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    def __len__(self) -> int:
        return self.shape[0]

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * weights[self.col], minlength=self.shape[0])

    def __rmatmul__(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=self.value * by_row[self.row], minlength=self.shape[1])

    __array_ufunc__ = None

    def half(self, odd: int) -> Sparse:
        """Every second row."""
        mine = self.row % 2 == odd
        return Sparse(self.row[mine] // 2, self.col[mine], self.value[mine], ((self.shape[0] + 1 - odd) // 2, self.shape[1]))


Matrix = np.ndarray | Sparse


def with_ones(x: Matrix) -> Matrix:
    if isinstance(x, Sparse):
        n, m = x.shape
        cells = (np.concatenate([x.row, np.arange(n)]), np.concatenate([x.col, np.full(n, m)]), np.concatenate([x.value, np.ones(n)]))
        return Sparse(*cells, (n, m + 1))
    return np.column_stack([x, np.ones(len(x), np.float32)]).astype(np.float32)


def stacked(a: Matrix, b: Matrix) -> Matrix:
    if isinstance(a, Sparse):
        parts = (np.concatenate([a.row, b.row + len(a)]), np.concatenate([a.col, b.col]), np.concatenate([a.value, b.value]))
        return Sparse(*parts, (len(a) + len(b), a.shape[1]))
    return np.concatenate([a, b]).astype(np.float32)


def newton_step(x: Matrix, bend: np.ndarray, ridge: np.ndarray, slope: np.ndarray, *, rounds: int = 60) -> np.ndarray:
    """Solve (x' diag(bend) x + diag(ridge)) step = slope; sparse rows by conjugate
    gradients scaled by the diagonal, so that no square matrix of the columns is held."""
    if not isinstance(x, Sparse):
        return np.linalg.solve((x * bend[:, None].astype(np.float32)).T @ x + np.diag(ridge), slope)
    scale = 1 / (bend @ Sparse(x.row, x.col, x.value**2, x.shape) + ridge)
    step, left = np.zeros_like(slope), slope.copy()
    ahead = scale * left
    size = left @ ahead
    least = 1e-8 * size
    for _ in range(rounds):
        if size <= least:
            break
        turned = (bend * (x @ ahead)) @ x + ridge * ahead
        along = size / (ahead @ turned)
        step, left = step + along * ahead, left - along * turned
        size, before = left @ (scale * left), size
        ahead = scale * left + (size / before) * ahead
    return step


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def risk_of(theta: np.ndarray, xp: Matrix, xu: Matrix, prior: float) -> tuple[float, float]:
    """The non-negative risk, and the estimated negative part before it is cut off at 0."""
    zp, zu = xp @ theta, xu @ theta
    negative = float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())
    return prior * float(np.logaddexp(0, -zp).mean()) + max(0.0, negative), negative


def fit(pos: Matrix, unl: Matrix, prior: float, *, l2: float = 1e-4, iterations: int = 60, within: bool = False) -> Linear:
    """Minimise the non-negative risk by Newton steps.

    Under the logistic loss l(f) - l(-f) = -f, so where the estimated negative part is above
    zero the risk is convex: -p * E_pos[f] + E_unl[log(1 + exp f)]; a step is halved until it
    lowers the risk. Where a step has left the negative part below zero, the next one goes
    up that part's own slope instead, until it is zero or more again. The best point met
    with such a part of zero or more is the model; if that is still the start, the fit is
    repeated ``within`` the region where the part is zero or more. Without positives or without unlabelled rows the model is the prior alone."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    start = float(np.log(prior / (1 - prior)))
    if not len(pos) or not len(unl):
        return Linear(np.zeros(pos.shape[1], np.float64), start)
    xp, xu = with_ones(pos), with_ones(unl)
    mean_p = xp.mean(axis=0, dtype=np.float64) if isinstance(xp, np.ndarray) else np.full(len(xp), 1 / len(xp)) @ xp
    ridge = np.full(xp.shape[1], l2)
    ridge[-1] = 1e-9
    theta = np.zeros(xp.shape[1])
    theta[-1] = start

    def value(t: np.ndarray) -> tuple[float, float]:
        risk, negative = risk_of(t, xp, xu, prior)
        return risk + 0.5 * float(ridge @ (t * t)), negative

    now, negative = value(theta)
    first = best = theta
    least = np.inf
    for _ in range(iterations):
        if negative >= 0 and now < least:
            best, least = theta, now
        s = sigmoid(xu @ theta)
        bend = s * (1 - s) / len(xu)
        if negative >= 0:  # down the risk
            step = newton_step(xu, bend, ridge + 1e-9, -prior * mean_p + s @ xu / len(xu) + ridge * theta)
            sizes = (0.5**k for k in range(14))
            better = lambda after, its: after < now and (its >= 0 or not within)
        else:  # the correction: up the negative part, no further than needed
            step = newton_step(xu, bend, ridge + 1e-9, prior * (sigmoid(xp @ theta) @ xp) / len(xp) - s @ xu / len(xu))
            sizes = (0.5**k for k in range(13, -3, -1))
            better = lambda after, its: its >= 0
        for size in sizes:
            after, its = value(theta - size * step)
            if better(after, its):
                break
        else:
            break
        small = negative >= 0 and its >= 0 and now - after < 1e-7
        theta, now, negative = theta - size * step, after, its
        if small:
            break
    if negative >= 0 and now < least:
        best = theta
    if best is first and not within:
        return fit(pos, unl, prior, l2=l2, iterations=iterations, within=True)
    return Linear(best[:-1].copy(), float(best[-1]))


def separator(pos: Matrix, unl: Matrix, l2: float, iterations: int = 30) -> Linear:
    """A plain logistic model of sampled as positive against sampled at large: its order of
    texts is all that is used."""
    x = with_ones(stacked(pos, unl))
    y = np.concatenate([np.ones(len(pos)), np.zeros(len(unl))])
    w = np.concatenate([np.full(len(pos), 0.5 / len(pos)), np.full(len(unl), 0.5 / len(unl))])
    theta, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)

    def loss(t: np.ndarray) -> float:
        return float(w @ np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ t)) + 0.5 * (ridge @ (t * t)))

    now = loss(theta)
    for _ in range(iterations):
        s = sigmoid(x @ theta)
        step, size = newton_step(x, w * s * (1 - s), ridge, (w * (s - y)) @ x + ridge * theta), 1.0
        while size > 1e-4 and loss(theta - size * step) >= now:
            size /= 2
        if size <= 1e-4:
            break
        theta = theta - size * step
        gained, now = now - loss(theta), loss(theta)
        if gained < 1e-6:
            break
    return Linear(theta[:-1].copy(), float(theta[-1]))


def estimated_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives in the unlabelled sample, from held-out scores of both.

    Above any score lie at most as many of the unlabelled as the positives among them
    explain, if the top scores are pure: the least ratio of both shares over all scores,
    with a margin for what few rows at the top leave open."""
    if not len(pos) or not len(unl):
        return 0.5
    cuts = np.unique(np.concatenate([pos, unl]))
    above_p = 1 - np.searchsorted(np.sort(pos), cuts) / len(pos)
    above_u = 1 - np.searchsorted(np.sort(unl), cuts) / len(unl)
    some = above_p > 0
    margin = np.sqrt(np.log(40) / (2 * len(pos))) + np.sqrt(np.log(40) / (2 * len(unl)))
    at = np.argmin((above_u[some] + 1.01 * margin) / above_p[some])
    return float(np.clip(above_u[some][at] / above_p[some][at], 1e-3, 1 - 1e-3))


def learn(pos: Matrix, unl: Matrix, *, l2: float = 1e-4) -> tuple[Linear, float]:
    """Model and class prior: one half of either sample orders the other half's rows, from
    whose scores the prior is estimated; the model is then fitted to all rows."""
    if not len(pos) or not len(unl):
        return fit(pos, unl, 0.5, l2=l2), 0.5
    half = lambda x, odd: x.half(odd) if isinstance(x, Sparse) else x[odd::2]
    guide = separator(half(pos, 0), half(unl, 0), l2)
    prior = estimated_prior(guide.score(half(pos, 1)), guide.score(half(unl, 1)))
    return fit(pos, unl, prior, l2=l2), prior


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether a document's id falls into the fold that is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def samples(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, *, max_pos: int, max_unl: int) -> DataFrame:
    """Stored rows (text, p_draw, u_draw) of trusted positives and of unlabelled text.

    A draw is null where a row isn't in that sample. Draws are hashes of id and text, so
    they don't depend on how the rows are split among tasks; rows that repeat both count
    once. The rows are some ``max_pos`` and ``max_unl``; ``capped`` holds the figures
    exactly. Labelled ids are shared out within the same bound."""
    known = labels.where(F.col(label_col) == 1).where(usable).select("doc_id").distinct()
    rate = lambda most, of: min(1.0, most / max(1, of))
    hashed = lambda seed, *of: F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)) / float(1 << 52)
    chosen = durable(known.where(hashed("known", "doc_id") < rate(max_pos, known.count())))
    marked = docs.select("doc_id", "text").where(usable).join(F.broadcast(chosen.withColumn("known", F.lit(True))), "doc_id", "left")
    row = F.xxhash64("doc_id", "text")
    n_pos, n_all = marked.agg(F.approx_count_distinct(F.when(F.col("known"), row)), F.approx_count_distinct(row)).first()
    drawn = marked.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "known", hashed("p", "doc_id", "text").alias("p"), hashed("u", "doc_id", "text").alias("u"))
    in_pos, in_unl = F.col("known") & (F.col("p") < rate(max_pos, n_pos)), F.col("u") < rate(max_unl, n_all)
    kept = drawn.where(in_pos | in_unl).dropDuplicates(["doc_id", "p", "u"])
    return durable(kept.select("text", F.when(in_pos, F.col("p")).alias("p_draw"), F.when(in_unl, F.col("u")).alias("u_draw")))


def capped(sample: DataFrame, draw: str, most: int) -> DataFrame:
    """The rows of one sample, ``most`` at most, least draws first."""
    return sample.where(F.col(draw).isNotNull()).orderBy(draw).limit(most)
