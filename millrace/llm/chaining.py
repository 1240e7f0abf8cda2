"""Substring dedup by collinear chaining: fuzzy passages that repeat across documents.

1. Seeds: hashes of ``K`` consecutive words. One in ``SPARSE`` is a seed by its own hash,
   wherever it stands, so edits nearby take no seed away; ``WINDOW`` neighbours without one
   add their least, so any shared run of K + WINDOW - 1 words shares a seed for certain.
2. Join: a seed that several documents hold points from each of them to one anchor, the
   holder of least doc_id (a star, never all pairs). So does each run of adjacent shared
   seeds over ``RUNS`` words whose seeds have different anchors, as the parts of a passage
   may have other, lesser holders: a run's anchor holds all of it. An exact passage of
   MIN_WORDS + 2 * (WINDOW - 1) words or more always has such a run of MIN_WORDS, whose
   anchor shares a passage of that size.
3. Chaining: the seeds of a (document, anchor) pair that ascend in both texts are chained
   for the best sum of covered words less gap costs, through a Fenwick tree of prefix
   maxima over the anchor's positions.
4. Alignment: the words of a chained stretch and of its surroundings are fetched for both
   sides and aligned; between seeds by edit distance, beyond the ends as far as words
   agree but for a few edits. A passage counts with ``MIN_WORDS`` words and
   ``MIN_IDENTITY`` of them aligned; a chain that falls short as a whole is split, and its
   longest parts that do are kept.

Documents of equal words are one class: its least doc_id stands for it in the chaining,
and each other member is returned with one passage, its whole text.

Edge cases: null and empty texts have no seeds and no passages; documents without an id
can't be named as a partner and have no passages; rows that repeat id and text count as one
document; different texts under one id are different documents (and may share passages);
an id of any type is returned as it is; an empty table gives an empty result; other columns
pass by unread.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.skew import MOST, join_by_key
from millrace.llm.text import as_buffers, pieces, words_of
from millrace.session import durable, table

K, SPARSE, WINDOW, MAX_GAP = 5, 8, 16, 64
MIN_WORDS, MIN_IDENTITY = 50, 0.8

#: Hashes below this are seeds by themselves.
LOW = np.uint64(2**64 // SPARSE)

#: Least words of the runs of seeds that get an anchor of their own.
RUNS = (24, MIN_WORDS)

#: Words in a fetched block, and words fetched beyond either end of a chain: so many that a
#: single seed can grow to MIN_WORDS on one side.
BLOCK, AROUND = 32, MIN_WORDS - K

#: Cost of a word of gap, against K for a seed.
GAP_COST = 0.05

#: Words that may be passed over beyond a chain's end, and words that must agree behind.
JUMP, AGREE = 4, 4
JUMPS = sorted(((i, j) for i in range(JUMP + 1) for j in range(JUMP + 1) if i or j), key=lambda ij: (sum(ij), abs(ij[0] - ij[1]), ij))

#: Rows of blocks that are aligned at a time.
STRETCH = 16384

#: Ids that every task may hold as a filter; with more, no filter is used.
MAX_SHARED = 1_000_000

_MULT = np.uint64(0x9E3779B97F4A7C15)


def kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * _MULT + words[j : j + n]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def seed_places(grams: np.ndarray, owner: np.ndarray, whole: np.ndarray, window: int) -> np.ndarray:
    """Places of the seeds among the grams of several texts (``owner``: whose a gram is;
    ``whole``: whether it lies within its text).

    Grams of a low hash are seeds wherever they stand, so an edit nearby takes none away;
    a window of grams of one text without such a seed adds its least gram (the rightmost
    of equals), so every run of K + window - 1 words has a seed."""
    low = whole & (grams < LOW)
    places, n = [np.flatnonzero(low)], len(grams) - window + 1
    if n > 0:
        upto = np.concatenate(([0], np.cumsum(low)))
        bare = np.flatnonzero((upto[window:] == upto[:n]) & whole[window - 1 :] & (owner[:n] == owner[window - 1 :]))
        for a in range(0, len(bare), 1 << 15):
            at = bare[a : a + (1 << 15)]
            view = np.lib.stride_tricks.sliding_window_view(grams, window)[at]
            places.append(np.unique(at + window - 1 - np.argmin(view[:, ::-1], axis=1)))
    return np.unique(np.concatenate(places))


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Which rows are the first with their key."""
    order = np.lexsort(keys[::-1])
    changed = np.zeros(len(order), bool)
    changed[:1] = True
    for k in keys:
        changed[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.zeros(len(order), bool)
    out[order[changed]] = True  # lexsort is stable: the first of equals
    return out


def _seed_rows(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    """(hash, doc_id, pos, first) of all seeds of texts with ``least_words``; pos
    -1 - n_words: the hash of all words. ``first`` marks a seed's first place in a text."""
    window = max(1, min(WINDOW, least_words - K + 1))
    for batch in batches:
        ids = np.asarray(batch.column(0))
        data, offsets = as_buffers(batch.column(1))
        for lo, hi in pieces(offsets):
            _, _, words, rows = words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            size = np.diff(rows)
            long = np.flatnonzero(size >= max(1, least_words))
            if not len(long):
                continue
            owner = np.repeat(np.arange(hi - lo), size)
            rank = np.arange(len(words)) - rows[owner]
            with np.errstate(over="ignore"):
                mixed = kmers(words, 1) * (2 * rank.astype(np.uint64) + np.uint64(1))
            some = np.flatnonzero(size)
            entire = np.zeros(hi - lo, np.uint64)
            entire[some] = np.bitwise_xor.reduceat(mixed, rows[some])
            grams = kmers(words, K)
            own = owner[: len(grams)]
            at = seed_places(grams, own, (rank[: len(grams)] + K <= size[own]) & (size[own] >= least_words), window)
            hashes, docs, places = grams[at], own[at], rank[at]
            columns = [
                np.concatenate((hashes, entire[long])).view(np.int64),
                ids[lo + np.concatenate((docs, long))],
                np.concatenate((places, -1 - size[long])).astype(np.int32),
                np.concatenate((firsts(docs, hashes), np.ones(len(long), bool))),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["hash", "doc_id", "pos", "first"])


def _powers_at(base: int, exponents: np.ndarray) -> np.ndarray:
    """Powers of ``base`` modulo 2**64."""
    out, left, square = np.ones(len(exponents), np.uint64), exponents.astype(np.uint64), np.uint64(base)
    with np.errstate(over="ignore"):
        while left.any():
            out = np.where(left & np.uint64(1), out * square, out)
            left, square = left >> np.uint64(1), square * square
    return out


def seed_runs(docs: np.ndarray, pos: np.ndarray, hashes: np.ndarray, anchors: np.ndarray, a_pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """From each seed on, the shortest run of adjacent seeds over each of RUNS words: hash,
    doc_id, pos, span, first. Seeds come sorted by (doc_id, pos); the hash is the same
    wherever the same seeds stand at the same distances. Runs whose seeds already point to
    one anchor, at one distance, are left out: whoever holds such a run leaves it out."""
    n = len(docs)
    other = np.concatenate(([False], docs[1:] != docs[:-1]))
    far = np.cumsum(other | np.concatenate(([False], np.diff(pos) > WINDOW)))
    turn = np.cumsum(other | np.concatenate(([False], (np.diff(anchors) != 0) | (np.diff(a_pos - pos) != 0))))
    key = (np.cumsum(other) << 32) + pos
    mult = int(_MULT)
    found = []
    with np.errstate(over="ignore"):
        upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes.astype(np.int64).view(np.uint64) * _powers_at(mult, pos), dtype=np.uint64)))
        back = _powers_at(pow(mult, -1, 1 << 64), pos)
        for least in RUNS:
            j = np.searchsorted(key, key + (least - K))
            i = np.flatnonzero(j < n)
            i = i[(far[j[i]] == far[i]) & (turn[j[i]] != turn[i])]
            whole = (upto[j[i] + 1] - upto[i]) * back[i] + np.uint64(least)
            whole = (whole ^ (whole >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((whole.view(np.int64), docs[i], pos[i], pos[j[i]] + K - pos[i], firsts(docs[i], whole)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut only where the first ``keys`` columns change."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.asarray(c).astype(np.int64) for c in batch.columns]
        if held and any(c[0] != h[0] for c, h in zip(rows[:keys], held[0][:keys], strict=True)):
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in rows[:keys]], axis=0)) + 1
        if len(changes):
            last = int(changes[-1])
            yield [np.concatenate(c) for c in zip(*held, [c[:last] for c in rows], strict=True)]
            held, rows = [], [c[last:] for c in rows]
        held.append(rows)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a partition whose seeds come sorted by (doc_id, pos)."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    for docs, pos, hashes, anchors, a_pos in _whole_groups(batches, 1):
        found = seed_runs(docs, pos, hashes, anchors, a_pos)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], ["hash", "doc_id", "pos", "span", "first"])


class Fenwick:
    """Prefix maxima of (value, index) over ranks."""

    def __init__(self, n: int) -> None:
        self.n, self.best = n, [(0.0, -1)] * (n + 1)

    def put(self, rank: int, value: float, index: int) -> None:
        rank += 1
        while rank <= self.n:
            if value > self.best[rank][0]:
                self.best[rank] = (value, index)
            rank += rank & -rank

    def below(self, rank: int) -> tuple[float, int]:
        """Best entry of a rank under ``rank``."""
        best = (0.0, -1)
        while rank > 0:
            if self.best[rank][0] > best[0]:
                best = self.best[rank]
            rank -= rank & -rank
        return best


def chains(pos: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
    """Best collinear chains of seeds, as lists of indices in order; no seed is in two.

    A chain's value is K for each seed less GAP_COST for every word passed over in either
    text, so values shifted by GAP_COST * (pos + other) compare across predecessors."""
    n = len(pos)
    if (other - pos == other[0] - pos[0]).all():
        order = np.argsort(pos, kind="stable")
        cut = np.flatnonzero(np.diff(pos[order]) > MAX_GAP) + 1
        return np.split(order, cut)
    order = np.lexsort((-other, pos))  # seeds at one place can't follow one another
    x, y = pos[order].tolist(), other[order].tolist()
    ranks = np.unique(other, return_inverse=True)[1][order].tolist()
    tree = Fenwick(max(ranks) + 1)
    value, before = [0.0] * n, [-1] * n
    for i in range(n):
        shifted, j = tree.below(ranks[i])
        if j >= 0 and not (x[j] < x[i] <= x[j] + MAX_GAP and y[i] <= y[j] + MAX_GAP):
            near = ((value[h] + GAP_COST * (x[h] + y[h]), h) for h in range(bisect_left(x, x[i] - MAX_GAP), i) if x[h] < x[i] and y[h] < y[i] <= y[h] + MAX_GAP)
            shifted, j = max(near, default=(0.0, -1))  # the best is too far: the best of those within reach
        gain = shifted - GAP_COST * (x[i] + y[i]) if j >= 0 else 0.0
        if j >= 0 and gain > 0:
            value[i], before[i] = K + gain, j
        else:
            value[i] = float(K)
        tree.put(ranks[i], value[i] + GAP_COST * (x[i] + y[i]), i)
    used, found = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-value[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            found.append(order[chain[::-1]])
    return found


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of a partition whose rows come sorted by (doc_id, anchor): the outer places
    in either text, and all seeds as pairs of 32-bit places."""
    names = ["doc_id", "start", "end", "anchor", "a_start", "a_end", "seeds"]
    for docs, anchors, pos, other in _whole_groups(batches, 2):
        order = np.lexsort((other, pos, anchors, docs))
        kept = firsts(docs[order], anchors[order], pos[order], other[order])
        docs, anchors, pos, other = (c[order[kept]] for c in (docs, anchors, pos, other))
        new = np.concatenate(([True], (docs[1:] != docs[:-1]) | (anchors[1:] != anchors[:-1])))
        group, at, apart = np.cumsum(new) - 1, np.flatnonzero(new), other - pos
        bent = np.minimum.reduceat(apart, at) != np.maximum.reduceat(apart, at)
        # groups on one diagonal are only cut at wide gaps; the others are searched
        straight = np.flatnonzero(~bent[group])
        cut = new | np.concatenate(([True], np.diff(pos) > MAX_GAP))
        picked, begin = [straight], [cut[straight]]
        ends = np.append(at[1:], len(pos))
        for a, b in zip(at[bent].tolist(), ends[bent].tolist(), strict=True):
            for chain in chains(pos[a:b], other[a:b]):
                picked.append(a + chain)
                begin.append(np.arange(len(chain)) == 0)
        rows, starts = np.concatenate(picked), np.flatnonzero(np.concatenate(begin))
        first, last = rows[starts], rows[np.append(starts[1:], len(rows)) - 1]
        pairs = np.column_stack((pos[rows], other[rows])).astype("<i4")
        for a in range(0, len(starts), 1 << 16):  # small batches
            c = slice(a, a + (1 << 16))
            offsets = np.append(starts[c], starts[c.stop] if c.stop < len(starts) else len(rows))
            body = pairs[offsets[0] : offsets[-1]].tobytes()
            seeds = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((8 * (offsets - offsets[0])).astype(np.int64)), pa.py_buffer(body)])
            columns = [docs[first[c]], pos[first[c]], pos[last[c]] + K, anchors[first[c]], other[first[c]], other[last[c]] + K]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), seeds.cast(pa.binary())], names)


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, block, words): texts as blocks of 32-bit word hashes."""
    for batch in batches:
        ids = np.asarray(batch.column(0))
        data, offsets = as_buffers(batch.column(1))
        for lo, hi in pieces(offsets):
            _, _, words, rows = words_of(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            small = (words >> np.uint64(32)).astype("<u4")
            per = -(-np.diff(rows) // BLOCK)
            owner = np.repeat(np.arange(hi - lo), per)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
            bounds = np.append(rows[owner] + BLOCK * number, len(small)).astype(np.int64)
            cut = pa.Array.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(4 * bounds), pa.py_buffer(small.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo + owner]), pa.array(number), cut.cast(pa.binary())], ["doc_id", "block", "words"])


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """Words of a longest common subsequence, by bits of one number: a bit of ``a`` goes
    out where the length grows."""
    if not len(a) or not len(b):
        return 0
    if len(a) == len(b) and (a == b).all():
        return len(a)
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for word in b.tolist():
        same = row & places.get(word, 0)
        row = ((row + same) | (row - same)) & full
    return len(a) - row.bit_count()


def extended(words: np.ndarray, a: np.ndarray, a_stop: np.ndarray, b: np.ndarray, b_stop: np.ndarray, step: int) -> np.ndarray:
    """How far pairs of texts go on alike from places a and b of ``words`` up to (not
    including) a_stop and b_stop, forward (step 1) or backward (step -1): one row a pair
    of words passed in either text and words that agree.

    A stretch goes on while few words differ; at its end up to JUMP words of either text are
    passed over if AGREE words agree behind them (an insertion, deletion or exchange)."""
    out = np.zeros((len(a), 3), np.int64)
    live, ahead = np.arange(len(a)), np.arange(AROUND + BLOCK)
    while len(live):
        x, y = a[live] + step * out[live, 0], b[live] + step * out[live, 1]
        room_x, room_y = step * (a_stop[live] - x), step * (b_stop[live] - y)
        ok = ahead < np.minimum(room_x, room_y)[:, None]
        same = ok & (words[np.where(ok, x[:, None] + step * ahead, 0)] == words[np.where(ok, y[:, None] + step * ahead, 0)])
        gained = np.cumsum(np.where(same, 1, -4), axis=1)
        far = np.where(gained.max(axis=1) > 0, np.argmax(gained, axis=1) + 1, 0)
        agree = np.where(far > 0, np.cumsum(same, axis=1)[np.arange(len(live)), np.maximum(far - 1, 0)], 0)
        out[live] += np.column_stack((far, far, agree))
        x, y, room_x, room_y = x + step * far, y + step * far, room_x - far, room_y - far
        todo, jumped = np.flatnonzero((room_x > AGREE) & (room_y > AGREE)), np.zeros(len(live), bool)
        for i, j in JUMPS:
            if not len(todo):
                break
            fits = (room_x[todo] >= i + AGREE) & (room_y[todo] >= j + AGREE)
            for k in range(AGREE):
                where = np.flatnonzero(fits)
                fits[where] = words[x[todo[where]] + step * (i + k)] == words[y[todo[where]] + step * (j + k)]
            hit = todo[fits]
            out[live[hit], 0] += i
            out[live[hit], 1] += j
            jumped[hit] = True
            todo = todo[~fits]
        live = live[jumped]
    return out


def reach(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``extended`` forward over one pair of runs of words, whole."""
    both = np.concatenate((a, b, np.zeros(1, a.dtype)))
    one = lambda x: np.array([x])
    return extended(both, one(0), one(len(a)), one(len(a)), one(len(a) + len(b)), 1)[0]


def aligned(mine: np.ndarray, m_at: int, theirs: np.ndarray, t_at: int, seeds: list[tuple[int, int]], min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY, ends: tuple | None = None) -> list[tuple[int, int, int, int, float]]:
    """Stretches (start, end in either text, identity) of one chain: the whole chain if
    it has ``min_words`` words and ``min_identity`` of them agree, else every part from
    one exact run to another that has, and that no longer such part holds.

    ``mine`` holds words from ``m_at`` on, ``theirs`` from ``t_at`` on; ``ends`` is how far
    the chain goes on before its first and after its last seed, where that is known."""
    p, q = seeds[0]
    x, y = p + K, q + K
    runs, between = [[p, q, K]], []  # exact runs (place in either text, words); words that agree in the gaps
    for sp, sq in seeds[1:]:
        if sp < x or sq < y:  # overlaps what is aligned already
            step = min(sp + K - x, sq + K - y)
            if sp + K - x == sq + K - y and step > 0:
                runs[-1][2] += step
                x, y = x + step, y + step
            continue
        gap, other = mine[x - m_at : sp - m_at], theirs[y - t_at : sq - t_at]
        if len(gap) == len(other) and (gap == other).all():
            runs[-1][2] += len(gap) + K
        else:
            between.append(agreeing(gap, other))
            runs.append([sp, sq, K])
        x, y = sp + K, sq + K

    # the whole chain
    x, y, n = runs[-1]
    back, ahead = ends or (reach(mine[: p - m_at][::-1], theirs[: q - t_at][::-1]), reach(mine[x + n - m_at :], theirs[y + n - t_at :]))
    start, end, a_start, a_end = p - back[0], x + n + ahead[0], q - back[1], y + n + ahead[1]
    identity = (sum(r[2] for r in runs) + sum(between) + back[2] + ahead[2]) / max(end - start, a_end - a_start)
    if end - start < min_words or len(runs) == 1 or identity >= min_identity:
        return [(start, end, a_start, a_end, identity)] if end - start >= min_words and identity >= min_identity else []

    # its parts: what each run gains on either side, up to the next run, where one starts or ends with it
    m, t, size = (np.array(c) for c in zip(*runs, strict=True))
    m_end, t_end = m + size, t + size
    back = [back, *(reach(mine[a - m_at : b - m_at][::-1], theirs[c - t_at : d - t_at][::-1]) for a, b, c, d in zip(m_end[:-1], m[1:], t_end[:-1], t[1:], strict=True))]
    ahead = [*(reach(mine[a - m_at : b - m_at], theirs[c - t_at : d - t_at]) for a, b, c, d in zip(m_end[:-1], m[1:], t_end[:-1], t[1:], strict=True)), ahead]
    back, ahead = np.array(back), np.array(ahead)
    upto = np.cumsum(size) + np.concatenate(([0], np.cumsum(between, dtype=np.int64)))
    start, end, a_start, a_end = m - back[:, 0], m_end + ahead[:, 0], t - back[:, 1], t_end + ahead[:, 1]
    before, after = upto - size - back[:, 2], upto + ahead[:, 2]

    found, last = [], -1
    for i in range(len(runs)):
        words, others, agree = end[i:] - start[i], a_end[i:] - a_start[i], after[i:] - before[i]
        identity = agree / np.maximum(words, others)
        good = np.flatnonzero((words >= min_words) & (identity >= min_identity))
        if len(good) and i + good[-1] > last:
            n, last = int(good[-1]), i + int(good[-1])
            found.append((int(start[i]), int(end[last]), int(a_start[i]), int(a_end[last]), float(identity[n])))
    return found


def _passages_of(rows: pa.Table, min_words: int, min_identity: float) -> list[np.ndarray]:
    """Columns of the passages of whole chains: doc_id, start, end, anchor, a_start, a_end,
    identity. Chains on one diagonal are measured all at once, the others one by one."""
    chain, side, doc, block = (np.asarray(rows.column(k)).astype(np.int64) for k in range(4))
    order = np.lexsort((block, side, chain))
    chain, side, doc, block = (c[order] for c in (chain, side, doc, block))
    cells = rows.column(4).combine_chunks().cast(pa.large_binary()).take(pa.array(order))
    _, offs, data = cells.buffers()
    off = np.frombuffer(offs, np.int64)[: len(order) + 1] // 4
    words = np.frombuffer(data, "<i4", int(off[-1])) if off[-1] else np.zeros(1, "<i4")

    c0 = np.flatnonzero(np.concatenate(([True], chain[1:] != chain[:-1])))
    c1 = np.append(c0[1:], len(chain))
    s1 = c0 + 1 + np.add.reduceat(side == 0, c0)
    m_off, m_stop, m_at, t_off, t_stop, t_at = off[c0 + 1], off[s1], block[c0 + 1] * BLOCK, off[s1], off[c1], block[s1] * BLOCK
    p, q, x, y = words[off[c0]], words[off[c0] + 1], words[off[c0 + 1] - 2] + K, words[off[c0 + 1] - 1] + K
    to_m, to_t = m_off - m_at, t_off - t_at  # from a place in the text to one in ``words``
    back = extended(words, p + to_m - 1, m_off - 1, q + to_t - 1, t_off - 1, -1)
    ahead = extended(words, x + to_m, m_stop, y + to_t, t_stop, 1)
    start, end, a_start, a_end = p - back[:, 0], x + ahead[:, 0], q - back[:, 1], y + ahead[:, 1]
    n_seeds = (off[c0 + 1] - off[c0]) // 2
    owner = np.repeat(np.arange(len(c0)), n_seeds)
    pairs = np.repeat(off[c0], n_seeds) + 2 * (np.arange(len(owner)) - np.repeat(np.cumsum(n_seeds) - n_seeds, n_seeds))
    apart = words[pairs + 1] - words[pairs]
    at = np.cumsum(n_seeds) - n_seeds
    straight = np.minimum.reduceat(apart, at) == np.maximum.reduceat(apart, at)
    long = end - start >= min_words

    middle = np.where(straight & long, x - p, 0)
    owner = np.repeat(np.arange(len(c0)), middle)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(middle) - middle, middle)
    same = words[(p + to_m)[owner] + step] == words[(q + to_t)[owner] + step]
    agree = np.bincount(owner[same], minlength=len(c0)) + back[:, 2] + ahead[:, 2]
    identity = agree / np.maximum(end - start, a_end - a_start)
    good = straight & long & (identity >= min_identity)
    mine, theirs = doc[c0 + 1], doc[s1]
    found = [[c[good] for c in (mine, start, end, theirs, a_start, a_end, identity)]]

    more = []
    for i in np.flatnonzero(long & ~good).tolist():
        seeds = words[off[c0[i]] : off[c0[i] + 1]].reshape(-1, 2).tolist()
        stretches = aligned(words[m_off[i] : m_stop[i]], int(m_at[i]), words[t_off[i] : t_stop[i]], int(t_at[i]), seeds, min_words, min_identity, (back[i], ahead[i]))
        more += [(mine[i], s, e, theirs[i], a_s, a_e, alike) for s, e, a_s, a_e, alike in stretches]
    if more:
        found.append([np.array(c) for c in zip(*more, strict=True)])
    return [np.concatenate(c) for c in zip(*found, strict=True)]


def _align_rows(batches: Iterator[pa.RecordBatch], min_words: int, min_identity: float) -> Iterator[pa.RecordBatch]:
    """Passages of a partition whose rows (chain, side, doc_id, block, words) come sorted by
    chain: its seeds (side -1), then the blocks of words of either text."""
    names, held = ["doc_id", "start", "end", "anchor", "a_start", "a_end", "identity"], []

    def solved(upto: list[pa.RecordBatch]) -> pa.RecordBatch:
        columns = _passages_of(pa.Table.from_batches(upto), min_words, min_identity)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "identity" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    for batch in batches:
        for a in range(0, batch.num_rows, STRETCH):
            part = batch.slice(a, STRETCH)
            chain = np.asarray(part.column(0))
            cut = int(np.searchsorted(chain, chain[-1]))
            if held and (cut or held[0].column(0)[0].as_py() != chain[0]):
                yield solved([*held, part.slice(0, cut)] if cut else held)
                held = []
            elif cut:
                yield solved([part.slice(0, cut)])
            held.append(part.slice(cut))
    if held:
        yield solved(held)


def _renamed(texts: DataFrame, repeated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts with one row a document, and (own, doc_id) of the new ids: the texts of an id
    that has several rows get ids beyond all others, one for each different text."""
    most = texts.agg(F.max("doc_id")).first()[0]
    marked = texts.join(F.broadcast(repeated) if repeated.count() <= MAX_SHARED else repeated, "doc_id", "left_semi")
    once = marked.groupBy("doc_id", F.sha2("text", 256).alias("sha")).agg(F.min("text").alias("text"))
    own = durable(once.select("doc_id", "text", (F.monotonically_increasing_id() + F.lit(most) + 1).alias("own")))
    others = texts.join(F.broadcast(repeated) if repeated.count() <= MAX_SHARED else repeated, "doc_id", "left_anti")
    return others.unionByName(own.select(F.col("own").alias("doc_id"), "text")), own.select("own", "doc_id")


def passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """Passages: doc_id, start, end (words), anchor, a_start, a_end, identity."""
    kind = docs.schema[id_col].dataType
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    if kind.typeName() in ("long", "integer", "short", "byte"):
        texts, names = known.select(F.col("doc_id").cast("long"), "text"), None
    else:  # numbers stand for other ids
        once = known.groupBy("doc_id", F.sha2("text", 256)).agg(F.min("text").alias("text"))
        numbered = durable(once.select("doc_id", "text", F.monotonically_increasing_id().alias("own")))
        texts, names = numbered.select(F.col("own").alias("doc_id"), "text"), numbered.select("own", "doc_id")
    least = max(1, math.ceil(min_words * min_identity - 1e-9))  # of words, in either text of a passage
    seeds_of = lambda rows: durable(rows.mapInArrow(lambda b: _seed_rows(b, least), "hash bigint, doc_id bigint, pos int, first boolean"))
    seeds = seeds_of(texts)
    repeated = durable(seeds.where("pos < 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if not repeated.isEmpty():
        texts, names = _renamed(texts, repeated)
        seeds = seeds_of(texts)

    # classes of equal texts: the least id stands for all
    wholes = seeds.where("pos < 0").select("doc_id", "hash", (-1 - F.col("pos")).alias("n_words"))
    first = durable(wholes.groupBy("hash", "n_words").agg(F.min("doc_id").alias("anchor"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    copies = durable(join_by_key(wholes, first, ["hash", "n_words"], wholes.count()).where("doc_id != anchor").select("doc_id", "anchor", "n_words"))
    single = seeds.where("pos >= 0").join(F.broadcast(copies.select("doc_id")) if copies.count() <= MAX_SHARED else copies.select("doc_id"), "doc_id", "left_anti")

    # each shared seed and its anchor
    lead = F.when(F.col("first"), F.col("doc_id"))
    anchored = [F.min("doc_id").alias("anchor"), F.min_by("pos", lead).alias("a_pos"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")]
    several = durable(single.groupBy("hash").agg(*anchored).where("anchor != most").drop("most"))
    shared = durable(join_by_key(single.select("hash", "doc_id", "pos"), several, ["hash"], seeds.count()))
    by_seed = shared.where("doc_id != anchor").select("doc_id", "anchor", "pos", "a_pos")

    # runs of shared seeds: their first and last seed point to the run's anchor
    ordered = shared.select("doc_id", "pos", "hash", "anchor", "a_pos").repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    runs = durable(ordered.mapInArrow(_run_rows, "hash bigint, doc_id bigint, pos int, span int, first boolean"))
    held = durable(runs.groupBy("hash", "span").agg(*anchored).where("anchor != most").drop("most"))
    ends = join_by_key(runs.drop("first"), held, ["hash", "span"], runs.count()).where("doc_id != anchor").withColumn("by", F.explode(F.array(F.lit(0), F.col("span") - K)))
    by_run = ends.select("doc_id", "anchor", (F.col("pos") + F.col("by")).alias("pos"), (F.col("a_pos") + F.col("by")).alias("a_pos"))

    pairs = by_seed.unionByName(by_run).repartition("doc_id", "anchor").sortWithinPartitions("doc_id", "anchor")
    chained = pairs.mapInArrow(_chain_rows, "doc_id bigint, start bigint, end bigint, anchor bigint, a_start bigint, a_end bigint, seeds binary")
    found = durable(chained.withColumn("chain", F.monotonically_increasing_id()))

    # blocks of words that the chains cover, from both texts
    upto = lambda a, b: [F.floor(F.greatest(F.col(a) - AROUND, F.lit(0)) / BLOCK), F.floor((F.col(b) + AROUND) / BLOCK)]
    side = lambda n, doc, a, b: found.select("chain", F.lit(n).alias("side"), F.col(doc).alias("doc_id"), F.explode(F.sequence(*upto(a, b))).alias("block"))
    wanted = side(0, "doc_id", "start", "end").unionByName(side(1, "anchor", "a_start", "a_end"))
    ids = durable(found.select("doc_id").union(found.select(F.col("anchor").alias("doc_id"))).distinct())
    in_chains = texts.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= MAX_SHARED else texts
    blocks = lambda rows: rows.mapInArrow(_block_rows, "doc_id bigint, block bigint, words binary")
    # blocks that over 1/MOST of the chains' sides want number fewer than MOST: shared out
    a_lo, a_hi = upto("a_start", "a_end")
    total = found.agg(F.sum(a_hi - a_lo + 1)).first()[0] or 0
    busy = found.groupBy("anchor").agg(F.sum(a_hi - a_lo + 1).alias("n")).where(F.col("n") > total / MOST).select(F.col("anchor").alias("doc_id"))
    hot = durable(side(1, "anchor", "a_start", "a_end").join(F.broadcast(busy), "doc_id", "left_semi").groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > total / MOST).select("doc_id", "block"))
    if hot.isEmpty():
        fetched = wanted.join(blocks(in_chains), ["doc_id", "block"])
    else:
        few = blocks(texts.join(F.broadcast(hot.select("doc_id").distinct()), "doc_id", "left_semi")).join(F.broadcast(hot), ["doc_id", "block"], "left_semi")
        rest = wanted.join(F.broadcast(hot), ["doc_id", "block"], "left_anti").join(blocks(in_chains), ["doc_id", "block"])
        fetched = wanted.join(F.broadcast(few), ["doc_id", "block"]).unionByName(rest)
    shape = ["chain", "side", "doc_id", "block", "words"]
    head = found.select("chain", F.lit(-1).alias("side"), "doc_id", F.lit(0).cast("long").alias("block"), F.col("seeds").alias("words"))
    ready = head.unionByName(fetched.select(*shape)).repartition("chain").sortWithinPartitions("chain")
    long = ready.mapInArrow(lambda b: _align_rows(b, min_words, min_identity), "doc_id bigint, start bigint, end bigint, anchor bigint, a_start bigint, a_end bigint, identity double").distinct()

    zero, n = F.lit(0).cast("long"), F.col("n_words").cast("long")
    same = copies.where(F.col("n_words") >= min_words).select("doc_id", zero.alias("start"), n.alias("end"), "anchor", zero.alias("a_start"), n.alias("a_end"), F.lit(1.0).alias("identity"))
    whole = long.unionByName(same)
    if names is not None:  # back to the ids of the rows
        own = names.select(F.col("own").alias("doc_id"), F.col("doc_id").alias("named"))
        for c in ("doc_id", "anchor"):
            back = F.coalesce("named", c) if names.schema["doc_id"].dataType == texts.schema["doc_id"].dataType else F.col("named")
            whole = whole.join(own.withColumnRenamed("doc_id", c), c, "left").withColumn(c, back).drop("named")
    return whole.select("doc_id", "start", "end", "anchor", "a_start", "a_end", "identity")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document shares with its anchors."""
    found = passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("anchor").alias("other_doc_id"), F.col("start").alias("first_word"), F.col("end").alias("end_word"), F.col("a_start").alias("other_first_word"), F.col("a_end").alias("other_end_word"), "identity")
