"""Embedding near-dedup: a pivot-permutation index with shared-pivot counts.

Reference points (pivots) come from a bounded sample and lie apart from each other. A vector
is described by the ``PREFIX`` pivots that are nearest to it, in order. Two vectors of a small
angle share most of them, so candidates are those that share at least ``SHARED``; inverted
lists by pivot find them, and each pair is looked at in the list of its first common pivot
only. The index misses a linked pair when it shares fewer (recall is measured in the tests).
A list holds vectors in 8 bits; what its error bound lets pass is verified in double precision.

Large groups of near copies never meet pair by pair. Vectors within half the link angle of a
leader surely link with each other (triangle inequality), so they form a ball, and the index
holds leaders only. Balls are made inside the tasks of a range partitioning, and members of
balls whose leaders lie close together then move to one of them. Two balls link wholly or not
at all where angles and radii decide; else each member is held against the other's leader, and
only members still undecided are compared one by one. Counts are therefore exact for the pairs
of balls that the index finds, and no pair of copies is ever a row.

A pivot list of over ``LONG`` leaders is dealt anew by second common pivot.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of unequal length compare as if padded with zeros; repeated rows count each;
a component's id is its smallest id that is not null; an empty table gives an empty result;
other columns pass by unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.graph import components
from millrace.llm.skew import join_by_key
from millrace.session import durable, table

#: Nearest pivots that describe a vector, and how many of them candidates share.
PREFIX, SHARED = 8, 2

#: Pivots: about the root of the number of vectors, within these bounds; they come from a
#: sample of ``SAMPLE`` vectors a pivot, and no two have a cosine over ``APART``.
LEAST_PIVOTS, MOST_PIVOTS, SAMPLE, APART = 64, 4096, 4, 0.9

#: Leaders of a pivot list beyond which it is dealt anew by a second pivot.
LONG = 8192

#: Bounds on angles are kept apart by this much, against rounding.
SLACK = 1e-7


@F.arrow_udf(T.BinaryType())
def unit_vectors(vectors: pa.Array) -> pa.Array:
    """Finite non-zero vectors at length one, as doubles; null for all others."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    out = []
    for v in vectors:
        x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(x).max(initial=0) if x is not None else 0
        if not np.isfinite(top) or top == 0:
            out.append(None)
            continue
        x = x / top
        out.append((x / math.sqrt(x @ x)).astype("<f8").tobytes())
    return pa.array(out, pa.binary())


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles, padded with zeros to ``dim``."""
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        x = np.frombuffer(v.as_buffer(), "<f8")
        out[i, : len(x)] = x
    return out


def choose_pivots(units: DataFrame, dim: int, total: int) -> np.ndarray:
    """Pivots that lie apart, in the order of a hash of the sampled vectors."""
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(total)))
    rows = units.where("u is not null").select("u", F.xxhash64("id", "u").alias("h")).orderBy("h", "u").limit(SAMPLE * wanted).collect()
    found = np.zeros((0, dim))
    for r in rows:
        x = np.zeros(dim)
        x[: len(r["u"]) // 8] = np.frombuffer(bytes(r["u"]), "<f8")
        if not len(found) or (found @ x).max() <= APART:
            found = np.vstack([found, x])
        if len(found) == wanted:
            break
    return found


def _describe(pivots: np.ndarray, dim: int):
    """(rid, id, u, near, p1, p2): the nearest pivots in order."""
    depth = min(PREFIX, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros((batch.num_rows, depth), "<i2")
            for a in range(0, batch.num_rows, 2048):
                close = matrix(batch.column(2)[a : a + 2048], dim) @ pivots.T
                first = np.argpartition(-close, depth - 1, axis=1)[:, :depth]
                order = np.argsort(-np.take_along_axis(close, first, 1), axis=1, kind="stable")
                near[a : a + 2048] = np.take_along_axis(first, order, 1)
            second = near[:, min(1, depth - 1)]
            columns = [pa.array([r.tobytes() for r in near], pa.binary()), pa.array(near[:, 0], pa.int32()), pa.array(second, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "near", "p1", "p2"])

    return run


def cover(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy balls: the row of each vector's leader, and its cosine to it (1 for leaders)."""
    leader, close = np.full(len(x), -1), np.ones(len(x))
    left = np.arange(len(x))
    while len(left):
        block = left[:256]  # leaders among the next rows, then all that they reach
        own: list[int] = []
        inner = x[block] @ x[block].T
        for i in range(len(block)):
            if leader[block[i]] < 0:
                reached = np.flatnonzero((inner[i] >= least) & (leader[block] < 0))
                leader[block[reached]], close[block[reached]] = block[i], inner[i, reached]
                leader[block[i]], close[block[i]] = block[i], 1.0
                own.append(block[i])
        left = left[256:]
        for a in range(0, len(left), 8192):
            rest = left[a : a + 8192]
            cos = x[rest] @ x[own].T
            best = cos.argmax(axis=1)
            best_cos = cos[np.arange(len(rest)), best]
            hit = best_cos >= least
            leader[rest[hit]], close[rest[hit]] = np.array(own)[best[hit]], best_cos[hit]
        left = left[leader[left] < 0]
    return leader, close


#: Vectors that a task holds at once while it makes balls.
HELD = 1 << 15


def _balls(dim: int, least: float):
    """Balls of rows (rid, id, u, near, p1, p2) that come sorted by nearest pivots."""

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        rid = np.asarray(rows.column(0))
        p1, p2 = np.asarray(rows.column(4)), np.asarray(rows.column(5))
        ball, close = rid.copy(), np.ones(len(rid))
        edge = np.flatnonzero((p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])) + 1
        for a, b in zip([0, *edge], [*edge, len(rid)], strict=True):
            if b - a > 1:
                leader, cos = cover(matrix(rows.column(2)[a:b], dim), least)
                ball[a:b], close[a:b] = rid[a:b][leader], cos
        yield pa.RecordBatch.from_arrays([*rows.columns[:4], rows.column(4), pa.array(ball), pa.array(close)], ["rid", "id", "u", "near", "p1", "ball", "close"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= HELD:
                yield from made(held)
                held, n = [], 0
        if held:
            yield from made(held)

    return run


def _adopt(dim: int, least: float):
    """(ball, into): leaders of balls of a task's pivots that a larger ball's leader reaches."""

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).sort_by([("n", "descending"), ("ball", "ascending")]).combine_chunks().to_batches()[0]
        ball = np.asarray(rows.column(0))
        leader, _ = cover(matrix(rows.column(1), dim), least)
        moved = np.flatnonzero(leader != np.arange(len(ball)))
        yield pa.RecordBatch.from_arrays([pa.array(ball[moved]), pa.array(ball[leader[moved]]), rows.column(1).take(pa.array(leader[moved]))], ["ball", "into", "into_u"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            p1 = np.asarray(batch.column(3))
            edge = np.flatnonzero(p1[1:] != p1[:-1]) + 1
            for a, b in zip([0, *edge], [*edge, len(p1)], strict=True):
                if b > a and p1[a] != key and held:
                    yield from made(held)
                    held = []
                if b > a:
                    key = p1[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield from made(held)

    return run


def cosine_udf(dim: int):
    @F.arrow_udf(T.DoubleType())
    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(np.einsum("ij,ij->i", matrix(a, dim), matrix(b, dim)))

    return cosine


def _postings(hot: np.ndarray, depth: int, dim: int):
    """Entries of the inverted lists: one a near pivot, or one a pair of them in hot lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), dim)
            scale = np.abs(x).max(axis=1) / 127
            small = np.rint(x / scale[:, None]).astype(np.int8)
            error = np.linalg.norm(x - small * scale[:, None], axis=1)
            near = np.sort(np.frombuffer(b"".join(v.as_py() for v in batch.column(2)), "<i2").reshape(-1, depth), axis=1)
            row, key = [], []
            for i in range(depth):
                cold = ~np.isin(near[:, i], hot)
                row.append(np.flatnonzero(cold))
                key.append(near[cold, i].astype(np.int64) << 16)
                for j in range(i + 1, depth):
                    row.append(np.flatnonzero(~cold))
                    key.append((near[~cold, i].astype(np.int64) << 16) + near[~cold, j] + 1)
            row, key = np.concatenate(row), np.concatenate(key)
            code = pa.array([v.tobytes() for v in small], pa.binary()).take(pa.array(row))
            near_of = pa.array([v.tobytes() for v in near], pa.binary()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(row)), code, near_of, pa.array(scale[row]), pa.array(error[row]), batch.column(3).take(pa.array(row))], ["list", "ball", "code", "near", "scale", "error", "radius"])

    return run


def _compare(angle: float, depth: int, shared: int):
    """Candidates (a, b) of the lists of a task, whose entries come sorted by list."""

    def pairs(key: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        if rows.num_rows < 2:
            return
        ball, scale, error, radius = (np.asarray(rows.column(i)) for i in (1, 4, 5, 6))
        near = np.frombuffer(b"".join(v.as_py() for v in rows.column(3)), "<i2").reshape(-1, depth)
        x = (np.frombuffer(b"".join(v.as_py() for v in rows.column(2)), np.int8).reshape(len(ball), -1) * scale[:, None]).astype(np.float32)
        pivot, second = key >> 16, (key & 0xFFFF) - 1
        for a in range(0, len(ball), 1024):
            for b in range(a, len(ball), 8192):
                bound = np.cos(np.minimum(np.pi, angle + radius[a : a + 1024, None] + radius[None, b : b + 8192])) - error[a : a + 1024, None] - 1.1 * error[None, b : b + 8192] - 1e-5
                i, j = np.nonzero(x[a : a + 1024] @ x[b : b + 8192].T >= bound)
                i, j = i + a, j + b
                i, j = i[j > i], j[j > i]
                for c in range(0, len(i), 1 << 16):  # count what is shared, in pieces
                    u, v = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                    common = (near[u][:, :, None] == near[v][:, None, :]).any(axis=2)
                    first = common.argmax(axis=1)
                    ok = (common.sum(axis=1) >= shared) & (near[u, first] == pivot)
                    if second >= 0:
                        common[np.arange(len(u)), first] = False
                        ok &= near[u, common.argmax(axis=1)] == second
                    if ok.any():
                        lo, hi = np.minimum(ball[u[ok]], ball[v[ok]]), np.maximum(ball[u[ok]], ball[v[ok]])
                        yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            lists = np.asarray(batch.column(0))
            edge = np.flatnonzero(lists[1:] != lists[:-1]) + 1
            for a, b in zip([0, *edge], [*edge, len(lists)], strict=True):
                if b > a and lists[a] != key:
                    if held:
                        yield from pairs(int(key), held)
                    held, key = [], lists[a]
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from pairs(int(key), held)

    return run


def near_vectors(rows: DataFrame, *, min_cosine: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row a vector: id, n_links (others linked directly), component_id, kept."""
    angle = math.acos(min_cosine)
    half = math.cos(angle / 2) + SLACK
    units = rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), unit_vectors(F.col(vec_col)).alias("u"))
    size = units.agg(F.max(F.octet_length("u")), F.count("u")).first()
    kind = rows.schema[id_col].dataType.simpleString()
    alone = units.where("u is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if not size[1]:
        return alone
    dim = size[0] // 8
    pivots = choose_pivots(units, dim, size[1])
    depth = min(PREFIX, len(pivots))
    shared = min(SHARED, depth)

    described = units.where("u is not null").mapInArrow(_describe(pivots, dim), f"rid bigint, id {kind}, u binary, near binary, p1 int, p2 int")
    dealt = described.repartitionByRange("p1", "p2", "rid").sortWithinPartitions("p1", "p2", "rid")
    members = durable(dealt.mapInArrow(_balls(dim, half), f"rid bigint, id {kind}, u binary, near binary, p1 int, ball bigint, close double"))

    # balls of one group that several tasks or cells made: their members move to one leader
    counted = members.groupBy("ball").agg(F.count(F.lit(1)).alias("n"))
    several = counted.where("n > 1").join(members.select(F.col("rid").alias("ball"), "u", "p1"), "ball").select("ball", "u", "n", "p1")
    adopted = durable(several.repartition("p1").sortWithinPartitions("p1").mapInArrow(_adopt(dim, half), "ball bigint, into bigint, into_u binary"))
    cosine = cosine_udf(dim)
    if not adopted.isEmpty():
        moving = join_by_key(members, adopted.join(counted, "ball"), ["ball"], size[1]).withColumn("closer", cosine("u", "into_u"))
        reached = F.col("closer") >= half
        moving = moving.withColumn("ball", F.when(reached, F.col("into")).otherwise(F.col("ball"))).withColumn("close", F.when(reached, F.col("closer")).otherwise(F.col("close")))
        members = durable(members.join(adopted.select("ball"), "ball", "left_anti").select(*members.columns).unionByName(moving.select(*members.columns)))

    radius = F.acos(F.least(F.min("close"), F.lit(1.0)))
    stats = members.groupBy("ball").agg(F.count(F.lit(1)).alias("n"), radius.alias("radius"), F.min("id").alias("least"))
    leaders = durable(stats.join(members.select(F.col("rid").alias("ball"), "u", "near"), "ball").select("ball", "u", "near", "radius", "n", "least"))

    lists = leaders.select(F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("i"), "near").select(F.substring("near", F.col("i") * 2 + 1, F.lit(2)).alias("p"))
    hot = np.array([int.from_bytes(bytes(r["p"]), "little") for r in lists.groupBy("p").count().where(F.col("count") > LONG).select("p").collect()], np.int64)
    entries = leaders.select("ball", "u", "near", "radius").mapInArrow(_postings(hot, depth, dim), "list bigint, ball bigint, code binary, near binary, scale double, error double, radius double")
    found = durable(entries.repartition("list").sortWithinPartitions("list").mapInArrow(_compare(angle, depth, shared), "a bigint, b bigint"))

    side = lambda s: leaders.select(F.col("ball").alias(s), F.col("u").alias(f"u{s}"), F.col("radius").alias(f"r{s}"), F.col("n").alias(f"n{s}"))
    judged = found.join(side("a"), "a").join(side("b"), "b").withColumn("cos", cosine("ua", "ub"))
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.col("cos"), F.lit(1.0))))

    def verdict(own: Column, other: Column) -> Column:
        single = (own == 0) & (other == 0)
        wholly = F.when(single, F.col("cos") >= min_cosine).otherwise(apart + own + other <= angle - SLACK)
        partly = ~single & (apart - own - other <= angle + SLACK)
        return F.when(wholly, F.lit("all")).when(partly, F.lit("some")).otherwise(F.lit("none"))

    judged = durable(judged.withColumn("link", verdict(F.col("ra"), F.col("rb"))).where("link != 'none'").select("a", "b", "na", "nb", "rb", "ra", "link"))
    both = judged.select(F.col("a").alias("ball"), F.col("b").alias("other"), F.col("nb").alias("n"), F.col("rb").alias("r"), "link")
    both = both.unionByName(judged.select(F.col("b").alias("ball"), F.col("a").alias("other"), F.col("na").alias("n"), F.col("ra").alias("r"), "link"))
    by_ball = both.where("link = 'all'").groupBy("ball").agg(F.sum("n").alias("more"))

    # the others member by member against the other leader, and what stays open pair by pair
    leader_of = leaders.select(F.col("ball").alias("other"), F.col("u").alias("other_u"))
    open_balls = both.where("link = 'some'").select("ball", "other", F.col("n").alias("others"), "r").join(leader_of, "other")
    held = members.select("rid", "u", "ball").join(open_balls, "ball").withColumn("cos", cosine("u", "other_u"))
    held = held.withColumn("link", verdict(F.lit(0.0), F.col("r"))).where("link != 'none'").select("rid", "ball", "other", "others", "link", F.when(F.col("link") == "some", F.col("u")).alias("u"))
    held = durable(held)
    singly = held.where("link = 'some'").select("rid", "ball", "other", "u").join(members.select(F.col("ball").alias("other"), F.col("u").alias("v")), "other")
    singly = singly.where(cosine("u", "v") >= min_cosine).groupBy("rid", "ball", "other").agg(F.count(F.lit(1)).alias("others"))
    by_row = durable(held.where("link = 'all'").select("rid", "ball", "other", "others").unionByName(singly))

    edges = judged.where("link = 'all'").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(by_row.select(F.col("ball").alias("u"), F.col("other").alias("v")).distinct())
    roots = components(edges).withColumnRenamed("node", "ball")
    rooted = leaders.select("ball", "n", "least").join(roots, "ball", "left").withColumn("root", F.coalesce("root", "ball"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    balls = rooted.join(named, "root").join(by_ball, "ball", "left").select("ball", "n", F.col("n").alias("size"), F.coalesce("more", F.lit(0)).alias("more"), "component_id")
    whole = join_by_key(members.select("rid", "id", "ball"), durable(balls), ["ball"], size[1])
    extra = by_row.groupBy("rid").agg(F.sum("others").alias("extra"))
    counts = whole.join(extra, "rid", "left").withColumn("n_links", F.col("size") - 1 + F.col("more") + F.coalesce("extra", F.lit(0)))
    return alone.unionByName(counts.select("id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with their links of cosine 0.9 or more and their component."""
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP13_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM valid x JOIN valid y ON x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least ON least.a = e.vec_id LEFT JOIN degree ON degree.a = e.vec_id
"""
