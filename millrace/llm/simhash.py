"""SimHash near-dedup: a byte-position inverted index with count filtering.

A fingerprint has 64 bits in 8 byte positions. Two that differ in at most 3 bits share at
least 5 positional bytes, so each pair shares 3 bytes within the first or within the last
four positions. The inverted index therefore has 8 posting lists for each fingerprint,
keyed by three positions and their bytes. Inside a list the shared positional bytes of
pairs are tallied, pairs below 5 are dropped, and the rest is verified by bit distance.

Equal fingerprints are one node, so copies never meet in a list. A list is walked breadth
first from unvisited nodes; it returns a spanning forest of its links, never all pairs.
Lists of over ``LONG`` nodes are dealt anew by two more positions (a linked pair shares
two of the other five). All nodes of such a list share five positional bytes, so every pair
has the least count already and only verification is left: by distance, or in a list of
over ``LOOKUP`` nodes by looking up what lies within the radius in its three free bytes.
Components join the forests of all lists.

Edge cases: null text has no words; texts without words have fingerprint zero and are
linked like any other; repeated rows share a fingerprint; a component's id is its smallest
non-null doc_id (null if it has none); an empty table gives an empty result; other columns
pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.graph import components
from millrace.llm.skew import join_by_key
from millrace.session import durable, table

BITS, RADIUS = 64, 3
LEAST_SHARED = 8 - RADIUS

#: Triples of positions: of any 5 positions, 3 lie in one half.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]

#: Nodes of a posting list beyond which it is dealt anew, and looked up instead of compared.
LONG, LOOKUP = 4096, 8192


def fingerprint_of(text: str | None, shingle: int, seed: int = 42) -> int:
    """Majority of the bits of all shingle hashes of one text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(BITS, np.int64), len(starts)
    for a in range(0, n, 1 << 16):  # a long text stays a small array
        part = zip(starts[a : a + (1 << 16)].tolist(), ends[a + size - 1 : a + size - 1 + (1 << 16)].tolist(), strict=False)
        hashes = np.array([digest(joined[s:e], seed) for s, e in part], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint_udf(shingle: int):
    @F.arrow_udf(T.LongType())
    def fingerprint(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint_of(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))

    return fingerprint.asNondeterministic()


def neighbours(front: np.ndarray, rest: np.ndarray, free_bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in front, places in rest) of linked pairs; ``rest`` is sorted."""
    if len(rest) > LOOKUP:  # look up all fingerprints within the radius
        masks = [0] + [sum(1 << int(b) for b in c) for r in range(1, RADIUS + 1) for c in combinations(free_bits, r)]
        for mask in np.array(masks, np.uint64):
            want = front ^ mask
            at = np.minimum(np.searchsorted(rest, want), len(rest) - 1)
            hit = np.flatnonzero(rest[at] == want)
            if len(hit):
                yield hit, at[hit]
        return
    step = max(1, (1 << 20) // max(1, len(rest)))
    rest_bytes = rest.view(np.uint8).reshape(-1, 8)
    for a in range(0, len(front), step):
        own = front[a : a + step].view(np.uint8).reshape(-1, 8)
        shared = sum((own[:, None, k] == rest_bytes[None, :, k]).astype(np.uint8) for k in range(8))
        x, y = np.nonzero(shared >= LEAST_SHARED)
        near = np.bitwise_count(front[a + x] ^ rest[y]) <= RADIUS
        if near.any():
            yield a + x[near], y[near]


def forest(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least node of a component, node) that span the links among ``nodes``."""
    rest = np.sort(nodes)
    low, high = np.bitwise_and.reduce(rest), np.bitwise_or.reduce(rest)
    free_bits = np.flatnonzero(np.unpackbits(np.array([low ^ high], "<u8").view(np.uint8), bitorder="little"))
    roots, found = [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = np.array([root], np.uint64)
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            for _, y in neighbours(front, rest, free_bits):
                hit[y] = True
            front, rest = rest[hit], rest[~hit]
            if len(front):
                roots.append(np.full(len(front), root, np.uint64))
                found.append(front)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(roots), np.concatenate(found)


def _walk_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the posting lists of a partition, whose rows come sorted by list."""
    key, own = None, []

    def edges(nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        whole = np.unique(np.concatenate(nodes)) if nodes else np.zeros(0, np.uint64)
        if len(whole) > 1:
            u, v = forest(whole)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        keys = np.asarray(batch.column(0))
        nodes = np.asarray(batch.column(1)).view(np.uint64)
        at = np.concatenate(([0], np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=tuple(range(1, keys.ndim)))) + 1, [len(keys)])) if len(keys) else [0]
        for a, b in zip(at[:-1], at[1:], strict=False):
            if keys[a] != key:
                yield from edges(own)
                key, own = keys[a], []
            own.append(nodes[a:b])
    yield from edges(own)


def links(fingerprints: DataFrame) -> DataFrame:
    """Edges u, v that span the links among distinct fingerprints (one column, fp)."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    entry = lambda i, ps: F.struct((F.lit(i << 24) + byte(ps[0]) * 65536 + byte(ps[1]) * 256 + byte(ps[2])).alias("list"), F.lit(i).alias("triple"))
    posted = fingerprints.select("fp", F.explode(F.array(*[entry(i, t) for i, t in enumerate(TRIPLES)])).alias("e")).select("fp", "e.*")
    posted = durable(posted)
    sizes = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    hot = durable(sizes.where(F.col("n") > LONG).select("list"))
    listed = posted.join(sizes.where(F.col("n").between(2, LONG)).select("list"), "list", "left_semi").select("list", "fp")

    deeper = []  # a further pair of positions for lists that are too long
    for i, triple in enumerate(TRIPLES):
        for j, (p, q) in enumerate(combinations([k for k in range(8) if k not in triple], 2)):
            deeper.append(F.when(F.col("triple") == i, (F.col("list") * 16 + j) * 65536 + byte(p) * 256 + byte(q) + F.lit(1 << 60)))
    again = posted.join(hot, "list", "left_semi").select(F.explode(F.filter(F.array(*deeper), lambda x: x.isNotNull())).alias("list"), "fp")
    both = listed.unionByName(again)
    return both.repartition("list").sortWithinPartitions("list").mapInArrow(_walk_lists, "u bigint, v bigint")


def near_groups(docs: DataFrame, *, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, text_sha256, fp (signed 64-bit), component_id."""
    fingerprint = fingerprint_udf(shingle)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = durable(texts.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), fingerprint("text").alias("fp")))
    nodes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    rooted = durable(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    named = durable(join_by_key(rooted.select("fp", "root", F.col("n").alias("rows")), least, ["root"], nodes.count()).select("fp", "component_id", F.col("rows").alias("n")))
    return join_by_key(rows, named, ["fp"], rows.count()).select("doc_id", "text_sha256", "fp", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their fingerprint and component."""
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
