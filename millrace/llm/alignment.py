"""Cross-tokenizer alignment: id-striped dense count matrices.

Both tokenizers read the same bytes. Where a token of each ends at the same byte, a group
ends, and all tokens of one side of a group are linked with all of the other. How many
documents hold a pair of ids linked is counted in dense matrices: ids of the first side are
cut into stripes of ``WIDTH``, the linked pairs are partitioned by stripe, and each stripe adds
into its own block, whose size depends on the vocabularies alone. Row maxima of the block are
the best counts. Links are then scored where their stripe's block lies, and a document's parts
are summed.

A task writes its links by stripe and by some thousand documents (each pair with the documents
that hold it and how often), so a row is a small array and not a link. A stripe with very many
links is shared out over parts; their partial blocks are added before any link is scored.

Edge cases: null and empty texts, and texts that a tokenizer doesn't reproduce byte by byte,
have no tokens and zeros in all columns; repeated rows count as documents of their own; long
groups are counted by distinct ids instead of links; an empty table gives an empty result;
other columns pass by unread.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.packing import _byte_level_ranks, encoder, tokenizer_file
from millrace.session import durable, table

#: Ids of the first side in a stripe: its block has so many rows of 8 bytes an id of the other.
WIDTH = 256

#: Tokens and documents whose links a task holds at once, and links expanded at once.
HELD_TOKENS, DOC_BITS, EXPANDED = 1 << 18, 12, 1 << 20

#: Links of a group beyond which its distinct ids are paired instead.
LONG_GROUP = 256

#: Bytes of pairs beyond which a stripe gets a further part.
PART_BYTES = 64 << 20


class Side:
    """One tokenizer: ids of a text, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            whole = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            self.names = [b"" if model.is_control(i) else whole(i) for i in range(model.get_piece_size())]
            self.ids = lambda text: model.encode(text)
        else:
            with open(path, encoding="utf-8") as f:
                ranks = _byte_level_ranks(json.load(f))
            if ranks is None:
                raise ValueError("a byte-level BPE file or a sentence piece model is needed")
            self.names = [b""] * (max(ranks.values()) + 1)
            for name, i in ranks.items():
                self.names[i] = name
            own = encoder(path)
            self.ids = lambda text: np.frombuffer(own.encode(" " + text), "<u4").tolist()
        self.lengths = np.array([len(x) for x in self.names], np.int64)


_sides: dict[str, Side] = {}


def side(path: str) -> Side:
    """One tokenizer a worker, whatever the number of its tasks."""
    if path not in _sides:
        _sides[path] = Side(path)
    return _sides[path]


class Groups(NamedTuple):
    """Groups of adjoining documents: tokens, their group, and tokens a group."""

    a: np.ndarray
    b: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray


def groups_of(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> Groups:
    """Cut two token sequences of the same bytes where tokens of both end."""
    end_a, end_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    mark = np.zeros(int(end_a[-1]) + 1 if len(a) else 1, np.uint8)
    mark[end_a] |= 1
    mark[end_b] |= 2
    last_a, last_b = mark[end_a] == 3, mark[end_b] == 3
    of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    n = int(last_a.sum())
    return Groups(a, b, of_a, of_b, np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n))


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sum of their times."""
    order = np.argsort(codes)
    codes, times = codes[order], times[order]
    head = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[head], np.add.reduceat(times, head) if len(head) else times


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes.sort()
    head = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[head], np.diff(np.append(head, len(codes)))


def links_of(g: Groups, doc: np.ndarray, b_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (a, b, document) as codes in order, and the number of their links. ``doc`` is
    the document of each group."""
    start_a, start_b = np.cumsum(g.n_a) - g.n_a, np.cumsum(g.n_b) - g.n_b
    size = g.n_a * g.n_b
    found = []
    code = lambda a, b, d: ((a << b_bits) + b << DOC_BITS) + d
    small = np.flatnonzero(size <= LONG_GROUP)
    total = np.cumsum(size[small])
    lo = 0
    while lo < len(small):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + EXPANDED, "right")))
        of = small[lo:hi]
        n = size[of]
        group = np.repeat(of, n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        row, column = np.divmod(k, g.n_b[group])
        found.append(counted(code(g.a[start_a[group] + row], g.b[start_b[group] + column], doc[group])))
        lo = hi
    for i in np.flatnonzero(size > LONG_GROUP).tolist():
        a, times_a = np.unique(g.a[start_a[i] : start_a[i] + g.n_a[i]], return_counts=True)
        b, times_b = np.unique(g.b[start_b[i] : start_b[i] + g.n_b[i]], return_counts=True)
        found.append((code(a[:, None], b[None, :], doc[i]).ravel(), (times_a[:, None] * times_b[None, :]).ravel()))
    if len(found) == 1:
        return found[0]
    return summed(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


MADE = "rid bigint, stripe int, doc_id {0}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, `groups` binary, pairs binary, held binary, docs binary, times binary"


def _aligner(path_a: str, path_b: str, wants_groups: bool):
    """Rows of documents (stripe is null) and rows of links by stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = side(path_a), side(path_b)
        b_bits = len(two.names).bit_length()
        words = [b"%d%s" % (i, s) for n, marks in ((len(one.names), (b",", b"|")), (len(two.names), (b",", b";"))) for i in range(n) for s in marks] if wants_groups else []
        base, rid = 0, TaskContext.get().partitionId() << 33
        shape: pa.Schema | None = None

        def rows_of(columns: dict) -> pa.RecordBatch:
            n = len(columns["rid"])
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in shape], schema=shape)

        def flush(ids: list, a: list, b: list) -> Iterator[pa.RecordBatch]:
            n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
            g = groups_of(*(np.array([i for x in s for i in x], np.int64) for s in (a, b)), one.lengths, two.lengths)
            doc = np.repeat(np.arange(len(ids)), n_a)[np.cumsum(g.n_a) - 1] if len(g.n_a) else np.zeros(0, np.int64)
            n_groups = np.bincount(doc, minlength=len(ids))
            n_links = np.zeros(len(ids), np.int64)
            np.add.at(n_links, doc, g.n_a * g.n_b)
            shown = [None] * len(ids)
            if wants_groups:
                order = np.empty(len(g.a) + len(g.b), np.int64)
                end_a, start_b = np.cumsum(g.n_a), np.cumsum(g.n_b) - g.n_b
                last_a, last_b = np.append(g.of_a[1:] != g.of_a[:-1], True), np.append(g.of_b[1:] != g.of_b[:-1], True)
                order[np.arange(len(g.a)) + start_b[g.of_a]] = 2 * g.a + last_a[: len(g.a)]
                order[np.arange(len(g.b)) + end_a[g.of_b]] = 2 * (len(one.names) + g.b) + last_b[: len(g.b)]
                ends = np.cumsum(n_a + n_b)
                shown = [b"".join(map(words.__getitem__, order[e - n : e].tolist()))[:-1] for e, n in zip(ends.tolist(), (n_a + n_b).tolist(), strict=True)]
            yield rows_of({"rid": np.arange(rid, rid + len(ids)), "doc_id": ids, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": shown})
            codes, times = links_of(g, doc, b_bits)
            stripe = codes >> (DOC_BITS + b_bits)
            stripe //= WIDTH
            cut = np.flatnonzero(np.append(True, stripe[1:] != stripe[:-1])) if len(codes) else np.zeros(0, np.int64)
            out = {k: [] for k in ("stripe", "pairs", "held", "docs", "times")}
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(codes)], strict=False):
                pair = (codes[lo:hi] >> DOC_BITS) - (int(stripe[lo]) * WIDTH << b_bits)
                head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                n = times[lo:hi]
                out["stripe"].append(int(stripe[lo]))
                out["pairs"].append(pair[head].astype("<u4").tobytes())
                out["held"].append(np.diff(np.append(head, hi - lo)).astype("<u2").tobytes())
                out["docs"].append((codes[lo:hi] & ((1 << DOC_BITS) - 1)).astype("<u2").tobytes())
                out["times"].append(n.astype("u1" if n.max() < 256 else "<i8").tobytes())
            if out["stripe"]:
                yield rows_of({"rid": np.full(len(cut), rid), **out})

        ids, a, b, held = [], [], [], 0
        for batch in batches:
            shape = shape or pa.schema([("rid", pa.int64()), ("stripe", pa.int32()), ("doc_id", batch.column(0).type), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), *((c, pa.binary()) for c in ("groups", "pairs", "held", "docs", "times"))])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                whole = b" " + text.encode()
                own, other = ([], []) if not text else (one.ids(text), two.ids(text))
                if b"".join([one.names[i] for i in own]) != whole or b"".join([two.names[i] for i in other]) != whole:
                    own, other = [], []
                ids.append(doc)
                a.append(own)
                b.append(other)
                held += len(own)
                if held >= HELD_TOKENS or len(ids) >> DOC_BITS:
                    yield from flush(ids, a, b)
                    rid += len(ids)
                    ids, a, b, held = [], [], [], 0
        if ids:
            yield from flush(ids, a, b)

    return run


def _numbers(value: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[bool, pa.RecordBatch, int]]:
    """(first of its key, batch, row) of rows that come sorted by their first columns."""
    key = None
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
        for i, own in enumerate(keys):
            yield own != key, batch, i
            key = own


def _add_blocks(cells: int, held_kind: str):
    """Sum (stripe, part, pairs, held) of each stripe and part in a dense block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key = np.zeros(cells, np.int64), None

        def emit() -> pa.RecordBatch:
            some = np.flatnonzero(block)
            out = pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([some.astype("<u4").tobytes()], pa.binary()), pa.array([block[some].astype("<i8").tobytes()], pa.binary())], ["stripe", "pairs", "held"])
            block[some] = 0
            return out

        for first, batch, i in _runs(batches, 2):
            if first and key is not None:
                yield emit()
            key = batch.column(0)[i].as_py()
            np.add.at(block, _numbers(batch.column(2)[i], "<u4"), _numbers(batch.column(3)[i], held_kind).astype(np.int64))
        if key is not None:
            yield emit()

    return run


def _score(cells: int, b_bits: int):
    """Per row of links: its documents' links with the best count, and the sum of counts. Rows
    (stripe, part, links, rid, pairs, held, docs, times) come sorted, the counts before the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = np.zeros(cells, np.int64)
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            rid, *rest = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), *(pa.array(x, pa.binary()) for x in rest)], ["rid", "docs", "best", "sums"])

        for first, batch, i in _runs(batches, 2):
            pairs = _numbers(batch.column(4)[i], "<u4")
            if first:
                block[:] = 0
            if not batch.column(2)[i].as_py():
                block[pairs] = _numbers(batch.column(5)[i], "<i8")
                top = block.reshape(-1, 1 << b_bits).max(axis=1)
                continue
            held = _numbers(batch.column(5)[i], "<u2")
            docs = _numbers(batch.column(6)[i], "<u2")
            raw = batch.column(7)[i].as_buffer()
            times = np.frombuffer(raw, "u1" if len(raw) == len(docs) else "<i8").astype(np.int64)
            count = block[pairs]
            best, sums = np.zeros(1 << DOC_BITS, np.int64), np.zeros(1 << DOC_BITS, np.int64)
            np.add.at(best, docs, times * np.repeat(count == top[pairs >> b_bits], held))
            np.add.at(sums, docs, times * np.repeat(count, held))
            some = np.flatnonzero(sums)
            narrow = lambda x: x.astype("<u4" if x.max(initial=0) < 1 << 32 else "<i8").tobytes()
            out.append((batch.column(3)[i].as_py(), some.astype("<u2").tobytes(), narrow(best[some]), narrow(sums[some])))
            if len(out) >= 256:
                yield flush()
        if out:
            yield flush()

    return run


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the scores (rid, docs, best, sums) of each document; rows come sorted by rid."""
    both, key = np.zeros((2, 1 << DOC_BITS), np.int64), None

    def emit() -> pa.RecordBatch:
        some = np.flatnonzero(both[1])
        out = pa.RecordBatch.from_arrays([pa.array(key + some), pa.array(both[0, some]), pa.array(both[1, some])], ["rid", "n_best", "count_sum"])
        both[:] = 0
        return out

    for first, batch, i in _runs(batches, 1):
        if first and key is not None:
            yield emit()
        key = batch.column(0)[i].as_py()
        docs = _numbers(batch.column(1)[i], "<u2")
        for k in (0, 1):
            raw = batch.column(2 + k)[i].as_buffer()
            both[k, docs] += np.frombuffer(raw, "<u4" if len(raw) == 4 * len(docs) else "<i8").astype(np.int64)
    if key is not None:
        yield emit()


def _pair_rows(b_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, pairs, held in zip(*batch.columns, strict=True):
                pair, n = _numbers(pairs, "<u4").astype(np.int64), _numbers(held, "<i8")
                row = pair >> b_bits
                top = np.zeros(WIDTH, np.int64)
                np.maximum.at(top, row, n)
                yield pa.RecordBatch.from_arrays([pa.array(row + stripe.as_py() * WIDTH), pa.array(pair & ((1 << b_bits) - 1)), pa.array(n), pa.array(n == top[row])], ["a", "b", "documents", "best"])

    return run


class Alignment(NamedTuple):
    """``documents``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (or what is
    derived from them); ``pairs``: a, b, documents that hold them linked, best of a."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", derive: dict[str, Column] | None = None, keep_groups: bool = True) -> Alignment:
    """Align a byte-level BPE (a) with a sentence piece model (b) over all documents.

    ``groups`` is text: ``a1,a2|b1;a3|b2`` has the ids of each group. ``derive`` adds columns
    made from a document's row; with ``keep_groups`` off the groups themselves are not stored."""
    b_bits = len(side(path_b).names).bit_length()
    cells = WIDTH << b_bits
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(_aligner(path_a, path_b, keep_groups or bool(derive)), MADE.format(docs.schema[id_col].dataType.simpleString()))
    made = made.withColumns(derive or {})
    made = durable(made if keep_groups else made.drop("groups"))

    blocks = made.where("stripe is not null")
    sizes = blocks.groupBy("stripe").agg(F.sum(F.octet_length("pairs")).alias("n")).collect()  # one row a stripe
    many = {r["stripe"]: -(-r["n"] // PART_BYTES) for r in sizes if r["n"] > PART_BYTES}
    parts = F.coalesce(F.create_map(*[F.lit(x) for kv in many.items() for x in kv])[F.col("stripe")], F.lit(1)) if many else F.lit(1)
    dealt = blocks.withColumn("part", F.pmod(F.xxhash64("rid"), parts).cast("int"))
    sums = "stripe int, pairs binary, held binary"
    partial = dealt.select("stripe", "part", "pairs", "held").repartition("stripe", "part").sortWithinPartitions("stripe", "part").mapInArrow(_add_blocks(cells, "<u2"), sums)
    totals = durable(partial.select("stripe", F.lit(0).alias("part"), "pairs", "held").repartition("stripe").sortWithinPartitions("stripe").mapInArrow(_add_blocks(cells, "<i8"), sums))

    nothing = F.lit(None).cast("binary")
    counts = totals.select("stripe", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))).alias("part"), F.lit(False).alias("links"), F.lit(None).cast("long").alias("rid"), "pairs", "held", nothing.alias("docs"), nothing.alias("times"))
    both = counts.unionByName(dealt.select("stripe", "part", F.lit(True).alias("links"), "rid", "pairs", "held", "docs", "times"))
    scored = both.repartition("stripe", "part").sortWithinPartitions("stripe", "part", "links").mapInArrow(_score(cells, b_bits), "rid bigint, docs binary, best binary, sums binary")
    scores = scored.repartition("rid").sortWithinPartitions("rid").mapInArrow(_by_document, "rid bigint, n_best bigint, count_sum bigint")

    documents = made.where("stripe is null").drop("stripe", "pairs", "held", "docs", "times")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    joined = documents.join(scores, "rid", "left").withColumn("n_best", zero("n_best")).withColumn("count_sum", zero("count_sum")).drop("rid")
    return Alignment(joined, totals.mapInArrow(_pair_rows(b_bits), "a bigint, b bigint, documents bigint, best boolean"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, aligned between two public tokenizers."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = align(table(spark, sf_dir, "documents"), tokenizer_file(), tokenizer_file("piece_bpe_32k.model"), derive={"groups_sha256": digest}, keep_groups=False)
    return found.documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
