"""Packing: bounded-space online packing of token streams into fixed windows.

Each task tokenizes its documents and packs them as they come. It keeps ``n_open`` open
windows: a piece goes to the window that it fills best; when none has room, the fullest
window is emitted and a new one opened. Documents beyond one window are cut into whole
windows and a rest; other documents stay in one piece. What is open at a task's end is
passed on as whole windows, and these leftovers are merged by the same rule, ``FAN_IN``
partitions at a time and level by level, so no task gathers all of them.

Token ids come from a tokenizer file that every worker reads by its path.

Edge cases: null and empty texts are the closing id alone; repeated rows are packed each;
a text of any length is cut, never shortened; ids of any type come back as they are; an
empty table gives an empty result; other columns pass by unread.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import durable, table

#: Partitions whose leftovers one task merges.
FAN_IN = 32

#: A sequence's number: the level of the packer that emitted it, its task and a count, in
#: bits of their own, so no two sequences share one (7 levels, 2^28 tasks, 2^32 windows each).
LEVEL_BITS, TASK_BITS = 60, 32

CLOSING = np.zeros(1, "<u4").tobytes()

#: Fixed value: how byte-level BPE files of this kind split a text before merging.
BYTE_LEVEL_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids by token bytes of a plain byte-level BPE file; None for any other kind."""
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or spec.get("normalizer") or spec.get("post_processor") or model.get("type") != "BPE":
        return None
    # printable Latin-1 bytes stand for themselves, the others for characters from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}


class Encoder:
    """Text to little-endian unsigned 32-bit ids of a tokenizer file; strings of special
    tokens are ordinary text. Plain byte-level BPE runs on a faster engine with the same
    ids (tests hold them against the library that the file is for)."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            ranks = _byte_level_ranks(json.load(f))
        if ranks:
            import tiktoken

            own = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda text: own.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        else:
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(path)
            slow.encode_special_tokens = True
            self.encode = lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker, whatever the number of its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class OpenWindows:
    """The open windows of one packer, sorted by the room they have left."""

    def __init__(self, size: int, n_open: int, stamp: int) -> None:
        self.size, self.n_open, self.next_id = size, n_open, stamp
        self.rooms: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}

    def place(self, entry: object, length: int) -> tuple[int, list] | None:
        """Put an entry into a window; what is returned has been emitted."""
        if length == self.size:
            self.next_id += 1
            return self.next_id - 1, [entry]
        emitted = None
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, window = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.n_open:
                _, full = self.rooms.pop(0)
                emitted = (full, self.held.pop(full))
            room, window = self.size, self.next_id
            self.next_id += 1
            self.held[window] = []
        self.held[window].append(entry)
        if room > length:
            insort(self.rooms, (room - length, window))
            return emitted
        if emitted is None:
            return window, self.held.pop(window)
        insort(self.rooms, (0, window))  # emitted with the next call or as a full leftover
        return emitted


def _piece_schema(id_kind: pa.DataType) -> pa.Schema:
    return pa.schema([("doc_id", id_kind), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open", pa.bool_()), ("task", pa.int64())])


def first_number(level: int, task: int) -> int:
    """The number of the first sequence of a packer."""
    return (level << LEVEL_BITS) + (task << TASK_BITS)


def _packer(path: str, size: int, n_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = encoder(path), TaskContext.get().partitionId()
        packer = OpenWindows(size, n_open, first_number(0, task))
        rows: list[tuple] = []
        shape: pa.Schema | None = None

        def emit(window: int, entries: list, still_open: bool = False) -> None:
            offset = 0
            for doc, start, length, whole, ids in entries:
                rows.append((doc, start, length, whole, ids, window, offset, still_open, task))
                offset += length

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

        for batch in batches:
            shape = _piece_schema(batch.column(0).type)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokens.encode(text.as_py() or "") + CLOSING
                n = len(ids) // 4
                for start in range(0, n, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    done = packer.place((doc, start, len(piece) // 4, n, piece), len(piece) // 4)
                    if done:
                        emit(*done)
                if len(rows) >= 4096:
                    yield flush()
        for window, entries in packer.held.items():
            emit(window, entries, True)
        if rows:
            yield flush()

    return run


WINDOWS = pa.schema([("window", pa.int64()), ("used", pa.int64()), ("task", pa.int64())])


def _merger(size: int, n_open: int, level: int):
    """Merge leftover windows (window, used, task): which goes into which, and where."""

    def run(key: tuple, tables: pa.Table) -> pa.Table:
        task = key[0].as_py()
        packer = OpenWindows(size, n_open, first_number(level, task))
        out = []

        def emit(window: int, entries: list, still_open: bool = False) -> None:
            at = 0
            for source, used in entries:
                out.append((source, window, at, used, still_open, task))
                at += used

        order = tables.sort_by([("used", "descending"), ("window", "ascending")])
        for source, used in zip(order["window"].to_pylist(), order["used"].to_pylist(), strict=True):
            done = packer.place((source, used), used)
            if done:
                emit(*done)
        for window, entries in packer.held.items():
            emit(window, entries, True)
        columns = zip(*out, strict=True)
        names = ["window", "target", "shift", "used", "open", "task"]
        return pa.table({n: pa.array(c, pa.bool_() if n == "open" else pa.int64()) for n, c in zip(names, columns, strict=True)})

    return run


def pack(docs: DataFrame, tokenizer_path: str, *, size: int = 1024, n_open: int = 256, id_col: str = "doc_id", text_col: str = "text", derive: dict[str, Column] | None = None, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, ids (little-endian
    32-bit), sequence_id, offset. ``derive`` adds columns made from a piece (of its
    ``ids``, say); with ``keep_ids`` off the ids themselves are not stored."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, start bigint, length bigint, doc_tokens bigint, ids binary, sequence_id bigint, `offset` bigint, `open` boolean, task bigint"
    made = rows.mapInArrow(_packer(tokenizer_path, size, n_open), schema).withColumns(derive or {})
    made = durable(made if keep_ids else made.drop("ids"))

    left = made.where("open").groupBy(F.col("sequence_id").alias("window"), "task").agg(F.sum("length").alias("used"))
    left = durable(left)
    moves, tasks = left.select("window", F.col("window").alias("target"), F.lit(0).cast("long").alias("shift")), (left.agg(F.max("task")).first()[0] or 0) + 1
    level = 1
    while True:
        merging = left.select("window", "used", F.floor(F.col("task") / FAN_IN).alias("task"))
        merged = durable(merging.groupBy("task").applyInArrow(_merger(size, n_open, level), "window bigint, target bigint, shift bigint, used bigint, `open` boolean, task bigint"))
        step = merged.select(F.col("window").alias("target"), F.col("target").alias("next"), F.col("shift").alias("more"))
        moves = moves.join(step, "target", "left").select("window", F.coalesce("next", "target").alias("target"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            break
        left = merged.where("open").groupBy(F.col("target").alias("window"), "task").agg(F.sum("used").alias("used"))
        level += 1
    closed = made.where(~F.col("open")).drop("open", "task")
    moved = made.where("open").drop("open", "task").join(moves.withColumnRenamed("window", "sequence_id"), "sequence_id")
    settled = moved.withColumn("sequence_id", F.col("target")).withColumn("offset", F.col("offset") + F.col("shift")).drop("target", "shift")
    return closed.unionByName(settled.select(*closed.columns))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """A file of the installed public tokenizers; any other path does as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_file(), derive={"ids_crc32": F.crc32("ids")}, keep_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
