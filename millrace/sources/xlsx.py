"""Spreadsheet source: workbooks to rows of cells, and seed sheets to companies.

Workbooks are read as zip archives, through Spark's own file reader, so they may lie in any
store. A first pass runs through every sheet once as a stream, judges whether it is well
formed and cuts it between rows into pieces of ``PIECE`` bytes; the pieces are then dealt
evenly to tasks, which make cells of them. So neither a book of many sheets nor a sheet of
many rows fills a task. Rows are (path, sheet, row_no, cells), missing cells empty."""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as T
from millrace.functions import urls as U
from millrace.functions import vocab as V

_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _plain(tag: str) -> str:
    return tag.rpartition("}")[2]


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, archive member) of every sheet in workbook order."""
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = []
    for node in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _plain(node.tag) == "sheet":
            target = targets.get(node.get(_REL), "")
            found.append((node.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return found


def column_index(reference: str) -> int:
    """Zero-based column of a cell reference such as AB12."""
    n = 0
    for ch in re.match(r"[A-Z]+", reference or "A")[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _plain(x.tag) == "t")


def _shared(strings: list[str], index: str) -> str:
    """A shared string; an index that points to none is an empty cell."""
    return strings[int(index)] if index.isdecimal() and len(index) < 19 and int(index) < len(strings) else ""


def _ended(stream, name: str) -> Iterator[ElementTree.Element]:
    """Elements of a plain name as they end; each is let go of before the next is read."""
    above: list[ElementTree.Element] = []
    inside = 0
    for event, node in ElementTree.iterparse(stream, ("start", "end")):
        hit = _plain(node.tag) == name
        if event == "start":
            above.append(node)
            inside += hit
            continue
        above.pop()
        if hit:
            inside -= 1
            yield node
            node.clear()
        if above and (hit or not inside):
            above[-1].remove(node)


def _strings(book: zipfile.ZipFile) -> list[str] | None:
    """The shared strings of a book, if it has any."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return None
    with book.open("xl/sharedStrings.xml") as stream:
        return [_text(si) for si in _ended(stream, "si")]


ROW = "path string, sheet string, row_no bigint, cells array<string>, error string"


#: Rows of a sheet that leave a task at once.
BATCH = 2048

#: Bytes of a sheet after which a piece is cut, at the next end of a row.
PIECE = 1 << 17

_READ = 1 << 14
_BROKEN = (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError)
_PIECE = "path string, sheet string, first bigint, n bigint, piece binary, strings map<string,string>, error string"


class _Unlike(Exception):
    """A sheet whose bytes can't be cut: it declares entities or isn't UTF-8."""


class _Cutter:
    """Takes a sheet as a stream of bytes and gives its rows in pieces (first row number, rows
    that end in it, bytes), each a document of its own. What ``ElementTree`` finds wrong, it
    finds wrong at the same place, after the rows before it."""

    def __init__(self, size: int):
        self.size, self.parser = size, expat.ParserCreate(namespace_separator="}")
        self.parser.StartElementHandler, self.parser.EndElementHandler = self._start, self._end
        self.parser.StartNamespaceDeclHandler = lambda prefix, _: self.prefixes.add(prefix)
        self.parser.XmlDeclHandler, self.parser.StartDoctypeDeclHandler = self._declared, self._doctype
        self.prefixes: set[str | None] = set()
        self.held, self.base = bytearray(), 0  # bytes of the sheet from place ``base`` on
        self.inside, self.begin, self.seen = 0, -1, 0  # depth in rows, where an open row begins, last element
        self.done, self.n, self.weight, self.parts, self.ready = 0, 0, 0, [], []

    def _declared(self, _version, encoding, _alone):
        if encoding and encoding.lower() not in ("utf-8", "us-ascii"):
            raise _Unlike

    def _doctype(self, *_):
        raise _Unlike

    def _start(self, name, _):
        row = name[-3:] == "row" and _plain(name) == "row"
        if not self.inside:
            self._take(self.parser.CurrentByteIndex)
            if row:
                self.begin = self.seen
        self.inside += row

    def _end(self, name):
        if not self.inside:
            self._take(self.parser.CurrentByteIndex)
        elif name[-3:] == "row" and _plain(name) == "row":
            self.inside -= 1
            self.n += 1

    def _take(self, end: int) -> None:
        """An open row's bytes last until the next element begins or ends."""
        self.seen = end
        if self.begin >= 0:
            self.parts.append(bytes(self.held[self.begin - self.base : end - self.base]))
            self.weight, self.begin = self.weight + len(self.parts[-1]), -1
            if self.weight >= self.size:
                self._close()

    def _close(self) -> None:
        if self.n:
            bound = "".join(f' xmlns:{p}="urn:{i}"' for i, p in enumerate(sorted(self.prefixes - {None, "xml"})))
            self.ready.append((self.done, self.n, b"".join([f"<rows{bound}>".encode(), *self.parts, b"</rows>"])))
        self.done, self.n, self.weight, self.parts = self.done + self.n, 0, 0, []

    def rest(self, end: int | None = None) -> Iterator[tuple[int, int, bytes]]:
        """What is left at the end, or before place ``end``."""
        self._take(self.base + len(self.held) if end is None else end)
        self._close()
        yield from self.ready
        self.ready = []

    def feed(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """Take the next bytes; none at the end."""
        if not self.base and not self.held and (data[:2] in (b"\xff\xfe", b"\xfe\xff") or 0 in data[:2]):
            raise _Unlike
        self.held += data
        try:
            self.parser.Parse(data, not data)
        except expat.ExpatError as why:
            yield from self.rest(self.parser.ErrorByteIndex)
            raise ElementTree.ParseError(str(why)) from why
        yield from self.ready
        self.ready = []
        kept = self.begin if self.begin >= 0 else self.seen
        del self.held[: kept - self.base]
        self.base = kept


def _pieces(book: zipfile.ZipFile, member: str, size: int) -> Iterator[tuple[int, int, bytes]]:
    """A sheet's rows in pieces of about ``size`` bytes, those before an error as well."""
    cutter = _Cutter(size)
    try:
        with book.open(member) as stream:
            while True:
                try:
                    data = stream.read(_READ)
                except _BROKEN:
                    yield from cutter.rest()
                    raise
                yield from cutter.feed(data)
                if not data:
                    yield from cutter.rest()
                    return
    except _Unlike:  # known before the first row
        yield from _pieces_of_nodes(book, member, size)


def _pieces_of_nodes(book: zipfile.ZipFile, member: str, size: int) -> Iterator[tuple[int, int, bytes]]:
    """The same of any sheet, its rows read one by one and written out anew."""
    done, held, weight = 0, [], 0

    def piece():
        return done, len(held), b"".join([b"<rows>", *held, b"</rows>"])

    with book.open(member) as stream:
        try:
            for node in _ended(stream, "row"):
                node.tail = None
                held.append(ElementTree.tostring(node))
                weight += len(held[-1])
                if weight >= size:
                    yield piece()
                    done, held, weight = done + len(held), [], 0
        except _BROKEN:
            if held:
                yield piece()
            raise
    if held:
        yield piece()


def _row_nodes(piece: bytes) -> Iterator[ElementTree.Element]:
    """Rows that end in a piece; the last one of a broken sheet may lack its end."""
    try:
        for _, node in ElementTree.iterparse(io.BytesIO(piece)):
            if _plain(node.tag) == "row":
                yield node
                node.clear()
    except ElementTree.ParseError:
        return  # the sheet's error is told by the pass that cut it, and so is the number of rows


_VALUE = re.compile(rb"<(?:[^\s<>/:]+:)?v(?:\s[^<>]*)?>([^<]*)<")


def _used(piece: bytes, strings: list[str] | None) -> list[tuple[str, str]] | None:
    """Those shared strings that a piece may point to, by their indices as they are written."""
    if not strings:
        return None
    said = set(_VALUE.findall(piece))
    if b"<!" in piece or b"<?" in piece or any(b"&" in x for x in said):
        texts = {x.text or "" for row in _row_nodes(piece) for x in row.iter() if _plain(x.tag) == "v"}
    else:
        texts = {x.decode() for x in said}
    return [(x, found) for x in sorted(texts) if (found := _shared(strings, x))]


def _cells(node: ElementTree.Element, strings: dict[str, str]) -> list[str]:
    """Dense cells of a row; shared, inline and plain values as text."""
    cells: list[str] = []
    for i, cell in enumerate(x for x in node if _plain(x.tag) == "c"):
        at = column_index(cell.get("r")) if cell.get("r") else i
        kind, value = cell.get("t"), next((x.text or "" for x in cell if _plain(x.tag) == "v"), "")
        text = _text(cell) if kind == "inlineStr" else strings.get(value, "") if kind == "s" else value
        cells += [""] * (at + 1 - len(cells))
        cells[at] = text
    return cells


def _cut_books(size: int):
    text = pa.string()
    shape = pa.schema([("path", text), ("sheet", text), ("first", pa.int64()), ("n", pa.int64()), ("piece", pa.binary()), ("strings", pa.map_(text, text)), ("error", text)])

    def made(path, sheet, first=None, n=None, piece=None, strings=None, error=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"path": path, "sheet": sheet, "first": first, "n": n, "piece": piece, "strings": strings, "error": error}], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:  # one bad file must not end the job, nor one bad sheet its book
                    with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as book:
                        found, strings, loaded = sheets(book), None, False
                        for sheet, member in found:
                            try:
                                if not loaded:
                                    strings, loaded = _strings(book), True
                                for first, n, piece in _pieces(book, member, size):
                                    yield made(path, sheet, first, n, piece, _used(piece, strings))
                            except _BROKEN as why:
                                yield made(path, sheet, error=f"{type(why).__name__}: {why}")
                except _BROKEN as why:
                    yield made(path, None, error=f"{type(why).__name__}: {why}")

    return run


def _read_pieces(size: int):
    shape = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row_no", pa.int64()), ("cells", pa.list_(pa.string())), ("error", pa.string())])

    def made(path, sheet, numbers, cells, error=None) -> pa.RecordBatch:
        n = len(cells)
        return pa.RecordBatch.from_pydict({"path": [path] * n, "sheet": [sheet] * n, "row_no": numbers, "cells": cells, "error": [error] * n}, schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, sheet, first, n, piece, strings, error = (batch.column(j)[i].as_py() for j in range(7))
                if error:
                    yield made(path, sheet, [None], [None], error)
                    continue
                known = dict(strings or ())
                cells = [_cells(node, known) for node in itertools.islice(_row_nodes(piece), n)]
                if len(cells) < n:
                    raise RuntimeError(f"{len(cells)} of {n} rows in a piece of {path}, {sheet}")
                whole = made(path, sheet, range(first, first + n), cells)
                for at in range(0, n, size):
                    yield whole.slice(at, size)

    return run


def book_rows(files: DataFrame, batch: int = BATCH, piece: int = PIECE) -> DataFrame:
    """All rows of all sheets of workbooks (path, content). A file that can't be read is one
    row with its error; a sheet that breaks off keeps the rows before."""
    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = files.select("path", "content").mapInArrow(_cut_books(piece), _PIECE)
    return cut.repartition(tasks, "path", "sheet", "first").mapInArrow(_read_pieces(batch), ROW)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all sheets of the workbooks at a path or glob, on any file system."""
    return book_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path))


def import_report(cells: DataFrame, made: DataFrame, known: DataFrame) -> DataFrame:
    """By file: companies read, new ones among them (by normalised name), and its error."""
    fresh = made.select("path", T.company_key(F.col("name")).alias("name_norm")).distinct().join(known.select("name_norm").distinct().withColumn("__old", F.lit(True)), "name_norm", "left")
    counts = fresh.groupBy("path").agg(F.count(F.lit(1)).alias("n_read"), F.count_if(F.col("__old").isNull()).alias("n_new"))
    files = cells.groupBy("path").agg(F.max("error").alias("error"))
    return files.join(counts, "path", "left").select("path", F.coalesce("n_read", F.lit(0)).alias("n_read"), F.coalesce("n_new", F.lit(0)).alias("n_new"), "error")


# fixed values: header words of seed sheets by field
HEADERS = {
    "name": ("公司/单位名称", "招聘单位", "公司名称", "单位名称", "企业名称"),
    "company_nature": ("企业性质",),
    "industry": ("行业分类（来自企查查数据）", "行业分类", "行业"),
    "hint_apply_urls": ("网申/投递地址", "投递地址", "网申地址"),
    "source_url": ("公告原文链接", "招聘原文", "原文链接"),
    "official_site": ("官方网站", "官网"),
}


def seed_companies(cells: DataFrame, limit_per_sheet: int | None = None) -> DataFrame:
    """Company records of seed sheets.

    The header is the first of the first 15 rows with a name column; the sheets of notes
    and templates are left out, names under 2 characters and offer rows as well."""
    kept = cells.where(F.col("cells").isNotNull() & ~T.has_any(F.col("sheet"), V.SKIPPED_SHEET_WORDS))
    heading = F.transform("cells", lambda x: F.replace(F.replace(T.strip(x), F.lit("\n"), F.lit("")), F.lit(" "), F.lit("")))

    def found(field: str) -> Column:
        """Place of a heading's first word, equal or contained, from 1."""
        at = lambda w: F.get(F.filter(F.transform(heading, lambda x, i: F.when(F.contains(x, F.lit(w)), i + 1)), lambda i: i.isNotNull()), F.lit(0))
        return F.coalesce(*[at(w.replace(" ", "")) for w in HEADERS[field]]).alias(f"at_{field}")

    heads = kept.where("row_no < 15").select("path", "sheet", "row_no", *[found(f) for f in HEADERS]).where("at_name is not null")
    first = Window.partitionBy("path", "sheet").orderBy("row_no")
    head = heads.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n").withColumnRenamed("row_no", "head_no")
    body = kept.join(F.broadcast(head), ["path", "sheet"]).where("row_no > head_no")
    value = lambda f: F.when(F.col(f"at_{f}").isNotNull(), T.non_blank(F.get("cells", (F.col(f"at_{f}") - 1).cast("int"))))
    rows_ = body.select("path", "sheet", "row_no", value("name").alias("name"), T.clean_nature(value("company_nature")).alias("company_nature"), value("industry").alias("industry"), F.concat_ws(" ", *[value(f) for f in ("hint_apply_urls", "source_url", "official_site")]).alias("raw"))
    named = rows_.where((F.length("name") >= 2) & ~F.startswith(F.lower("name"), F.lit("offer")) & ~F.contains("name", F.lit("注意事项")))
    urls = F.filter(F.split(T.or_empty(F.col("raw")), r"[\s,;，；]+"), U.looks_like_url)
    made = named.withColumn("hint_apply_urls", U.preferred(urls)).withColumn("verify_status", F.when(F.exists("hint_apply_urls", U.is_trusted), "official").otherwise("unverified")).drop("raw")
    if limit_per_sheet is None:
        return made
    nth = Window.partitionBy("path", "sheet").orderBy("row_no")
    return made.withColumn("__n", F.row_number().over(nth)).where(F.col("__n") <= limit_per_sheet).drop("__n")
