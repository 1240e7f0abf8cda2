"""Sheets are cut between rows and their pieces dealt to tasks; rows and errors stay those of a plain parse."""

import io
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from millrace.functions import urls as U
from millrace.sources import xlsx
from tests.test_states import book, sheet

SHARED = '<sst xmlns="urn:m"><si><t>甲</t></si><si><r><t>b</t></r><r><t>c</t></r></si><si><t/></si></sst>'
PREFIXED = '<x:worksheet xmlns:x="urn:m" xmlns:y="urn:y"><x:sheetData>' + "".join(f'<x:row y:n="{i}"><x:c r="C{i}"><x:v>{i}</x:v></x:c></x:row>' for i in range(40)) + "</x:sheetData></x:worksheet>"
STRINGS = "<worksheet><sheetData>" + '<row a=">"/>'.join(f'<row><c t="s"><v>{v}</v></c><c><v>{v}</v></c></row >' for v in ("0", "1", "&#49;", "<![CDATA[1]]>", "2", "7", "", "-1", "9" * 30, "<!-- </row> -->0")) + "<!-- end --></sheetData></worksheet>"
NESTED = "<w><d>" + "<row><c><v>1</v></c><x><row><c><v>in</v></c></row></x></row>text" * 9 + "</d><e><row/></e></w>"
CASES = {
    "prefixed": PREFIXED, "strings": STRINGS, "nested": NESTED, "empty": "<w/>", "none": "",
    "entities": '<!DOCTYPE w [<!ENTITY e "x&lt;y">]><w>' + '<row><c t="inlineStr"><is><t>&e;</t></is></c></row>' * 9 + "</w>",
    "wide": '<?xml version="1.0" encoding="utf-16"?>' + sheet([["宽", str(i)] for i in range(9)]),
    "latin": '<?xml version="1.0" encoding="iso-8859-1"?>' + sheet([["\xe9", str(i)] for i in range(9)]),
    "cut": sheet([["a", str(i)] for i in range(2000)])[:-40], "cut in a tag": sheet([["a"], ["b"]])[:-25], "unbound": sheet([["a"], ["b"]]) + "<p:q/>", "after": "<w>" + sheet([["a"], ["b"]]) + "&no;<row/></w>",
    "nested cut": NESTED[: NESTED.index("</x>") + 2], "entities cut": '<!DOCTYPE w [<!ENTITY e "x">]><w>' + "<row><c><v>&e;</v></c></row>" * 3 + "<row>",
}


def encoded(name, text):
    return text.encode({"wide": "utf-16", "latin": "iso-8859-1"}.get(name, "utf-8"))


def plainly(data):
    """Rows and the error of a sheet by one parse of the whole."""
    strings, out = ["甲", "bc", ""], []
    try:
        for _, node in ElementTree.iterparse(io.BytesIO(data)):
            if node.tag.rpartition("}")[2] == "row":
                out.append(xlsx._cells(node, {str(i): x for i, x in enumerate(strings)}))
                node.clear()
    except ElementTree.ParseError as why:
        return out, f"ParseError: {why}"
    return out, None


@pytest.mark.parametrize("size", [1, 300, xlsx.PIECE])
def test_pieces_are_a_plain_parse(size):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", SHARED)
        for name, text in CASES.items():
            z.writestr(name, encoded(name, text))
    with zipfile.ZipFile(out) as z:
        strings = xlsx._strings(z)
        assert strings == ["甲", "bc", ""]
        for name, text in CASES.items():
            got, error, next_row = [], None, 0
            try:
                for first, n, piece in xlsx._pieces(z, name, size):
                    known = dict(xlsx._used(piece, strings))
                    rows = [xlsx._cells(x, known) for x in xlsx._row_nodes(piece)]
                    assert (first, n) == (next_row, len(rows))
                    got, next_row = got + rows, next_row + n
            except ElementTree.ParseError as why:
                error = f"ParseError: {why}"
            assert (got, error) == plainly(encoded(name, text)), name
    assert plainly(encoded("strings", STRINGS))[0][::2][:5] == [["甲", "0"], ["bc", "1"], ["bc", "1"], ["bc", "1"], ["", "2"]]


def test_a_piece_is_small_however_long_the_sheet():
    long = book({"s": sheet([[f"n{i}", "x" * 50] for i in range(20_000)])})
    with zipfile.ZipFile(io.BytesIO(long)) as z:
        pieces = [(n, len(piece)) for _, n, piece in xlsx._pieces(z, "xl/worksheets/s0.xml", 10_000)]
    assert sum(n for n, _ in pieces) == 20_000 and max(x for _, x in pieces) < 11_000


def test_rows_of_one_sheet_are_dealt_to_many_tasks(spark):
    many = [[f"n{i}", str(i)] for i in range(20_000)]
    files = spark.createDataFrame([("a", book({"s": sheet(many)}))], "path string, content binary")
    rows = xlsx.book_rows(files, piece=20_000).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["row_no"], r["cells"]) for r in rows) == list(enumerate(many))
    assert len({r["task"] for r in rows}) > 4


def test_a_single_address_is_not_scored(spark, monkeypatch):
    monkeypatch.setattr(U, "apply_score", lambda u: F.raise_error(F.concat(F.lit("scored "), u)).cast("int"))
    lists = [(1, ["https://a.com/x"]), (2, [" https://a.com/x", "https://a.com/x ", "", None]), (3, []), (4, None)]
    got = spark.createDataFrame(lists, "id int, urls array<string>").select("id", U.preferred(F.col("urls")).alias("best")).collect()
    assert {r["id"]: r["best"] for r in got} == {1: ["https://a.com/x"], 2: ["https://a.com/x"], 3: [], 4: None}


def test_trusted_hosts_are_looked_for_in_the_host_alone(spark):
    urls = ["https://x.mokahr.com/1", "HTTPS://ZHIYE.COM:80", "https://a.com/mokahr.com", "https://mokahrXcom/", "mokahr.com", "", None, " https://jobs.feishu.cn?a", "https://"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(U.is_trusted(F.col("u")).alias("t")).collect()
    assert [r["t"] for r in got] == [True, True, False, False, False, False, False, True, False]
