import io
import zipfile

import pytest

from veilspan.operators import extract
from veilspan.sources import docx
from veilspan.sources.rules import ASCII_RULES

NS = f'xmlns:w="{docx.W}" xmlns:r="{docx.R}"'


def p(*runs):
    return "<w:p>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in runs) + "</w:p>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"


def package(body, header="", footer=""):
    refs = '<w:sectPr><w:headerReference w:type="default" r:id="h"/><w:footerReference w:type="default" r:id="f"/></w:sectPr>'
    files = {
        "word/document.xml": f"<w:document {NS}><w:body>{body}{refs}</w:body></w:document>",
        "word/header1.xml": f"<w:hdr {NS}>{header}</w:hdr>",
        "word/footer1.xml": f"<w:ftr {NS}>{footer}</w:ftr>",
        "word/_rels/document.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="h" Target="header1.xml"/><Relationship Id="f" Target="footer1.xml"/></Relationships>',
        "docProps/core.xml": '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>a@b.com</dc:title><dc:creator></dc:creator></cp:coreProperties>',
        "docProps/custom.xml": f'<Properties xmlns="{docx.CUSTOM_NS}" xmlns:vt="x"><property name="Client"><vt:lpwstr>Acme &amp; co</vt:lpwstr></property></Properties>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


CONTENT = package(
    p("to a@b", ".com  and ", "c@d.org") + p("") + table([p("x@y.net"), p("")], [f"<w:tcPr><w:gridSpan w:val='2'/></w:tcPr>{p('one')}{p('two')}"]) + f"<w:sdt><w:sdtContent>{p('in a box')}</w:sdtContent></w:sdt>" + p("last"),
    header=p("head e@f.com") + table([p("cell")]),
    footer=f"<w:sdt><w:sdtContent>{p('foot')}</w:sdtContent></w:sdt>",
)


def test_blocks_in_order():
    got = [(b.block_id, b.normalized()[0]) for b in docx.Package(CONTENT).blocks()]
    assert got == [
        ("header_0_0", "head e@f.com"), ("header_table_0_0", "cell"), ("paragraph_0", "to a@b.com and c@d.org"), ("table_0_cell_0_0", "x@y.net"), ("table_0_cell_0_1", ""), ("table_0_cell_1_0", "one two"),
        ("sdt_0", "in a box"), ("paragraph_2", "last"), ("footer_sdt_0_0", "foot"),
    ]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docx")
    (folder / "a.docx").write_bytes(CONTENT)
    (folder / "bad.docx").write_bytes(b"no package")
    return docx.read_files(spark, str(folder))


def test_find_rewrite_restore(spark, files):
    blocks = docx.blocks(files)
    found = extract.scan(blocks, ASCII_RULES)
    assert {(r.block_id, r.original_value) for r in found.collect()} == {("header_0_0", "e@f.com"), ("paragraph_0", "a@b.com"), ("paragraph_0", "c@d.org"), ("table_0_cell_0_0", "x@y.net")}
    from veilspan.operators import rewrite

    marked = rewrite.with_uuid(found)
    good = files.where("doc_id like '%a.docx'")
    hidden = docx.rewritten(good, marked.withColumnRenamed("uuid", "text").select("doc_id", "block_id", "start", "end", "text"), highlight=True).cache()
    assert hidden.first().replaced == 4
    texts = [r.text for r in docx.blocks(hidden).collect()]
    assert not any("@" in t for t in texts)
    back = docx.restored(hidden.select("doc_id", "content"), marked.select("uuid", "original_value"))
    want = {b.block_id: b.normalized()[0] for b in docx.Package(CONTENT).blocks()}
    assert {r.block_id: r.text for r in docx.blocks(back).collect()} == want


def test_metadata(spark, files):
    assert {tuple(r)[1:] for r in docx.metadata(files).collect()} == {("core", "title", "a@b.com"), ("custom", "Client", "Acme & co")}
    path = files.where("doc_id like '%a.docx'").first().doc_id
    props = spark.createDataFrame([(path, "custom", "Client", "<id> & id")], "doc_id string, section string, property string, value string")
    spans = spark.createDataFrame([], "doc_id string, block_id string, start int, end int, text string")
    out = docx.rewritten(files.where("doc_id like '%a.docx'"), spans, props)
    assert ("custom", "Client", "<id> & id") in {tuple(r)[1:] for r in docx.metadata(out).collect()}
    assert docx.encoded(out).count() == 1


def test_span_over_runs_keeps_the_rest():
    pack = docx.Package(CONTENT)
    assert pack.replace([("paragraph_0", 3, 10, "X"), ("nowhere", 0, 1, "Y"), ("paragraph_2", 2, 99, "Z")]) == 1
    again = {b.block_id: b.normalized()[0] for b in docx.Package(pack.content()).blocks()}
    assert again["paragraph_0"] == "to X and c@d.org" and again["paragraph_2"] == "last"


def test_files_are_dealt_over_the_cores_and_leave_in_pieces(spark, tmp_path):
    from veilspan.plans import files

    spark.range(900).selectExpr("id AS c_custkey", "concat('n', id) AS c_name", "'S' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = files._files(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    import pandas as pd

    assert [len(p) for p in docx.pieces(pd.DataFrame({"a": range(2 * docx.PIECE + 1)}))] == [docx.PIECE, docx.PIECE, 1]
    assert docx.blocks(made).count() == 7200


def test_plain_text_of_blocks_and_prefixes_when_written():
    package_ = docx.Package(package(p("a \u00a0\u2003 b\x1c", "\u200bc"). replace("\x1c", "\u2028"), p("h"), p("f")))
    assert all(b.text() == b.normalized()[0] for b in package_.blocks())
    assert b"<w:document" in docx.Package(package_.content()).files["word/document.xml"]


def test_packages_are_read_as_zipfile_reads_them_and_written_alike():
    parts = {"word/document.xml": b"<a/>" * 200, "ж.xml": "ж".encode(), "empty": b""}
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        made = docx.packed(parts, method)
        assert made == docx.packed(parts, method)
        with zipfile.ZipFile(io.BytesIO(made)) as z:
            assert z.testzip() is None and {i.filename: z.read(i) for i in z.infolist()} == parts
        assert docx.unpacked(made) == parts
    plain = {n: c for n, c in parts.items() if n.isascii()}
    streamed = io.BytesIO()
    with zipfile.ZipFile(type("Pipe", (), {"write": streamed.write, "flush": streamed.flush})(), "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in plain.items():
            z.writestr(name, content)
        z.comment = b"a comment"
    good = docx.packed(plain)
    for odd in (streamed.getvalue(), b"before" + good, good):
        assert docx.unpacked(odd) == plain
    for bad in (b"", b"no package", good[:-1], good.replace(b"PK\x01\x02", b"PK\x01\x09")):
        with pytest.raises(zipfile.BadZipFile):
            docx.unpacked(bad)
    stored = docx.packed(plain, zipfile.ZIP_STORED)
    with pytest.raises(zipfile.BadZipFile):
        docx.unpacked(stored.replace(b"<a/>", b"<b/>", 1))


def test_only_changed_parts_are_written_anew():
    pack = docx.Package(CONTENT)
    assert pack.replace([("paragraph_0", 3, 10, "X")]) == 1
    again = docx.unpacked(pack.content())
    assert {n for n, c in pack.files.items() if again[n] != c} == {"word/document.xml"}


def test_rewritten_files_are_opened_once(spark, files, tmp_path):
    from veilspan.plans import files as plans

    got = {r.doc_id.rpartition("/")[2]: r for r in docx.opened(files.selectExpr("doc_id", "7 AS n", "content")).collect()}
    assert got["bad.docx"].blocks is None and got["bad.docx"].properties is None and got["bad.docx"].n == 7
    assert [tuple(b) for b in got["a.docx"].blocks] == [tuple(r)[1:] for r in docx.blocks(files).orderBy("block_seq").collect()]
    assert {tuple(p) for p in got["a.docx"].properties} == {tuple(r)[1:] for r in docx.metadata(files).collect()}
    spark.range(30).selectExpr("id AS c_custkey", "concat('n', id) AS c_name", "'S' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    plan = plans.q79(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert sum(line.lstrip(" :+-").startswith(("MapInArrow", "PythonMapInArrow", "MapInPandas")) for line in plan.splitlines()) == 3


def test_files_are_made_once_for_searching_and_restoring(spark, tmp_path):
    from veilspan.plans import files as plans

    spark.range(30).selectExpr("id AS c_custkey", "concat('n', id) AS c_name", "'S' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    out = plans.q80(spark, str(tmp_path))
    assert len(out.collect()) == 240
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("MapInArrow write(") == 2 and any("ReusedExchange" in line and "content" in line for line in final.splitlines())
