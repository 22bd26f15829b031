import io
import zipfile


from veilspan.sources import rules, tables, xlsx


def test_round_trip():
    rows = [["a", "b & <c>"], [1, None, 2.5], [], ["é\n x ", '"q"', True]]
    ((name, got),) = xlsx.sheets(xlsx.workbook({"Лист": rows}))
    assert name == "Лист" and got == [["a", "b & <c>"], ["1", None, "2.5"], [], ["é\n x ", '"q"', "True"]]
    assert [xlsx.column_index(xlsx.column_name(i) + "7") for i in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]


def test_shared_strings_and_gaps():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{xlsx.MAIN}" xmlns:r="{xlsx.LINKS}"><sheets><sheet name="s" sheetId="1" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{xlsx.PACKAGE}/relationships"><Relationship Id="x" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{xlsx.MAIN}"><si><t>one</t></si><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>no</t></rPh></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{xlsx.MAIN}"><sheetData><row r="2"><c r="B2" t="s"><v>1</v></c><c r="D2" t="b"><v>1</v></c></row><row r="4"><c r="A4"><v>12.0</v></c></row></sheetData></worksheet>')
    assert list(xlsx.sheets(out.getvalue())) == [("s", [[], [None, "two runs", None, "TRUE"], [], ["12"]])]


def test_replacement_workbooks(spark, tmp_path):
    table = spark.createDataFrame([(1, 2, "b", "u2", "p1"), (1, 1, "a", "u1", "p0"), (2, 1, "c", "u3", "p0")], "doc_id long, number int, original_value string, uuid string, block_id string")
    for r in tables.replacement_workbooks(table).collect():
        (tmp_path / f"{r.doc_id}.xlsx").write_bytes(r.content)
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    got = tables.read_replacements(spark, f"{tmp_path}/*.xlsx")
    assert sorted(map(tuple, got.collect())) == [("u1", "a"), ("u2", "b"), ("u3", "c")]
    first = xlsx.read_table(spark, f"{tmp_path}/1.xlsx").orderBy("row").collect()
    assert [r["№"] for r in first] == ["1", "2"]


def test_rules_of_a_workbook(spark, tmp_path):
    (tmp_path / "r.xlsx").write_bytes(xlsx.workbook({"r": [["Category", "Pattern", "Description", "Confidence"], ["INN", r"\d{10}", "number", 0.9], ["X", "", "none", 1], ["Y", "a,b", None, "high"]]}))
    got = rules.read_structured_workbook(spark, f"{tmp_path}/r.xlsx").orderBy("category").collect()
    assert [tuple(r) for r in got] == [("inn", r"\d{10}", "number", 0.9), ("y", "a,b", "", 0.5)]


def test_rows_are_read_and_written_one_by_one():
    taken = []
    book = xlsx.workbook({"s": (taken.append(i) or [i] for i in range(50_000))})
    assert len(taken) == 50_000
    import tracemalloc

    tracemalloc.start()
    assert sum(1 for _ in xlsx._streamed(book)) == 50_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000  # the tree of the sheet takes over 50 MB


def _book(*parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{xlsx.MAIN}" xmlns:r="{xlsx.LINKS}"><sheets>' + "".join(f'<sheet name="s{i}" sheetId="{i}" r:id="x{i}"/>' for i in range(len(parts))) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{xlsx.PACKAGE}/relationships">' + "".join(f'<Relationship Id="x{i}" Target="worksheets/{i}.xml"/>' for i in range(len(parts))) + "</Relationships>")
        for i, p in enumerate(parts):
            z.writestr(f"xl/worksheets/{i}.xml", f'<worksheet xmlns="{xlsx.MAIN}"><sheetData>{p}')
    return out.getvalue()


def test_gaps_disorder_and_broken_sheets(spark):
    end = "</sheetData></worksheet>"
    gaps = '<row r="2"><c r="B2"><v>1</v></c></row><row><c><v>2</v></c><c><v>3</v></c></row>' + end
    mixed = '<row r="3"><c r="A3"><v>1</v></c></row><row r="1"><c r="A1"><v>2</v></c></row><row r="3"><c><v>4</v></c></row>' + end
    broken = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 6000))
    files = spark.createDataFrame([("a", _book(gaps, mixed)), ("b", _book(gaps, broken)), ("c", _book(gaps))], "doc_id string, content binary")
    got = sorted((r.doc_id, r.sheet_no, r.row, r.cells) for r in xlsx.cells(files).collect())
    first = [(0, []), (1, [None, "1"]), (2, ["2", "3"])]
    assert got == [("a", 0, *r) for r in first] + [("a", 1, 0, ["2"]), ("a", 1, 1, []), ("a", 1, 2, ["1", "4"])] + [("c", 0, *r) for r in first]


def test_workbooks_keep_types_and_nulls(spark):
    rows = spark.createDataFrame([(1, 2, None, 0.5), (1, 1, 7, float("nan")), (None, 1, 8, 2.0), (2, None, 9, None)], "k long, o int, n long, x double")
    books = {r.k: list(xlsx.sheets(bytes(r.content)))[0][1] for r in xlsx.workbooks(rows, "k", "s", {"n": "n", "x": "x"}, "o").collect()}
    assert books == {1: [["n", "x"], ["7"], [None, "0.5"]], None: [["n", "x"], ["8", "2"]], 2: [["n", "x"], ["9"]]}
