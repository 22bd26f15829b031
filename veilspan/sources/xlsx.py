"""Workbooks (XLSX): the cells of their sheets as rows, and tables as workbooks, with the standard library's zip and XML.

A workbook is read in one task, and written from the rows of one key, both row by row: a worker holds the packed file and a piece of its rows, not its tree.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, islice
from operator import itemgetter
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Names of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS = 1_048_576
#: Rows that a worker holds at once.
PIECE = 2000


def _m(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def column_index(reference: str) -> int:
    """0 for A, 26 for AA, of a cell's reference."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def column_name(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def _text(element: ET.Element) -> str:
    """The text of a string item, without phonetic hints."""
    return "".join(t.text or "" for child in element for t in ([child] if child.tag == _m("t") else child.findall(_m("t")) if child.tag == _m("r") else ()))


def sheets(content: bytes) -> Iterator[tuple[str, list[list[str | None]]]]:
    """Name and rows of each sheet, in order; a cell is its text, whatever its type, and empty cells and rows keep their place."""
    for _, name, rows in _sheets(content):
        yield name, _placed(rows)


def _sheets(content: bytes) -> Iterator[tuple[int, str, Iterator[tuple[int, list[tuple[int | None, str | None]]]]]]:
    """Place and name of each sheet, with its rows as they come (see _rows); a sheet must be read before the next."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [_text(i) for i in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(_m("si"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        n = 0
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(_m("sheet")):
            target = targets.get(sheet.get(f"{{{LINKS}}}id"), "")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part in names:
                with z.open(part) as file:
                    yield n, sheet.get("name"), _rows(file, shared)
                n += 1


def _rows(file, shared: list[str]) -> Iterator[tuple[int, list[tuple[int | None, str | None]]]]:
    """The place of each row of a sheet as it is read, and its cells (column, if it is told; text); a row leaves the tree at its end."""
    above: list[ET.Element] = []
    size = 0
    for event, row in ET.iterparse(file, ["start", "end"]):
        if event == "start":
            above.append(row)
            continue
        above.pop()
        if row.tag != _m("row"):
            continue
        at = int(row.get("r", size + 1)) - 1
        size = max(size, at + 1)
        found: list[tuple[int | None, str | None]] = []
        for cell in row.findall(_m("c")):
            k = column_index(cell.get("r")) if cell.get("r") else None
            value, kind = cell.find(_m("v")), cell.get("t", "n")
            inline = cell.find(_m("is"))
            text = _text(inline) if inline is not None else value.text if value is not None else None
            if kind == "s" and text is not None:
                text = shared[int(text)]
            elif kind == "b" and text is not None:
                text = "TRUE" if text == "1" else "FALSE"
            elif kind == "n" and text is not None and re.fullmatch(r"-?[0-9]+\.0+", text):
                text = text.partition(".")[0]
            found.append((k, text))
        yield at, found
        if above:
            above[-1].clear()


def _put(row: list[str | None], found: list[tuple[int | None, str | None]]) -> list[str | None]:
    """The row with cells at their columns; one without a column comes behind the others."""
    for k, text in found:
        k = len(row) if k is None else k
        row += [None] * (k + 1 - len(row))
        row[k] = text
    return row


def _placed(rows: Iterator[tuple[int, list[tuple[int | None, str | None]]]]) -> list[list[str | None]]:
    out: list[list[str | None]] = []
    for at, found in rows:
        while len(out) <= at:
            out.append([])
        _put(out[at], found)
    return out


def _in_order(content: bytes) -> bool:
    """Whether the rows of each sheet come in order, each once; reads all, so a file with an error shows it here."""
    out = True
    for _, _, rows in _sheets(content):
        last = -1
        for at, _ in rows:
            out &= at > last
            last = max(at, last)
    return out


def _streamed(content: bytes) -> Iterator[tuple[int, str, int, list[str | None]]]:
    """sheet_no, sheet, row, cells of all rows of a workbook, gaps included."""
    if not _in_order(content):
        yield from ((n, name, i, row) for n, (name, table) in enumerate(sheets(content)) for i, row in enumerate(table))
        return
    for n, name, rows in _sheets(content):
        size = 0
        for at, found in rows:
            yield from ((n, name, i, []) for i in range(size, at))
            yield n, name, at, _put([], found)
            size = at + 1


def workbook(tables: dict[str, Iterable[list[object]]]) -> bytes:
    """A workbook with these sheets, whose rows are taken one by one; numbers stay numbers, all else is text."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(tables) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(tables, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(tables) + 1)) + "</Relationships>")
        for i, rows in enumerate(tables.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as file:
                for part in _sheet(rows):
                    file.write(part.encode())
    return out.getvalue()


def _sheet(rows: Iterable[list[object]]) -> Iterator[str]:
    yield f'<worksheet xmlns="{MAIN}"><sheetData>'
    for r, row in enumerate(rows, 1):
        if r > MOST_ROWS:
            raise ValueError(f"a sheet has {MOST_ROWS} rows at most")
        cells = "".join(_cell(f"{column_name(k)}{r}", v) for k, v in enumerate(row) if v is not None)
        yield f'<row r="{r}">{cells}</row>'
    yield "</sheetData></worksheet>"


def _cell(reference: str, value: object) -> str:
    if isinstance(value, int | float) and not isinstance(value, bool):
        return f'<c r="{reference}"><v>{value}</v></c>'
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value))  # XML has no such characters
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def cells(files: DataFrame) -> DataFrame:
    """doc_id, sheet_no, sheet, row, cells of all rows of workbooks (doc_id, content); a file that is no workbook has none."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for doc_id, content in zip(f["doc_id"], f["content"], strict=True):
                found = _streamed(content)
                try:  # all errors of a file show before its first row
                    while out := [(doc_id, *r) for r in islice(found, PIECE)]:
                        yield pd.DataFrame(out, columns=["doc_id", "sheet_no", "sheet", "row", "cells"]).astype({"row": "int32", "sheet_no": "int32"})
                except (zipfile.BadZipFile, KeyError, ET.ParseError):
                    continue

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(rows, "doc_id string, sheet_no int, sheet string, row int, cells array<string>")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """cells() of the workbooks below a path, which is their doc_id."""
    return cells(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select(F.col("path").alias("doc_id"), "content"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """table_of() of the workbooks below a path."""
    return table_of(read_cells(spark, path))


def table_of(rows: DataFrame) -> DataFrame:
    """The first sheets of workbooks (as cells() gives them) as one table of texts; the first row with any text names the columns.

    Each workbook's own names decide where its columns stand; a name that it lacks is null. Rows without any text are dropped.
    """
    rows = rows.where((F.col("sheet_no") == 0) & F.exists("cells", lambda c: F.coalesce(F.trim(c) != "", F.lit(False))))
    top = rows.groupBy("doc_id").agg(F.min("row").alias("_top"), F.min_by("cells", "row").alias("_names"))
    names = [r.name for r in top.select(F.posexplode("_names").alias("at", "name")).where("name is not null").groupBy("name").agg(F.min("at").alias("at")).orderBy("at", "name").collect()]
    rows = rows.join(top, "doc_id").where(F.col("row") > F.col("_top"))
    pick = lambda n: F.try_element_at(F.col("cells"), F.nullif(F.array_position("_names", n), F.lit(0)).cast("int")).alias(n)
    return rows.select("doc_id", "row", *map(pick, names)) if names else rows.select("doc_id", "row")


def workbooks(table: DataFrame, key: str, sheet: str, columns: dict[str, str], *order: str) -> DataFrame:
    """key, content: one workbook for each value of the key, with its rows in order and the columns under their written names."""
    kind = table.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("content", T.BinaryType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for i in range(0, b.num_rows, PIECE) for r in b.slice(i, PIECE).to_pylist())
        for k, group in groupby(rows, itemgetter(key)):  # the shuffle brings the rows of a key together, in order
            values = ([None if isinstance(r[c], float) and r[c] != r[c] else r[c] for c in columns] for r in group)
            content = workbook({sheet: chain([list(columns.values())], values)})
            yield pa.RecordBatch.from_arrays([pa.array([k], kinds.field(key).type), pa.array([content], pa.binary())], names=[key, "content"])

    kinds = to_arrow_schema(T.StructType([schema[key]]))
    rows = table.select(key, *dict.fromkeys(c for c in (*columns, *order) if c != key)).repartition(F.col(key))
    return rows.sortWithinPartitions(F.asc(key), *(F.asc_nulls_last(c) for c in order)).mapInArrow(write, schema)
